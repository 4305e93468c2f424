"""Sinks: materialised tables (CTAS equivalent) and temp views."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, partition_by=None, mode: str = "overwrite",
                max_rows_per_file: int | None = None) -> None:
    """CREATE TABLE AS SELECT -> Parquet files (optionally partitioned for pruning).

    ``max_rows_per_file`` bounds file size without a shuffle (each write task
    rolls over to a new file), which also bounds the scan split of later readers.
    """
    w = df.write.mode(mode)
    if max_rows_per_file:
        w = w.option("maxRecordsPerFile", int(max_rows_per_file))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def written_once(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the session's shared folder and read back: several scans of it derive its rows once."""
    path = shared_dir(df.sparkSession, name)
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_as_table(df: DataFrame, name: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).saveAsTable(name)


def create_view(df: DataFrame, name: str) -> DataFrame:
    """CREATE OR REPLACE VIEW -> session temp view."""
    df.createOrReplaceTempView(name)
    return df


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.split("[")[0] == "local"


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A fresh folder under the cluster's shared ``spark.checkpoint.dir``.

    The setting is read from the session.  Only a ``local[...]`` session (tests,
    a laptop) may fall back to a new temporary folder; on a cluster a
    machine-local folder would be invisible to executors, so an unset setting
    is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...) for this cluster")
        import tempfile

        base = tempfile.mkdtemp(prefix="txnlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", base)
    return "/".join([base.rstrip("/"), *parts, uuid.uuid4().hex])


__all__ = ["write_table", "written_once", "save_as_table", "create_view", "shared_dir"]
