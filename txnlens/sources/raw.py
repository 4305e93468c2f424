"""Raw transaction sources: CSV (text columns, explicit schema) and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import RAW_CSV_SCHEMA, RAW_TYPED_SCHEMA


def read_raw_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Read raw CSV with every column as string; ``clean`` applies the casts.

    No schema inference: inference would turn ``zip`` into an integer and
    silently NULL malformed numbers.  Files are split by Spark into
    ``spark.sql.files.maxPartitionBytes`` chunks, so the scan parallelises
    over any number of executors.
    """
    return (spark.read.schema(RAW_CSV_SCHEMA)
            .option("header", str(header).lower())
            .option("mode", "PERMISSIVE")
            .csv(path))


def read_raw_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Read typed raw Parquet; column pruning and filter pushdown reach the scan."""
    return spark.read.schema(RAW_TYPED_SCHEMA).parquet(path)
