"""Incremental ingestion with Structured Streaming.

The same clean -> validate -> feature projection as the batch path, applied to
raw files as they land.  The per-category mean/std needed for the z-score is a
*static* table computed by the batch path (size-checked, then broadcast into a
stream-static join), so streaming state stays empty for the row features.
A report that is an aggregate over days (F5) keeps one small row of state a day, so it
needs no watermark and no late row is ever dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schema as S
from ..operators import cleaning
from ..operators.features import features
from ..sources.manifest import ManifestTable


def read_raw_stream(spark: SparkSession, path: str, fmt: str = "parquet", max_files_per_trigger: int = 64) -> DataFrame:
    schema = S.RAW_TYPED_SCHEMA if fmt == "parquet" else S.RAW_CSV_SCHEMA
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        reader = reader.option("header", "true")
    return reader.format(fmt).load(path)


def stream_features(raw_stream: DataFrame, stats: DataFrame, max_broadcast_rows: int = 100_000) -> DataFrame:
    """Row features for a raw stream; ``stats`` = ``features.category_stats`` of a batch."""
    return features(cleaning.validated(cleaning.clean(raw_stream)), max_broadcast_rows, stats)


def start_parquet_sink(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", trigger_once: bool = False):
    """Exactly-once Parquet sink; the checkpoint must live in shared storage on a cluster."""
    w = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint) \
        .outputMode(mode)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()


def start_report_sink(report: DataFrame, path: str, checkpoint: str, trigger_once: bool = False, keep: int = 3):
    """Keeps an aggregated report (such as ``transactions.daily_volume`` of a feature stream) up to date.

    Each trigger replaces the report's ``ManifestTable`` at ``path`` as a whole: a reader sees one trigger's
    rows or the next one's, and the files of all but the last ``keep`` are removed.
    """
    def replace(rows: DataFrame, n: int) -> None:
        table = ManifestTable(rows.sparkSession, path)
        table.replace(rows)
        table.vacuum(keep)

    w = report.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(replace)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
