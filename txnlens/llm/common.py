"""Pieces that several corpus operators share.

Rows are addressed by ``did`` (``doc_id``, nulls as the smallest BIGINT) and ``crc`` (the first
16 bytes of the text's SHA-256), so that repeated rows, rows that share an id and rows
without one keep their own results; rows equal in both have the same text and are
interchangeable.
"""

from __future__ import annotations

import gc
import re
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlens.sources.sinks import shared_dir

NO_ID = -(1 << 63)


#: Bytes of an Arrow batch: what a Python worker holds of its input at a time, but for one longer row.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lets Spark cut the batches it sends to Python at ``BATCH_BYTES``; a smaller limit of the session stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.match(r"(\d+)([kmgt]?)", spark.conf.get(name).lower()).groups()
    if int(number) * {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}[unit] > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the cluster's shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files behind tables already written.

    They go when the driver's JVM collects the plans that made them, which a small driver
    may not do for long; an operator with several shuffles over the corpus asks for it
    between its steps, so that disk holds one step at a time.
    """
    for _ in range(2):  # what the first round frees lets go of more
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def keyed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``did, crc, text`` of a table of documents; other columns are left behind. A null text is empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(_did(doc_id).alias("did"), _checksum(body).alias("crc"), body.alias("text"))


def once(rows: DataFrame) -> DataFrame:
    """One of all rows that are equal in ``did`` and ``crc``, as ``did, crc, text``."""
    return rows.groupBy("did", "crc").agg(F.first("text").alias("text"))


def _did(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))


def _checksum(body: Column) -> Column:
    return F.substring(F.unhex(F.sha2(body, 256)), 1, 16)


def doc_id() -> Column:
    return F.nullif(F.col("did"), F.lit(NO_ID)).alias("doc_id")


def addressed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__did`` and ``__crc``, the address of each row."""
    return docs.withColumns({"__did": _did("doc_id"), "__crc": _checksum(F.coalesce(F.col("text"), F.lit("")))})


def small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """``df``, to be broadcast if it has no more than ``rows`` rows; beyond that Spark joins as it sees fit."""
    return F.broadcast(df) if df.count() <= rows else df


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and the offsets of its values (nulls are empty)."""
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    if column.null_count:
        column = pc.fill_null(column, b"" if kind == pa.large_binary() else "")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def passes(offsets: np.ndarray, limit: int, overlap: int) -> Iterator[tuple[int, int, int, int]]:
    """``first, last, lo, hi``: bytes of whole documents, or overlapping slices of one beyond ``limit``."""
    i, n = 0, len(offsets) - 1
    while i < n:
        if offsets[i + 1] - offsets[i] > limit:
            lo, end = int(offsets[i]), int(offsets[i + 1])
            while True:
                hi = min(lo + limit, end)
                yield i, i + 1, lo, hi
                if hi == end:
                    break
                lo = hi - overlap
            i += 1
        else:
            j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
            yield i, j, int(offsets[i]), int(offsets[j])
            i = j


#: Bytes that separate words: space and the ASCII controls tab to carriage return.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the document it lies in; words never cross documents."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~separator[data]
    starts = inside[1:-1] & ~inside[:-2]
    ends = np.zeros(len(data) + 1, dtype=bool)
    ends[1:] = inside[1:-1] & ~inside[2:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    cut = cut[inside[cut] & inside[cut + 1]]
    starts[cut] = True
    ends[cut] = True
    start, end = np.flatnonzero(starts), np.flatnonzero(ends)
    return start, end, np.searchsorted(offsets, start, "right") - 1


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, so that what is made of them stays small."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def flatten(table: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    """Columns without nulls as numpy arrays."""
    return [table.column(n).to_numpy(zero_copy_only=False) for n in names]


def held_out(parts: int, reserved: int, doc_id: str = "doc_id") -> Column:
    """Whether the CRC-32 of a document's id, as text, leaves the remainder ``reserved`` of ``parts``."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == reserved, F.lit(False))
