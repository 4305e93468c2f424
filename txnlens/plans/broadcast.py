"""Joins against small sides whose size is *checked* before broadcasting.

A small side (per-category statistics) is written once to the session's shared folder, its
rows are counted there, and only then is it broadcast.  Nothing stays cached, and a lost
executor reads the written table again.  If it is larger than the bound, the join falls
back to a shuffle join that AQE may still convert at runtime.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import shared_dir, write_table

DEFAULT_MAX_BROADCAST_ROWS = 100_000


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """``big.join(small)`` broadcasting ``small`` only when its measured size is bounded."""
    spark = small.sparkSession
    path = shared_dir(spark, "small")
    write_table(small, path)
    small = spark.read.schema(small.schema).parquet(path)
    return big.join(F.broadcast(small) if small.count() <= max_rows else small, on, how)
