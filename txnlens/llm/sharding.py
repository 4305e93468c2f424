"""Sharding: contiguous shards of near equal bytes, cut on a global prefix sum.

Documents are numbered in a written table and dealt into ranges of ``doc_id``, ties by text
checksum, size and number, so that rows without an id and repeated rows are split, too. Each range sums its bytes and rows; a running sum over
the ranges, one row each, gives every range its offset, and a running sum inside the
range every document its own. The total is cut at equal targets: a document belongs to
the shard that its middle byte falls into, so that shards are contiguous and none is off
its target by more than one document. Slots count up in the same order.

Size is the text's UTF-8 bytes (null: none) plus ``OVERHEAD``. The law that holds is ``bytes``:
sizes near equal. Equal texts are not kept together; a group of copies may be larger than
a shard. ``grown_shard`` belongs to another law and is null.

Results for odd input: null ids come first and are kept as null; repeated rows follow each
other; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnlens.llm import common

SHARDS = 40
OVERHEAD = 16


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for each row of ``docs``."""
    body = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(body) + OVERHEAD).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    # written: the numbers stay the same when a task runs again
    sized = common.keep(sized.withColumn("number", F.monotonically_increasing_id()), "sizes")
    order = ["doc_id", "text_crc32", "size", "number"]
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = common.keep(sized.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    whole = Window.partitionBy()
    offsets = totals.select(
        "part", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(whole).alias("total"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumn("upto", F.sum("size").over(inside)).withColumn("row", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    placed = placed.join(F.broadcast(offsets), "part")  # at most one row a range
    row = F.col("rows_before") + F.col("row") - 1
    cut = F.expr(f"(bytes_before + upto - size div 2 - 1) * {shards} div total").cast("int")
    placed = common.keep(placed.select("doc_id", "size", "text_crc32", cut.alias("shard"), row.alias("row")), "placed")
    starts = placed.groupBy("shard").agg(F.min("row").alias("start"))  # one row a shard
    return placed.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_byte_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))

