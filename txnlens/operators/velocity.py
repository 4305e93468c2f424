"""Card velocity (B5): count, spend and max of the same card's earlier
transactions in the open interval ``(ts - window, ts)``.

Time is cut into hours, and a card's hour is a group of its own, so a card that
holds a third of all rows is spread over its hours.  The interval falls into three
pieces, and all that a row needs of them lies in the group of its hour:

* its own hour's rows before it;
* the rows of one window earlier, which join the hour as copies moved ahead by the
  window, after it;
* the whole hours between, one row an hour that stands before all others.

So the first piece and the last are one running frame in time order, the second is a
running frame in reverse order, both linear in the group, and Spark spills a
long group to disk.  Three shuffles: the hours' sums, the sums over neighbouring hours
(one row an hour), and the rows themselves, which travel once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import epoch_micros

HOUR_US = 3_600_000_000


def _between(rows: DataFrame, hours: int) -> DataFrame:
    """Per card and hour with rows: sums over the ``hours - 1`` hours before it, as an event ahead of the hour's own."""
    per_hour = rows.groupBy("card_number", "_b").agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"), F.max("_x").alias("_x"))
    before = Window.partitionBy("card_number").orderBy("_b").rangeBetween(-(hours - 1), -1)
    sums = per_hour.select("card_number", "_b", (F.col("_b") * HOUR_US - 1).alias("_at"),
                           *[f(c).over(before).alias(c) for f, c in ((F.sum, "_n"), (F.sum, "_s"), (F.max, "_x"))])
    return sums.where(F.col("_n").isNotNull())


def card_velocity(v: DataFrame, hours: int = 24) -> DataFrame:
    """``txn_count_{hours}h``, ``spend_{hours}h`` and ``max_txn_{hours}h`` of the card's previous ``hours``, for each transaction."""
    hour = F.floor(F.col("_at") / HOUR_US).cast("long")
    rows = v.select("transaction_id", "card_number", "transaction_ts", "amount", epoch_micros(F.col("transaction_ts")).alias("_at"),
                    F.when(F.col("amount").isNotNull(), 1).otherwise(0).cast("long").alias("_n"),
                    (F.col("amount").cast("decimal(12,2)") * 100).cast("long").alias("_s"))  # cents: exact, and cheaper to sum than decimals
    rows = rows.withColumns({"_x": F.col("_s"), "_b": hour})
    earlier = rows.select("card_number", (F.col("_at") + hours * HOUR_US).alias("_at"), "_n", "_s", "_x").withColumn("_b", hour)
    events = rows.withColumn("_kind", F.lit(0)).unionByName(earlier.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    if hours > 1:  # no hour lies whole between the ends of a window of one
        events = events.unionByName(_between(rows, hours).withColumn("_kind", F.lit(2)), allowMissingColumns=True)

    group = Window.partitionBy("card_number", "_b")
    before = group.orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    after = group.orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, -1)
    old = F.col("_kind") == 1
    pieces = events.select(
        "transaction_id", "card_number", "transaction_ts", "amount", "_kind",
        *[f(F.when(~old, F.col(c))).over(before).alias(c + "1") for f, c in ((F.sum, "_n"), (F.sum, "_s"), (F.max, "_x"))],
        *[f(F.when(old, F.col(c))).over(after).alias(c + "2") for f, c in ((F.sum, "_n"), (F.sum, "_s"), (F.max, "_x"))])

    def money(cents):
        return (cents.cast("decimal(28,0)") / 100).cast("decimal(28,2)")

    both = {c: F.coalesce(F.col(c + "1"), F.lit(0)) + F.coalesce(F.col(c + "2"), F.lit(0)) for c in ("_n", "_s")}
    return pieces.where("_kind = 0").select(
        "transaction_id", "card_number", "transaction_ts", "amount",
        both["_n"].alias(f"txn_count_{hours}h"), money(both["_s"]).alias(f"spend_{hours}h"),
        F.coalesce(money(F.greatest("_x1", "_x2")), F.lit(0)).cast("decimal(12,2)").alias(f"max_txn_{hours}h"))
