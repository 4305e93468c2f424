"""Transaction-level reports (F1–F12) and the README's time-of-day / weekday rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import semantics as X
from ..functions.semantics import epoch_micros
from ..sources.sinks import written_once
from .percentile import exact_percentiles


def amount_distribution(f: DataFrame) -> DataFrame:
    """Amount distribution by label; percentiles are exact, taken over integer cents.

    The percentiles scan their rows three times, so label and amount are written once.
    """
    fraud_label, legit_label = S.FRAUD_LABELS
    probs = {"_p25": 0.25, "_p50": 0.5, "_p75": 0.75, "_p95": 0.95}
    stats = exact_percentiles(
        written_once(f.select("is_fraud", "amount"), "amounts"), ["is_fraud"], F.col("amount") * 100, probs,
        extra_aggs={"txn_count": X.n_rows(), "avg_amount": X.money_avg("amount"),
                    "min_amount": F.round(F.min("amount"), 2), "max_amount": F.round(F.max("amount"), 2),
                    "std_amount": F.round(F.stddev_samp("amount"), 2)})
    cents = {name: F.round(F.col(name), 0) / 100 for name in probs}
    return stats.select("is_fraud",
                        F.when(F.col("is_fraud") == 1, fraud_label).otherwise(legit_label).alias("label"),
                        "txn_count", "avg_amount", "min_amount", "max_amount",
                        cents["_p25"].alias("p25_amount"), cents["_p50"].alias("median_amount"),
                        cents["_p75"].alias("p75_amount"), cents["_p95"].alias("p95_amount"), "std_amount")


def amount_histogram(f: DataFrame) -> DataFrame:
    bucket = X.label_chain(F.col("amount"), S.AMOUNT_HISTOGRAM, S.AMOUNT_HISTOGRAM_ELSE)
    return (f.groupBy(bucket.alias("amount_bucket"))
            .agg(X.n_rows().alias("total_txns"), X.fraud_count().alias("fraud_count"),
                 X.fraud_rate().alias("fraud_rate_pct"), X.money_sum("amount").alias("total_value"))
            .orderBy("amount_bucket"))


def extreme_z(f: DataFrame, threshold: float = S.Z_ANOMALY) -> DataFrame:
    """Rows whose amount z-score exceeds ``threshold`` in absolute value (no label filter)."""
    return (f.filter(F.abs("amount_z_score") > threshold)
            .select("transaction_id", "transaction_ts", "card_number", "full_name", "merchant_name", "category",
                    "amount", F.round("amount_z_score", 2).alias("amount_z_score"), "geo_distance_km",
                    "is_late_night", "is_far_from_home", "is_fraud")
            .orderBy(F.desc("amount_z_score"), "transaction_id"))


def category_amount_tier(f: DataFrame) -> DataFrame:
    tier = X.label_chain(F.col("amount"), S.AMOUNT_TIERS, S.AMOUNT_TIER_ELSE)
    return (f.groupBy("category", tier.alias("amount_tier"))
            .agg(X.n_rows().alias("total_txns"), X.fraud_count().alias("fraud_count"),
                 X.fraud_rate().alias("fraud_rate_pct"))
            .orderBy("category", "amount_tier"))


def daily_volume(f: DataFrame) -> DataFrame:
    return (f.groupBy("transaction_date")
            .agg(X.n_rows().alias("total_txns"), X.fraud_count().alias("fraud_count"),
                 X.fraud_rate().alias("fraud_rate_pct"), X.money_sum("amount").alias("total_value"),
                 X.money_sum(X.fraud_amount()).alias("fraud_value"))
            .orderBy("transaction_date"))


def rolling_fraud_rate(f: DataFrame, days: int = 7) -> DataFrame:
    """Mean of the unrounded daily rate over the last ``days`` *rows* (dates present).

    The window runs over the daily aggregate (one row per date), so its single
    partition holds at most a few thousand rows whatever the data size.
    """
    daily = f.groupBy("transaction_date").agg(X.n_rows().alias("total_txns"), X.fraud_count().alias("fraud_count"))
    raw_rate = F.col("fraud_count") * X.hundred() / F.col("total_txns")
    w = Window.orderBy("transaction_date").rowsBetween(-(days - 1), 0)
    return (daily.select("transaction_date", "total_txns", "fraud_count",
                         F.round(raw_rate, 4).alias("daily_fraud_rate_pct"),
                         F.round(F.avg(raw_rate).over(w), 4).alias("fraud_rate_7d_avg"))
            .orderBy("transaction_date"))


def day_hour_heatmap(f: DataFrame) -> DataFrame:
    return (f.groupBy(X.day_name("transaction_date").alias("day_name"), "day_of_week", "transaction_hour")
            .agg(X.n_rows().alias("total_txns"), X.fraud_count().alias("fraud_count"),
                 X.fraud_rate().alias("fraud_rate_pct"))
            .orderBy("day_of_week", "transaction_hour"))


def merchant_summary(f: DataFrame) -> DataFrame:
    return (f.groupBy("merchant_name", "category")
            .agg(X.n_rows().alias("total_txns"), F.count_distinct("card_number").alias("unique_customers"),
                 X.fraud_count().alias("fraud_count"), X.fraud_rate().alias("fraud_rate_pct"),
                 X.money_sum("amount").alias("total_revenue"), X.money_avg("amount").alias("avg_transaction"),
                 X.money_sum(X.fraud_amount()).alias("fraud_value"),
                 F.round(F.avg("geo_distance_km"), 1).alias("avg_customer_distance_km"))
            .orderBy(F.desc("fraud_rate_pct"), "merchant_name", "category"))


#: Rows on one side of a rapid-fire tile, about.
TILE_ROWS = 4096


def rapid_fire_tiles(f: DataFrame, minutes: int = 5, tile_rows: int = TILE_ROWS) -> tuple[DataFrame, DataFrame]:
    """The two sides of the rapid-fire join, dealt into tiles.

    Buckets are ``minutes`` wide, so a partner of t1 lies in t1's bucket or the next: t1 goes
    to both (``_jb``), t2 to its own.  A bucket's t2 rows are cut into parts of about
    ``tile_rows`` by a hash of their ids, and so are the t1 rows that come to it; a tile is one
    part against one part, and a row goes to every tile of its part.  Every pair meets in
    exactly one tile, and no tile grows with a burst.  Only counts of busy buckets are
    joined to the rows: none at all without bursts.
    """
    span = minutes * 60_000_000
    cols = ["card_number", "transaction_id", "transaction_ts", "amount", "merchant_name", "is_fraud", "full_name"]
    base = f.select(*cols, epoch_micros(F.col("transaction_ts")).alias("_m"))
    base = base.withColumn("_b", F.floor(F.col("_m") / F.lit(span)).cast("long"))
    busy = base.groupBy("card_number", "_b").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > tile_rows // 2)
    # a bucket's own count, the one before it and the one after it, on one row
    near = busy.select("card_number", "_n", F.posexplode(F.array(F.col("_b") + 1, F.col("_b"), F.col("_b") - 1)).alias("_at", "_b"))
    near = near.groupBy("card_number", "_b").agg(*[F.coalesce(F.max(F.when(F.col("_at") == k, F.col("_n"))), F.lit(0)).alias(name)
                                                   for k, name in enumerate(("_before", "_own", "_after"))])
    rows = base.join(near, ["card_number", "_b"], "left")

    def parts(*counts: str) -> Column:
        total = sum((F.coalesce(F.col(c), F.lit(0)) for c in counts[1:]), F.coalesce(F.col(counts[0]), F.lit(0)))
        return F.greatest(F.lit(1), F.ceil(total / tile_rows)).cast("int")

    def tile(bucket: Column, theirs: Column, mine: Column) -> Column:
        return F.struct(bucket.alias("_jb"), theirs.alias("_l"), mine.alias("_r"))

    own = tile(F.col("_b"), parts("_before", "_own"), parts("_own"))
    following = tile(F.col("_b") + 1, parts("_own", "_after"), parts("_after"))
    place = F.xxhash64("transaction_id")
    left = rows.select(*cols, "_m", F.inline(F.array(own, following)))
    left = left.select(*cols, "_m", "_jb", F.pmod(place, F.col("_l")).cast("int").alias("_i"), F.explode(F.sequence(F.lit(0), F.col("_r") - 1)).alias("_j"))
    right = rows.select(*cols[:-1], "_m", F.inline(F.array(own)))
    right = right.select(*cols[:-1], "_m", "_jb", F.explode(F.sequence(F.lit(0), F.col("_l") - 1)).alias("_i"), F.pmod(place, F.col("_r")).cast("int").alias("_j"))
    return left, right


def rapid_fire(f: DataFrame, minutes: int = 5, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Pairs of one card's transactions with ``t1 < t2 <= t1 + minutes``: an interval self-join as an equi-join on tiles."""
    span = minutes * 60_000_000
    left, right = rapid_fire_tiles(f, minutes, tile_rows)
    left = left.select(*[F.col(c).alias("l_" + c) for c in left.columns])
    right = right.select(*[F.col(c).alias("r_" + c) for c in right.columns])
    cond = ((F.col("r__m") > F.col("l__m")) & (F.col("r__m") <= F.col("l__m") + F.lit(span))
            & (F.col("r_transaction_id") != F.col("l_transaction_id")))
    for c in ("card_number", "_jb", "_i", "_j"):
        cond = (F.col("l_" + c) == F.col("r_" + c)) & cond
    return (left.join(right, cond, "inner")
            .select(F.col("l_card_number").alias("card_number"), F.col("l_full_name").alias("full_name"),
                    F.col("l_transaction_id").alias("txn_1_id"), F.col("r_transaction_id").alias("txn_2_id"),
                    F.col("l_transaction_ts").alias("txn_1_time"), F.col("r_transaction_ts").alias("txn_2_time"),
                    F.timestamp_diff("SECOND", F.col("l_transaction_ts"), F.col("r_transaction_ts")).alias("seconds_apart"),
                    F.col("l_amount").alias("txn_1_amount"), F.col("r_amount").alias("txn_2_amount"),
                    F.col("l_merchant_name").alias("txn_1_merchant"), F.col("r_merchant_name").alias("txn_2_merchant"),
                    F.col("l_is_fraud").alias("txn_1_fraud"), F.col("r_is_fraud").alias("txn_2_fraud"))
            .orderBy("card_number", "txn_1_time", "txn_2_time", "txn_1_id", "txn_2_id"))


def top_fraud_transactions(f: DataFrame, n: int = 50) -> DataFrame:
    """Frauds ranked by amount: top-n first (TakeOrdered), then row_number over n rows."""
    top = (f.filter(F.col("is_fraud") == 1)
           .select("transaction_id", "transaction_ts", "card_number", "full_name", "merchant_name", "category",
                   F.round("amount", 2).alias("amount"), "state",
                   F.round("geo_distance_km", 1).alias("distance_km"), "is_late_night",
                   F.round("amount_z_score", 2).alias("amount_z_score"))
           .orderBy(F.desc("amount"), "transaction_id").limit(n))
    rank = F.row_number().over(Window.orderBy(F.desc("amount"), "transaction_id"))
    return top.select(rank.alias("rank"), *top.columns).orderBy("rank")


def cumulative_fraud(f: DataFrame) -> DataFrame:
    daily = f.groupBy("transaction_date").agg(X.money_sum(X.fraud_amount()).alias("daily_fraud_value"),
                                              X.fraud_count().alias("daily_fraud_count"))
    w = Window.orderBy("transaction_date").rowsBetween(Window.unboundedPreceding, 0)
    return (daily.select("transaction_date", "daily_fraud_value", "daily_fraud_count",
                         F.round(F.sum("daily_fraud_value").over(w), 2).alias("cumulative_fraud_value"),
                         F.sum("daily_fraud_count").over(w).alias("cumulative_fraud_count"))
            .orderBy("transaction_date"))


def multi_factor_anomalies(f: DataFrame, min_flags: int = 3) -> DataFrame:
    flags = (X.flag(F.abs("amount_z_score") > S.Z_ANOMALY) + F.col("is_late_night") + F.col("is_far_from_home")
             + X.flag(F.col("is_weekend") == 1))
    return (f.withColumn("anomaly_flag_count", flags)
            .filter(F.col("anomaly_flag_count") >= min_flags)
            .select("transaction_id", "transaction_ts", "card_number", "full_name", "merchant_name", "category",
                    F.round("amount", 2).alias("amount"), F.round("amount_z_score", 2).alias("amount_z_score"),
                    F.round("geo_distance_km", 1).alias("distance_km"), "is_late_night", "is_far_from_home",
                    "is_fraud", "anomaly_flag_count")
            .orderBy(F.desc("anomaly_flag_count"), F.desc("amount"), "transaction_id"))


# README rollups (time of day, day of week) over the B2 labels.

def fraud_by_time_of_day(f: DataFrame) -> DataFrame:
    return (f.groupBy(X.time_of_day("transaction_hour").alias("time_of_day"))
            .agg(X.n_rows().alias("total_txns"), X.fraud_count().alias("fraud_count"),
                 X.fraud_rate().alias("fraud_rate_pct"),
                 X.money_avg(X.fraud_amount()).alias("avg_fraud_amount"),
                 F.min("transaction_hour").alias("_h"))
            .orderBy("_h").drop("_h"))


def fraud_by_day_of_week(f: DataFrame) -> DataFrame:
    return (f.groupBy("day_of_week", X.day_name("transaction_date").alias("day_name"))
            .agg(X.n_rows().alias("total_txns"), X.fraud_count().alias("fraud_count"),
                 X.fraud_rate().alias("fraud_rate_pct"),
                 X.money_avg(X.fraud_amount()).alias("avg_fraud_amount"))
            .orderBy("day_of_week"))
