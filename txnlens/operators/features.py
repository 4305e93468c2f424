"""Feature engineering over the validated view (B1–B4, B6–B8).

``features`` is the 34-column table every report reads.  It is one projection
plus one join against per-category statistics (bounded by the number of
categories, measured before it is broadcast) — not three self-joins on the row
key, which would shuffle the whole table three more times and fan out
duplicate ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import semantics as X
from ..plans.broadcast import join_small
from ..sources.sinks import written_once
from .percentile import exact_percentiles



def _age(df_col_dob="date_of_birth", df_col_date="transaction_date"):
    return X.year_diff(F.col(df_col_dob).cast("date"), F.col(df_col_date))


def age_features(v: DataFrame) -> DataFrame:
    age = _age()
    return v.select("transaction_id", "card_number", "date_of_birth", "transaction_date",
                    age.alias("customer_age"), X.age_group(age).alias("age_group"))


def _dow():
    return F.dayofweek("transaction_date")


def time_features(v: DataFrame) -> DataFrame:
    h = F.col("transaction_hour")
    return v.select(
        "transaction_id", "transaction_ts", "transaction_hour",
        _dow().alias("day_of_week"),
        X.day_name("transaction_date").alias("day_name"),
        X.flag(_dow().isin(*S.WEEKEND_DAYS)).alias("is_weekend"),
        X.time_of_day(h).alias("time_of_day"),
        X.flag(h.between(*S.LATE_NIGHT_HOURS)).alias("is_late_night"))


def _km():
    return X.geo_distance_km()


def geo_features(v: DataFrame) -> DataFrame:
    km = _km()
    return v.select(
        "transaction_id", "customer_lat", "customer_long", "merchant_lat", "merchant_long",
        X.geo_distance_deg().alias("geo_distance_deg"),
        km.alias("geo_distance_km"),
        X.flag(km > S.FAR_FROM_HOME_KM).alias("is_far_from_home"))


def amount_features(v: DataFrame, max_broadcast_rows: int = 100_000) -> DataFrame:
    """Per-row z-score against the category mean/std, p95 flag and log-scale bucket."""
    # The workload also computes a per-category median that no output uses; only p95 is needed.
    # The statistics are broadcast only behind a check of their size.
    # The percentiles scan their rows three times, so category and amount are written once.
    rows = written_once(v.filter(F.col("category").isNotNull()).select("category", "amount"), "category-amounts")
    stats = exact_percentiles(rows, ["category"], "amount",
                              {"cat_p95_amount": 0.95},
                              extra_aggs={"cat_avg_amount": F.avg("amount"),
                                          "cat_std_amount": F.stddev_samp("amount")})
    a = F.col("amount")
    return (join_small(v.select("transaction_id", "amount", "category"), stats, "category", max_rows=max_broadcast_rows)
            .select("transaction_id", "amount", "category", "cat_avg_amount", "cat_std_amount",
                    ((a - F.col("cat_avg_amount")) / F.nullif(F.col("cat_std_amount"), F.lit(0.0))).alias("amount_z_score"),
                    X.flag(a > F.col("cat_p95_amount")).alias("is_high_amount"),
                    X.label_chain(a, S.AMOUNT_FEATURE_BUCKETS, S.AMOUNT_FEATURE_ELSE).alias("amount_bucket")))


def city_tier_features(v: DataFrame) -> DataFrame:
    return v.select("transaction_id", "city", "state", "city_pop", X.city_tier("city_pop").alias("city_tier"))


def merchant_loyalty(v: DataFrame) -> DataFrame:
    """Repeat use per card x merchant."""
    n = X.n_rows()
    return (v.groupBy("card_number", "merchant_name")
            .agg(n.alias("visit_count"), F.sum("amount").alias("total_spend"),
                 F.min("transaction_ts").alias("first_visit"), F.max("transaction_ts").alias("last_visit"))
            .withColumn("is_repeat_merchant", X.flag(F.col("visit_count") > 1))
            .orderBy(F.desc("visit_count"), "card_number", "merchant_name"))


def category_stats(v: DataFrame) -> DataFrame:
    """Mean and standard deviation of the amount per category, one row each."""
    return v.groupBy("category").agg(F.avg("amount").alias("_cat_avg"), F.stddev_samp("amount").alias("_cat_std"))


def row_features(v: DataFrame) -> DataFrame:
    """Validated rows with a category and all features that a row has by itself (all but the z-score)."""
    rows = v.where(F.col("category").isNotNull()).select(
        "*", _age().alias("customer_age"), _dow().alias("day_of_week"),
        X.flag(_dow().isin(*S.WEEKEND_DAYS)).alias("is_weekend"),
        X.flag(F.col("transaction_hour").between(*S.LATE_NIGHT_HOURS)).alias("is_late_night"),
        _km().alias("geo_distance_km"))
    return rows.select("*", X.flag(F.col("geo_distance_km") > S.FAR_FROM_HOME_KM).alias("is_far_from_home"), X.city_tier("city_pop").alias("city_tier"))


def features(v: DataFrame, max_broadcast_rows: int = 100_000, stats: DataFrame | None = None) -> DataFrame:
    """The wide feature table: validated columns + 8 features (NULL category dropped).

    ``stats`` are those of ``v`` unless given (a stream takes them from a batch).
    """
    stats = category_stats(v) if stats is None else stats
    joined = join_small(row_features(v), stats, "category", "inner", max_broadcast_rows)
    return joined.select(
        *v.columns, "customer_age", "day_of_week", "is_weekend", "is_late_night", "geo_distance_km", "is_far_from_home",
        ((F.col("amount") - F.col("_cat_avg")) / F.nullif(F.col("_cat_std"), F.lit(0.0))).alias("amount_z_score"),
        "city_tier")
