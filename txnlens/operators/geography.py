"""Geographic reports (E1–E9)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import semantics as X
from ..sources.sinks import written_once
from .percentile import exact_percentiles



def fraud_by_state(f: DataFrame) -> DataFrame:
    return (f.groupBy("state")
            .agg(X.n_rows().alias("total_transactions"), X.fraud_count().alias("fraud_count"),
                 X.fraud_rate().alias("fraud_rate_pct"),
                 X.money_sum("amount").alias("total_value"),
                 X.money_sum(X.fraud_amount()).alias("fraud_value"),
                 X.money_avg(X.fraud_amount()).alias("avg_fraud_amount"),
                 F.count_distinct("card_number").alias("unique_cards"),
                 F.count_distinct("merchant_name").alias("unique_merchants"))
            .orderBy(F.desc("fraud_rate_pct"), "state"))


def top_fraud_cities(f: DataFrame, n: int = 20) -> DataFrame:
    keys = ["city", "state", "city_pop", "city_tier"]
    return (f.groupBy(*keys)
            .agg(X.n_rows().alias("total_transactions"), X.fraud_count().alias("fraud_count"),
                 X.fraud_rate().alias("fraud_rate_pct"),
                 X.money_sum(X.fraud_amount()).alias("total_fraud_value"))
            .orderBy(F.desc("fraud_count"), *keys)
            .limit(n))


def tier_profile(f: DataFrame) -> DataFrame:
    return (f.groupBy("city_tier")
            .agg(F.count_distinct("city").alias("city_count"),
                 X.n_rows().alias("total_transactions"), X.fraud_count().alias("fraud_count"),
                 X.fraud_rate().alias("fraud_rate_pct"),
                 F.round(F.avg("city_pop"), 0).alias("avg_city_pop"),
                 X.money_avg(X.fraud_amount()).alias("avg_fraud_amount"))
            .orderBy(X.city_tier_rank("city_tier")))


def fraud_by_distance_band(f: DataFrame) -> DataFrame:
    return (f.groupBy(X.distance_band("geo_distance_km").alias("distance_band"))
            .agg(X.n_rows().alias("total_transactions"), X.fraud_count().alias("fraud_count"),
                 X.fraud_rate().alias("fraud_rate_pct"),
                 F.round(F.avg("geo_distance_km"), 1).alias("avg_distance_km"),
                 X.money_avg(X.fraud_amount()).alias("avg_fraud_amount"),
                 F.min("geo_distance_km").alias("_min_km"))
            .orderBy("_min_km").drop("_min_km"))


def local_vs_distant(f: DataFrame) -> DataFrame:
    far = F.col("is_far_from_home")
    fraud = F.col("is_fraud") == 1
    local_n, distant_n = F.sum(X.flag(far == 0)), F.sum(X.flag(far == 1))
    distant_f, local_f = F.sum(X.flag((far == 1) & fraud)), F.sum(X.flag((far == 0) & fraud))
    return (f.groupBy("state")
            .agg(local_n.alias("local_txns"), distant_n.alias("distant_txns"), distant_f.alias("distant_fraud"),
                 X.rate(distant_f, distant_n).alias("distant_fraud_rate_pct"),
                 X.rate(local_f, local_n).alias("local_fraud_rate_pct"))
            .orderBy(F.desc("distant_fraud"), "state"))


def distance_stats(f: DataFrame) -> DataFrame:
    """Distance distribution by label, with exact median and p90.

    The percentiles scan their rows three times, so label and distance are written once.
    """
    fraud_label, legit_label = S.FRAUD_LABELS
    km = F.col("geo_distance_km")
    stats = exact_percentiles(
        written_once(f.select("is_fraud", "geo_distance_km"), "distances"), ["is_fraud"], "geo_distance_km", {"_p50": 0.5, "_p90": 0.9},
        extra_aggs={"txn_count": X.n_rows(), "avg_distance_km": F.round(F.avg(km), 2),
                    "min_distance_km": F.round(F.min(km), 2), "max_distance_km": F.round(F.max(km), 2)})
    return stats.select("is_fraud",
                        F.when(F.col("is_fraud") == 1, fraud_label).otherwise(legit_label).alias("label"),
                        "txn_count", "avg_distance_km", "min_distance_km", "max_distance_km",
                        F.round("_p50", 2).alias("median_distance_km"), F.round("_p90", 2).alias("p90_distance_km"))


def state_heatmap(f: DataFrame) -> DataFrame:
    """Per-state rate, also as % of the highest state's (unrounded) rate.

    The normalised value is the exact rational ``f * n_max * 100 / (n * f_max)``
    (numerator carried at 10 decimals), rounded half-up once, so no
    intermediate decimal rounding can move the last digit.
    """
    n, fc = X.n_rows(), F.sum("is_fraud")
    per_state = (f.groupBy("state")
                 .agg(n.alias("total_txns"), fc.alias("fraud_txns"), X.rate(fc, n).alias("fraud_rate_pct"),
                      X.money_sum(X.fraud_amount()).alias("fraud_dollar_value"),
                      F.count_distinct("card_number").alias("affected_cards"),
                      (fc * X.hundred() / n).alias("_raw_rate")))
    # The window runs over the aggregated rows (one per state), never over raw rows.
    top = F.max_by(F.struct(F.col("fraud_txns").alias("f"), F.col("total_txns").alias("n")), F.col("_raw_rate")) \
        .over(Window.partitionBy())
    num = (F.col("fraud_txns").cast("decimal(38,0)") * F.col("_top.n") * 100).cast("decimal(38,10)")
    den = F.col("total_txns").cast("decimal(38,0)") * F.col("_top.f")
    return (per_state.withColumn("_top", top).select(
        F.col("state").alias("state_code"), "total_txns", "fraud_txns", "fraud_rate_pct", "fraud_dollar_value",
        "affected_cards", F.round(num / F.nullif(den, F.lit(0)), 2).alias("fraud_rate_normalized"))
        .orderBy(F.desc("fraud_rate_pct"), "state_code"))


def state_risk_labels(f: DataFrame) -> DataFrame:
    """State rate vs the unweighted mean of the rounded state rates."""
    state_rates = f.groupBy("state").agg(X.fraud_rate().alias("state_fraud_rate"))
    # Mean over the per-state rows (one row per state), not over transactions.
    with_avg = state_rates.withColumn("avg_fraud_rate", F.avg("state_fraud_rate").over(Window.partitionBy()))
    (hi_ratio, hi_label), (mid_ratio, mid_label) = S.STATE_RISK
    r, a = F.col("state_fraud_rate"), F.col("avg_fraud_rate")
    return (with_avg
            .select("state", "state_fraud_rate", "avg_fraud_rate",
                    F.round(r - a, 4).alias("deviation_from_avg"),
                    F.when(r > a * F.lit(Decimal(str(hi_ratio))), hi_label)
                    .when(r > a * F.lit(Decimal(str(mid_ratio))), mid_label)
                    .otherwise(S.STATE_RISK_ELSE).alias("risk_label"))
            .orderBy(F.desc("state_fraud_rate"), "state"))


def merchant_grid(f: DataFrame, cell: int = 2, min_txns: int = 50, n: int = 30) -> DataFrame:
    """Merchant location hot spots on a ``cell``-degree grid."""
    lat_cell = F.round(F.col("merchant_lat").cast("double") / cell) * cell
    long_cell = F.round(F.col("merchant_long").cast("double") / cell) * cell
    return (f.groupBy(lat_cell.alias("lat_cell"), long_cell.alias("long_cell"))
            .agg(X.n_rows().alias("total_txns"), X.fraud_count().alias("fraud_count"),
                 X.fraud_rate().alias("fraud_rate_pct"),
                 X.money_sum(X.fraud_amount()).alias("fraud_value"))
            .filter(F.col("total_txns") >= min_txns)
            .orderBy(F.desc("fraud_count"), "lat_cell", "long_cell")
            .limit(n))
