"""Catalog of every operator: name -> (input stage, function).

Stages form the workload's lineage::

    raw -> clean -> validated -> features -> reports

``build_stages`` wires them lazily; ``run`` evaluates one named operator.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import audit, cleaning, customers, features as feat, geography, kpis, transactions, velocity
from ..sources.fixture import raw_transactions
from ..sources.raw import read_raw_csv
from ..sources.sinks import shared_dir

DOB_AS_OF = "2025-01-01"  # fixed reference date for the age audit (CURRENT_DATE is not reproducible)


@dataclass(frozen=True)
class Op:
    stage: str
    fn: Callable[[DataFrame], DataFrame]
    doc: str = ""


CATALOG: dict[str, Op] = {
    # A. cleaning and audit
    "clean_transactions": Op("clean", lambda c: c, "A1 staging table"),
    "duplicate_ids": Op("clean_dups", audit.duplicate_ids, "A2 duplicated transaction ids"),
    "null_audit": Op("clean", audit.null_audit, "A3"),
    "label_counts": Op("clean", audit.label_counts, "A4"),
    "amount_audit": Op("clean", audit.amount_audit, "A5"),
    "geo_audit": Op("clean", audit.geo_audit, "A6"),
    "gender_counts": Op("clean", audit.gender_counts, "A7"),
    "unlisted_categories": Op("clean", audit.unlisted_categories, "A8"),
    "dob_audit": Op("clean", lambda c: audit.dob_audit(c, DOB_AS_OF), "A9"),
    "validated_transactions": Op("clean", cleaning.validated, "A10"),
    # B. features
    "age_features": Op("validated", feat.age_features, "B1"),
    "time_features": Op("validated", feat.time_features, "B2"),
    "geo_features": Op("validated", feat.geo_features, "B3"),
    "amount_features": Op("validated", feat.amount_features, "B4"),
    "card_velocity_24h": Op("validated", lambda v: velocity.card_velocity(v, 24), "B5"),
    "card_velocity_7d": Op("validated", lambda v: velocity.card_velocity(v, 168), "B5b"),
    "city_tier_features": Op("validated", feat.city_tier_features, "B6"),
    "merchant_loyalty": Op("validated", feat.merchant_loyalty, "B7"),
    "fraud_features": Op("features", lambda f: f, "B8 wide feature table"),
    # C. KPIs
    "fraud_summary": Op("features", kpis.fraud_summary, "C1"),
    "fraud_by_category": Op("features", kpis.fraud_by_category, "C2"),
    "monthly_trend": Op("features", kpis.monthly_trend, "C3"),
    "fraud_by_hour": Op("features", kpis.fraud_by_hour, "C4"),
    "weekday_vs_weekend": Op("features", kpis.weekday_vs_weekend, "C5"),
    "fraud_by_gender": Op("features", kpis.fraud_by_gender, "C6"),
    "fraud_by_age_group": Op("features", kpis.fraud_by_age_group, "C7"),
    "fraud_by_city_tier": Op("features", kpis.fraud_by_city_tier, "C8"),
    "far_vs_near": Op("features", kpis.far_vs_near, "C9"),
    "top_fraud_merchants": Op("features", kpis.top_fraud_merchants, "C10"),
    # D. customers
    "customer_summary": Op("features", customers.customer_summary, "D1"),
    "repeat_victims": Op("features", customers.repeat_victims, "D2"),
    "spend_by_category": Op("features", customers.spend_by_category, "D3"),
    "fraud_by_job": Op("features", customers.fraud_by_job, "D4"),
    "fraud_by_age_gender": Op("features", customers.fraud_by_age_gender, "D5"),
    "late_night_customers": Op("features", customers.late_night_customers, "D6"),
    "high_frequency_customers": Op("features", customers.high_frequency_customers, "D7"),
    "customer_risk_score": Op("features", customers.customer_risk_score, "D8"),
    "first_vs_returning": Op("features", customers.first_vs_returning, "D9"),
    # E. geography
    "fraud_by_state": Op("features", geography.fraud_by_state, "E1"),
    "top_fraud_cities": Op("features", geography.top_fraud_cities, "E2"),
    "tier_profile": Op("features", geography.tier_profile, "E3"),
    "fraud_by_distance_band": Op("features", geography.fraud_by_distance_band, "E4"),
    "local_vs_distant": Op("features", geography.local_vs_distant, "E5"),
    "distance_stats": Op("features", geography.distance_stats, "E6"),
    "state_heatmap": Op("features", geography.state_heatmap, "E7"),
    "state_risk_labels": Op("features", geography.state_risk_labels, "E8"),
    "merchant_grid": Op("features", geography.merchant_grid, "E9"),
    # F. transactions
    "amount_distribution": Op("features", transactions.amount_distribution, "F1"),
    "amount_histogram": Op("features", transactions.amount_histogram, "F2"),
    "extreme_z": Op("features", transactions.extreme_z, "F3"),
    "category_amount_tier": Op("features", transactions.category_amount_tier, "F4"),
    "daily_volume": Op("features", transactions.daily_volume, "F5"),
    "rolling_fraud_rate": Op("features", transactions.rolling_fraud_rate, "F6"),
    "day_hour_heatmap": Op("features", transactions.day_hour_heatmap, "F7"),
    "merchant_summary": Op("features", transactions.merchant_summary, "F8"),
    "rapid_fire": Op("features", transactions.rapid_fire, "F9"),
    "top_fraud_transactions": Op("features", transactions.top_fraud_transactions, "F10"),
    "cumulative_fraud": Op("features", transactions.cumulative_fraud, "F11"),
    "multi_factor_anomalies": Op("features", transactions.multi_factor_anomalies, "F12"),
    # G. README rollups
    "fraud_by_time_of_day": Op("features", transactions.fraud_by_time_of_day, "G1"),
    "fraud_by_day_of_week": Op("features", transactions.fraud_by_day_of_week, "G2"),
}


class Stages:
    """Lazily built lineage over one raw source; ``permissive`` as in ``cleaning.clean``."""

    def __init__(self, raw: DataFrame, raw_dups: DataFrame | None = None, permissive: bool = False):
        self.raw = raw
        self.permissive = permissive
        self.raw_dups = raw_dups
        self._cache: dict[str, DataFrame] = {}

    def get(self, stage: str) -> DataFrame:
        if stage in self._cache:
            return self._cache[stage]
        if stage == "raw":
            df = self.raw
        elif stage == "clean":
            df = cleaning.clean(self.raw, self.permissive)
        elif stage == "clean_dups":
            df = self.get("clean") if self.raw_dups is None else cleaning.clean(self.raw_dups, self.permissive)
        elif stage == "validated":
            df = cleaning.validated(self.get("clean"))
        elif stage == "features":
            df = feat.features(self.get("validated"))
        else:
            raise KeyError(stage)
        self._cache[stage] = df
        return df

    def run(self, name: str) -> DataFrame:
        op = CATALOG[name]
        return op.fn(self.get(op.stage))


def fixture_stages(spark: SparkSession, sf_dir: str) -> Stages:
    return Stages(raw_transactions(spark, sf_dir), raw_transactions(spark, sf_dir, with_duplicates=True))


def run_named(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return fixture_stages(spark, sf_dir).run(name)


#: Reports that are also run from a store of day partials.
STORED = ("customer_summary", "fraud_by_job", "fraud_by_state", "top_fraud_cities", "merchant_summary", "daily_volume", "amount_moments")


def _stored(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .rollup import two_loads

        return two_loads(feat.row_features(fixture_stages(spark, sf_dir).get("validated")), name, shared_dir(spark, "rollup"))

    return run


def _from_csv(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = shared_dir(spark, "csv")
        raw_transactions(spark, sf_dir).write.option("header", True).csv(path)
        return Stages(read_raw_csv(spark, path)).run(name)

    return run


#: Queries beside the catalog: reports over a store of two loads, from CSV text, and why raw rows are rejected.
EXTRAS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{f"rollup_{name}": _stored(name) for name in STORED},
    "csv_fraud_by_category": _from_csv("fraud_by_category"),
    "rejected_rows": lambda spark, sf_dir: cleaning.rejected_rows(raw_transactions(spark, sf_dir)),
}


def normalize(df: DataFrame) -> DataFrame:
    """Canonical comparison types: integers -> BIGINT, decimals -> DOUBLE,
    doubles rounded to 6 dp (last-bit differences between engines vanish)."""
    out = []
    for fld in df.schema.fields:
        c = F.col(f"`{fld.name}`")
        t = fld.dataType
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            c = c.cast("bigint")
        elif isinstance(t, T.DecimalType):
            c = F.round(c.cast("double"), 6)
        elif isinstance(t, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
        out.append(c.alias(fld.name))
    return df.select(*out)
