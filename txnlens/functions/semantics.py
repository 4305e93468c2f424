"""Column-expression helpers that pin down every dialect-sensitive meaning.

All helpers return JVM-side ``Column`` expressions (codegen friendly); none of
them uses a Python UDF.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S

EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def hundred() -> Column:
    """Decimal literal 100.0: percentages stay in exact decimal arithmetic."""
    return F.lit(Decimal("100.0"))


def n_rows() -> Column:
    """COUNT(*)."""
    return F.count(F.lit(1))


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def year_diff(start, end) -> Column:
    """Calendar-year boundaries crossed between two dates (not completed years)."""
    return F.year(col(end)) - F.year(col(start))


def day_name(d) -> Column:
    """Full English weekday name ('Sunday')."""
    return F.date_format(col(d), "EEEE")


def epoch_micros(ts) -> Column:
    """Microseconds since 1970-01-01 of a TIMESTAMP_NTZ (time-zone independent)."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH_NTZ}, {ts})") if isinstance(ts, str) else \
        F.timestamp_diff("MICROSECOND", F.expr(EPOCH_NTZ), ts)


def flag(cond: Column) -> Column:
    """CASE WHEN cond THEN 1 ELSE 0 END (NULL condition -> 0)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def label_chain(value: Column, bounds, otherwise: str) -> Column:
    """Searched CASE: first ``value < bound`` wins."""
    expr = None
    for bound, label in bounds:
        expr = F.when(value < bound, label) if expr is None else expr.when(value < bound, label)
    return expr.otherwise(otherwise)


def age_group(age) -> Column:
    return label_chain(col(age), S.AGE_GROUPS, S.AGE_GROUP_ELSE)


def time_of_day(hour) -> Column:
    h = col(hour)
    expr = None
    for (lo, hi), label in S.TIME_OF_DAY:
        expr = F.when(h.between(lo, hi), label) if expr is None else expr.when(h.between(lo, hi), label)
    return expr.otherwise(S.TIME_OF_DAY_ELSE)


def city_tier(pop) -> Column:
    return label_chain(col(pop), S.CITY_TIERS, S.CITY_TIER_ELSE)


def city_tier_rank(tier) -> Column:
    t = col(tier)
    expr = None
    for i, label in enumerate(S.CITY_TIER_ORDER, start=1):
        expr = F.when(t == label, i) if expr is None else expr.when(t == label, i)
    return expr


def distance_band(km) -> Column:
    return label_chain(col(km), S.DISTANCE_BANDS, S.DISTANCE_BAND_ELSE)


def geo_distance_km(clat="customer_lat", clong="customer_long", mlat="merchant_lat", mlong="merchant_long") -> Column:
    """Flat-earth distance in km between home and merchant.

    Coordinate differences are scaled by the *decimal* 111.0 (exact), then
    squared in double, as the workload's DECIMAL columns are.
    """
    km = F.lit(S.KM_PER_DEGREE)
    dlat = (col(mlat) - col(clat)) * km
    dlong = (col(mlong) - col(clong)) * km * F.cos(F.radians(col(clat)))
    return F.sqrt(F.pow(dlat, 2) + F.pow(dlong, 2))


def geo_distance_deg(clat="customer_lat", clong="customer_long", mlat="merchant_lat", mlong="merchant_long") -> Column:
    return F.sqrt(F.pow(col(mlat) - col(clat), 2) + F.pow(col(mlong) - col(clong), 2))


# ---------------------------------------------------------------------------
# Aggregates
# ---------------------------------------------------------------------------

def fraud_count() -> Column:
    return F.sum("is_fraud")


def rate(num: Column, den: Column, scale: int = 4) -> Column:
    """ROUND(num * 100.0 / den, scale) in exact decimal arithmetic; NULL if den = 0."""
    return F.round(num * hundred() / F.nullif(den, F.lit(0)), scale)


def fraud_rate(scale: int = 4) -> Column:
    return rate(F.sum("is_fraud"), n_rows(), scale)


def fraud_amount(c="amount") -> Column:
    """amount of fraudulent rows, NULL otherwise (feeds conditional aggregates)."""
    return F.when(F.col("is_fraud") == 1, col(c))


def legit_amount(c="amount") -> Column:
    return F.when(F.col("is_fraud") == 0, col(c))


def money_sum(c) -> Column:
    return F.round(F.sum(col(c)), 2)


def money_avg(c) -> Column:
    """ROUND(AVG(decimal), 2) computed as an exact decimal quotient, then rounded once."""
    x = col(c)
    return F.round(F.sum(x) / F.nullif(F.count(x), F.lit(0)), 2)
