"""Data-quality audits over the clean table (A2–A9).

Each audit is a single aggregation: partial (map-side) aggregation runs before
the shuffle, so a hot value never concentrates raw rows in one task.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import semantics as X
from ..functions.semantics import flag, year_diff



def duplicate_ids(clean_df: DataFrame) -> DataFrame:
    """transaction_ids that occur more than once, most frequent first."""
    return (clean_df.groupBy("transaction_id").agg(X.n_rows().alias("duplicate_count"))
            .filter(F.col("duplicate_count") > 1)
            .orderBy(F.desc("duplicate_count"), F.asc("transaction_id")))


NULL_AUDIT_COLUMNS = (
    ("transaction_id", "null_transaction_id"), ("card_number", "null_card_number"),
    ("transaction_ts", "null_timestamp"), ("merchant_name", "null_merchant"),
    ("category", "null_category"), ("amount", "null_amount"), ("gender", "null_gender"),
    ("date_of_birth", "null_dob"), ("state", "null_state"), ("customer_lat", "null_customer_lat"),
    ("merchant_lat", "null_merchant_lat"), ("is_fraud", "null_is_fraud"),
)


def null_audit(clean_df: DataFrame) -> DataFrame:
    return clean_df.agg(
        X.n_rows().alias("total_rows"),
        *[F.sum(flag(F.col(c).isNull())).alias(name) for c, name in NULL_AUDIT_COLUMNS])


def label_counts(clean_df: DataFrame) -> DataFrame:
    return clean_df.groupBy("is_fraud").agg(X.n_rows().alias("row_count")).orderBy("is_fraud")


def amount_audit(clean_df: DataFrame) -> DataFrame:
    a = F.col("amount")
    return clean_df.agg(
        X.n_rows().alias("total_rows"),
        F.sum(flag(a <= 0)).alias("non_positive_amounts"),
        F.sum(flag(a > S.EXTREME_AMOUNT)).alias("extreme_high_amounts"),
        F.min(a).alias("min_amount"),
        F.max(a).alias("max_amount"),
        F.avg(a).alias("avg_amount"))


def geo_audit(clean_df: DataFrame) -> DataFrame:
    def bad(c, bounds):
        return F.sum(flag(~F.col(c).between(*bounds)))

    return clean_df.agg(
        X.n_rows().alias("total_rows"),
        bad("customer_lat", S.LAT_RANGE).alias("bad_customer_lat"),
        bad("customer_long", S.LONG_RANGE).alias("bad_customer_long"),
        bad("merchant_lat", S.LAT_RANGE).alias("bad_merchant_lat"),
        bad("merchant_long", S.LONG_RANGE).alias("bad_merchant_long"))


def gender_counts(clean_df: DataFrame) -> DataFrame:
    return clean_df.groupBy("gender").agg(X.n_rows().alias("row_count")).orderBy("gender")


def unlisted_categories(clean_df: DataFrame) -> DataFrame:
    """Categories outside the known list (NULL is neither listed nor unlisted)."""
    return (clean_df.filter(~F.col("category").isin(*S.KNOWN_CATEGORIES))
            .groupBy("category").agg(X.n_rows().alias("row_count")))


def dob_audit(clean_df: DataFrame, as_of: _dt.date | str | None = None) -> DataFrame:
    """Age sanity at ``as_of`` (default: today, as the workload's CURRENT_DATE)."""
    ref = F.current_date() if as_of is None else F.lit(str(as_of)).cast("date")
    dob = F.col("date_of_birth").cast("date")
    age = year_diff(dob, ref)
    return clean_df.agg(
        X.n_rows().alias("total_rows"),
        F.sum(flag(age < 0)).alias("negative_age"),
        F.sum(flag(age > 120)).alias("age_over_120"),
        F.min(dob).alias("oldest_dob"),
        F.max(dob).alias("youngest_dob"))
