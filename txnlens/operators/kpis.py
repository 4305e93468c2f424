"""Top-level fraud KPIs (C1–C10) over the feature table.

Every report is one ``groupBy().agg()``: Spark aggregates partially on the
map side, so the shuffle carries one row per group per task, whatever the
skew of the grouping key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import semantics as X



def _totals(count_name="total_txns"):
    return [X.n_rows().alias(count_name), X.fraud_count().alias("fraud_count")]


def fraud_summary(f: DataFrame) -> DataFrame:
    n, fc = X.n_rows(), F.sum("is_fraud")
    fraud_value = F.sum(X.fraud_amount())
    return f.agg(
        n.alias("total_transactions"), fc.alias("total_fraud_cases"), (n - fc).alias("total_legit_cases"),
        X.rate(fc, n).alias("fraud_rate_pct"),
        F.round(F.sum("amount"), 2).alias("total_transaction_value"),
        F.round(fraud_value, 2).alias("total_fraud_value"),
        X.rate(fraud_value, F.sum("amount")).alias("fraud_value_pct"),
        X.money_avg(X.fraud_amount()).alias("avg_fraud_amount"),
        X.money_avg(X.legit_amount()).alias("avg_legit_amount"))


def fraud_by_category(f: DataFrame) -> DataFrame:
    return (f.groupBy("category")
            .agg(*_totals(), X.fraud_rate().alias("fraud_rate_pct"),
                 X.money_sum("amount").alias("total_value"),
                 X.money_sum(X.fraud_amount()).alias("fraud_value"),
                 X.money_avg(X.fraud_amount()).alias("avg_fraud_amount"))
            .orderBy(F.desc("fraud_rate_pct"), "category"))


def monthly_trend(f: DataFrame) -> DataFrame:
    return (f.groupBy(F.trunc("transaction_date", "month").alias("month"))
            .agg(*_totals(), X.fraud_rate().alias("fraud_rate_pct"),
                 X.money_sum(X.fraud_amount()).alias("fraud_value"))
            .orderBy("month"))


def fraud_by_hour(f: DataFrame) -> DataFrame:
    return (f.groupBy("transaction_hour")
            .agg(*_totals(), X.fraud_rate().alias("fraud_rate_pct"),
                 X.money_avg(X.fraud_amount()).alias("avg_fraud_amount"))
            .orderBy("transaction_hour"))


def weekday_vs_weekend(f: DataFrame) -> DataFrame:
    weekend, weekday = S.WEEKEND_LABELS
    return (f.groupBy("is_weekend")
            .agg(*_totals(), X.fraud_rate().alias("fraud_rate_pct"),
                 X.money_avg("amount").alias("avg_transaction_amount"))
            .select(F.when(F.col("is_weekend") == 1, weekend).otherwise(weekday).alias("day_type"),
                    "total_txns", "fraud_count", "fraud_rate_pct", "avg_transaction_amount"))


def fraud_by_gender(f: DataFrame) -> DataFrame:
    return (f.groupBy("gender")
            .agg(*_totals(), X.fraud_rate().alias("fraud_rate_pct"),
                 X.money_avg(X.fraud_amount()).alias("avg_fraud_amount"),
                 X.money_avg(X.legit_amount()).alias("avg_legit_amount")))


def fraud_by_age_group(f: DataFrame) -> DataFrame:
    return (f.groupBy(X.age_group("customer_age").alias("age_group"))
            .agg(*_totals(), X.fraud_rate().alias("fraud_rate_pct"),
                 X.money_avg(X.fraud_amount()).alias("avg_fraud_amount"),
                 F.min("customer_age").alias("_min_age"))
            .orderBy("_min_age").drop("_min_age"))


def fraud_by_city_tier(f: DataFrame) -> DataFrame:
    return (f.groupBy("city_tier")
            .agg(*_totals(), X.fraud_rate().alias("fraud_rate_pct"),
                 X.money_avg(X.fraud_amount()).alias("avg_fraud_amount"))
            .orderBy(F.desc("fraud_rate_pct"), "city_tier"))


def far_vs_near(f: DataFrame) -> DataFrame:
    far, near = S.DISTANCE_GROUP_LABELS
    return (f.groupBy("is_far_from_home")
            .agg(*_totals(), X.fraud_rate().alias("fraud_rate_pct"))
            .select(F.when(F.col("is_far_from_home") == 1, far).otherwise(near).alias("distance_group"),
                    "total_txns", "fraud_count", "fraud_rate_pct"))


def top_fraud_merchants(f: DataFrame, n: int = 10) -> DataFrame:
    """Top-n merchants by fraud value; ties broken by merchant, category."""
    return (f.groupBy("merchant_name", "category")
            .agg(X.fraud_count().alias("fraud_count"),
                 X.money_sum(X.fraud_amount()).alias("total_fraud_value"),
                 X.fraud_rate(2).alias("fraud_rate_pct"))
            .orderBy(F.desc_nulls_last("total_fraud_value"), "merchant_name", "category")
            .limit(n))
