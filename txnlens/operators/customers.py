"""Cardholder-level reports (D1–D9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import semantics as X


def customer_summary(f: DataFrame) -> DataFrame:
    """Per-card profile; a card whose rows span a new year yields one row per age.

    Rows are summed per category and merchant of a card first, so that the two distinct
    counts repeat those sums and not the transactions.
    """
    keys = ["card_number", "full_name", "gender", "customer_age", "city", "state", "job", "city_tier"]
    pre = f.groupBy(*keys, "category", "merchant_name").agg(
        X.n_rows().alias("n"), X.fraud_count().alias("fr"), F.sum("amount").alias("amt"), F.count("amount").alias("amt_n"),
        F.sum(X.fraud_amount()).alias("fr_amt"),
        F.min("transaction_date").alias("first"), F.max("transaction_date").alias("last"))

    def total(c: str):  # of sums, in their own type: a wider decimal would leave the quotient fewer digits
        return F.sum(c).cast(pre.schema[c].dataType)

    return (pre.groupBy(*keys)
            .agg(F.sum("n").alias("total_transactions"), F.sum("fr").alias("fraud_count"),
                 X.rate(F.sum("fr"), F.sum("n"), 2).alias("fraud_rate_pct"),
                 F.round(total("amt"), 2).alias("total_spend"),
                 F.round(total("fr_amt"), 2).alias("total_fraud_amount"),
                 F.round(total("amt") / F.nullif(F.sum("amt_n"), F.lit(0)), 2).alias("avg_transaction_amount"),
                 F.min("first").alias("first_transaction"),
                 F.max("last").alias("last_transaction"),
                 F.count_distinct("category").alias("unique_categories"),
                 F.count_distinct("merchant_name").alias("unique_merchants"))
            .orderBy(F.desc("fraud_count"), "card_number", "customer_age"))


def repeat_victims(f: DataFrame, min_fraud: int = 1) -> DataFrame:
    """Cards with more than ``min_fraud`` fraudulent transactions."""
    fraud_date = F.when(F.col("is_fraud") == 1, F.col("transaction_date"))
    return (f.groupBy("card_number", "full_name")
            .agg(X.fraud_count().alias("fraud_incidents"),
                 X.money_sum(X.fraud_amount()).alias("total_fraud_loss"),
                 X.money_avg(X.fraud_amount()).alias("avg_fraud_amount"),
                 F.min(fraud_date).alias("first_fraud_date"), F.max(fraud_date).alias("last_fraud_date"))
            .filter(F.col("fraud_incidents") > min_fraud)
            .orderBy(F.desc("fraud_incidents"), "card_number"))


def spend_by_category(f: DataFrame) -> DataFrame:
    return (f.groupBy("card_number", "full_name", "category")
            .agg(X.n_rows().alias("txn_count"), X.money_sum("amount").alias("total_spend"),
                 X.money_avg("amount").alias("avg_spend"), X.fraud_count().alias("fraud_count"))
            .orderBy("card_number", F.desc("total_spend"), "category"))


def fraud_by_job(f: DataFrame, min_txns: int = 10, n: int = 25) -> DataFrame:
    return (f.groupBy("job")
            .agg(F.count_distinct("card_number").alias("unique_customers"),
                 X.n_rows().alias("total_transactions"), X.fraud_count().alias("fraud_count"),
                 X.fraud_rate().alias("fraud_rate_pct"),
                 X.money_avg("amount").alias("avg_transaction_amount"),
                 X.money_avg(X.fraud_amount()).alias("avg_fraud_amount"))
            .filter(F.col("total_transactions") >= min_txns)
            .orderBy(F.desc_nulls_last("fraud_rate_pct"), "job")
            .limit(n))


def fraud_by_age_gender(f: DataFrame) -> DataFrame:
    return (f.groupBy(X.age_group("customer_age").alias("age_group"), "gender")
            .agg(X.n_rows().alias("total_txns"), X.fraud_count().alias("fraud_count"),
                 X.fraud_rate().alias("fraud_rate_pct"),
                 X.money_avg(X.fraud_amount()).alias("avg_fraud_amount"))
            .orderBy("age_group", "gender"))


def late_night_customers(f: DataFrame) -> DataFrame:
    return (f.filter(F.col("is_late_night") == 1)
            .groupBy("card_number", "full_name")
            .agg(X.n_rows().alias("late_night_txns"), X.fraud_count().alias("late_night_fraud"),
                 X.fraud_rate(2).alias("late_night_fraud_rate_pct"),
                 X.money_sum("amount").alias("late_night_total_spend"))
            .orderBy(F.desc("late_night_fraud"), "card_number"))


def high_frequency_customers(f: DataFrame, min_txns: int = 5, n: int = 50) -> DataFrame:
    """Transactions per active-day span (NULL for a single day), top ``n``."""
    n_rows = X.n_rows()
    days = F.datediff(F.max("transaction_date"), F.min("transaction_date"))
    return (f.groupBy("card_number", "full_name")
            .agg(n_rows.alias("total_transactions"),
                 (n_rows / F.nullif(days, F.lit(0))).alias("avg_txns_per_day"),
                 X.money_sum("amount").alias("total_spend"), X.fraud_count().alias("fraud_count"))
            .filter(F.col("total_transactions") > min_txns)
            .orderBy(F.desc_nulls_last("avg_txns_per_day"), "card_number", "full_name")
            .limit(n))


def customer_risk_score(f: DataFrame) -> DataFrame:
    """Composite 0–100 score: four capped components, computed once from the aggregates."""
    cap = F.lit(S.RISK_CAP)
    w = S.RISK_WEIGHTS
    agg = (f.groupBy("card_number", "full_name", "gender", "state")
           .agg(X.n_rows().alias("total_txns"), F.sum("is_fraud").alias("confirmed_fraud_count"),
                F.sum("is_late_night").alias("_late"), F.sum("is_far_from_home").alias("_far"),
                F.sum(X.flag(F.abs("amount_z_score") > S.Z_ANOMALY)).alias("_z")))
    scored = agg.select(
        "card_number", "full_name", "gender", "state", "total_txns", "confirmed_fraud_count",
        F.least(F.col("confirmed_fraud_count") * w["fraud"], cap).alias("score_fraud_history"),
        F.least(F.col("_late") * w["late_night"], cap).alias("score_late_night"),
        F.least(F.col("_far") * w["far"], cap).alias("score_geo_anomaly"),
        F.least(F.col("_z") * w["amount"], cap).alias("score_amount_anomaly"))
    total = (F.col("score_fraud_history") + F.col("score_late_night") + F.col("score_geo_anomaly")
             + F.col("score_amount_anomaly"))
    scored = scored.withColumn("risk_score", total)
    tier = None
    for bound, label in S.RISK_TIERS:
        cond = F.col("risk_score") >= bound
        tier = F.when(cond, label) if tier is None else tier.when(cond, label)
    tier = tier.otherwise(S.RISK_TIER_ELSE)
    return scored.withColumn("risk_tier", tier).orderBy(F.desc("risk_score"), "card_number")


def first_vs_returning(f: DataFrame) -> DataFrame:
    """Fraud on a card's first observed transaction(s) vs the rest.

    Pure aggregation, no self-join and no per-card window: rows are first
    pre-aggregated per (card, ts); per card, ``min_by`` picks the earliest instant's
    partial sums (all ties at that instant count as "first"), and the card totals
    give the returning part by subtraction.  All buffers have a fixed width, so
    both steps stay hash aggregates.
    """
    per_ts = f.groupBy("card_number", "transaction_ts").agg(
        X.n_rows().alias("n"), F.sum("is_fraud").alias("fr"),
        F.sum("amount").alias("amt"), F.count("amount").alias("amt_n"))
    per_card = per_ts.groupBy("card_number").agg(
        *[F.min_by(c, "transaction_ts").alias(f"first_{c}") for c in ("n", "fr", "amt", "amt_n")],
        F.sum("n").alias("n"), F.sum("fr").alias("fr"), F.sum("amt").alias("amt"), F.sum("amt_n").alias("amt_n"))
    first_label, returning_label = S.CUSTOMER_TYPE_LABELS
    # One pass over the per-card rows: each card emits its "first" and its "returning" part.
    parts = per_card.select(F.explode(F.array(
        F.struct(F.lit(first_label).alias("customer_type"), F.col("first_n").alias("n"),
                 F.col("first_fr").alias("fr"), F.col("first_amt").alias("amt"),
                 F.col("first_amt_n").alias("amt_n")),
        F.struct(F.lit(returning_label).alias("customer_type"), (F.col("n") - F.col("first_n")).alias("n"),
                 (F.col("fr") - F.col("first_fr")).alias("fr"), (F.col("amt") - F.col("first_amt")).alias("amt"),
                 (F.col("amt_n") - F.col("first_amt_n")).alias("amt_n")))).alias("p")).select("p.*")
    total_n = F.sum("n")
    return (parts.filter(F.col("n") > 0)
            .groupBy("customer_type")
            .agg(total_n.alias("total_txns"), F.sum("fr").alias("fraud_count"),
                 X.rate(F.sum("fr"), total_n).alias("fraud_rate_pct"),
                 F.round(F.sum("amt") / F.nullif(F.sum("amt_n"), F.lit(0)), 2).alias("avg_amount")))
