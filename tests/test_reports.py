"""What the oracles do not see: the order of a report's rows, and many groups."""

import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from txnlens import schema as S
from txnlens.operators import features as feat
from txnlens.operators import transactions
from txnlens.plans.catalog import CATALOG, fixture_stages

#: Report -> its order keys; "-" for descending, NULLs last. A function gives a key's rank.
ORDERS = {
    "label_counts": ["is_fraud"], "gender_counts": ["gender"], "duplicate_ids": ["-duplicate_count", "transaction_id"],
    "merchant_loyalty": ["-visit_count", "card_number", "merchant_name"],
    "fraud_by_category": ["-fraud_rate_pct", "category"], "monthly_trend": ["month"], "fraud_by_hour": ["transaction_hour"],
    "fraud_by_city_tier": ["-fraud_rate_pct", "city_tier"], "top_fraud_merchants": ["-total_fraud_value", "merchant_name", "category"],
    "customer_summary": ["-fraud_count", "card_number", "customer_age"], "repeat_victims": ["-fraud_incidents", "card_number"],
    "spend_by_category": ["card_number", "-total_spend", "category"], "fraud_by_job": ["-fraud_rate_pct", "job"], "fraud_by_age_gender": ["age_group", "gender"],
    "late_night_customers": ["-late_night_fraud", "card_number"], "high_frequency_customers": ["-avg_txns_per_day", "card_number", "full_name"],
    "customer_risk_score": ["-risk_score", "card_number"], "fraud_by_state": ["-fraud_rate_pct", "state"],
    "top_fraud_cities": ["-fraud_count", "city", "state", "city_pop", "city_tier"], "tier_profile": [lambda r: S.CITY_TIER_ORDER.index(r["city_tier"])],
    "fraud_by_distance_band": ["avg_distance_km"], "local_vs_distant": ["-distant_fraud", "state"], "state_heatmap": ["-fraud_rate_pct", "state_code"],
    "state_risk_labels": ["-state_fraud_rate", "state"], "merchant_grid": ["-fraud_count", "lat_cell", "long_cell"], "amount_histogram": ["amount_bucket"],
    "extreme_z": ["-amount_z_score"], "category_amount_tier": ["category", "amount_tier"], "daily_volume": ["transaction_date"],
    "rolling_fraud_rate": ["transaction_date"], "day_hour_heatmap": ["day_of_week", "transaction_hour"], "merchant_summary": ["-fraud_rate_pct", "merchant_name", "category"],
    "rapid_fire": ["card_number", "txn_1_time", "txn_2_time", "txn_1_id", "txn_2_id"], "top_fraud_transactions": ["rank"], "cumulative_fraud": ["transaction_date"],
    "multi_factor_anomalies": ["-anomaly_flag_count", "-amount", "transaction_id"], "fraud_by_day_of_week": ["day_of_week"],
    "fraud_by_age_group": [lambda r: [*(x for _, x in S.AGE_GROUPS), S.AGE_GROUP_ELSE].index(r["age_group"])],
}


@pytest.fixture(scope="module")
def stages(spark):
    st = fixture_stages(spark, SF_SMALL)
    path = f"{tempfile.mkdtemp(prefix='txnlens-test-')}/features"
    st.get("features").write.parquet(path)
    st._cache["features"] = spark.read.parquet(path)
    return st


class Down:
    """Orders the other way round."""

    def __init__(self, x):
        self.x = x

    def __lt__(self, other):
        return other.x < self.x

    def __eq__(self, other):
        return self.x == other.x


def key(row, names):
    out = []
    for n in names:
        x = n(row) if callable(n) else row[n.lstrip("-")]
        down = not callable(n) and n.startswith("-")
        out.append((x is None, 0 if x is None else Down(x) if down else x))
    return out


@pytest.mark.parametrize("name", sorted(ORDERS))
def test_rows_come_in_order(stages, name):
    keys = [key(r, ORDERS[name]) for r in stages.run(name).collect()]
    assert keys and all(not b < a for a, b in zip(keys, keys[1:], strict=False))


def test_many_groups(spark):
    """Thousands of merchants and cards, where the fixture has forty and some hundred."""
    f = fixture_stages(spark, SF_MID).get("features")
    f = f.withColumn("merchant_name", F.concat(F.lit("M"), F.pmod(F.xxhash64("transaction_id"), F.lit(3000))))
    f = f.withColumn("card_number", F.pmod(F.xxhash64("transaction_id", F.lit(1)), F.lit(4000)))
    p = f.select("merchant_name", "category", "card_number", "amount", "is_fraud", "transaction_ts").toPandas()
    p["amount"] = p.amount.astype(float)
    got = {(r.merchant_name, r.category): (r.total_txns, r.unique_customers, r.fraud_count, float(r.total_revenue)) for r in transactions.merchant_summary(f).collect()}
    want = p.groupby(["merchant_name", "category"]).agg(n=("amount", "size"), c=("card_number", "nunique"), fraud=("is_fraud", "sum"), s=("amount", "sum"))
    assert len(got) > 5000 and got == {k: (int(r.n), int(r.c), int(r.fraud), round(r.s, 2)) for k, r in want.iterrows()}
    got = {(r.card_number, r.merchant_name): (r.visit_count, float(r.total_spend), r.first_visit) for r in feat.merchant_loyalty(f).collect()}
    want = p.groupby(["card_number", "merchant_name"]).agg(n=("amount", "size"), s=("amount", "sum"), t=("transaction_ts", "min"))
    assert len(got) > 5000 and got == {k: (int(r.n), round(r.s, 2), r.t.to_pydatetime()) for k, r in want.iterrows()}
