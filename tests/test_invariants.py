"""Invariants across reports, and rewrites checked against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from txnlens.operators import customers, geography, kpis, transactions
from txnlens.operators.percentile import exact_percentiles
from txnlens.plans.catalog import fixture_stages


@pytest.fixture(scope="module")
def stages(spark):
    return fixture_stages(spark, SF_SMALL)


def test_fixture_counts(stages):
    # FIXTURES.md §4, sf0.001
    assert stages.get("raw").count() == 1000
    assert stages.get("clean").count() == 976
    assert stages.get("validated").count() == 890
    f = stages.get("features")
    assert f.count() == 862
    assert f.filter("is_fraud = 1").count() == 45
    assert str(f.agg(F.sum("amount")).first()[0]) == "77125.73"
    assert f.select("card_number").distinct().count() == 14


@pytest.mark.parametrize("op,key", [
    (kpis.fraud_by_category, "total_txns"), (kpis.fraud_by_hour, "total_txns"),
    (kpis.fraud_by_gender, "total_txns"), (kpis.fraud_by_city_tier, "total_txns"),
    (geography.fraud_by_distance_band, "total_transactions"), (transactions.amount_histogram, "total_txns"),
    (kpis.fraud_by_age_group, "total_txns"), (transactions.fraud_by_time_of_day, "total_txns"),
])
def test_partitions_sum_to_summary(stages, op, key):
    f = stages.get("features")
    total = kpis.fraud_summary(f).first()
    agg = op(f).agg(F.sum(key), F.sum("fraud_count")).first()
    assert (agg[0], agg[1]) == (total.total_transactions, total.total_fraud_cases)


def test_cumulative_ends_at_total(stages):
    f = stages.get("features")
    total = kpis.fraud_summary(f).first()
    last = transactions.cumulative_fraud(f).orderBy(F.desc("transaction_date")).first()
    assert last.cumulative_fraud_count == total.total_fraud_cases
    assert last.cumulative_fraud_value == total.total_fraud_value


def test_heatmap_max_is_100(stages):
    r = geography.state_heatmap(stages.get("features")).agg(F.max("fraud_rate_normalized")).first()[0]
    assert float(r) == 100.0


def test_risk_scores_bounded(stages):
    r = customers.customer_risk_score(stages.get("features")).agg(F.min("risk_score"), F.max("risk_score")).first()
    assert 0 <= r[0] <= r[1] <= 100


def test_rapid_fire_equals_brute_force(spark):
    f = fixture_stages(spark, SF_MID).get("features")
    got = transactions.rapid_fire(f).select("txn_1_id", "txn_2_id")
    a, b = f.alias("a"), f.alias("b")
    brute = (a.join(b, (F.col("a.card_number") == F.col("b.card_number"))
                    & (F.col("b.transaction_ts") > F.col("a.transaction_ts"))
                    & (F.col("b.transaction_ts") <= F.col("a.transaction_ts") + F.expr("INTERVAL 5 MINUTES"))
                    & (F.col("a.transaction_id") != F.col("b.transaction_id")))
             .select(F.col("a.transaction_id").alias("txn_1_id"), F.col("b.transaction_id").alias("txn_2_id")))
    assert got.count() == brute.count() == 56
    assert got.exceptAll(brute).count() == 0


def _np_pct(vals, p):
    vals = np.sort(np.asarray(vals, dtype=float))
    pos = (len(vals) - 1) * p
    lo, hi = int(np.floor(pos)), int(np.ceil(pos))
    return vals[lo] + (vals[hi] - vals[lo]) * (pos - lo)


def test_percentiles_match_numpy(spark):
    rnd = random.Random(7)
    data = [(g, float(x)) for g in ("a", "b", None) for x in
            [rnd.choice([rnd.gauss(0, 1), rnd.randint(0, 5), 1e6 * rnd.random()]) for _ in range(300)]]
    data += [("c", 5.0)] * 40
    df = spark.createDataFrame(data, "g string, v double")
    probs = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p95": 0.95, "p100": 1.0}
    got = {r["g"]: r for r in exact_percentiles(df, ["g"], "v", probs).collect()}
    for g in ("a", "b", None, "c"):
        vals = [v for k, v in data if k == g]
        for name, p in probs.items():
            assert got[g][name] == _np_pct(vals, p), (g, name)


def test_percentiles_heavy_tail_converge(spark):
    rnd = random.Random(11)
    data = [("x", float(rnd.lognormvariate(0, 4))) for _ in range(3000)] + [("x", 0.5)] * 50
    df = spark.createDataFrame(data, "g string, v double")
    probs = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
    got = exact_percentiles(df, ["g"], "v", probs).first()
    vals = [v for _, v in data]
    for name, p in probs.items():
        assert got[name] == _np_pct(vals, p), name


def test_percentiles_empty_and_all_null_groups(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1.0), ("b", 3.0)], "g string, v double")
    got = {r["g"]: r for r in exact_percentiles(df, ["g"], "v", {"p50": 0.5},
                                                extra_aggs={"n": F.count(F.lit(1))}).collect()}
    assert got["a"]["p50"] is None and got["a"]["n"] == 2
    assert got["b"]["p50"] == 2.0 and got["b"]["n"] == 2
    empty = exact_percentiles(df.filter("false"), ["g"], "v", {"p50": 0.5})
    assert empty.count() == 0 and empty.columns == ["g", "p50"]


def test_percentiles_many_groups(spark):
    rnd = random.Random(5)
    data = [(g, float(rnd.randint(0, 50))) for g in range(30) for _ in range(rnd.randint(1, 12))]
    df = spark.createDataFrame(data, "g int, v double")
    probs = {"p25": 0.25, "p50": 0.5, "p95": 0.95}
    got = {r["g"]: r for r in exact_percentiles(df, ["g"], "v", probs,
                                                extra_aggs={"n": F.count(F.lit(1))}).collect()}
    assert len(got) == 30
    for g in range(30):
        vals = [v for k, v in data if k == g]
        assert got[g]["n"] == len(vals)
        for name, p in probs.items():
            assert got[g][name] == _np_pct(vals, p), (g, name)


def test_percentiles_of_close_signed_and_special_values(spark):
    """Neighbours in the last bit, powers of two, subnormals, both zeros and infinities keep their order."""
    rnd = random.Random(3)
    vals = [float(np.nextafter(x, y)) for x in (1.0, -2.0, 1024.0, 5e-324, 1e300) for y in (-np.inf, x, np.inf)]
    vals += [0.0, -0.0, np.inf, -np.inf] + [rnd.choice([-1, 1]) * 2.0 ** rnd.randint(-1074, 1023) for _ in range(200)]
    rnd.shuffle(vals)
    df = spark.createDataFrame([(x,) for x in vals], "v double")
    n = len(vals)
    probs = {f"p{i}": i / (n - 1) for i in range(0, n, 9)}
    got = exact_percentiles(df, [], "v", probs).first()
    want = sorted(vals)
    for i in range(0, n, 9):
        pos = (n - 1) * probs[f"p{i}"]
        lo, hi = want[int(np.floor(pos))], want[int(np.ceil(pos))]
        assert got[f"p{i}"] == (lo if lo == hi else lo + (hi - lo) * (pos - np.floor(pos))), i


def test_percentiles_run_nothing_when_defined(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), F.sqrt(F.col("id")).alias("v"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("defined", "")
    try:
        got = exact_percentiles(rows, ["g"], "v", {"p50": 0.5})
        assert not tracker.getJobIdsForGroup("defined")
        assert got.count() == 3
        assert tracker.getJobIdsForGroup("defined")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
