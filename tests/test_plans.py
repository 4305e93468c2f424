"""Physical-plan checks: the rewrites keep the shapes we designed for."""

import re
import tempfile
from decimal import Decimal

from conftest import SF_SMALL
from rows import raw_rows
from txnlens.operators import customers, features, geography, transactions, velocity
from txnlens.plans.catalog import Stages, fixture_stages
from txnlens.plans.inspect import plan_text
from txnlens.sources.fixture import COMPILED_METHOD
from txnlens.sources.raw import read_raw_parquet


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_single_broadcast_join(spark):
    p = plan(fixture_stages(spark, SF_SMALL).get("features"))
    assert p.count("BroadcastHashJoin") == 1
    assert "SortMergeJoin" not in p and "CartesianProduct" not in p


def test_clean_filter_pushed_to_scan(spark):
    from txnlens.operators.cleaning import clean
    from txnlens.sources.raw import read_raw_parquet

    import tempfile
    d = tempfile.mkdtemp(prefix="txnlens-test-raw-")
    fixture_stages(spark, SF_SMALL).get("raw").write.mode("overwrite").parquet(d)
    p = plan(clean(read_raw_parquet(spark, d)).select("transaction_id", "amount"))
    assert "PushedFilters: [IsNotNull(trans_num)" in p
    schema = p.split("ReadSchema: struct<")[1].split(">")[0]
    assert sorted(f.split(":")[0] for f in schema.split(",")) == \
        sorted(["trans_num", "cc_num", "trans_date_trans_time", "amt", "is_fraud"])


def test_velocity_has_no_self_join_on_raw_rows(spark):
    v = fixture_stages(spark, SF_SMALL).get("validated")
    p = plan(velocity.card_velocity(v, 24))
    assert "Join" not in p and "Cartesian" not in p
    assert p.count("Exchange ") <= 3  # the hours' sums, their neighbours, the rows


def test_percentiles_shuffle_counts_only(spark):
    """Every shuffle below the result carries counts: none has the rows themselves."""
    f = fixture_stages(spark, SF_SMALL).get("features")
    lines = [line for line in plan(geography.distance_stats(f)).splitlines() if "Exchange hashpartitioning" in line or "Exchange SinglePartition" in line]
    assert lines and all("_b#" not in line or "_g#" in line for line in lines)
    from txnlens.operators.percentile import exact_percentiles

    p = plan(exact_percentiles(f, ["is_fraud"], "geo_distance_km", {"p50": 0.5}))
    for k, line in enumerate(p.splitlines()):
        if "Exchange hashpartitioning(_g" in line:
            below = p.splitlines()[k + 1]
            assert "HashAggregate" in below or "Union" in below or "Exchange" in below, below


def test_percentile_reports_derive_their_rows_once(spark):
    """The scans of the percentiles read the rows written for them, not what these are derived from."""
    d = tempfile.mkdtemp(prefix="txnlens-test-once-")
    raw_rows(spark, *[dict(amt=10.0 * (i + 1), merch_lat=Decimal("40.1") + i, is_fraud=i % 2) for i in range(4)]).write.mode("overwrite").parquet(d)
    stages = Stages(read_raw_parquet(spark, d))
    distances = geography.distance_stats(stages.get("features"))
    amounts = transactions.amount_distribution(stages.get("features"))
    assert d not in plan_text(distances) and d not in plan_text(amounts)
    # the statistics of amount_features are beside the rows themselves, which are scanned once more
    assert plan_text(features.amount_features(stages.get("validated"))).count(d) == 1
    assert sorted((r.is_fraud, r.txn_count, round(r.median_distance_km - (r.min_distance_km + r.max_distance_km) / 2)) for r in distances.collect()) == [(0, 2, 0), (1, 2, 0)]
    assert sorted((r.is_fraud, float(r.median_amount)) for r in amounts.collect()) == [(0, 20.0), (1, 30.0)]


def test_long_methods_are_not_left_to_the_interpreter(spark):
    """Filters over derived event columns are one method of more than HotSpot compiles; results are those of that method."""
    d = tempfile.mkdtemp(prefix="txnlens-test-events-")
    events = spark.range(400).selectExpr(
        "id as event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id) as ts", "id % 30 as user_id", "if(id % 9 = 0, 'error', 'view') as event_type",
        "id * 1.5D as value", "concat('{\"k\": ', id % 100, '}') as props")
    events.write.parquet(f"{d}/events.parquet")
    held = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    try:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
        f = features.row_features(fixture_stages(spark, d).get("validated"))
        assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == str(COMPILED_METHOD)
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
        sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", f._jdf.queryExecution().explainString(mode))]
        assert max(sizes) > COMPILED_METHOD
        short = sorted(map(str, f.collect()))
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
        assert short and short == sorted(map(str, f.select("*").collect()))
    finally:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", held)


def test_amount_features_broadcast_is_checked(spark):
    v = fixture_stages(spark, SF_SMALL).get("validated")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan(features.amount_features(v))
        assert "Broadcast" not in plan(features.amount_features(v, max_broadcast_rows=1))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_top_fraud_ranks_after_limit(spark):
    f = fixture_stages(spark, SF_SMALL).get("features")
    p = plan(transactions.top_fraud_transactions(f))
    assert "TakeOrderedAndProject" in p
    # the rank window sits on the 50 rows TakeOrdered returns: no exchange of raw rows to one partition
    assert "SinglePartition" not in p
    assert p.index("Window [row_number()") < p.index("TakeOrderedAndProject")


def test_rapid_fire_is_equi_join(spark):
    f = fixture_stages(spark, SF_SMALL).get("features")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(transactions.rapid_fire(f))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "NestedLoop" not in p and "Cartesian" not in p
    keys = [line for line in p.splitlines() if "SortMergeJoin [l_" in line]
    assert len(keys) == 1 and all(k in keys[0] for k in ("l_card_number", "l__jb", "l__i", "l__j", "r_card_number", "r__jb", "r__i", "r__j")), keys


def test_first_vs_returning_has_hash_aggregates_only(spark):
    f = fixture_stages(spark, SF_SMALL).get("features")
    p = plan(customers.first_vs_returning(f))
    assert "SortAggregate" not in p and "HashAggregate" in p
