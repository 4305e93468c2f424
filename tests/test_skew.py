"""A third of all rows on one card: the skew-proof rewrites stay exact."""

import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_MID
from txnlens.functions.semantics import epoch_micros
from txnlens.operators import customers, transactions, velocity
from txnlens.plans.catalog import fixture_stages


@pytest.fixture(scope="module")
def hot(spark):
    st = fixture_stages(spark, SF_MID)
    move = F.abs(F.hash("transaction_id")) % 3 == 0
    v = st.get("validated").withColumn("card_number", F.when(move, F.lit(1)).otherwise(F.col("card_number")))
    f = st.get("features").withColumn("card_number", F.when(move, F.lit(1)).otherwise(F.col("card_number")))
    return v, f


def test_hot_card_is_hot(hot):
    v, _ = hot
    assert v.filter("card_number = 1").count() * 4 > v.count()


def range_frame(v, hours):
    """The definition as one range frame a card: quadratic for a busy card, so for tests only."""
    w = Window.partitionBy("card_number").orderBy("_m").rangeBetween(-(hours * 3_600_000_000 - 1), -1)
    rows = v.withColumn("_m", epoch_micros(F.col("transaction_ts")))
    return rows.select("transaction_id", F.count("amount").over(w).alias("n"), F.coalesce(F.sum("amount").over(w), F.lit(0)).cast("double").alias("s"),
                       F.coalesce(F.max("amount").over(w), F.lit(0)).cast("double").alias("x"))


@pytest.mark.parametrize("hours", [1, 24, 168])
def test_velocity_hot_card(hot, hours):
    v, _ = hot
    a = velocity.card_velocity(v, hours).select(
        "transaction_id", F.col(f"txn_count_{hours}h").alias("n"), F.col(f"spend_{hours}h").cast("double").alias("s"), F.col(f"max_txn_{hours}h").cast("double").alias("x"))
    b = range_frame(v, hours)
    assert a.count() == b.count() == v.count()
    assert a.exceptAll(b).count() == 0


def test_velocity_is_linear_in_one_hot_hour(spark):
    """One card, all rows inside one hour: twice the rows take about twice the time."""
    def took(n):
        v = spark.range(n).select(F.col("id").cast("string").alias("transaction_id"), F.lit(1).cast("long").alias("card_number"),
                                  F.expr("timestamp_ntz'2024-03-05 12:00:00' + make_dt_interval(0, 0, 0, id * 0.1)").alias("transaction_ts"),
                                  F.lit(2).cast("decimal(12,2)").alias("amount"))
        best = 1e9
        for _ in range(2):
            t = time.time()
            rows = velocity.card_velocity(v, 24).agg(F.sum("txn_count_24h"), F.count("*")).first()
            best = min(best, time.time() - t)
            assert tuple(rows) == (n * (n - 1) // 2, n)
        return best

    took(2_000)
    assert took(32_000) < 2.5 * took(16_000) + 1


def test_rapid_fire_hot_card(hot):
    _, f = hot
    got = transactions.rapid_fire(f).select("txn_1_id", "txn_2_id")
    a, b = f.alias("a"), f.alias("b")
    brute = (a.join(b, (F.col("a.card_number") == F.col("b.card_number"))
                    & (F.col("b.transaction_ts") > F.col("a.transaction_ts"))
                    & (F.col("b.transaction_ts") <= F.col("a.transaction_ts") + F.expr("INTERVAL 5 MINUTES"))
                    & (F.col("a.transaction_id") != F.col("b.transaction_id")))
             .select(F.col("a.transaction_id").alias("txn_1_id"), F.col("b.transaction_id").alias("txn_2_id")))
    assert got.count() == brute.count()
    assert got.exceptAll(brute).count() == 0


def burst(spark, n, seconds):
    """``n`` rows of one card within ``seconds``, on both sides of a bucket's edge."""
    at = F.expr(f"timestamp_ntz'2024-03-05 12:00:00' - make_dt_interval(0, 0, 0, {seconds / 2}) + make_dt_interval(0, 0, 0, cast(id * {seconds} / {n} as decimal(18,6)))")
    return spark.range(0, n, 1, 8).select(
        F.lit(1).cast("long").alias("card_number"), F.concat(F.lit("t"), F.col("id")).alias("transaction_id"), at.alias("transaction_ts"), F.lit(2).cast("decimal(12,2)").alias("amount"),
        F.lit("m").alias("merchant_name"), F.lit(0).alias("is_fraud"), F.lit("Ann").alias("full_name"))


def test_rapid_fire_cuts_a_burst_into_tiles(spark):
    """100,000 rows of one burst: no tile has many rows, and any two rows of it meet in one tile."""
    left, right = transactions.rapid_fire_tiles(burst(spark, 100_000, 300))
    tile = ["card_number", "_jb", "_i", "_j"]
    a, b = (x.groupBy(*tile).count() for x in (left, right))
    both = a.join(b.withColumnRenamed("count", "other"), tile)
    largest = both.agg(F.max("count"), F.max("other"), F.sum(F.col("count") * F.col("other")), F.count("*")).first()
    assert max(largest[0], largest[1]) < 1.1 * transactions.TILE_ROWS and largest[3] > 400
    # two buckets of 50,000: each row against its own bucket, the first bucket against the second
    assert largest[2] == 3 * 50_000**2


def test_rapid_fire_tiles_give_every_pair_once(spark):
    f = burst(spark, 600, 700)
    want = sorted((f"t{i}", f"t{j}") for i in range(600) for j in range(i + 1, 600) if (j - i) * 700 * 1000 // 600 <= 300_000 and (j - i) * 700 / 600 <= 300)
    for tile_rows in (10_000, 50, 7):
        got = sorted((r.txn_1_id, r.txn_2_id) for r in transactions.rapid_fire(f, tile_rows=tile_rows).select("txn_1_id", "txn_2_id").collect())
        assert got == want


def test_first_vs_returning_hot_card(hot):
    _, f = hot
    first = f.groupBy("card_number").agg(F.min("transaction_ts").alias("first_ts"))
    j = f.join(first, "card_number")
    brute = (j.groupBy(F.when(F.col("transaction_ts") == F.col("first_ts"), "First Transaction")
                        .otherwise("Returning Customer").alias("customer_type"))
             .agg(F.count(F.lit(1)).alias("total_txns"), F.sum("is_fraud").alias("fraud_count")))
    got = customers.first_vs_returning(f).select("customer_type", "total_txns", "fraud_count")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, brute.collect()))
