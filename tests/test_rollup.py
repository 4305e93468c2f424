"""Tables by manifest and reports from day partials."""

import shutil
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from rows import raw_rows
from txnlens.operators import rollup, transactions
from txnlens.operators.features import row_features
from txnlens.plans.catalog import CATALOG, Stages, fixture_stages
from txnlens.plans.rollup import RollupStore
from txnlens.sources.manifest import ConcurrentCommit, ManifestTable


def fresh():
    return tempfile.mkdtemp(prefix="txnlens-test-")


def rows(df):
    return [tuple(r) for r in df.collect()]


# Manifest tables.


def test_replace_swaps_whole_tables(spark):
    t = ManifestTable(spark, fresh())
    assert t.read() is None and t.versions() == []
    assert t.replace(spark.range(5)) == 1 and t.replace(spark.range(3)) == 2
    assert t.read().count() == 3 and t.read(1).count() == 5


def test_a_write_that_dies_changes_nothing(spark):
    t = ManifestTable(spark, fresh())
    t.replace(spark.range(4))
    dies = spark.range(0, 1000, 1, 8).select(F.when(F.col("id") == 900, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        t.replace(dies)
    assert t.read().count() == 4 and t.versions() == [1]
    t.replace(spark.range(1000))  # the rerun
    assert t.read().count() == 1000
    assert len(t.vacuum(keep=1)) == 2 and t.versions() == [2] and t.read().count() == 1000


def test_a_repeated_batch_replaces_itself(spark):
    t = ManifestTable(spark, fresh())
    t.put("a", spark.range(3))
    t.put("b", spark.range(10, 12))
    t.put("a", spark.range(3))
    assert sorted(r.id for r in t.read().collect()) == [0, 1, 2, 10, 11]
    assert t.read(names=["b"]).count() == 2


def test_of_two_writers_one_commits(spark):
    base = fresh()
    one, two = ManifestTable(spark, base), ManifestTable(spark, base)
    one.replace(spark.range(1))
    a, b = one.stage(spark.range(2)), two.stage(spark.range(3))
    one.commit({"all": a}, after=1)
    with pytest.raises(ConcurrentCommit):
        two.commit({"all": b}, after=1)
    assert one.read().count() == 2


# Day partials.


@pytest.fixture(scope="module")
def features(spark):
    path = f"{fresh()}/features"
    fixture_stages(spark, SF_SMALL).get("features").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def store(spark, features):
    """Two loads, the first one's files gone before the second: it reads only its own."""
    base = fresh()
    held = RollupStore(spark, f"{base}/store")
    for k in (0, 1):
        features.where(F.dayofmonth("transaction_date") % 2 == k).write.parquet(f"{base}/{k}")
        held.load(f"load-{k}", spark.read.parquet(f"{base}/{k}"))
        shutil.rmtree(f"{base}/{k}")
    return held


@pytest.mark.parametrize("name", [n for n in rollup.NAMES if n in CATALOG])
def test_reports_from_partials_equal_those_from_rows(store, features, name):
    want, got = CATALOG[name].fn(features), store.report(name)
    assert got.columns == want.columns
    if rollup.rollup(name).order:
        assert rows(got) == rows(want)  # in the same order, too
    else:
        assert sorted(rows(got)) == sorted(rows(want))


def test_stddev_from_moments(store, features):
    want = transactions.amount_distribution(features).select("is_fraud", "txn_count", "avg_amount", "min_amount", "max_amount", "std_amount").orderBy("is_fraud")
    assert rows(store.report("amount_moments")) == rows(want)


def test_a_report_of_some_days(store, features):
    some = F.col("day").between("2024-01-05", "2024-01-20")
    want = CATALOG["fraud_by_state"].fn(features.where(F.col("transaction_date").between("2024-01-05", "2024-01-20")))
    assert rows(store.report("fraud_by_state", some)) == rows(want)


def test_partials_hold_only_days_of_their_load(spark, store):
    for n, folder in store.table.parts().items():
        if n.endswith("/sums"):
            days = spark.read.parquet(f"{store.table.base}/{folder}").select(F.dayofmonth("day") % 2).distinct().collect()
            assert {d[0] for d in days} <= {int(n.split("/")[0][-1])}


def test_numbers_are_dense_and_unique(spark, store, features):
    for column in rollup.dictionary_columns(rollup.NAMES):
        numbers = store._read(store._folders(store.table.parts(), "dictionary", column))
        n = features.select(column).where(F.col(column).isNotNull()).distinct().count()
        assert sorted(r.number for r in numbers.collect()) == list(range(1, n + 1)) and numbers.select("value").distinct().count() == n


def test_repeat_compact_and_vacuum(spark, features):
    names = ["customer_summary", "fraud_by_job", "daily_volume"]
    held = RollupStore(spark, fresh(), names)
    odd = F.dayofmonth("transaction_date") % 2 == 1
    held.load("odd", features.where(odd))
    held.load("even", features.where(~odd))
    held.load("odd", features.where(odd))  # the same batch once more
    want = {n: rows(CATALOG[n].fn(features)) for n in names}
    assert {n: rows(held.report(n)) for n in names} == want
    held.compact()
    held.table.vacuum(keep=1)
    assert {n: rows(held.report(n)) for n in names} == want
    assert held._read(held._folders(held.table.parts(), "daily_volume", "sums")).count() == len(want["daily_volume"])
    with pytest.raises(Exception, match="lost"):
        held.load("more", features.withColumn("amount", F.when(F.col("amount") > 50, F.raise_error(F.lit("lost"))).otherwise(F.col("amount")).cast("decimal(12,2)")))
    assert {n: rows(held.report(n)) for n in names} == want


def test_a_load_derives_its_rows_once(spark):
    f = row_features(Stages(raw_rows(spark, *[dict(merchant=f"fraud_Shop_{i % 3}", amt=5.0 + i) for i in range(8)])).get("validated"))
    seen = spark.sparkContext.accumulator(0)

    def mark(city):
        seen.add(1)
        return city

    held = RollupStore(spark, fresh(), ["customer_summary"])
    held.load("one", f.withColumn("city", F.udf(mark, "string")("city")))
    assert seen.value == 8
    (row,) = held.report("customer_summary").collect()
    assert (row.city, row.total_transactions, float(row.total_spend), row.unique_categories, row.unique_merchants) == ("Town", 8, 68.0, 1, 3)


def test_row_features_need_no_other_rows(spark, features):
    v = fixture_stages(spark, SF_SMALL).get("validated")
    assert sorted(rows(row_features(v).select(*[c for c in features.columns if c != "amount_z_score"])), key=str) == sorted(rows(features.drop("amount_z_score")), key=str)
