"""Every catalog operator against its independent DuckDB oracle (the driver's gate)."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from oracle_compare import compare, duck
from txnlens.plans.catalog import CATALOG, EXTRAS

NAMES = sorted({*CATALOG, *EXTRAS})


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(NAMES) <= set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    r = compare(spark, SF_SMALL, name, con)
    assert r["cols_match"], r
    assert r["rows_match"], r
    assert r["values_match"], r


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert "fraud_rate_pct" in df.columns


@pytest.mark.parametrize("name", ["time_features", "card_velocity_24h", "rapid_fire", "daily_volume"])
def test_independent_of_session_time_zone(spark, con, name):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        r = compare(spark, SF_SMALL, name, con)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert r["values_match"], r
