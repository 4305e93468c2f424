"""One hand-made case per semantic trap."""

import datetime as dt
from decimal import Decimal

import pytest
from rows import raw_rows
from txnlens.operators import audit, cleaning, customers, features as feat, geography, kpis, transactions, velocity
from txnlens.plans.catalog import Stages


def feats(spark, *rows):
    return Stages(raw_rows(spark, *rows)).get("features")


def test_s1_age_counts_year_boundaries(spark):
    f = feats(spark, dict(dob=dt.date(2000, 12, 31), trans_date_trans_time=dt.datetime(2001, 1, 1, 10)))
    assert f.select("customer_age").first()[0] == 1


def test_s2_s3_sunday(spark):
    v = cleaning.validated(cleaning.clean(raw_rows(spark, dict(trans_date_trans_time=dt.datetime(2024, 3, 3, 1)))))
    r = feat.time_features(v).first()
    assert (r.day_of_week, r.day_name, r.is_weekend, r.time_of_day, r.is_late_night) == (1, "Sunday", 1, "Late Night", 1)


def test_s5_null_first_name_skipped(spark):
    c = cleaning.clean(raw_rows(spark, dict(first=None)))
    assert c.first().full_name == " Lee"


def test_s7_half_cent_average_rounds_half_up(spark):
    f = feats(spark, dict(amt=1.00), dict(amt=1.01))
    assert kpis.weekday_vs_weekend(f).first().avg_transaction_amount == Decimal("1.01")


def test_s8_even_count_median(spark):
    f = feats(spark, *[dict(amt=a) for a in (1.0, 2.0, 3.0, 4.0)])
    r = transactions.amount_distribution(f).first()
    assert (r.median_amount, r.p25_amount) == (2.5, 1.75)


def test_s9_single_row_category_has_null_z(spark):
    f = feats(spark, dict(category="travel"), dict(category="home", amt=5.0), dict(category="home", amt=7.0))
    z = {r.category: r.amount_z_score for r in f.collect()}
    assert z["travel"] is None and z["home"] == pytest.approx(0.7071067811865476)


def test_s11_ties_at_cutoff_are_deterministic(spark):
    rows = [dict(merchant=f"fraud_M{i}", is_fraud=1, amt=10.0) for i in range(12)]
    got = [r.merchant_name for r in kpis.top_fraud_merchants(feats(spark, *rows)).collect()]
    assert got == sorted(f"M{i}" for i in range(12))[:10]


def test_s12_duplicate_ids_do_not_fan_out(spark):
    f = feats(spark, dict(trans_num="dup"), dict(trans_num="dup"))
    assert f.count() == 2
    c = cleaning.clean(raw_rows(spark, dict(trans_num="dup"), dict(trans_num="dup")))
    assert [tuple(r) for r in audit.duplicate_ids(c).collect()] == [("dup", 2)]


def test_s13_null_category_dropped_from_features(spark):
    f = feats(spark, dict(category=None), dict())
    assert f.count() == 1


def test_s16_velocity_open_bounds(spark):
    t = dt.datetime(2024, 3, 5, 12)
    rows = [dict(trans_date_trans_time=t, amt=1.0),
            dict(trans_date_trans_time=t - dt.timedelta(hours=24), amt=2.0),           # exact edge: out
            dict(trans_date_trans_time=t - dt.timedelta(hours=24) + dt.timedelta(microseconds=1), amt=4.0),
            dict(trans_date_trans_time=t, amt=8.0)]                                       # same instant: out
    v = cleaning.validated(cleaning.clean(raw_rows(spark, *rows)))
    got = {r.transaction_id: (r.txn_count_24h, r.spend_24h) for r in velocity.card_velocity(v, 24).collect()}
    assert got["t0"] == (1, Decimal("4.00"))
    assert got["t3"] == (1, Decimal("4.00"))
    assert got["t1"] == (0, 0)


def test_s17_rapid_fire_half_open(spark):
    t = dt.datetime(2024, 3, 5, 12)
    rows = [dict(trans_date_trans_time=t), dict(trans_date_trans_time=t + dt.timedelta(minutes=5)),
            dict(trans_date_trans_time=t + dt.timedelta(minutes=5))]
    pairs = {(r.txn_1_id, r.txn_2_id, r.seconds_apart) for r in transactions.rapid_fire(feats(spark, *rows)).collect()}
    assert pairs == {("t0", "t1", 300), ("t0", "t2", 300)}


def test_s20_new_year_splits_customer_summary(spark):
    rows = [dict(trans_date_trans_time=dt.datetime(2023, 12, 31, 10)), dict(trans_date_trans_time=dt.datetime(2024, 1, 1, 10))]
    assert customers.customer_summary(feats(spark, *rows)).count() == 2


def test_s21_malformed_amount_strict_and_permissive(spark):
    from txnlens.schema import RAW_CSV_SCHEMA

    raw = spark.createDataFrame([tuple("abc" if c == "amt" else {"trans_date_trans_time": "2024-03-05 12:00:00",
                                                                    "cc_num": "1", "is_fraud": "0", "trans_num": "t1",
                                                                    "lat": "40", "long": "-100", "merch_lat": "40",
                                                                    "merch_long": "-100", "city_pop": "10",
                                                                    "unix_time": "0"}.get(c, "x")
                                       for c in RAW_CSV_SCHEMA.fieldNames())], RAW_CSV_SCHEMA)
    with pytest.raises(Exception):
        cleaning.clean(raw).collect()
    assert cleaning.clean(raw, permissive=True).count() == 0
    assert [tuple(r) for r in cleaning.rejected_rows(raw).collect()] == [("amt", "malformed", 1)]


@pytest.mark.parametrize("column", ["trans_date_trans_time", "cc_num", "amt", "is_fraud"])
def test_permissive_drops_and_counts_failed_casts(spark, column):
    from txnlens.schema import RAW_CSV_SCHEMA

    good = {"trans_date_trans_time": "2024-03-05 12:00:00", "cc_num": "1", "is_fraud": "0", "amt": "2.5", "lat": "40", "long": "-100",
            "merch_lat": "40", "merch_long": "-100", "city_pop": "10", "unix_time": "0"}
    rows = [tuple({**good, "trans_num": t, **bad}.get(c, "x") for c in RAW_CSV_SCHEMA.fieldNames())
            for t, bad in (("ok", {}), ("bad", {column: "2024-13-45 99:00:00"}), ("none", {column: None}))]
    raw = spark.createDataFrame(rows, RAW_CSV_SCHEMA)
    assert [r.transaction_id for r in cleaning.clean(raw, permissive=True).collect()] == ["ok"]
    assert sorted(map(tuple, cleaning.rejected_rows(raw).collect())) == [(column, "malformed", 1), (column, "missing", 1)]
    kept = {r.trans_num: r for r in cleaning.rejected(cleaning.route(raw)).collect()}
    assert set(kept) == {"bad", "none"} and kept["bad"][column] == "2024-13-45 99:00:00" and kept["bad"].street == "x"
    assert [tuple(x) for x in kept["bad"].reasons] == [(column, "2024-13-45 99:00:00", "malformed")]


def test_zip_is_a_varchar_of_ten(spark):
    assert [r.zip_code for r in cleaning.clean(raw_rows(spark, dict(zip="12345-678901"), dict(zip="123"))).orderBy("transaction_id").collect()] == ["12345-6789", "123"]


def test_s22_no_fraud_gives_nulls_not_errors(spark):
    f = feats(spark, dict(), dict(state="ny"))
    r = geography.state_heatmap(f).collect()
    assert all(x.fraud_rate_normalized is None for x in r)
    assert kpis.fraud_summary(f).first().avg_fraud_amount is None


def test_s23_negative_cell_midpoint_rounds_away_from_zero(spark):
    rows = [dict(merch_long=Decimal("-101.000000"), long=-101.0) for _ in range(50)]
    r = geography.merchant_grid(feats(spark, *rows)).first()
    assert r.long_cell == -102.0


def test_dob_audit_as_of(spark):
    c = cleaning.clean(raw_rows(spark, dict(dob=dt.date(1890, 1, 1)), dict(dob=dt.date(2030, 1, 1))))
    r = audit.dob_audit(c, "2025-01-01").first()
    assert (r.negative_age, r.age_over_120) == (1, 1)


def test_first_vs_returning_counts_ties_as_first(spark):
    t = dt.datetime(2024, 3, 5, 12)
    rows = [dict(trans_date_trans_time=t), dict(trans_date_trans_time=t, is_fraud=1),
            dict(trans_date_trans_time=t + dt.timedelta(hours=1))]
    got = {r.customer_type: (r.total_txns, r.fraud_count) for r in customers.first_vs_returning(feats(spark, *rows)).collect()}
    assert got == {"First Transaction": (2, 1), "Returning Customer": (1, 0)}


def test_risk_score_bounds(spark):
    rows = [dict(is_fraud=1, trans_date_trans_time=dt.datetime(2024, 3, 2, 1), merch_lat=Decimal("45.000000"))
            for _ in range(20)]
    r = customers.customer_risk_score(feats(spark, *rows)).first()
    assert 0 <= r.risk_score <= 100 and r.risk_tier == "High Risk"
    assert r.score_fraud_history == 25 and r.score_late_night == 25


def test_state_risk_labels(spark):
    rows = [dict(state="ak", is_fraud=1), dict(state="ak"), dict(state="ny"), dict(state="ny"), dict(state="tx")]
    got = {r.state: r.risk_label for r in geography.state_risk_labels(feats(spark, *rows)).collect()}
    assert got == {"AK": "High-Risk State", "NY": "Below Average", "TX": "Below Average"}


def test_rolling_rate_uses_rows_not_calendar_days(spark):
    rows = [dict(trans_date_trans_time=dt.datetime(2024, 3, d, 12), is_fraud=int(d == 1)) for d in (1, 20)]
    r = transactions.rolling_fraud_rate(feats(spark, *rows)).orderBy("transaction_date").collect()
    assert [float(x.fraud_rate_7d_avg) for x in r] == [100.0, 50.0]


def test_top_fraud_transactions_rank(spark):
    rows = [dict(is_fraud=1, amt=float(a)) for a in (5, 9, 7)]
    r = transactions.top_fraud_transactions(feats(spark, *rows)).collect()
    assert [(x["rank"], float(x.amount)) for x in r] == [(1, 9.0), (2, 7.0), (3, 5.0)]


def test_cumulative_skips_days_without_fraud(spark):
    rows = [dict(trans_date_trans_time=dt.datetime(2024, 3, 1), is_fraud=0),
            dict(trans_date_trans_time=dt.datetime(2024, 3, 2), is_fraud=1, amt=3.0)]
    r = transactions.cumulative_fraud(feats(spark, *rows)).orderBy("transaction_date").collect()
    assert [(x.daily_fraud_value, x.cumulative_fraud_value, x.cumulative_fraud_count) for x in r] == \
        [(None, None, 0), (Decimal("3.00"), Decimal("3.00"), 1)]


def test_bucket_edges_are_half_open(spark):
    amounts = [9.99, 10.0, 25.0, 50.0, 100.0, 200.0, 500.0, 1000.0]
    f = feats(spark, *[dict(amt=a, trans_num=f"a{i}") for i, a in enumerate(amounts)])
    from pyspark.sql import functions as F

    from txnlens import schema as S
    from txnlens.functions import semantics as X

    bucket = X.label_chain(F.col("amount"), S.AMOUNT_HISTOGRAM, S.AMOUNT_HISTOGRAM_ELSE)
    hist = {float(r.amount): r.b for r in f.select("amount", bucket.alias("b")).collect()}
    assert hist == {9.99: "1. $0–$10", 10.0: "2. $10–$25", 25.0: "3. $25–$50", 50.0: "4. $50–$100",
                    100.0: "5. $100–$200", 200.0: "6. $200–$500", 500.0: "7. $500–$1,000", 1000.0: "8. $1,000+"}
    tiers = {(r.amount_tier, r.total_txns) for r in transactions.category_amount_tier(f).collect()}
    assert tiers == {("Low (<$50)", 3), ("Medium ($50–$200)", 2), ("High (>$200)", 3)}


def test_city_tier_and_age_and_hour_edges(spark):
    rows = [dict(city_pop=4999, trans_num="p0"), dict(city_pop=5000, trans_num="p1"),
            dict(city_pop=500000, trans_num="p2"),
            dict(dob=dt.date(1999, 7, 1), trans_date_trans_time=dt.datetime(2024, 3, 5, 5, 59, 59), trans_num="h5"),
            dict(dob=dt.date(1998, 7, 1), trans_date_trans_time=dt.datetime(2024, 3, 5, 6, 0, 0), trans_num="h6"),
            dict(trans_date_trans_time=dt.datetime(2024, 3, 5, 21, 59, 0), trans_num="h21"),
            dict(trans_date_trans_time=dt.datetime(2024, 3, 5, 22, 0, 0), trans_num="h22")]
    f = feats(spark, *rows)
    got = {r.transaction_id: r for r in f.collect()}
    assert (got["p0"].city_tier, got["p1"].city_tier, got["p2"].city_tier) == ("Rural", "Small Town", "Metro")
    assert (got["h5"].customer_age, got["h6"].customer_age) == (25, 26)
    assert (got["h5"].is_late_night, got["h6"].is_late_night) == (1, 0)
    v = cleaning.validated(cleaning.clean(raw_rows(spark, *rows)))
    tod = {r.transaction_id: r.time_of_day for r in feat.time_features(v).collect()}
    assert (tod["h5"], tod["h6"], tod["h21"], tod["h22"]) == ("Late Night", "Morning", "Evening", "Night")
    ages = {r.transaction_id: r.age_group for r in feat.age_features(v).collect()}
    assert (ages["h5"], ages["h6"]) == ("25-34", "25-34")
