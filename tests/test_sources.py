"""Sources, sinks, the batch run and streaming ingestion."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from txnlens.operators import cleaning
from txnlens.operators.features import category_stats
from txnlens.operators.transactions import daily_volume
from txnlens.plans.catalog import fixture_stages
from txnlens.plans.batch import run_all
from txnlens.schema import RAW_COLUMNS
from txnlens.sources.raw import read_raw_csv, read_raw_parquet
from txnlens.sources.manifest import ManifestTable
from txnlens.streaming.ingest import read_raw_stream, start_parquet_sink, start_report_sink, stream_features


def _fresh():
    return tempfile.mkdtemp(prefix="txnlens-test-")


def test_csv_round_trip_matches_parquet(spark):
    raw = fixture_stages(spark, SF_SMALL).get("raw")
    d = _fresh()
    raw.select(*[F.col(c).cast("string") for c in RAW_COLUMNS]).write.option("header", "true").csv(f"{d}/csv")
    raw.write.parquet(f"{d}/pq")
    a = cleaning.clean(read_raw_csv(spark, f"{d}/csv"))
    b = cleaning.clean(read_raw_parquet(spark, f"{d}/pq"))
    assert a.count() == b.count() == 976
    assert a.exceptAll(b).count() == 0


def test_run_all_writes_reports(spark):
    st = fixture_stages(spark, SF_SMALL)
    out = _fresh()
    paths = run_all(spark, st.raw, out, names=["fraud_summary", "fraud_by_state", "clean_transactions", "fraud_features",
                                               "duplicate_ids"])
    assert spark.read.parquet(paths["fraud_summary"]).first().total_transactions == 862
    # The wide tables are their own reports, each written once.
    (base,) = {os.path.dirname(paths[n]) for n in ("clean_transactions", "fraud_features")}
    assert (paths["clean_transactions"], paths["fraud_features"]) == (f"{base}/clean", f"{base}/features")
    assert sorted(os.listdir(f"{base}/reports")) == ["duplicate_ids", "fraud_by_state", "fraud_summary"]
    assert spark.read.parquet(paths["fraud_features"]).count() == 862


def test_streaming_features_match_batch(spark):
    st = fixture_stages(spark, SF_SMALL)
    d = _fresh()
    st.raw.repartition(4).write.parquet(f"{d}/in")
    stats = category_stats(st.get("validated"))
    feats = stream_features(read_raw_stream(spark, f"{d}/in", max_files_per_trigger=1), stats)
    q = start_parquet_sink(feats, f"{d}/out", f"{d}/ckpt", trigger_once=True)
    q.awaitTermination()
    got = spark.read.parquet(f"{d}/out")
    assert got.count() == 862
    batch = st.get("features")
    cols = ["transaction_id", "amount", "customer_age", "is_far_from_home", "city_tier"]
    assert got.select(cols).exceptAll(batch.select(cols)).count() == 0
    # One trigger a file, so most rows of a day come late: none is dropped.
    files = spark.readStream.schema(got.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/out")
    q2 = start_report_sink(daily_volume(files), f"{d}/daily", f"{d}/ckpt2", trigger_once=True)
    q2.awaitTermination()
    table = ManifestTable(spark, f"{d}/daily")
    emitted, want = table.read(), daily_volume(batch)
    assert table.versions()[-1] > 3 and len(os.listdir(f"{d}/daily/data")) <= 3 and emitted.count() == want.count()
    assert emitted.exceptAll(want).count() == 0


def test_a_report_of_some_days_reads_their_months_only(spark):
    """Two years of rows: only the months of the wanted days are listed."""
    from txnlens.operators.kpis import monthly_trend
    from txnlens.operators.transactions import daily_volume
    from txnlens.plans.batch import read_features

    f = fixture_stages(spark, SF_SMALL).get("features")
    f = f.withColumn("transaction_date", F.expr("date_add(date'2023-01-01', cast(pmod(xxhash64(transaction_id), 730) as int))"))
    path = f"{_fresh()}/features"
    f.withColumn("txn_month", F.date_format("transaction_date", "yyyy-MM")).write.partitionBy("txn_month").parquet(path)
    f = spark.read.parquet(path).drop("txn_month")
    some = read_features(spark, path, "2023-11-20", "2024-02-03")
    plan = some._jdf.queryExecution().executedPlan().toString()
    listed = plan[plan.index("PartitionFilters: [") :]
    assert "txn_month" in listed[: listed.index("]")] and "2023-11" in listed and "2024-02" in listed
    assert len({x.split("txn_month=")[1].split("/")[0] for x in some.inputFiles()}) == 24 and some.columns == f.columns
    want = f.where(F.col("transaction_date").between("2023-11-20", "2024-02-03"))
    for report in (monthly_trend, daily_volume):
        assert [tuple(r) for r in report(some).collect()] == [tuple(r) for r in report(want).collect()]
    assert read_features(spark, path).count() == f.count() and read_features(spark, path, first="2024-12-30").count() == f.where("transaction_date >= '2024-12-30'").count()


def test_month_partitioned_features_prune(spark):
    from txnlens.plans.batch import MaterializedStages

    st = fixture_stages(spark, SF_SMALL)
    ms = MaterializedStages(spark, st.raw, out_dir=_fresh(), partition_features_by_month=True)
    scan = spark.read.parquet(ms.features_path).filter("txn_month = '2024-03'")
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(txn_month" in plan
    assert scan.count() == ms.get("features").filter("month(transaction_date) = 3").count()
    assert spark.sql("SELECT COUNT(*) FROM transaction_features").first()[0] == 862


def test_cli_runs_selected_reports(spark, capsys):
    import json

    from txnlens.__main__ import main

    st = fixture_stages(spark, SF_SMALL)
    d = _fresh()
    st.raw.write.parquet(f"{d}/raw")
    main(["--input", f"{d}/raw", "--format", "parquet", "--out", f"{d}/out", "--reports", "fraud_summary"])
    paths = json.loads(capsys.readouterr().out)
    assert spark.read.parquet(paths["fraud_summary"]).first().total_transactions == 862


def test_shuffles_start_with_more_partitions_for_larger_input(spark):
    from txnlens.plans.session import size_shuffles

    d = f"{_fresh()}/raw"
    fixture_stages(spark, SF_SMALL).get("raw").write.parquet(d)
    raw = read_raw_parquet(spark, d)
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    try:
        assert size_shuffles(spark, raw) == 8
        assert size_shuffles(spark, raw, 1024) > 8
        assert int(spark.conf.get(key)) > 8
    finally:
        spark.conf.unset(key)


CSV_TEXT = """,trans_date_trans_time,cc_num,merchant,category,amt,first,last,gender,street,city,state,zip,lat,long,city_pop,job,dob,trans_num,unix_time,merch_lat,merch_long,is_fraud
0,2024-06-21 12:14:25,4000000000000001,fraud_Shop A,grocery_pos,12.5,Ann,Lee,F,1 Main St,Town,ca,01234,40.5,-100.25,1200,"Engineer, civil",1980-06-01,t0,1718972065,40.6,-100.3,0
1,2024-06-21 23:59:59,4000000000000001,fraud_Shop B,travel,999.99,Ann,Lee,F,1 Main St,Town,ca,01234,40.5,-100.25,1200,"Engineer, civil",1980-06-01,t1,1719014399,41.9,-101.5,1
2,2024-06-22 00:10:00,4000000000000002,fraud_Shop C,misc_net,abc,Bo,Kim,M,2 Oak Rd,City,NY,00501,41.0,-74.0,600000,Clerk,1990-01-31,t2,1719015000,41.1,-74.1,0
"""


def test_csv_with_unnamed_index_quotes_and_text_dates(spark):
    d = _fresh()
    with open(f"{d}/raw.csv", "w") as fh:
        fh.write(CSV_TEXT)
    raw = read_raw_csv(spark, f"{d}/raw.csv")
    strict = cleaning.clean(raw)
    try:
        strict.collect()
        raise AssertionError("malformed amount must fail a strict clean")
    except Exception as exc:  # ANSI cast error
        assert "abc" in str(exc) or "CAST" in str(exc).upper()
    c = cleaning.clean(raw, permissive=True)
    rows = {r.transaction_id: r for r in c.collect()}
    assert rows["t0"].zip_code == "01234" and rows["t0"].state == "CA" and rows["t0"].job == "Engineer, civil"
    assert str(rows["t1"].amount) == "999.99" and rows["t1"].transaction_hour == 23
    assert "t2" not in rows
    v = cleaning.validated(c)
    assert sorted(r.transaction_id for r in v.collect()) == ["t0", "t1"]
    from txnlens.operators.features import features

    f = {r.transaction_id: r for r in features(v).collect()}
    assert f["t0"].customer_age == 44 and f["t0"].city_tier == "Rural"


def test_cli_permissive_drops_and_counts(spark, capsys):
    import json

    from txnlens.__main__ import main

    d = _fresh()
    with open(f"{d}/raw.csv", "w") as fh:
        fh.write(CSV_TEXT)
    main(["--input", f"{d}/raw.csv", "--out", f"{d}/out", "--reports", "clean_transactions,fraud_summary", "--permissive"])
    paths = json.loads(capsys.readouterr().out)
    rejected = spark.read.parquet(paths["rejected_rows"]).collect()
    assert [(r.trans_num, r.amt, [tuple(x) for x in r.reasons]) for r in rejected] == [("t2", "abc", [("amt", "abc", "malformed")])]
    assert sorted(r.transaction_id for r in spark.read.parquet(paths["clean_transactions"]).collect()) == ["t0", "t1"]
    assert spark.read.parquet(paths["fraud_summary"]).first().total_transactions == 2


def test_permissive_run_routes_every_row_in_one_scan(spark):
    from txnlens.plans.batch import MaterializedStages
    from txnlens.sources.fixture import raw_transactions

    raw = raw_transactions(spark, SF_SMALL)
    plan = cleaning.route(raw)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
    stages = MaterializedStages(spark, raw, out_dir=_fresh(), defer_features=True, permissive=True)
    clean, rejected = stages.get("clean"), stages.rejected
    assert clean.count() + rejected.count() == raw.count() and rejected.count() > 0
    assert clean.exceptAll(cleaning.clean(raw)).count() == 0 and clean.count() == cleaning.clean(raw).count()
    assert {x.reason for r in rejected.collect() for x in r.reasons} == {"missing"}
