"""Batch run: materialise the staging and feature tables once, then every report.

The feature table is read by some 40 reports; it is written once as Parquet (not
``cache()``d) so each report gets column pruning and predicate pushdown at the
scan, and so executor loss never forces recomputing the feature join.  Where
it is written comes from the session's ``spark.checkpoint.dir`` (a shared
folder on a cluster); a local folder is only created when that is unset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning
from ..operators.features import features as build_features
from ..sources.sinks import create_view, shared_dir, write_table
from .catalog import CATALOG, Stages

#: Reports that are a stage's table itself: their path is that table, which is not written again.
TABLE_REPORTS = {"clean_transactions": "clean", "fraud_features": "features"}
VIEW_NAMES = {"transactions_clean": "clean", "transactions_validated": "validated",
              "transaction_features": "features"}


def read_features(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """The feature table written at ``path``, of the days ``first`` to ``last``.

    Of a table partitioned by month only the months of these days are read.
    """
    f = spark.read.parquet(path)
    monthly = "txn_month" in f.columns
    for day, op in ((first, ">="), (last, "<=")):
        if day is not None:
            f = f.where(f"transaction_date {op} date'{day}'")
            if monthly:
                f = f.where(f"txn_month {op} '{day[:7]}'")
    return f.drop("txn_month") if monthly else f


class MaterializedStages(Stages):
    """Stages whose clean and features tables were written to storage.

    With ``defer_features=True`` only the clean table is written by the
    constructor; :meth:`materialize_features` builds the feature table later
    (so reports that need only ``clean`` can run meanwhile).
    """

    def __init__(self, spark: SparkSession, raw: DataFrame, raw_dups: DataFrame | None = None,
                 out_dir: str | None = None, partition_features_by_month: bool = False,
                 max_rows_per_file: int | None = 2_000_000, defer_features: bool = False, permissive: bool = False):
        super().__init__(raw, raw_dups, permissive)
        self.spark = spark
        self.out_dir = out_dir or shared_dir(spark, "txnlens")
        self.partition_features_by_month = partition_features_by_month
        self.max_rows_per_file = max_rows_per_file
        self.features_path = f"{self.out_dir}/features"
        if permissive:
            # one pass over the raw rows writes both kinds, each to a folder of its own
            status = F.when(F.size("reasons") > 0, "rejected").otherwise("clean")
            routed = cleaning.route(raw).withColumn("status", status)
            write_table(routed, f"{self.out_dir}/routed", ["status"], max_rows_per_file=max_rows_per_file)
            held = spark.read.schema(routed.schema).parquet(f"{self.out_dir}/routed")
            self.clean_path = f"{self.out_dir}/routed/status=clean"
            clean_df = held.where("status = 'clean'").select(*cleaning.CLEAN_COLUMNS)
            self.rejected = cleaning.rejected(held.where("status = 'rejected'"))
        else:
            self.clean_path = f"{self.out_dir}/clean"
            write_table(cleaning.clean(raw), self.clean_path, max_rows_per_file=max_rows_per_file)
            clean_df = spark.read.parquet(self.clean_path)
        self._cache["clean"] = clean_df
        self._cache["validated"] = cleaning.validated(clean_df)
        if not defer_features:
            self.materialize_features()

    def materialize_features(self) -> DataFrame:
        feats = build_features(self._cache["validated"])
        part = None
        if self.partition_features_by_month:
            feats = feats.withColumn("txn_month", F.date_format("transaction_date", "yyyy-MM"))
            part = ["txn_month"]
        write_table(feats, self.features_path, part, max_rows_per_file=self.max_rows_per_file)
        f = self.spark.read.parquet(self.features_path)
        self._cache["features"] = f.drop("txn_month") if self.partition_features_by_month else f
        # CREATE VIEW equivalents, for ad-hoc SQL over the same tables.
        for name, stage in VIEW_NAMES.items():
            create_view(self._cache[stage], name)
        return self._cache["features"]


def write_reports(stages: Stages, names, out_dir: str, concurrency: int = 4) -> dict[str, str]:
    """Write each named report as Parquet; up to ``concurrency`` Spark jobs run at once.

    Reports are independent reads of the materialised tables, so they are
    submitted from a small thread pool.  Each worker thread uses its own
    scheduler pool, so under ``spark.scheduler.mode=FAIR`` one large report
    cannot starve the others.
    """
    import itertools
    import threading
    from concurrent.futures import ThreadPoolExecutor

    sc = stages.raw.sparkSession.sparkContext
    numbers, local = itertools.count(), threading.local()

    def one(name: str) -> tuple[str, str]:
        if not hasattr(local, "pool"):
            local.pool = f"txnlens-{next(numbers)}"
        sc.setLocalProperty("spark.scheduler.pool", local.pool)
        path = f"{out_dir}/reports/{name}"
        write_table(stages.run(name), path)
        return name, path

    names = list(names)
    if concurrency <= 1:
        return dict(one(n) for n in names)
    with ThreadPoolExecutor(max_workers=concurrency) as pool:
        return dict(pool.map(one, names))


def run_all(spark: SparkSession, raw: DataFrame, out_dir: str | None = None, names=None,
            raw_dups: DataFrame | None = None, partition_features_by_month: bool = False,
            concurrency: int = 4, permissive: bool = False) -> dict[str, str]:
    """Write every report (or ``names``) as Parquet under ``out_dir``; return name -> path.

    The clean table is written first; the feature table is then built while
    the reports that need only ``clean`` / ``validated`` already run.  The clean and the
    feature table are their own reports (``TABLE_REPORTS``); with
    ``partition_features_by_month`` the latter has ``txn_month`` besides.  A ``permissive``
    run sends rows with missing or malformed critical fields, and the reasons, to the table ``rejected_rows``.
    """
    from concurrent.futures import ThreadPoolExecutor

    names = list(names or CATALOG)
    stages = MaterializedStages(spark, raw, raw_dups, out_dir, partition_features_by_month, defer_features=True,
                                permissive=permissive)
    tables = {n: {"clean": stages.clean_path, "features": stages.features_path}[TABLE_REPORTS[n]] for n in names if n in TABLE_REPORTS}
    early = [n for n in names if n not in tables and CATALOG[n].stage != "features"]
    late = [n for n in names if n not in tables and CATALOG[n].stage == "features"]
    with ThreadPoolExecutor(max_workers=1) as builder:
        built = builder.submit(stages.materialize_features)
        paths = write_reports(stages, early, stages.out_dir, max(concurrency - 1, 1))
        built.result()
    paths.update(write_reports(stages, late, stages.out_dir, concurrency))
    paths = {n: (paths | tables)[n] for n in names}
    if permissive:
        paths["rejected_rows"] = f"{stages.out_dir}/reports/rejected_rows"
        write_table(stages.rejected, paths["rejected_rows"])
    return paths
