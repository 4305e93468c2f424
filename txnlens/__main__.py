"""Batch entry point (``python -m txnlens``, or this file given to ``spark-submit``).

    python -m txnlens --input s3://bucket/raw/ --format csv --out s3://bucket/fraud-out/

Reads the raw transactions, writes the clean and feature tables once and then
every report (or ``--reports a,b``) as Parquet.  ``--out`` defaults to a new
folder under the session's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import argparse
import json

from txnlens.plans.catalog import CATALOG
from txnlens.plans.batch import run_all
from txnlens.plans.session import build_session, size_shuffles
from txnlens.sources.raw import read_raw_csv, read_raw_parquet


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="txnlens")
    ap.add_argument("--input", required=True, help="raw transaction files (CSV with header, or Parquet)")
    ap.add_argument("--format", choices=["csv", "parquet"], default="csv")
    ap.add_argument("--out", default=None, help="output folder (default: under spark.checkpoint.dir)")
    ap.add_argument("--reports", default=None, help="comma-separated report names (default: all)")
    ap.add_argument("--partition-by-month", action="store_true", help="partition the feature table by month")
    ap.add_argument("--concurrency", type=int, default=4, help="reports written concurrently (default 4)")
    ap.add_argument("--permissive", action="store_true",
                    help="send rows with missing or malformed critical fields to the table rejected_rows, with the reasons (default: a malformed one fails the run)")
    args = ap.parse_args(argv)

    spark = build_session()
    raw = read_raw_csv(spark, args.input) if args.format == "csv" else read_raw_parquet(spark, args.input)
    size_shuffles(spark, raw)
    names = args.reports.split(",") if args.reports else list(CATALOG)
    unknown = [n for n in names if n not in CATALOG]
    if unknown:
        raise SystemExit(f"unknown reports: {unknown}")
    paths = run_all(spark, raw, args.out, names, partition_features_by_month=args.partition_by_month,
                    concurrency=args.concurrency, permissive=args.permissive)
    print(json.dumps(paths, indent=1))


if __name__ == "__main__":
    main()
