"""Spark-vs-DuckDB comparison used by the tests (mirrors the driver's check).

Run standalone:  python tests/oracle_compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as _dt
import math
import os
import sys

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _canon(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (1, "nan")
        return (1, repr(round(v, 6) + 0.0))
    if isinstance(v, bool):
        return (1, repr(int(v)))
    if isinstance(v, _dt.datetime):
        if (v.hour, v.minute, v.second, v.microsecond) == (0, 0, 0, 0):
            return (1, v.date().isoformat())
        return (1, v.isoformat())
    if isinstance(v, _dt.date):
        return (1, v.isoformat())
    return (1, repr(v))


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_canon(None if (x is not None and not isinstance(x, str) and _isnull(x)) else _py(x))
                         for x in rec))
    return cols, sorted(out)


def _isnull(x):
    try:
        import pandas as pd

        return bool(pd.isna(x))
    except (TypeError, ValueError):
        return False


def _py(x):
    import numpy as np
    import pandas as pd

    if isinstance(x, pd.Timestamp):
        return x.to_pydatetime()
    if isinstance(x, np.integer):
        return int(x)
    if isinstance(x, np.floating):
        return float(x)
    return x


def compare(spark, sf_dir: str, name: str, con=None):
    import __spark_entry__ as E

    con = con or duck(sf_dir)
    sdf = E.queries()[name](spark, sf_dir)
    spdf = sdf.toPandas()
    sql = E.oracle_sql().get(name)
    result = {"name": name, "spark_rows": len(spdf)}
    if sql is None:
        result["oracle"] = False
        return result
    dpdf = con.execute(sql).df()
    result["oracle_rows"] = len(dpdf)
    scols, srows = rows_of(spdf)
    dcols, drows = rows_of(dpdf)
    result["cols_match"] = scols == dcols
    result["rows_match"] = len(srows) == len(drows)
    result["values_match"] = srows == drows
    if not result["values_match"] and result["cols_match"]:
        diff = [(a, b) for a, b in zip(srows, drows) if a != b]
        result["first_diff"] = diff[:2]
        result["n_diff"] = len(diff)
    if not result["cols_match"]:
        result["cols"] = (scols, dcols)
    return result


if __name__ == "__main__":
    from txnlens.plans.session import local_session
    import __spark_entry__ as E

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(E.oracle_sql())
    spark = local_session(8)
    con = duck(sf)
    bad = 0
    for n in names:
        try:
            r = compare(spark, sf, n, con)
        except Exception as exc:  # report and continue
            r = {"name": n, "error": repr(exc)[:600]}
        ok = r.get("values_match") and r.get("cols_match")
        bad += not ok
        print(("OK  " if ok else "BAD ") + repr(r)[:1500], flush=True)
    print(f"{len(names) - bad}/{len(names)} match")
