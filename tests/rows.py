"""Hand-made raw rows for unit tests (typed raw schema, sensible defaults)."""

import datetime as dt
from decimal import Decimal

from txnlens.schema import RAW_COLUMNS, RAW_TYPED_SCHEMA

BASE = dict(
    idx=0, trans_date_trans_time=dt.datetime(2024, 3, 5, 12, 0, 0), cc_num=4000000000000001,
    merchant="fraud_Shop_A", category="grocery_pos", amt=10.0, first="Ann", last="Lee", gender="F",
    street="1 Main St", city="Town", state="ca", zip="01234", lat=40.0, long=-100.0, city_pop=1000,
    job="Clerk", dob=dt.date(1980, 6, 1), trans_num="t0", unix_time=0,
    merch_lat=Decimal("40.100000"), merch_long=Decimal("-100.100000"), is_fraud=0,
)


def raw_rows(spark, *overrides):
    rows = []
    for i, o in enumerate(overrides):
        r = dict(BASE)
        r["idx"] = i
        r["trans_num"] = f"t{i}"
        r.update(o)
        rows.append(tuple(r[c] for c in RAW_COLUMNS))
    return spark.createDataFrame(rows, RAW_TYPED_SCHEMA)
