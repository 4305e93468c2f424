"""Clean (CTAS staging table) and validate (view) — narrow, shuffle-free stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S

CLEAN_COLUMNS = [
    "transaction_id", "card_number", "transaction_ts", "transaction_date", "transaction_hour",
    "merchant_name", "merchant_raw", "category", "amount", "first_name", "last_name", "full_name",
    "gender", "date_of_birth", "street", "city", "state", "zip_code", "customer_lat", "customer_long",
    "merchant_lat", "merchant_long", "city_pop", "job", "unix_time", "is_fraud",
]


def _caster(permissive: bool):
    def cast(c, t: str) -> Column:
        x = F.col(c) if isinstance(c, str) else c
        return x.try_cast(t) if permissive else x.cast(t)

    return cast


#: The zip is a VARCHAR(10): longer text is cut.
ZIP_LENGTH = 10
#: Staging columns of the critical fields that are cast.
CRITICAL = ("transaction_ts", "card_number", "amount", "is_fraud")
#: Raw cell of each critical field -> the staging column made of it.
CRITICAL_CELLS = {"trans_num": "transaction_id", "cc_num": "card_number", "trans_date_trans_time": "transaction_ts", "amt": "amount", "is_fraud": "is_fraud"}
MISSING, MALFORMED = "missing", "malformed"


def clean(raw: DataFrame, permissive: bool = False) -> DataFrame:
    """Rename, cast and derive the 26 staging columns; drop rows missing a critical field.

    ``permissive=False`` (default) casts strictly: malformed text fails the job
    under ANSI mode instead of silently becoming NULL.  ``permissive=True`` uses
    ``try_cast`` and drops rows whose critical casts fail; :func:`route` keeps them,
    with the reason.  The NULL filter is applied on raw columns first, so for
    Parquet it is pushed into the scan.
    """
    kept = raw.filter(F.expr(" and ".join(f"{c} is not null" for c in CRITICAL_CELLS)))
    staged = kept.select(*_staged(permissive))
    return staged.dropna(how="any", subset=list(CRITICAL)) if permissive else staged


def _staged(permissive: bool) -> list[Column]:
    cast = _caster(permissive)
    ts = cast("trans_date_trans_time", "timestamp_ntz")
    return [
        F.col("trans_num").cast("string").alias("transaction_id"),
        cast("cc_num", "bigint").alias("card_number"),
        ts.alias("transaction_ts"),
        F.to_date(ts).alias("transaction_date"),
        F.hour(ts).alias("transaction_hour"),
        F.replace(F.col("merchant"), F.lit("fraud_"), F.lit("")).alias("merchant_name"),
        F.col("merchant").alias("merchant_raw"),
        F.col("category"),
        F.round(cast(cast("amt", "double"), "decimal(12,2)"), 2).cast("decimal(12,2)").alias("amount"),
        F.col("first").alias("first_name"),
        F.col("last").alias("last_name"),
        F.concat(F.coalesce(F.col("first"), F.lit("")), F.lit(" "), F.coalesce(F.col("last"), F.lit(""))).alias("full_name"),
        F.upper("gender").alias("gender"),
        F.col("dob").alias("date_of_birth"),
        F.col("street"),
        F.col("city"),
        F.upper("state").alias("state"),
        F.substring(F.col("zip").cast("string"), 1, ZIP_LENGTH).alias("zip_code"),
        cast("lat", "decimal(9,6)").alias("customer_lat"),
        cast("long", "decimal(9,6)").alias("customer_long"),
        cast("merch_lat", "decimal(9,6)").alias("merchant_lat"),
        cast("merch_long", "decimal(9,6)").alias("merchant_long"),
        cast("city_pop", "bigint").alias("city_pop"),
        F.col("job"),
        cast("unix_time", "bigint").alias("unix_time"),
        cast("is_fraud", "smallint").alias("is_fraud"),
    ]


def route(raw: DataFrame) -> DataFrame:
    """Every raw row, staged, with what is wrong with it: one projection for the clean and the rejected rows.

    ``reasons`` lists the critical cells that are missing or malformed, as (``cell``, ``text``,
    ``reason``); it is empty for a clean row.  ``raw`` holds a rejected row as it came.
    """
    routed = raw.select(*_staged(permissive=True), F.struct(*[F.col(f"`{c}`") for c in raw.columns]).alias("raw"))

    def reason(cell: str, column: str) -> Column:
        text = F.col("raw")[cell].cast("string")
        found = F.struct(F.lit(cell).alias("cell"), text.alias("text"), F.when(text.isNull(), MISSING).otherwise(MALFORMED).alias("reason"))
        return F.when(F.col(column).isNull(), found)

    reasons = F.array_compact(F.array(*[reason(cell, column) for cell, column in CRITICAL_CELLS.items()]))
    return routed.withColumn("reasons", reasons).withColumn("raw", F.when(F.size("reasons") > 0, F.col("raw")))


def rejected(routed: DataFrame) -> DataFrame:
    """The rejected rows of a routed table: ``reasons`` and the raw cells."""
    return routed.where(F.size("reasons") > 0).select("reasons", "raw.*")


def rejected_rows(raw: DataFrame) -> DataFrame:
    """How many rows a permissive clean drops, by cell and reason (a row counts under each of its reasons)."""
    reasons = rejected(route(raw)).select(F.explode("reasons").alias("r"))
    return reasons.groupBy(F.col("r.cell").alias("cell"), F.col("r.reason").alias("reason")).agg(F.count(F.lit(1)).alias("rejected_rows"))


def _in_range(c: str, bounds) -> Column:
    return F.col(c).between(*bounds)


def validated(clean_df: DataFrame) -> DataFrame:
    """Rows with a positive amount, a 0/1 label, US coordinates and gender M/F."""
    return clean_df.filter(
        (F.col("amount") > 0)
        & F.col("is_fraud").isin(*S.VALID_LABELS)
        & _in_range("customer_lat", S.LAT_RANGE) & _in_range("customer_long", S.LONG_RANGE)
        & _in_range("merchant_lat", S.LAT_RANGE) & _in_range("merchant_long", S.LONG_RANGE)
        & F.col("gender").isin(*S.VALID_GENDERS))
