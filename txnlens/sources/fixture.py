"""Derive a raw card-transaction table from the driver's ``events`` table.

The derivation (see FIXTURES.md §3) is pure integer / decimal arithmetic on
each event row, so it is one narrow projection: it scales with ``events`` and
gives the same values in Spark and in the DuckDB oracle.  Dirty rows (NULLs,
bad labels, out-of-range coordinates, unlisted categories, mixed-case
gender/state) are planted deliberately so every audit finds something.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.semantics import EPOCH_NTZ
from ..schema import KNOWN_CATEGORIES, RAW_COLUMNS

# Fixed values of the fixture: state codes, in the order indexed by user_id % 12.
FIXTURE_STATES = ("ak", "AL", "CA", "co", "FL", "GA", "NY", "oh", "PA", "TX", "wa", "WY")


def _pick(index: Column, values) -> Column:
    """values[index] for a 0-based integer index column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def raw_from_events(events: DataFrame, with_duplicates: bool = False) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("int")
    secs = F.timestamp_diff("SECOND", F.expr(EPOCH_NTZ), F.col("ts")) + (u % 6) * 31 * 86400
    m = e * 5 + F.col("_k")
    category = (F.when(m % 29 == 0, F.lit(None).cast("string"))
                .when(m % 29 == 1, F.lit("unlisted"))
                .otherwise(_pick(m % 14, KNOWN_CATEGORIES)))
    amt = (F.when(e % 101 == 1, F.lit(None).cast("double"))
           .when(e % 97 == 1, F.lit(0.0))
           .when(e % 103 == 1, -F.col("value"))
           .when(e == 777, F.lit(26000.0))
           .when(e % 10 == 0, F.col("value") * 9.0)
           .otherwise(F.col("value")))
    gender = F.when(u % 20 == 13, "x").when(u % 2 == 0, "m").otherwise("F")
    shift = F.when(e % 211 == 2, 3).when(e % 307 == 2, 6).otherwise(0)
    merch_lat = F.when(e % 113 == 1, F.lit(0).cast("decimal(9,6)")).otherwise(
        (25 + (u % 23) + ((e % 41) - 20) * F.lit(0.05).cast("decimal(3,2)") + shift).cast("decimal(9,6)"))
    merch_long = (-120 + (u % 50) + ((e % 37) - 18) * F.lit(0.06).cast("decimal(3,2)")).cast("decimal(9,6)")
    is_fraud = (F.when(e % 137 == 1, F.lit(None).cast("int"))
                .when(e % 131 == 1, F.lit(2))
                .when((F.col("event_type") == "error") & (F.col("_k") % 4 == 0), F.lit(1))
                .otherwise(F.lit(0)))
    raw = (events.withColumn("_k", k).withColumn("_secs", secs)
           .select(
               e.alias("idx"),
               F.timestamp_add("SECOND", F.col("_secs"), F.expr(EPOCH_NTZ)).alias("trans_date_trans_time"),
               (F.lit(4000000000000000) + u).alias("cc_num"),
               F.concat(F.lit("fraud_Merchant_"), ((e * 7) % 40).cast("string")).alias("merchant"),
               category.alias("category"),
               amt.alias("amt"),
               F.concat(F.lit("First"), (u % 50).cast("string")).alias("first"),
               F.concat(F.lit("Last"), u.cast("string")).alias("last"),
               gender.alias("gender"),
               F.concat(u.cast("string"), F.lit(" Main St")).alias("street"),
               F.concat(F.lit("City"), (u % 37).cast("string")).alias("city"),
               _pick(u % 12, FIXTURE_STATES).alias("state"),
               F.concat((1000 + u).cast("string"), F.when(u % 50 == 7, "-123456789").otherwise("")).alias("zip"),
               (25 + (u % 23)).cast("double").alias("lat"),
               (-120 + (u % 50)).cast("double").alias("long"),
               (300 + 25 * F.pow(u % 37, 3).cast("bigint")).alias("city_pop"),
               F.concat(F.lit("Job"), (u % 30).cast("string")).alias("job"),
               F.date_add(F.lit("1930-01-01").cast("date"), ((u * 1373) % 27000).cast("int")).alias("dob"),
               F.when(e % 127 == 1, F.lit(None).cast("string"))
                .otherwise(F.concat(F.lit("t"), e.cast("string"))).alias("trans_num"),
               F.col("_secs").alias("unix_time"),
               merch_lat.alias("merch_lat"),
               merch_long.alias("merch_long"),
               is_fraud.alias("is_fraud"),
           ))
    if with_duplicates:
        raw = raw.unionByName(raw.filter(F.col("idx") % 250 == 0))
    return raw.select(*RAW_COLUMNS)


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")


#: HotSpot compiles no method with more bytes of bytecode than this.
COMPILED_METHOD = 8000


def raw_transactions(spark: SparkSession, sf_dir: str, with_duplicates: bool = False) -> DataFrame:
    # Filters on derived columns become one long method over the event's columns, which the JVM
    # would interpret; above this length Spark evaluates in short ones.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(COMPILED_METHOD))
    return raw_from_events(load_events(spark, sf_dir), with_duplicates)
