"""Prepares ``documents`` for training: each stage works on all that the one before it kept.

1. quality: documents that the quality classifier rejects go;
2. near_duplicates: of each group of near duplicates (SimHash) one document stays;
3. repeated_bytes: byte strings that occur more than once are cut out of the texts, as are
   characters that a cut leaves incomplete; ``n_chars`` follows, and no document goes;
4. benchmark: documents that hold a benchmark item go;
5. tokens: the texts are encoded, and decoded again.

Each stage but the last returns the columns of its input. Rows are addressed by id and
text, so that repeated ids and null ids keep their own decisions; of rows equal in both,
one passes the second stage. A missing column other than ``doc_id`` and ``text`` is no error, and
other columns are passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlens.llm import common
from txnlens.llm.bpe import digests
from txnlens.llm.decontaminate import matches
from txnlens.llm.quality import accepted
from txnlens.llm.simhash import near_duplicates
from txnlens.llm.suffix_dedup import suffix_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    stays = near_duplicates(docs).where("stays").select(F.coalesce("doc_id", F.lit(common.NO_ID)).alias("__did"), F.col("crc").alias("__crc")).distinct()
    kept = common.addressed(docs).join(stays, ["__did", "__crc"], "left_semi")
    return kept.dropDuplicates(["__did", "__crc"]).select(*docs.columns)


def repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = [c for c in docs.columns if c != "text"]
    texts = suffix_dedup(docs, others, as_text=True).select("row", F.col("kept").alias("text"))
    columns = {"text": F.col("text"), "n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in others else None}
    return texts.select(*[columns.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = matches(common.keyed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = common.keep(found.select(F.col("did").alias("__did"), F.col("crc").alias("__crc")).distinct(), "leaks")
    return common.addressed(docs).join(common.small(leaks), ["__did", "__crc"], "left_anti").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return digests(docs)


STAGES = [("quality", quality), ("near_duplicates", near_dups), ("repeated_bytes", repeated_bytes), ("benchmark", benchmark), ("tokens", tokens)]

#: SQL can't express the classifier, the suffix array or the encoding; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
