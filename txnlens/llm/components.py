"""Connected components of a table of links, by alternating large and small stars.

Each round sends links to the smallest known node: first from every node to its larger
neighbours, then from every node to its smaller ones. Groups are reduced to their
minimum with partial sums, written, and joined back, so a node with very many links is
not gathered and Spark can split it; the number of links never grows. A round's links are
written to the shared folder; the rounds end when one changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.llm import common


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` for each node of a link; the component is its smallest node. Nodes are BIGINT."""
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    held = common.keep(links.where(F.col(a) != F.col(b)).select(u, v).distinct(), "links")
    before = _state(held)
    while before[0]:
        both = held.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(held.select(F.col("v").alias("n"), F.col("u").alias("m")))
        least = common.keep(both.groupBy("n").agg(F.min("m").alias("r")).select("n", F.least("n", "r").alias("r")), "least")
        large = both.join(least, "n").where("m > n").select(F.col("m").alias("u"), F.col("r").alias("v")).distinct()
        large = common.keep(large, "large")
        least = common.keep(large.groupBy("u").agg(F.min("v").alias("r")), "least")
        small = large.join(least, "u").where("v != r").select(F.col("v").alias("u"), F.col("r").alias("v"))
        held = common.keep(small.unionByName(least.select("u", F.col("r").alias("v"))).distinct(), "links")
        after = _state(held)
        if after == before:
            break
        before = after
    return held.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(held.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
