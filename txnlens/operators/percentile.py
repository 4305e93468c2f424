"""Exact continuous percentiles (PERCENTILE_CONT) as one lazy plan that shuffles counts, not rows.

Spark's exact ``percentile`` keeps a value -> count map per group in one task; with two
groups (fraud and legitimate) over raw doubles that map grows with the data.  Here values
fall into buckets that keep their order: sign, binary exponent and the leading ``_BITS`` bits of
the mantissa.

1. Rows are counted per (group, bucket); partial sums leave a task as some ten thousand rows
   at most for each power of two that the values span.  Running counts over them tell which
   buckets hold a rank.  Those, a few a probability, come back as a scalar subquery.
2. A second scan keeps the rows of these buckets only, and counts them per value.
3. Running counts over the values of the chosen buckets and the sums of all others read off
   every rank.  A chosen bucket has some ``2 ** -(_BITS + 1)`` of the rows between two powers of two,
   equal values are one row.

No group is ever in one task, no count of groups or values switches the plan, no job runs
when the report is defined.  Interpolation follows ``lo + (hi - lo) * frac`` with ``pos = (n - 1) * p``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BITS = 16
_INFINITE, _NAN = 4000, 5000  # beyond every exponent, which lie between -1074 and 1024
_SHIFT = 1100  # makes exponents positive, so that the sign can order them


def _bucket(v: str) -> Column:
    """The bucket of the DOUBLE column ``v``, a BIGINT in the values' order; NaN is the largest value, as in Spark's order."""
    place = 1 << _BITS + 2
    exponent = f"floor(log2(abs({v})))"
    return F.expr(f"""cast(case
        when isnan({v}) then {_NAN * place}
        when abs({v}) = double('infinity') then signum({v}) * {_INFINITE * place}
        when {v} = 0 then 0
        else signum({v}) * (({exponent} + {_SHIFT}) * {place} + floor(abs({v}) / pow(2D, {exponent}) * {1 << _BITS})) end as bigint)""")


def exact_percentiles(df: DataFrame, keys, value, probs: dict, *, extra_aggs: dict | None = None) -> DataFrame:
    """Per-group exact continuous percentiles.

    ``probs`` maps output column name -> probability.  Returns one row per group with the key
    columns, any ``extra_aggs`` (name -> aggregate Column) and one DOUBLE column per
    probability.  NULL values are ignored, as in SQL; a group of NULLs only has NULL percentiles.
    """
    keys, extra_aggs = list(keys), extra_aggs or {}
    group = F.struct(*keys) if keys else F.struct(F.lit(0))  # as a struct, NULL keys equal each other
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = df.select(group.alias("_g"), v.alias("_v")).where(F.col("_v").isNotNull()).withColumn("_b", _bucket("_v"))

    def running(counts: DataFrame, order: str) -> DataFrame:
        """Counts up to each row of its group, and of the whole group."""
        return counts.selectExpr("*", f"sum(_c) over (partition by _g order by {order} rows unbounded preceding) as _upto", "sum(_c) over (partition by _g) as _n")

    def holds(p: float, side: str) -> str:
        rank = f"{side}((_n - 1) * {float(p)!r}D)"
        return f"(_upto - _c <= {rank} and {rank} < _upto)"

    buckets = rows.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_c"))
    any_rank = " or ".join(holds(p, side) for p in probs.values() for side in ("floor", "ceil"))
    # in one task: of each group there is one row a bucket
    chosen = running(buckets.repartition(1), "_b").where(any_rank).agg(F.collect_set("_b")).scalar()
    values = rows.where(F.array_contains(chosen, F.col("_b"))).groupBy("_g", "_b", "_v").agg(F.count(F.lit(1)).alias("_c"))
    both = values.unionByName(buckets.withColumn("_v", F.lit(None).cast("double")))
    # a bucket whose values follow it counts through these
    both = both.selectExpr("_g", "_b", "_v", "if(_v is null and lead(_b) over (partition by _g order by _b, _v nulls first) <=> _b, 0, _c) as _c")

    def percentile(p: float, name: str) -> Column:
        lo, hi = (f"max(if({holds(p, side)}, _v, null))" for side in ("floor", "ceil"))
        at = f"max((_n - 1) * {float(p)!r}D)"
        return F.expr(f"if({lo} = {hi}, {lo}, {lo} + ({hi} - {lo}) * ({at} - floor({at})))").alias(name)

    percentiles = running(both, "_b, _v nulls first").groupBy("_g").agg(*[percentile(p, name) for name, p in probs.items()])
    rest = df.groupBy(group.alias("_g")).agg(F.count(F.lit(1)).alias("_n"), *[c.alias(name) for name, c in extra_aggs.items()])
    found = rest.join(percentiles, "_g", "left")
    return found.select(*[F.col("_g")[k].alias(k) for k in keys], *extra_aggs, *probs)
