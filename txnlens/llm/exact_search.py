"""Exact top-k search by inner product: a vector-approximation file scanned block by block.

Components are integers, ``floor(scale * x)`` of each component as double. The score of two
vectors of one length is their inner product. For each query the ``k`` highest scores among
all other rows are returned, ties to the smaller ``vec_id``.

1. Rows are numbered in a written table. Rows of one length are dealt into parts of about
   ``PART_BYTES`` of components, queries into blocks of the same size. A task is one part
   against one block of queries, so a task's size is set by the parameter, not by the data.
2. In a task the part becomes a vector-approximation file: each dimension's range is cut
   into ``2 ** BITS`` cells of equal width, a vector is kept as one cell number a dimension.
   Scanning the cells gives for each query and vector a lower and an upper bound of the score.
3. A vector whose upper bound lies below the ``k``-th highest lower bound is out. The others'
   exact vectors are read in the order of their upper bounds, ``READ`` at a time, until no
   bound left reaches the ``k``-th exact score.
4. The parts' results, ``k`` rows a query and part, are merged by rank.

Results for odd input: vectors that are null or hold null or non-finite components take no
part, neither as query nor as candidate; vectors of different length do not meet; empty
vectors score 0 with each other; zero vectors take part; a null ``vec_id`` is no query, and
as a candidate it ranks last among equal scores; of rows with one ``vec_id`` each is a row
of its own, so that a repeated query is asked once a row and finds its other copies; fewer
than ``k`` candidates give fewer rows; a score beyond BIGINT counts as the nearest of
``-(2**63 - 1)`` and ``2**63 - 1``;
an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnlens.llm import common

SCALE, K, EVERY = 256, 5, 50
BITS = 6
PART_BYTES = 4 << 20
#: Exact vectors that a query reads in one go, and queries scanned in one go.
READ, SCAN = 16, 256
_MOST = (1 << 63) - 1

_FOUND = "query long, query_id long, vec_id long, row long, score long"


def _integers(column: pa.Array, size: int, scale: int) -> np.ndarray:
    """``floor(scale * x)`` as integral doubles; as Python integers where a double would overflow."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size)
    with np.errstate(over="ignore"):
        whole = np.floor(x * scale)
    if np.isfinite(whole).all():
        return whole
    return np.array([[int(v) * scale if abs(v) > 2.0**60 else int(np.floor(v * scale)) for v in row] for row in x], dtype=object)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the integral vectors ``a`` with ``b``: exact, then clipped to what BIGINT holds."""
    if not a.size:
        return np.zeros(len(a), dtype=np.int64)
    if a.dtype != object and np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0**53:
        return (a @ b).astype(np.int64)
    ints = np.frompyfunc(int, 1, 1)
    return np.array([min(max(int(v), -_MOST), _MOST) for v in (ints(a) * ints(b)).sum(1)], dtype=np.int64)


class Cells:
    """The approximation file of one part: per dimension an origin, a cell width and each vector's cell."""

    def __init__(self, x: np.ndarray):
        self.low = x.min(0)
        self.width = np.maximum(1.0, np.ceil((x.max(0) - self.low + 1) / (1 << BITS)))
        self.cell = np.minimum((x - self.low) // self.width, (1 << BITS) - 1).astype(np.uint8)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all scores; cells hold integers only, so a cell's last value is its width less one from its first."""
        corner = (queries * self.width) @ self.cell.T.astype(np.float64) + (queries @ self.low)[:, None]
        slack = queries * (self.width - 1)
        # what rounding in the sums can amount to
        unsure = 1e-12 * (np.abs(queries) @ (np.abs(self.low) + self.width * (1 << BITS)))[:, None] + 1e-9
        return corner + np.minimum(slack, 0).sum(1)[:, None] - unsure, corner + np.maximum(slack, 0).sum(1)[:, None] + unsure


def _refine(query: np.ndarray, at: np.ndarray, high: np.ndarray, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The places and scores of the ``k`` best of the candidates ``at``, best first."""
    at = at[np.argsort(-high[at], kind="stable")]
    places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for i in range(0, len(at), READ):
        if len(places) == k and high[at[i]] < scores[-1]:
            break  # certain: the bounds fall from here on
        read = at[i : i + READ]
        places, scores = np.append(places, read), np.append(scores, _exact(x[read], query))
        order = np.lexsort((rows[places], ids[places], -scores))[:k]
        places, scores = places[order], scores[order]
    return places, scores


def _search(table: pa.Table, k: int, scale: int) -> pa.Table:
    """One task: a block of queries against one part."""
    asks, rows = (table.column(c).to_numpy() for c in ("asks", "row"))
    size = table.column("size")[0].as_py()
    vectors = _integers(table.column("embedding").combine_chunks(), size, scale)
    named = table.column("vec_id").is_valid().to_numpy()
    ids = table.column("vec_id").fill_null(_MOST).to_numpy()
    x, x_ids, x_rows = vectors[~asks], ids[~asks], rows[~asks]
    found: list[tuple] = []
    wide = not size or vectors.dtype == object or np.abs(vectors).max() > 2.0**40
    cells = Cells(x) if len(x) and not wide else None
    asking = np.flatnonzero(asks) if len(x) else np.zeros(0, np.int64)
    for a in range(0, len(asking), SCAN):
        block = asking[a : a + SCAN]
        if cells:
            low, high = cells.bounds(vectors[block])
        else:  # no dimensions, or numbers that bounds in doubles cannot hold: all stay candidates
            low, high = np.full((len(block), len(x)), -np.inf), np.full((len(block), len(x)), np.inf)
        own = rows[block, None] == x_rows
        low[own] = -np.inf
        least = np.partition(low, -k, axis=1)[:, -k] if len(x) > k else np.full(len(block), -np.inf)
        stays = (high >= least[:, None]) & ~own
        for j, r in enumerate(block):
            places, scores = _refine(vectors[r], np.flatnonzero(stays[j]), high[j], x, x_ids, x_rows, k)
            found.append((np.full(len(places), r), places, scores))
    r, places, scores = (np.concatenate(c).astype(np.int64) for c in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 3
    columns = [rows[r], ids[r], pa.array(x_ids[places], mask=~named[~asks][places]), x_rows[places], scores]
    return pa.table([pa.array(c) for c in columns], names=["query", "query_id", "vec_id", "row", "score"])


def exact_search(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, part_bytes: int = PART_BYTES) -> DataFrame:
    """``query_id, rank, vec_id, score`` for each row of ``vectors`` (``vec_id, embedding``) that ``is_query`` picks, against all rows."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    sound = F.expr("embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(is_query, F.lit(False)).alias("picked")).where(sound)
    # written once: the numbers stay the same when a task runs again
    held = common.keep(rows.withColumn("size", F.size("embedding")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    per = F.greatest(F.lit(1), F.floor(F.lit(part_bytes) / (8 * F.greatest(F.col("size"), F.lit(1))))).cast("long")
    sizes = held.groupBy("size").agg(F.count("*").alias("n"), F.sum(F.col("picked").cast("long")).alias("asked")).where("asked > 0")
    sizes = common.keep(sizes.select("size", F.ceil(F.col("n") / per).cast("long").alias("parts"), F.ceil(F.col("asked") / per).cast("long").alias("blocks")), "sizes")
    tasks = sizes.agg(F.coalesce(F.sum(F.col("parts") * F.col("blocks")), F.lit(0))).first()[0]
    # spread by a hash of the row's number, which no value of the data can make hot
    spread = held.join(common.small(sizes), "size").withColumns({"part": F.pmod(F.xxhash64("row"), F.col("parts")), "block": F.pmod(F.xxhash64("row", F.lit(1)), F.col("blocks"))})
    columns = ["size", "part", "block", "row", "vec_id", "embedding"]
    stored = spread.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(*columns, F.lit(False).alias("asks"))
    asked = spread.where("picked").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(*columns, F.lit(True).alias("asks"))
    task = ["size", "part", "block"]
    dealt = stored.unionByName(asked).repartition(max(1, min(int(tasks), 10_000)), *task)
    found = dealt.groupBy(*task).applyInArrow(lambda t: _search(t, k, scale), _FOUND)
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op11_exact_topk(spark, sf_dir: str) -> DataFrame:
    return exact_search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.pmod(F.col("vec_id"), F.lit(EVERY)) == 0)


#: Fit for numbers that a double holds exactly.
ORACLE = f"""
with sound as (
  select row_number() over () as r, vec_id, embedding from embeddings where embedding is not null and vec_id is not null
), parts as (
  select r, vec_id, unnest(embedding) as c, generate_subscripts(embedding, 1) as i from sound
), whole as (
  select r, any_value(vec_id) as vec_id, list(floor({SCALE} * c::double) order by i) as x from parts
  group by r having bool_and(coalesce(isfinite(c), false))
), pairs as (
  select q.r as q, q.vec_id as query_id, c.vec_id as vec_id, c.r as r, list_inner_product(q.x, c.x)::bigint as score
  from whole q join whole c on q.r <> c.r and len(q.x) = len(c.x) where q.vec_id % {EVERY} = 0
)
select query_id, (row_number() over (partition by q order by score desc, vec_id, r))::integer as rank, vec_id, score
from pairs qualify rank <= {K}
"""
