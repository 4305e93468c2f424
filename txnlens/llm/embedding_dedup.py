"""Embedding near-dedup: a subspace pigeonhole join of unit vectors.

Vectors of one label are linked at a cosine of ``threshold`` or more, in double precision.
Unit vectors at that cosine are at most ``sqrt(2 - 2 * threshold)`` apart, and so are their
images under a fixed random rotation. The rotated coordinates are split into blocks of
``BLOCK``; the squared distance is the sum over the blocks, so in one block at least it is
within the block's proportional share of the budget.

1. Equal vectors of a label become one class, with partial sums.
2. Each block is range-joined on a grid: a class stands in its own cell and is copied to
   each greater cell that a box of the block's radius around it touches. Two classes
   within the budget of a block meet in exactly one cell of it.
3. In a cell, all meetings are verified by the exact cosine, as matrix products. A link
   counts in the first block whose budget it keeps, hence once. A cell yields each
   class's number of links and the links of a spanning forest, never its pairs.
4. A cell with more than ``crowd`` members is cut into parts, and each pair of parts is a
   task of its own.
5. Components follow from the forests' links.

Results for odd input: null, empty and zero vectors, vectors with a null or non-finite
component, and vectors without a label link with nothing; vectors of different length do
not link; repeated rows link with each other; a null ``vec_id`` takes part but never names a
component; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.llm import common
from txnlens.llm.components import components

THRESHOLD = 0.98
BLOCK = 4
#: Cell width, in radii of a block.
CELL = 4.0
CROWD = 1024
SEED = 6
MAX_BROADCAST_CELLS = 10_000

_ROTATIONS: dict[int, np.ndarray] = {}


def _rotation(n: int) -> np.ndarray:
    if n not in _ROTATIONS:
        q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(n, n)))
        _ROTATIONS[n] = q * np.sign(np.diag(r))
    return _ROTATIONS[n]


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and rotated ones, of vectors of one length."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return x, x @ _rotation(x.shape[1])


def _budgets(n: int, threshold: float) -> list[tuple[int, int, float]]:
    """First and last coordinate of each block, and its share of the squared distance."""
    return [(a, min(a + BLOCK, n), (2 - 2 * threshold + 1e-9) * (min(a + BLOCK, n) - a) / n) for a in range(0, n, BLOCK)]


def _cells(batches: Iterator[pa.RecordBatch], threshold: float, payload: bool) -> Iterator[pa.RecordBatch]:
    """``label, size, block, cell, home`` of each class, and its vector if asked for."""
    for batch in batches:
        sizes = batch.column("size").to_numpy()
        for n in np.unique(sizes):
            rows = batch.filter(pa.array(sizes == n))
            _, y = _units(rows.column("embedding"))
            for block, (a, b, budget) in enumerate(_budgets(int(n), threshold)):
                radius = np.sqrt(budget) * (1 + 1e-9) + 1e-12
                width = CELL * radius
                grid = lambda v: np.floor(v / width).astype(np.int64)
                home, low, high = grid(y[:, a:b]), grid(y[:, a:b] - radius), grid(y[:, a:b] + radius)
                for step in product((-1, 0, 1), repeat=b - a):
                    if step < (0,) * (b - a):
                        continue  # only to greater cells
                    at = home + np.array(step)
                    met = np.flatnonzero(((at >= low) & (at <= high)).all(1))
                    if not len(met):
                        continue
                    cell = np.zeros(len(met), dtype=np.int64)
                    for k in range(b - a):
                        cell = cell * (1 << 15) + (at[met, k] + (1 << 14))
                    part = rows.take(pa.array(met))
                    own = [pa.array(np.full(len(met), block, np.int32)), pa.array(cell), pa.array(np.full(len(met), not any(step)))]
                    names = ["cid", "label", "size", "copies", "embedding"] if payload else ["label", "size"]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *own], names=[*names, "block", "cell", "home"])


def _local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each one's component, for links inside a group."""
    root = np.arange(n)
    while True:
        least = root.copy()
        np.minimum.at(least, a, root[b])
        np.minimum.at(least, b, root[a])
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _verify(cid: np.ndarray, copies: np.ndarray, home: np.ndarray, side: np.ndarray, mixed: bool, block: int, x: np.ndarray, y: np.ndarray, threshold: float) -> pa.RecordBatch | None:
    """One task: links between home members, and between home members and copies of others."""
    n = len(cid)
    budgets = _budgets(x.shape[1], threshold)
    found_a, found_b = [], []
    for lo in range(0, n, 256):
        a, b = np.nonzero(x[lo : lo + 256] @ x.T >= threshold)
        a += lo
        ok = (a < b) & (home[a] | home[b])
        if mixed:
            ok &= side[a] != side[b]
        a, b = a[ok], b[ok]
        if len(a):
            d = (y[a] - y[b]) ** 2
            first = np.full(len(a), -1)
            for k in range(block, -1, -1):
                s, e, budget = budgets[k]
                first[d[:, s:e].sum(1) <= budget] = k
            a, b = a[first == block], b[first == block]
            found_a.append(a)
            found_b.append(b)
    if not found_a:
        return None
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    if not len(a):
        return None
    links = np.bincount(a, weights=copies[b], minlength=n) + np.bincount(b, weights=copies[a], minlength=n)
    root = _local_roots(n, a, b)
    at = np.flatnonzero(links > 0)
    return pa.RecordBatch.from_arrays([pa.array(cid[at]), pa.array(links[at].astype(np.int64)), pa.array(cid[root[at]])], names=["cid", "links", "root"])


def _join(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by task: verified one task at a time."""
    names = ["label", "size", "block", "cell", "one", "two"]
    held: list[pa.RecordBatch] = []
    key = None

    def settle() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        if len(rows) > 1:
            cid, copies, home, side, one, two = common.flatten(rows, "cid", "copies", "home", "side", "one", "two")
            x, y = _units(rows.column("embedding"))
            found = _verify(cid, copies.astype(np.float64), home, side, one[0] != two[0], int(rows.column("block")[0].as_py()), x, y, threshold)
            if found is not None:
                yield found

    for batch in batches:
        keys = np.stack(common.flatten(batch, *names), 1).astype(np.int64)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        for a, b in zip(np.concatenate([[0], cuts]), np.append(cuts, len(batch)), strict=True):
            if b <= a:
                continue
            if held and tuple(keys[a]) != key:
                yield from settle()
                held = []
            key = tuple(keys[a])
            held.append(batch.slice(int(a), int(b - a)))
    if held:
        yield from settle()


def near_links(classes: DataFrame, threshold: float = THRESHOLD, crowd: int = CROWD) -> DataFrame:
    """``cid, links, root``: each class's links found in a task, and a member it is connected to.

    ``classes`` has ``cid, label, size, copies, embedding`` with one row for each vector of a label.
    """
    spark = classes.sparkSession
    cell = ["label", "size", "block", "cell"]
    kind = classes.schema["embedding"].dataType.simpleString()
    bare = classes.select("label", "size", "embedding").mapInArrow(lambda x: _cells(x, threshold, False), "label int, size int, block int, cell long, home boolean")
    members = bare.groupBy(*cell).agg(F.count("*").alias("n"), F.sum(F.col("home").cast("int")).alias("homes"))
    met = members.where("n > 1 and homes > 0")
    crowded = common.keep(met.where(F.col("n") > crowd).select(*cell, F.ceil(F.col("n") / crowd).cast("int").alias("parts")), "crowded")
    few = crowded.count() <= MAX_BROADCAST_CELLS
    rows = classes.mapInArrow(lambda x: _cells(x, threshold, True), f"cid long, label int, size int, copies long, embedding {kind}, block int, cell long, home boolean")
    rows = rows.join(F.broadcast(crowded) if few else crowded, cell, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("side", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("one", F.least("side", "other")).withColumn("two", F.greatest("side", "other")).drop("other", "parts")
    task = [*cell, "one", "two"]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, *task).sortWithinPartitions(*task).mapInArrow(lambda x: _join(x, threshold), "cid long, links long, root long")


def embedding_dedup(vectors: DataFrame, threshold: float = THRESHOLD, crowd: int = CROWD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors`` (``vec_id, embedding, label``)."""
    if not 0 < threshold < 1:
        raise ValueError("threshold must lie between 0 and 1")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), "embedding")
    sound = F.expr("label is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x != 0)")
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    classes = rows.where("sound").groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = common.keep(classes.withColumn("size", F.size("embedding")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    found = common.keep(near_links(classes.select("cid", "label", "size", "copies", "embedding"), threshold, crowd), "near-links")
    common.release(vectors.sparkSession)
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    joined = components(found.select("cid", "root"), "cid", "root").withColumnRenamed("node", "cid")
    rooted = classes.select("cid", "label", "embedding", "least", "copies").join(links, "cid", "left").join(joined, "cid", "left").withColumn("root", F.coalesce("component", "cid"))
    named = rooted.groupBy("root").agg(F.min("least").alias("name"))
    decided = rooted.join(named, "root").select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("name").alias("component_id"))
    linked = rows.where("sound").join(decided, ["label", "embedding"]).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    alone = rows.where(~F.col("sound")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op6_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
