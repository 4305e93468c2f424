"""Embedding whitening by the exact characteristic polynomial of the vectors' integer scatter.

Each entry ``c`` becomes the whole number ``x = floor(SCALE * c) + SHIFT``. With ``n`` vectors, their
sums ``S`` and the products' sums, ``n * sum(x x') - S S'`` is ``n * n`` times their covariance, in
whole numbers and hence the same however the rows are dealt.

1. Each partition sums its share of the products: vectors are cut into limbs so small that
   sums in doubles are exact. The cells' sums meet as decimals.
2. The characteristic polynomial is found modulo primes, some primes a task, and joined by
   Chinese remainders (``charpoly``); its largest roots are isolated and give the components.
   This part has the size of the dimensions, whatever the number of rows.
3. Rows are projected where they lie. The covariance of the result is summed in two passes,
   the means first.

Vectors of one length are whitened together; another length is a fit list of its own.

Results for odd input: vectors that are null, empty or hold null or non-finite entries are
dropped, as are those with an entry of ``LARGEST`` or more, whose whole numbers would not be
exact; a component without variance has no whitened value, so that fewer than ``TOP`` may
come out, and none for a single vector or equal ones; of equal eigenvalues any orthonormal
basis is taken; a deviation beyond BIGINT is null; repeated rows and null ids are kept as they
are; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlens.llm import charpoly, common

SCALE, SHIFT, TOP = 1024, 100_000, 8
LARGEST = float(1 << 36)
#: Rows multiplied in one go, and bits of a limb: sums of products stay below 2**53.
ROWS, LIMB = 4096, 20


def _whole(column: pa.Array) -> np.ndarray:
    """``floor(SCALE * c)`` of vectors of one length; the shift is added where it matters."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.floor(x * SCALE).astype(np.int64)


def _products(y: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """``y' y`` as a sum of exact whole matrices, each with a power of two."""
    if not len(y):
        return []
    largest = int(np.abs(y).max())
    if largest * largest * len(y) < 1 << 53:
        d = y.astype(np.float64)
        return [(0, (d.T @ d).astype(np.int64))]
    limbs, rest = [], y
    while not limbs or not np.isin(rest, (0, -1)).all():
        limbs.append((rest & (1 << LIMB) - 1).astype(np.float64))
        rest = rest >> LIMB
    limbs.append(rest.astype(np.float64))  # 0 or -1, the sign
    return [(LIMB * (i + j), (a.T @ b).astype(np.int64)) for i, a in enumerate(limbs) for j, b in enumerate(limbs)]


def _moments(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """A partition's count, sums and products' sums, cell by cell: count, then sums, then products by row."""
    n, sums, products = 0, np.zeros(size, dtype=object), np.zeros((size, size), dtype=object)
    for batch in common.sliced(batches, ROWS):
        y = _whole(batch.column("embedding"))
        n += len(y)
        sums = sums + y.sum(0).astype(object)
        for power, part in _products(y):
            products = products + part.astype(object) * (1 << power)
    if n:
        values = [n, *sums, *products[np.triu_indices(size)]]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int64()), pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))], names=["cell", "x"])


def scatter(rows: DataFrame, size: int) -> tuple[int, list[int], list[list[int]]]:
    """The count, the sums of ``floor(SCALE * c)`` and the whole scatter ``n * sum(y y') - S S'``; its size is that of the dimensions."""
    cells = rows.select("embedding").mapInArrow(lambda x: _moments(x, size), "cell long, x decimal(38,0)")
    held = [int(r["x"]) for r in cells.groupBy("cell").agg(F.sum("x").alias("x")).orderBy("cell").collect()]
    if not held:
        return 0, [], []
    n, sums, flat = held[0], held[1 : size + 1], iter(held[size + 1 :])
    matrix = [[0] * size for _ in range(size)]
    for i in range(size):
        for j in range(i, size):
            matrix[i][j] = matrix[j][i] = n * next(flat) - sums[i] * sums[j]
    return n, sums, matrix


def _residues(batches: Iterator[pa.RecordBatch], matrix: list[list[int]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        primes = batch.column("prime").to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array(primes, pa.int64()), pa.array([charpoly.residues(matrix, p) for p in primes], pa.list_(pa.int64()))], names=["prime", "residues"])


def polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """The characteristic polynomial of a whole matrix, highest power first: each prime on its own, eight in a task."""
    size = len(matrix)
    primes = charpoly.enough_primes(sum(matrix[i][i] for i in range(size)), size)
    table = spark.createDataFrame([(p,) for p in primes], "prime long").repartition(-(-len(primes) // 8))
    found = table.mapInArrow(lambda x: _residues(x, matrix), "prime long, residues array<long>").collect()
    return charpoly.combine(sorted((r["prime"], r["residues"]) for r in found))


def _project(batches: Iterator[pa.RecordBatch], n: int, sums: list[int], vectors: np.ndarray, spread: np.ndarray) -> Iterator[pa.RecordBatch]:
    limit = 1 << 63
    for batch in common.sliced(batches, ROWS):
        y = _whole(batch.column("embedding"))
        if max(map(abs, sums)) + n * int(np.abs(y).max()) < 1 << 62:
            centred = n * y - np.array(sums, dtype=np.int64)
        else:
            centred = n * y.astype(object) - np.array(sums, dtype=object)
        if int(np.abs(centred).max()) ** 2 * centred.shape[1] < limit:
            deviation = (centred.astype(np.int64) ** 2).sum(1).tolist()
        else:
            deviation = [d if (d := sum(int(v) ** 2 for v in row)) < limit else None for row in centred]
        whitened = centred.astype(np.float64) @ vectors.T / spread
        lists = pa.FixedSizeListArray.from_arrays(pa.array(whitened.reshape(-1)), len(spread)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(deviation, pa.int64()), lists], names=["vec_id", "deviation", "w"])


def _identity_error(rows: DataFrame, count: int) -> float:
    """The largest absolute entry of the covariance of ``w`` minus the identity, centred before multiplying."""
    at = range(count)
    means = rows.agg(*[F.avg(F.col("w")[i]).alias(f"m{i}") for i in at]).first()
    centred = rows.select(*[(F.col("w")[i] - F.lit(means[i])).alias(f"c{i}") for i in at])
    entries = centred.agg(*[F.avg(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"e{i}_{j}") for i in at for j in at if i <= j]).first()
    return max(abs(entries[f"e{i}_{j}"] - (i == j)) for i in at for j in at if i <= j)


def _whitened(rows: DataFrame, size: int, top: int) -> DataFrame | None:
    spark = rows.sparkSession
    n, sums, matrix = scatter(rows, size)
    poly = polynomial(spark, matrix)
    trace = sum(matrix[i][i] for i in range(size))
    # a root of 0 is isolated as 0 exactly, since it is rounded up from above -1
    scaled = [r for r in charpoly.roots(poly, min(top, size)) if r > 0] if trace else []
    if not scaled:
        return None
    vectors = charpoly.components(matrix, scaled)
    unit = 1 << charpoly.FRACTION
    spread = np.array([float(Decimal(r) / Decimal(unit)) for r in scaled]) ** 0.5
    explained = [float(Decimal(r) / (Decimal(unit) * Decimal(trace))) for r in scaled]
    found = rows.select("vec_id", "embedding").mapInArrow(lambda x: _project(x, n, sums, vectors, spread), "vec_id long, deviation long, w array<double>")
    found = common.keep(found, "whitened")
    error = _identity_error(found, len(scaled))
    shares = F.array(*map(F.lit, explained))
    return found.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


def whitening(vectors: DataFrame, top: int = TOP) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each sound row of ``vectors`` (``vec_id, embedding``)."""
    if top < 1:
        raise ValueError("top must be 1 or more")
    sound = F.expr(f"embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < {LARGEST}D)")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(sound)
    sizes = [r["size"] for r in rows.groupBy(F.size("embedding").alias("size")).count().orderBy("size").collect()]
    parts = [_whitened(rows.where(F.size("embedding") == size), size, top) for size in sizes]
    result = vectors.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    for part in parts:
        result = result if part is None else result.unionByName(part)
    return result


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    return whitening(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
