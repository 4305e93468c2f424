"""Quality classifier: kernel ridge scores on document statistics, calibrated isotonically.

Each whole text is reduced to a dozen statistics (length, word length, symbols, case,
repetition, line and sentence structure, compressibility). Random Fourier features with a
fixed seed approximate a Gaussian kernel over the standardised statistics. Each partition
sums its share of the normal equations; their sum is solved for the ridge weights.
Scores of a fold of their own are binned and calibrated by pooling adjacent violators;
between pools the calibration is linear.

Labels (0 or 1; several for one id are averaged) are learned only from rows whose CRC-32
of the id, as text, is not ``RESERVED`` modulo ``FOLDS``; remainder ``CALIBRATION`` calibrates and
the others fit. Of the labelled ids at most ``SAMPLE``, the first by a hash of the id, take part; they are
broadcast, so that only labelled texts are read for the fit and none is shuffled. Each text is
scored where it lies, in one step with its statistics. Ids, labels, languages and sources are
never inputs of a score.

Results for odd input: null and empty texts have the statistics of an empty text and are
scored like any other; labels that are null or have no document are ignored; without
labels each score is 0.5; repeated rows and null ids are kept (a null id is never held
out); an empty table gives an empty result; other columns of the input are ignored
(``accepted`` returns them).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.llm import common

FOLDS, RESERVED, CALIBRATION = 5, 0, 1
#: Labelled ids that the classifier learns from at most.
SAMPLE = 50_000
THRESHOLD = 0.3
FEATURES = 160
#: Standard deviations of the statistics that the kernel takes for near.
BANDWIDTH = 2.5
RIDGE = 1e-4
BINS = 1 << 12
CLIP = 4.0
STATISTICS = 14


def statistics(text: bytes) -> list[float]:
    """The statistics of one text, as UTF-8."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * STATISTICS
    kinds = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower, digits = kinds[65:91].sum(), kinds[97:123].sum(), kinds[48:58].sum()
    letters = upper + lower + kinds[128:].sum()
    ends = kinds[[33, 46, 63]].sum()
    light = kinds[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum()
    symbols = kinds[33:127].sum() - upper - lower - digits - light
    distinct = len(set(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = sum(map(bytes.__eq__, words, words[1:]))
    packed = sum(len(zlib.compress(text[at : at + (1 << 20)], 1)) for at in range(0, size, 1 << 20))
    return [
        float(np.log1p(n)), (size - n) / n, symbols / n, float(kinds[33]) / n, float(upper) / (letters + 1), float(digits) / size, np.log1p(distinct) / np.log1p(n), repeated / n,
        packed / (size + 16), 1 - len(set(lines)) / len(lines), float(np.log1p(len(lines))) / np.log1p(n), float(ends) / n, float(kinds[124]) / n, float(light) / n,
    ]


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The statistics of a batch's texts, one row each."""
    data, offsets = common.utf8(batch.column("text"))
    view = memoryview(data)
    return np.array([statistics(bytes(view[a:b])) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], dtype=np.float64).reshape(-1, STATISTICS)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts become their statistics; other columns stay."""
    for batch in common.sliced(batches):
        lists = pa.FixedSizeListArray.from_arrays(pa.array(_matrix(batch).reshape(-1)), STATISTICS).cast(pa.list_(pa.float64()))
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), lists], names=[*names, "stats"])


def _projection() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(9)
    return rng.normal(0, 1 / BANDWIDTH, (STATISTICS, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)


def _features(stats: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    x = np.clip((stats - mean) / spread, -CLIP, CLIP)
    w, b = _projection()
    return np.hstack([np.ones((len(x), 1)), np.sqrt(2 / FEATURES) * np.cos(x @ w + b)])


def _held(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("stats").flatten()).reshape(len(batch), STATISTICS)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, STATISTICS))
    n = 0
    for batch in batches:
        x = _held(batch)
        total += [x.sum(0), (x * x).sum(0)]
        n += len(x)
    if n:
        yield _cells(np.append(total.reshape(-1), n))


def _cells(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["cell", "x"])


def _normal(batches: Iterator[pa.RecordBatch], mean: np.ndarray, spread: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A partition's share of the normal equations, cell by cell."""
    size = FEATURES + 1
    gram, right = np.zeros((size, size)), np.zeros(size)
    n = 0
    for batch in batches:
        z, y = _features(_held(batch), mean, spread), batch.column("y").to_numpy()
        gram += z.T @ z
        right += z.T @ y
        n += len(y)
    if n:
        yield _cells(np.concatenate([gram[np.triu_indices(size)], right, [n]]))


def _summed(cells: DataFrame) -> np.ndarray:
    """Sums of cells over the partitions; their number is set by the model, not by the data."""
    rows = cells.groupBy("cell").agg(F.sum("x").alias("x")).orderBy("cell").collect()
    return np.array([r["x"] for r in rows])


def _raw(batches: Iterator[pa.RecordBatch], model: tuple) -> Iterator[pa.RecordBatch]:
    mean, spread, weights = model
    for batch in batches:
        s = _features(_held(batch), mean, spread) @ weights
        yield pa.RecordBatch.from_arrays([pa.array(np.floor((np.clip(s, -1, 2) + 1) / 3 * (BINS - 1)).astype(np.int64)), pa.array(s), batch.column("y")], names=["bin", "s", "y"])


def pool(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools adjacent violators: the centres and values of a nondecreasing fit of ``y`` on ascending ``x``."""
    held: list[list[float]] = []
    for a, b, k in zip(x, y, n, strict=True):
        held.append([a * k, b * k, k])
        while len(held) > 1 and held[-2][1] * held[-1][2] >= held[-1][1] * held[-2][2]:
            last = held.pop()
            held[-1] = [p + q for p, q in zip(held[-1], last, strict=True)]
    return np.array([h[0] / h[2] for h in held]), np.array([h[1] / h[2] for h in held])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple | None:
    """``mean, spread, weights, knots, values`` from ``docs`` (``doc_id, text``) and ``labels`` (``doc_id, quality``); None without labels."""
    common.bound_batches(docs.sparkSession)
    votes = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col("quality").cast("double")).alias("y"))
    votes = common.keep(votes.where(~common.held_out(FOLDS, RESERVED)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "votes")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    learn = texts.join(F.broadcast(votes), "doc_id").select("text", "y", common.held_out(FOLDS, CALIBRATION).alias("calibrates"))
    learn = common.keep(learn.mapInArrow(_statistics, "y double, calibrates boolean, stats array<double>"), "labelled")
    for_fit = learn.where("not calibrates")
    if for_fit.isEmpty():
        for_fit = learn
    sums = _summed(for_fit.select("stats").mapInArrow(_moments, "cell long, x double"))
    if not len(sums):
        return None
    n = sums[-1]
    mean, square = sums[:STATISTICS] / n, sums[STATISTICS:-1] / n
    spread = np.sqrt(np.maximum(square - mean * mean, 1e-12))
    spread[spread < 1e-5] = 1.0
    sums = _summed(for_fit.select("stats", "y").mapInArrow(lambda x: _normal(x, mean, spread), "cell long, x double"))
    size = FEATURES + 1
    gram = np.zeros((size, size))
    gram[np.triu_indices(size)] = sums[: -size - 1]
    gram += np.triu(gram, 1).T
    weights = np.linalg.solve(gram + RIDGE * n * np.eye(size), sums[-size - 1 : -1])
    model = (mean, spread, weights)

    def binned(rows: DataFrame) -> list:
        raw = rows.select("stats", "y").mapInArrow(lambda x: _raw(x, model), "bin long, s double, y double")
        return raw.groupBy("bin").agg(F.avg("s").alias("s"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()  # at most BINS rows

    bins = binned(learn.where("calibrates"))
    if len({r["y"] for r in bins}) < 2:
        bins = binned(learn)
    knots, values = pool(*(np.array([float(r[c]) for r in bins]) for c in ("s", "y", "n")))
    return mean, spread, weights, knots, values


def _score(batches: Iterator[pa.RecordBatch], model: tuple | None, accept: bool) -> Iterator[pa.RecordBatch]:
    """Rows of ``row`` and ``text`` become ``row`` and ``score``, or only those that are accepted, with all they had."""
    for batch in common.sliced(batches):
        if model is None:
            score = np.full(len(batch), 0.5)
        else:
            mean, spread, weights, knots, values = model
            score = np.clip(np.interp(_features(_matrix(batch), mean, spread) @ weights, knots, values), 0.0, 1.0)
        if accept:
            yield batch.filter(pa.array(score >= THRESHOLD))
        else:
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(score)], names=["row", "score"])


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``; ``predicted`` is 1 from ``THRESHOLD`` on."""
    model = fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = rows.mapInArrow(lambda x: _score(x, model, False), "row long, score double").withColumnRenamed("row", "doc_id")
    return found.select("doc_id", common.held_out(FOLDS, RESERVED).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted 1, as they are: no row is shuffled for it, and a text is sent once."""
    model = fit(docs, labels)
    return docs.mapInArrow(lambda x: _score(x, model, True), docs.schema)


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
