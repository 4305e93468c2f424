"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the 1- to 3-grams of the lower-cased letters of a whole text (all else is one
space between words), hashed to ``DIMENSIONS`` places, weighted by TF-IDF and scaled to unit
length. Document frequencies are counted over all texts that may be learned from.

Weights are trained by follow-the-regularised-leader with elastic-net penalties
(per-coordinate steps; the L1 part leaves most weights exactly zero), on a sample: about
``SAMPLE`` labelled rows in all, the same share of each language, chosen by a hash of the
row. A fifth of it is kept from the training and fits the temperature that the scores are
divided by. The model is bounded by ``DIMENSIONS`` times the languages and is broadcast.

Learned only from rows whose CRC-32 of the id, as text, is not ``RESERVED`` modulo ``FOLDS`` and
whose language is given; predictions see the text alone.

Results for odd input: null texts and texts without a letter are ``und`` with score 0; if
nothing can be learned, all are; repeated rows and null ids are kept (a null id is never
held out); an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.llm import common
from txnlens.llm.rolling import mix64

FOLDS, RESERVED = 4, 2
DIMENSIONS = 1 << 14
SAMPLE = 3000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.01
#: Texts and characters turned into features in one go; one longer text goes alone.
DOCS, CHARS = 48, 1 << 18

_SHIFT = np.uint64(64 - DIMENSIONS.bit_length() + 1)
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1))
    return _LETTERS[0]


def _counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """N-gram counts of each text, and its number of letters."""
    codes = [np.frombuffer((t.lower() + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    doc = np.repeat(np.arange(len(texts)), [len(c) for c in codes])
    code = np.concatenate(codes)
    letter = _letters()[code]
    # letters, and one space before each word and after the last
    used = letter.copy()
    used[1:] |= letter[:-1]
    used[:-1] |= letter[1:] & ~letter[:-1]
    code = np.where(letter, code, 32)[used].astype(np.uint64)
    doc = doc[used]
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    cells = out.reshape(-1)
    gram = np.zeros(len(code), dtype=np.uint64)
    for n in range(3):
        gram = (gram[:-1] << np.uint64(21) | code[n:]) if n else code + np.uint64(1 << 60)
        own = doc[: len(gram)]
        whole = own == doc[n:]
        place = (mix64(gram + np.uint64(n << 62)) >> _SHIFT).astype(np.int64) + own * DIMENSIONS
        cells += np.bincount(place[whole], minlength=len(cells))
    return out, np.bincount(doc, weights=(code != 32), minlength=len(texts))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of a batch with the counts of their texts, some texts at a time."""
    for batch in batches:
        column = batch.column("text")
        first, held, chars = 0, [], 0
        for r in range(len(batch)):
            text = column[r].as_py() or ""
            if held and (len(held) >= DOCS or chars + len(text) > CHARS):
                yield batch.slice(first, len(held)), *_counts(held)
                first, held, chars = r, [], 0
            held.append(text)
            chars += len(text)
        if held:
            yield batch.slice(first, len(held)), *_counts(held)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, n = np.zeros(DIMENSIONS, dtype=np.int64), 0
    for rows, counts, _ in _featured(batches):
        found += (counts > 0).sum(0)
        n += len(rows)
    if n:
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(found[at], n))], names=["place", "n"])


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = counts * idf
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    x /= np.maximum(norm, 1e-12)[:, None]
    return x


def _vectors(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for rows, counts, _ in _featured(batches):
        x = _weighted(counts, shared.value)
        at = [np.flatnonzero(v) for v in x]
        yield pa.RecordBatch.from_arrays(
            [rows.column("lang"), rows.column("part"), pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())), pa.array([v[a] for v, a in zip(x, at, strict=True)], pa.list_(pa.float32()))],
            names=["lang", "part", "at", "x"])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(vectors: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int) -> np.ndarray:
    """Weights (``DIMENSIONS`` x classes) by follow-the-regularised-leader, one row at a time."""
    z, n = np.zeros((DIMENSIONS, classes)), np.zeros((DIMENSIONS, classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    rng = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for r in rng.permutation(len(y)):
            at, x = vectors[r]
            w = weights(z[at], n[at])
            p = _softmax(x @ w)
            p[y[r]] -= 1
            g = x[:, None] * p
            squared = n[at] + g * g
            z[at] += g - (np.sqrt(squared) - np.sqrt(n[at])) / ALPHA * w
            n[at] = squared
    return weights(z, n)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the smallest log loss."""
    best, at = np.inf, 1.0
    for t in np.exp(np.linspace(np.log(0.02), np.log(20), 121)):
        loss = -np.log(np.maximum(_softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean()
        if loss < best:
            best, at = loss, float(t)
    return at


def _predict(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    langs, idf, weights, heat = shared.value
    names = np.array([*langs, "und"], dtype=object)
    for rows, counts, letters in _featured(batches):
        if langs:
            p = _softmax((_weighted(counts, idf) @ weights) / heat)
            best = np.where(letters > 0, p.argmax(1), len(langs))
            score = np.where(letters > 0, p.max(1), 0.0).astype(np.float64)
        else:
            best, score = np.zeros(len(rows), dtype=int), np.zeros(len(rows))
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(names[best], pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple:
    """``languages, idf, weights, temperature`` from the rows of ``docs`` that may be learned from."""
    spark = docs.sparkSession
    learn = docs.where(F.col("lang").isNotNull() & ~common.held_out(FOLDS, RESERVED))
    learn = learn.select("lang", F.coalesce("text", F.lit("")).alias("text"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).alias("draw"))
    sizes = {r["lang"]: r["count"] for r in learn.groupBy("lang").count().collect()}  # one row a language
    if not sizes:
        return [], np.zeros(DIMENSIONS, np.float32), np.zeros((DIMENSIONS, 0), np.float32), 1.0
    counted = {r["place"]: r["n"] for r in learn.select("text").mapInArrow(_frequencies, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()}  # at most DIMENSIONS rows
    seen = np.zeros(DIMENSIONS)
    for place, n in counted.items():
        if place >= 0:
            seen[place] = n
    idf = (np.log((1 + counted[-1]) / (1 + seen)) + 1).astype(np.float32)

    langs = sorted(sizes)
    quota = max(1, sample // len(langs))
    rate = F.create_map(*[F.lit(x) for lang in langs for x in (lang, int(min(1.0, 1.2 * quota / sizes[lang]) * (1 << 30)))])
    chosen = learn.where(F.col("draw") < rate[F.col("lang")]).withColumnRenamed("draw", "part")
    shared = spark.sparkContext.broadcast(idf)
    drawn = chosen.select("lang", "part", "text").mapInArrow(lambda x: _vectors(x, shared), "lang string, part long, at array<int>, x array<float>")
    drawn = drawn.orderBy("part", "lang").limit(2 * sample).toArrow()  # should the draw overshoot, the first ones stay
    number = {lang: k for k, lang in enumerate(langs)}
    y = np.array([number[x] for x in drawn.column("lang").to_pylist()], dtype=np.int64)
    part = drawn.column("part").to_numpy() % 5
    vectors = [(a.values.to_numpy(), x.values.to_numpy().astype(np.float64)) for a, x in zip(drawn.column("at"), drawn.column("x"), strict=True)]
    for_fit, for_heat = np.flatnonzero(part != 0), np.flatnonzero(part == 0)
    if not len(for_fit) or not len(for_heat):
        for_fit = for_heat = np.arange(len(y))
    # rows come in any order: sort them by their content, so that the same sample trains the same model
    for_fit = np.array(sorted(for_fit, key=lambda r: (y[r], len(vectors[r][0]), vectors[r][1].sum())), dtype=np.int64)
    weights = train([vectors[r] for r in for_fit], y[for_fit], len(langs))
    logits = np.array([vectors[r][1] @ weights[vectors[r][0]] for r in for_heat]).reshape(len(for_heat), len(langs))
    heat = temperature(logits, y[for_heat]) if len(for_heat) else 1.0
    return langs, idf, weights.astype(np.float32), heat


def languages(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row of ``docs``."""
    common.bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, sample))
    rows = docs.select("doc_id", "text", common.held_out(FOLDS, RESERVED).alias("held_out"))
    return rows.mapInArrow(lambda x: _predict(x, model), "doc_id long, held_out boolean, lang_pred string, score double")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    return languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
