"""SimHash near-dedup: documents whose 64-bit fingerprints differ in few bits are linked.

Texts are lower-cased (A-Z only) and cut into words ``[^\\x20\\x09-\\x0D]+``. Shingles are runs of
``shingle`` words, repeats included, joined by a space (fewer words: all of them). A bit of
the fingerprint is 1 if it is set in over half of the shingles' XXH64 (UTF-8, seed 42).

Links. Equal fingerprints are one class, found with partial sums. The 64 bits are split
into ``BLOCKS`` blocks; two fingerprints at ``bits`` or fewer differing bits agree on
``BLOCKS - bits`` blocks at least, so the classes are joined on every choice of that many
blocks (32 bits and more of agreement by default, which keeps chance meetings rare) and
the pairs verified by Hamming distance.

A block value that more than ``crowd`` classes share is not joined pair by pair. Its classes
emit all fingerprints within half the distance instead (rounded up on one side, down on
the other); two classes are within ``bits`` exactly if they meet in one. Each meeting point
links its classes to one of them, which is linear in the classes and gives the same
components.

Results for odd input: null, empty and blank texts have fingerprint zero and link like any
other; repeated rows share a class; rows without ``doc_id`` take part, but never name a
component (null if no row of it has an id); an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.llm import common
from txnlens.llm.components import components

SHINGLE = 3
BITS = 3
SEED = 42
BLOCKS = 6
CROWD = 256
#: Shingles hashed in one go.
PASS = 1 << 16
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=-1))
    begins = [e + 1 for e in ends[:-1]]
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) :]
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, PASS):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(begins[lo : min(n, lo + PASS)], last[lo : lo + PASS], strict=False)], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in common.sliced(batches):
        data, offsets = common.utf8(batch.column("text"))
        data = memoryview(data)
        found = np.array([fingerprint(bytes(data[a:b]), shingle) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("crc"), pa.array(found.view(np.int64))], names=["doc_id", "crc", "fp"])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, crc, fp`` for each row; ``crc`` the checksum of ``common``, ``fp`` the fingerprint's bits as BIGINT."""
    common.bound_batches(docs.sparkSession)
    rows = common.keyed(docs).select(common.doc_id(), "crc", "text")
    return rows.mapInArrow(lambda x: _fingerprints(x, shingle), "doc_id long, crc binary, fp long")


def _masks(bits: int) -> list[int]:
    """Each choice of ``BLOCKS - bits`` blocks as a mask of their bits."""
    edges = [64 * k // BLOCKS for k in range(BLOCKS + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(chosen) for chosen in combinations(blocks, BLOCKS - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _ball(batches: Iterator[pa.RecordBatch], radius: int, inner: int) -> Iterator[pa.RecordBatch]:
    flips = [sum(1 << k for k in chosen) for r in range(radius + 1) for chosen in combinations(range(64), r)]
    near = np.array([bin(f).count("1") <= inner for f in flips])
    flips = np.array(flips, dtype=np.uint64).view(np.int64)
    for batch in batches:
        for fp in batch.column("fp").to_numpy():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flips), fp)), pa.array(flips ^ fp), pa.array(near)], names=["fp", "point", "near"])


def links(classes: DataFrame, bits: int = BITS, crowd: int = CROWD) -> DataFrame:
    """``a, b``: pairs of different ``fp`` of ``classes`` at ``bits`` or fewer differing bits that give its components."""
    masks = _masks(bits)
    keys = classes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "block"))
    counts = common.keep(keys.groupBy("choice", "block").count().where("count > 1"), "blocks")
    met = keys.join(counts, ["choice", "block"])
    few = common.keep(met.where(F.col("count") <= crowd).select("choice", "block", "fp"), "met")
    pairs = few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), ["choice", "block"]).where("a < b")
    pairs = pairs.select("a", "b")
    if not counts.where(F.col("count") > crowd).isEmpty():
        crowded = met.where(F.col("count") > crowd).select("fp").distinct()
        points = common.keep(crowded.mapInArrow(lambda x: _ball(x, (bits + 1) // 2, bits // 2), "fp long, point long, near boolean"), "points")
        centres = points.groupBy("point").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("centre"), F.count("*").alias("n")).where("n > 1 and centre is not null").select("point", "centre")
        pairs = pairs.unionByName(points.join(centres, "point").where("fp != centre").select(F.col("fp").alias("a"), F.col("centre").alias("b")))
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, crowd: int = CROWD) -> DataFrame:
    """``doc_id, crc, fp, component_id, stays`` for each row of ``docs``.

    The component's smallest ``doc_id`` names it. ``stays`` holds for the row with that id (of
    several, the one with the smallest ``crc``; without any id, that one).
    """
    if not 0 <= bits < BLOCKS:
        raise ValueError(f"bits must lie in 0..{BLOCKS - 1}")
    rows = common.keep(fingerprints(docs, shingle), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "crc"))
    classes = common.keep(rows.groupBy("fp").agg(first.alias("first")), "classes")
    joined = components(links(classes.select("fp"), bits, crowd), "a", "b").withColumnRenamed("node", "fp")
    rooted = classes.join(joined, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("first"))
    named = rooted.select("fp", "root").join(named, "root").select("fp", F.col("first.doc_id").alias("component_id"), F.col("first.crc").alias("first_crc"))
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("crc") == F.col("first_crc"))
    return rows.join(named, "fp").select("doc_id", "crc", "fp", "component_id", stays.alias("stays"))


def op1_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
