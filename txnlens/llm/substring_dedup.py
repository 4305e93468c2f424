"""Substring dedup: removes long word runs that an earlier document has, too.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A window is ``width`` consecutive words of one
document. Each word covered by a window whose words also start in a document with a
smaller ``doc_id`` is removed; windows are judged on the input.

Only windows at the positions of a difference cover are hashed. ``COVER`` holds each
difference modulo ``PERIOD`` once, so for any two positions some shift below ``PERIOD`` moves
both onto the cover: two equal windows of ``width`` words share an aligned anchor of
``width - PERIOD + 1`` words.

1. Anchor hashes that only one document has are settled.
2. A shared anchor is extended to its span, all words of the windows that contain it.
   Where the span is equal, all of its windows are: occurrences in later documents lose
   the whole span. Copies end here, counted with partial sums.
3. Where an anchor stands in differing spans, the windows of the first document of each
   kind are compared by 128 bits of hash, one group a window.

A word is known by 64 bits of hash, windows and spans by sums over at most 80 of these.

Every grouping is a partial aggregation followed by a join, so that no task gathers the
occurrences of a frequent anchor.

Results for odd input: null, empty and short texts keep all their words; rows that share a
``doc_id`` do not remove from each other; a null ``doc_id`` counts as smaller than any other; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.llm import common
from txnlens.llm.rolling import BASES, Rolling, mix64, signed, word_hashes

WIDTH = 50
PERIOD = 31
#: A perfect difference set: each nonzero residue modulo 31 is one difference of two members.
COVER = np.array([1, 5, 11, 24, 25, 27])
#: Bytes whose words are hashed in one go; one longer document goes alone.
PASS = 1 << 20

_ANCHORS = "did long, crc binary, at long, first long, windows long, key long, kind long"
_MARKS = "did long, crc binary, first long, windows long"


def _documents(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Documents of a batch, about ``PASS`` bytes at a time: first and last row, word hashes, first word of each."""
    data, offsets = common.utf8(batch.column("text"))
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PASS, "right")) - 1)
        start, end, doc = common.word_bounds(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        first = np.searchsorted(doc, np.arange(j - i + 1))
        yield i, j, word_hashes(data[offsets[i] : offsets[j]], start, end), doc, first
        i = j


def _anchors(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    length = width - PERIOD + 1
    for batch in batches:
        did, crc = batch.column("did"), batch.column("crc")
        for i, _, words, doc, first in _documents(batch):
            inner = np.arange(len(words)) - first[doc]
            count = np.diff(first)[doc]
            t = np.flatnonzero(np.isin(inner % PERIOD, COVER) & (inner + length <= count) & (count >= width))
            if not len(t):
                continue
            keys, kinds = Rolling(words, BASES[1]), Rolling(words, BASES[0])
            at, base = inner[t], first[doc[t]]
            a = np.maximum(0, at - (PERIOD - 1))
            b = np.minimum(at, count[t] - width)
            kind = kinds.spans(base + a, base + b + width) ^ mix64((at - a).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([x.take(pa.array(i + doc[t])) for x in (did, crc)] + [pa.array(x) for x in (at, a, b - a + 1, signed(keys.spans(t, t + length)), signed(kind))],
                                             names=["did", "crc", "at", "first", "windows", "key", "kind"])


def _windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The windows that contain one of the anchors ``ats`` of their document."""
    for batch in batches:
        did, crc = batch.column("did"), batch.column("crc")
        ats = batch.column("ats")
        for i, j, words, _, first in _documents(batch):
            one, two = Rolling(words, BASES[0]), Rolling(words, BASES[1])
            for r in range(i, j):
                n = first[r - i + 1] - first[r - i] - width + 1
                at = ats[r].values.to_numpy()
                change = np.zeros(n + 1, dtype=np.int32)
                np.add.at(change, np.maximum(0, at - (PERIOD - 1)), 1)
                np.add.at(change, np.minimum(at, n - 1) + 1, -1)
                s = np.flatnonzero(np.cumsum(change)[:n] > 0)
                w = first[r - i] + s
                yield pa.RecordBatch.from_arrays([*(x.take(pa.array(np.full(len(s), r))) for x in (did, crc)), pa.array(s), pa.array(signed(one.spans(w, w + width))), pa.array(signed(two.spans(w, w + width)))],
                                                 names=["did", "crc", "first", "one", "two"])


def earlier_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``did, crc, first, windows``: runs of window starts whose words also start in a smaller ``did``."""
    spark = docs.sparkSession
    anchors = docs.mapInArrow(lambda x: _anchors(x, width), _ANCHORS)
    per_key = anchors.groupBy("key").agg(F.min("did").alias("least"), F.max("did").alias("most"), F.min("kind").alias("low"), F.max("kind").alias("high"))
    shared = common.keep(per_key.where("least < most").select("key", (F.col("low") != F.col("high")).alias("mixed")), "shared")
    common.release(spark)

    found = common.keep(anchors.join(shared, "key"), "found")
    common.release(spark)
    # sums are written before they are joined, so that Spark can split a frequent key
    owner = common.keep(found.groupBy("key", "kind").agg(F.min("did").alias("owner")), "owners")
    judged = common.keep(found.join(owner, ["key", "kind"]).select("did", "crc", "at", "first", "windows", "mixed", (F.col("did") > F.col("owner")).alias("later")), "judged")
    settled = judged.where("later").select("did", "crc", "first", "windows")

    ats = judged.where("mixed and not later").groupBy("did", "crc").agg(F.collect_set("at").alias("ats"))
    windows = common.keep(common.once(docs).join(ats, ["did", "crc"]).select("did", "crc", "text", "ats").mapInArrow(
        lambda x: _windows(x, width), "did long, crc binary, first long, one long, two long"), "windows")
    common.release(spark)
    starts = windows.groupBy("one", "two").agg(F.min("did").alias("least"), F.max("did").alias("most")).where("least < most").select("one", "two", "least")
    starts = common.keep(starts, "starts")
    open_ = windows.join(starts, ["one", "two"]).where("did > least").select("did", "crc", "first", F.lit(1).cast("long").alias("windows"))
    return settled.unionByName(open_)


def _cut(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in common.sliced(batches):
        counts, gone, kept = [], [], []
        texts, marks = batch.column("text"), batch.column("marks")
        for r in range(len(batch)):
            words = texts[r].as_py().encode().split()
            counts.append(len(words))
            if marks[r].is_valid:
                flat = marks[r].values.flatten()
                first, windows = flat[0].to_numpy(), flat[1].to_numpy()
                change = np.zeros(len(words) + 1, dtype=np.int32)
                np.add.at(change, first, 1)
                np.add.at(change, first + windows + width - 1, -1)
                words = [words[k] for k in np.flatnonzero(np.cumsum(change)[:-1] <= 0)]
            gone.append(counts[-1] - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())],
                                         names=["doc_id", "n_words", "n_removed", "kept"])


def substring_dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` (remaining words, joined by a space, as UTF-8) for each row of ``docs``."""
    common.bound_batches(docs.sparkSession)
    if width < PERIOD:
        raise ValueError(f"width must be {PERIOD} or more")
    rows = common.keyed(docs)
    # distinct: rows that are repeated share their marks
    marks = earlier_windows(rows, width).distinct().groupBy("did", "crc").agg(F.collect_list(F.struct("first", "windows")).alias("marks"))
    marks = common.keep(marks, "marks")
    common.release(docs.sparkSession)
    joined = rows.join(marks, ["did", "crc"], "left").select(common.doc_id(), "text", "marks")
    return joined.mapInArrow(lambda x: _cut(x, width), "doc_id long, n_words long, n_removed long, kept binary")


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
