"""Suffix-array dedup: removes every byte covered by a long string that occurs more than once.

A text is its UTF-8 bytes. A string of ``width`` bytes that also starts anywhere else, in
another document or in the same one, is removed wherever it stands; overlapping strings
count, and all of them are judged on the input.

How the work is split. Each window of ``width`` bytes picks an anchor: the leftmost
position in it whose hash of ``gram`` bytes is smallest. Equal windows pick equal anchors
at the same offset, so only windows with the same anchor hash need be compared. Windows
of a document that follow each other and share an anchor form a span of at most
``2 * width - gram`` bytes. Anchor hashes only bring spans together; spans are the same if 64 bits of a
cryptographic digest of their bytes are, within one anchor hash.

1. Anchors whose hash occurs once are settled: nothing of theirs repeats.
2. Where all spans of an anchor hash are the same, every one of them is removed whole.
   Copies, however many, end here: they are counted with partial sums. Equal spans end to
   end in one document (a word said over and over) are one row from the start.
3. The spans that differ, one of each kind, are gathered by anchor hash. Their bytes,
   packed into symbols of ``SYMBOL`` bytes from the anchor on, are suffix-sorted by the
   grouping construction of ``suffixes``. Suffixes that agree on all whole symbols that
   any window must hold are neighbours there; the few bytes left at either end of a
   window are then compared exactly.
4. An anchor hash with more than ``hot`` kinds of spans (a passage in very many contexts)
   does not go to one task: its windows are counted one by one, by a digest of 128 bits.
   This splits the work, the results are the same.

Results for odd input: null or empty texts have no bytes and lose none; texts shorter than
``width`` lose none; rows that are repeated (same id, same text) match each other; a null
``doc_id`` is kept as null; an empty table gives an empty result; other columns of the
input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.llm import common
from txnlens.llm.rolling import BYTE_VALUES, Rolling, digests, signed, sliding_min
from txnlens.llm.suffixes import suffix_array

WIDTH = 400
GRAM = 128
SYMBOL = 16
HOT = 4096
#: Positions hashed in one go, and symbols sorted in one go.
PASS = 1 << 19
BATCH = 1 << 15
_PLACE = np.uint64((1 << 20) - 1)

_ANCHORS = "did long, crc binary, start long, windows int, times int, ahead int, key long, kind long"
_MARKS = "did long, crc binary, start long, windows long"


def _anchors(batches: Iterator[pa.RecordBatch], width: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        did, crc = batch.column("did"), batch.column("crc")
        data, offsets = common.utf8(batch.column("text"))
        for i, j, lo, hi in common.passes(offsets, PASS, width - 1):
            if hi - lo < width:
                continue
            values = BYTE_VALUES[data[lo:hi]]
            hashes = Rolling(values).windows(gram)
            place = np.arange(len(hashes), dtype=np.uint64)
            picked = sliding_min((hashes & ~_PLACE) | place, width - gram + 1) & _PLACE
            bounds = np.clip(offsets[i : j + 1], lo, hi) - lo
            doc = np.repeat(np.arange(i, j), np.diff(bounds))
            s = np.flatnonzero(doc[: len(picked)] == doc[width - 1 :])
            if not len(s):
                continue
            p = picked[s].astype(np.int64)
            fresh = np.concatenate([[True], (p[1:] != p[:-1]) | (np.diff(s) != 1)])
            at = np.flatnonzero(fresh)
            first, last, p = s[at], s[np.append(at[1:], len(s)) - 1], p[at]
            own, key, kind = doc[first], hashes[p], digests(data[lo:hi], first, last + width)
            # a text that repeats itself has the same span again and again, end to end: one row
            again = (own[1:] == own[:-1]) & (key[1:] == key[:-1]) & (kind[1:] == kind[:-1]) & (first[1:] == last[:-1] + 1)
            head = np.flatnonzero(np.concatenate([[True], ~again]))
            times = np.diff(np.append(head, len(first)))
            last = last[head + times - 1]
            first, p, own, key, kind = first[head], p[head], own[head], key[head], kind[head]
            yield pa.RecordBatch.from_arrays(
                [x.take(pa.array(own)) for x in (did, crc)] + [pa.array(x) for x in (first + lo - offsets[own], (last - first + 1).astype(np.int32), times.astype(np.int32), (p - first).astype(np.int32), signed(key), signed(kind))],
                names=["did", "crc", "start", "windows", "times", "ahead", "key", "kind"])


def _sorted_matches(pieces: list[bytes], ahead: np.ndarray, width: int) -> list[np.ndarray]:
    """For each piece, which of its windows also occurs elsewhere in the pieces."""
    whole = (width - SYMBOL + 1) // SYMBOL  # symbols that lie in any window, however it is aligned
    lengths = np.array([len(x) for x in pieces])
    skip = ahead % SYMBOL
    blocks = (lengths - skip) // SYMBOL
    flat = np.frombuffer(b"".join(x[o : o + n * SYMBOL] for x, o, n in zip(pieces, skip, blocks, strict=True)), dtype=f"V{SYMBOL}")
    names = np.unique(flat, return_inverse=True)[1].reshape(-1) + 1
    # a separator after each piece
    owner = np.repeat(np.arange(len(pieces)), blocks + 1)
    begin = np.concatenate([[0], np.cumsum(blocks + 1)])[:-1]
    symbols = np.zeros(len(owner), dtype=np.int64)
    inner = np.arange(len(owner)) - begin[owner]
    symbols[inner < blocks[owner]] = names
    order = suffix_array(symbols)
    order = order[(blocks[owner] - inner)[order] >= whole]
    hits = [np.zeros(max(0, n - width + 1), dtype=bool) for n in lengths]
    if len(order) < 2:
        return hits
    same = np.ones(len(order) - 1, dtype=bool)
    for k in range(whole):
        at = symbols[order + k]
        same &= at[1:] == at[:-1]
    run = np.concatenate([[0], np.cumsum(~same)])
    many = np.bincount(run)[run] > 1
    order, run = order[many], run[many]
    if not len(order):
        return hits
    # the bytes beside the shared symbols: SYMBOL before and after, 0 where the piece ends
    joined = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    base = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    own = owner[order]
    left = skip[own] + inner[order] * SYMBOL
    right = left + whole * SYMBOL
    rest = width - whole * SYMBOL  # bytes of a window outside the shared symbols
    for before in range(min(rest, SYMBOL - 1) + 1):
        after = rest - before
        fits = np.flatnonzero((left >= before) & (right + after <= lengths[own]))
        if len(fits) < 2:
            continue
        origin = base[own[fits]]
        row = np.empty((len(fits), rest + 8), dtype=np.uint8)
        row[:, :8] = run[fits].astype(np.int64).view(np.uint8).reshape(-1, 8)
        for k in range(before):
            row[:, 8 + k] = joined[origin + left[fits] - before + k]
        for k in range(after):
            row[:, 8 + before + k] = joined[origin + right[fits] + k]
        _, inverse, count = np.unique(np.ascontiguousarray(row).view(f"V{rest + 8}").reshape(-1), return_inverse=True, return_counts=True)
        for f in fits[count[inverse.reshape(-1)] > 1]:
            hits[own[f]][left[f] - before] = True
    return hits


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    first = np.flatnonzero(edge == 1)
    return first, np.flatnonzero(edge == -1) - first


def _sort_spans(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Spans ordered by key: sorted by whole keys, some ``BATCH`` symbols at a time."""
    rows: list[tuple] = []
    held = 0

    def settle() -> Iterator[pa.RecordBatch]:
        hits = _sorted_matches([r[6] for r in rows], np.array([r[4] for r in rows], dtype=np.int64), width)
        out: list[list] = [[], [], [], []]
        for (_, did, crc, start, _, n, _), hit in zip(rows, hits, strict=True):
            if n == 1:
                for a, k in zip(*_runs(hit), strict=True):
                    for column, x in zip(out, (did, crc, start + int(a), int(k)), strict=True):
                        column.append(x)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if k == 1 else pa.int64()) for k, x in enumerate(out)], names=["did", "crc", "start", "windows"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "did", "crc", "start", "ahead", "n", "piece")), strict=True):
            if held >= BATCH and row[0] != rows[-1][0]:
                yield from settle()
                rows, held = [], 0
            rows.append(row)
            held += len(row[6]) // SYMBOL
    if rows:
        yield from settle()


def _single_windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        did, crc = batch.column("did"), batch.column("crc")
        start, n = common.flatten(batch, "start", "n")
        data, offsets = common.utf8(batch.column("piece"))
        for i, j, lo, hi in common.passes(offsets, PASS, width - 1):
            doc = np.repeat(np.arange(i, j), np.diff(np.clip(offsets[i : j + 1], lo, hi) - lo))
            s = np.flatnonzero(doc[: max(0, len(doc) - width + 1)] == doc[width - 1 :]) if len(doc) >= width else np.zeros(0, np.int64)
            own, part = doc[s], memoryview(np.ascontiguousarray(data[lo:hi]))
            window = [blake2b(part[k : k + width], digest_size=16).digest() for k in s.tolist()]
            yield pa.RecordBatch.from_arrays([x.take(pa.array(own)) for x in (did, crc)] + [pa.array(start[own] + s + lo - offsets[own]), pa.array(n[own]), pa.array(window, pa.binary())],
                                             names=["did", "crc", "start", "n", "window"])


def repeated_windows(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``did, crc, start, windows``: runs of window starts whose window occurs elsewhere, too.

    ``docs`` has ``did, crc, text`` (``common.keyed``).
    """
    spark = docs.sparkSession
    anchors = common.keep(docs.mapInArrow(lambda x: _anchors(x, width, gram), _ANCHORS), "anchors")
    per_key = anchors.groupBy("key").agg(F.sum("times").alias("n"), F.min("kind").alias("least"), F.max("kind").alias("most"))
    # written first: a sum and a join in one stage would keep Spark from splitting a frequent key
    repeated = common.keep(per_key.where("n > 1").select("key", (F.col("least") != F.col("most")).alias("mixed")), "keys")
    found = common.keep(anchors.join(repeated, "key"), "repeated")
    common.release(spark)

    plain = found.where(~F.col("mixed"))
    mixed = found.where("mixed")
    kinds = common.keep(
        mixed.groupBy("key", "kind").agg(F.sum("times").alias("n"), F.min(F.struct("did", "crc", "start", F.expr("int(windows div times)").alias("windows"), "ahead")).alias("one")).select("key", "kind", "n", "one.*"), "kinds")
    copied = mixed.join(kinds.where("n > 1").select("key", "kind"), ["key", "kind"])
    crowd = kinds.groupBy("key").count().where(F.col("count") > hot).select("key", F.lit(True).alias("crowded"))
    wanted = kinds.join(crowd, "key", "left").withColumnRenamed("start", "at")
    body = F.expr(f"substring(cast(text as binary), int(at) + 1, windows + {width - 1})")
    pieces = common.once(docs).join(wanted, ["did", "crc"]).select("key", "did", "crc", F.col("at").alias("start"), "ahead", "n", F.coalesce("crowded", F.lit(False)).alias("crowded"), body.alias("piece"))
    pieces = common.keep(pieces, "pieces")
    common.release(spark)

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    to_sort = pieces.where(~F.col("crowded")).drop("crowded").repartition(parts, "key").sortWithinPartitions("key")
    ordered = to_sort.mapInArrow(lambda x: _sort_spans(x, width), _MARKS)
    single = pieces.where("crowded").select("did", "crc", "start", "n", "piece").mapInArrow(
        lambda x: _single_windows(x, width), "did long, crc binary, start long, n long, window binary")
    again = common.keep(single.groupBy("window").agg(F.sum("n").alias("total")).where("total > 1").select("window"), "again")
    lone = single.where("n = 1").join(again, "window").select("did", "crc", "start", F.lit(1).cast("long").alias("windows"))
    columns = ["did", "crc", "start", F.col("windows").cast("long").alias("windows")]
    return plain.select(*columns).unionByName(copied.select(*columns)).unionByName(ordered).unionByName(lone)


def _cut(batches: Iterator[pa.RecordBatch], width: int, as_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in common.sliced(batches):
        rows = len(batch)
        size, removed, spans = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        kept, marks = [], batch.column("marks")
        data, offsets = common.utf8(batch.column("text"))
        for r in range(rows):
            text = data[offsets[r] : offsets[r + 1]]
            size[r] = len(text)
            if marks[r].is_valid:
                flat = marks[r].values.flatten()
                start, windows = flat[0].to_numpy(), flat[1].to_numpy()
                change = np.zeros(len(text) + 1, dtype=np.int32)
                np.add.at(change, start, 1)
                np.add.at(change, start + windows + width - 1, -1)
                gone = np.cumsum(change)[:-1] > 0
                removed[r], spans[r] = int(gone.sum()), len(_runs(gone)[0])
                text = text[~gone]
            kept.append(text.tobytes().decode("utf-8", "ignore") if as_text else text.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(size), pa.array(removed), pa.array(spans), pa.array(kept, pa.string() if as_text else pa.binary())],
                                         names=["row", "n_bytes", "n_removed", "n_spans", "kept"])


def suffix_dedup(docs: DataFrame, carry: list[str], width: int = WIDTH, gram: int = GRAM, hot: int = HOT, as_text: bool = False) -> DataFrame:
    """``row`` (the columns ``carry`` as a struct), ``n_bytes, n_removed, n_spans, kept`` (the remaining bytes) for each row of ``docs``.

    ``as_text``: ``kept`` is a string, without the characters that a cut leaves incomplete. It is decoded where it is
    cut, since each further step in Python takes further workers, which stay and hold memory beside the JVM.
    """
    common.bound_batches(docs.sparkSession)
    if not 0 < gram <= width or width < 2 * SYMBOL:
        raise ValueError("gram must lie in 1..width, and width be two symbols or more")
    marks = repeated_windows(common.keyed(docs), width, gram, hot)
    # distinct: rows that are repeated share their marks
    marks = marks.distinct().groupBy(F.col("did").alias("__did"), F.col("crc").alias("__crc")).agg(F.collect_list(F.struct("start", "windows")).alias("marks"))
    marks = common.keep(marks, "marks")
    common.release(docs.sparkSession)
    rows = common.addressed(docs.select(F.struct(*carry).alias("row"), "doc_id", "text"))
    joined = rows.join(marks, ["__did", "__crc"], "left").select("row", "text", "marks")
    kind = joined.schema["row"].dataType.simpleString()
    return joined.mapInArrow(lambda x: _cut(x, width, as_text), f"row {kind}, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}")


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    return found.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
