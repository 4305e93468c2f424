"""Benchmark decontamination: an inverted index of the test items, asked by every passage.

Words are runs of letters and digits, lower-cased (bytes beyond ASCII count as letters). The
items are the documents of a BM25 index; each passage of the corpus is a query of its
distinct words. Items are indexed by length class (a power of two at least their
number of words), and passages for a class of ``c`` words are ``SPAN * c`` long and start every
``c`` words, so that any copy of an item lies whole in one passage, also one that insertions
have grown to ``(SPAN - 1) * c`` words.

Retrieval is block-max WAND. The items of a class, ordered by their threshold, form blocks;
for each word a block keeps its greatest impact. A passage whose sum of block maxima is
below the least threshold of a block skips the block (for all passages at once, as array
sums). In the other blocks the posting lists are walked with a pivot: items whose
upper bound is below the threshold are passed over, the rest scored in full. All items at
or above their threshold are retrieved.

An item's threshold is its own score less the greatest impacts of as many words as the
overlap rule lets go, so retrieval loses nothing that verification would accept.
Verification takes ``SHINGLE``-word shingles and asks that the passage holds ``OVERLAP`` or more of
the item's question and of its answer. The answer is the item's last line, or its last
sentence, or its last quarter; its shingles are all that end in it.

Items are taken in blocks of at most ``INDEX_BYTES`` (about), one index and one pass over the
corpus a block, one index at a time, so that what is broadcast has a bound however large the
benchmark is; equal items are indexed once. How rare a word is and how long items are on average
is counted over all of them, so that scores do not depend on the blocks.

Results for odd input: null, empty and wordless texts and items match nothing; repeated
rows and repeated items are reported each; null ids are kept as null; an empty table on
either side gives an empty result; other columns of the inputs are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import fsum

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.llm import common
from txnlens.llm.rolling import Rolling, word_hashes

SHINGLE = 5
OVERLAP = 0.8
K1, B = 1.2, 0.75
SPAN = 4
BLOCK = 8
INDEX_BYTES = 1 << 20
PASS = 1 << 20

_SEPARATES = np.ones(256, dtype=bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _SEPARATES[_lo:_hi] = False
_LAST_SENTENCE = re.compile(r"(?s)^(.*[.!?])\s+(\S.*)$")


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the document it lies in."""
    start, end, doc = common.word_bounds(data, offsets, _SEPARATES)
    return word_hashes(data, start, end), doc


def _hashed(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return _words(data, np.array([0, len(data)]))[0]


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item."""
    text = text.strip()
    head, line, tail = text.rpartition("\n")
    if line and _hashed(head).size and _hashed(tail).size:
        return head, tail
    found = _LAST_SENTENCE.match(text)
    if found and _hashed(found[1]).size and _hashed(found[2]).size:
        return found[1], found[2]
    parts = text.split()
    cut = len(parts) - max(1, len(parts) // 4)
    return " ".join(parts[:cut]), " ".join(parts[cut:])


class Item:
    def __init__(self, item_id: int | None, text: str, copies: int = 1):
        self.item_id, self.copies = item_id, copies
        question, answer = split_item(text)
        asked = len(_hashed(question))
        self.words = np.concatenate([_hashed(question), _hashed(answer)])
        n = len(self.words)
        self.width = min(SHINGLE, n)
        shingles = Rolling(self.words).windows(self.width) if n else self.words
        last = np.arange(len(shingles)) + self.width
        parts = [shingles[last <= asked], shingles[last > asked]]
        self.parts = [np.unique(p) for p in parts if len(p)]
        self.lost = sum(int((1 - OVERLAP) * len(p) + 1e-9) for p in self.parts)

    def overlap(self, shingles: np.ndarray) -> list[float]:
        """The share of the question's and of the answer's shingles that a passage holds."""
        return [float(np.isin(p, shingles).mean()) for p in self.parts]


class Index:
    """Items of one length class."""

    def __init__(self, items: list[Item], length: int, idf: dict[int, float], mean: float):
        impacts = []
        for item in items:
            scale = K1 * (1 - B + B * len(item.words) / mean)
            impacts.append({w: idf[w] * n * (K1 + 1) / (n + scale) for w, n in Counter(item.words.tolist()).items()})
        least = [sum(x.values()) - sum(sorted(x.values(), reverse=True)[: item.lost]) for x, item in zip(impacts, items, strict=True)]
        order = sorted(range(len(items)), key=lambda k: least[k])
        self.length = length
        self.items = [items[k] for k in order]
        self.least = np.array([least[k] for k in order]) * (1 - 1e-6)
        self.vocabulary = np.array(sorted({w for x in impacts for w in x}), dtype=np.uint64)
        self.seen = np.zeros(1 << 18, dtype=bool)  # by the first bits of a word's hash: most other words are sorted out here
        self.seen[self.vocabulary >> np.uint64(46)] = True
        place = {w: k for k, w in enumerate(self.vocabulary.tolist())}
        self.postings: list[dict[int, tuple[list[int], list[float]]]] = [{} for _ in range(-(-len(items) // BLOCK))]
        for at, k in enumerate(order):
            for w, x in impacts[k].items():
                items_at, xs = self.postings[at // BLOCK].setdefault(place[w], ([], []))
                items_at.append(at)
                xs.append(x)
        # block maxima by word, for the blocks that hold it: as long as the posting lists, whatever the vocabulary
        tops = sorted((t, b, max(xs) * (1 + 1e-6)) for b, lists in enumerate(self.postings) for t, (_, xs) in lists.items())
        self.top_start = np.searchsorted(np.array([t for t, _, _ in tops]), np.arange(len(place) + 1))
        self.top_block = np.array([b for _, b, _ in tops], dtype=np.int64)
        self.top = np.array([x for _, _, x in tops])
        self.block_least = self.least[::BLOCK]

    def passing(self, terms: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Query and block wherever the sum of the block's maxima reaches its least threshold."""
        out = []
        blocks, n = len(self.postings), np.diff(self.top_start)[terms]
        upto = np.concatenate([[0], np.cumsum(n)])
        # as many queries at a time as have some million sums and maxima
        cost = np.arange(len(first)) * blocks + upto[first]
        a = 0
        while a < len(first) - 1:
            b = max(a + 1, int(np.searchsorted(cost, cost[a] + (1 << 21), "right")) - 1)
            some = slice(first[a], first[b])
            at = np.arange(upto[first[b]] - upto[first[a]]) + np.repeat(self.top_start[terms[some]] - (upto[some] - upto[first[a]]), n[some])
            query = np.repeat(np.repeat(np.arange(b - a), np.diff(first[a : b + 1])), n[some])
            bound = np.bincount(query * blocks + self.top_block[at], weights=self.top[at], minlength=(b - a) * blocks).reshape(b - a, blocks)
            q, k = np.nonzero((bound > 0) & (bound * (1 + 1e-9) >= self.block_least))
            out.append((q + a, k))
            a = b
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int))

    def walk(self, terms: list[int], block: int) -> list[tuple[int, float]]:
        """Items of a block at or above their threshold, with their scores: WAND over its posting lists."""
        held = self.postings[block]
        lists = [[*held[t], max(held[t][1]) * (1 + 1e-6), 0] for t in terms if t in held]
        found, floor = [], float(self.block_least[block])
        while lists:
            lists.sort(key=lambda x: x[0][x[3]])
            bound, pivot = 0.0, -1
            for k, x in enumerate(lists):
                bound += x[2]
                if bound >= floor:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot][0][lists[pivot][3]]
            if lists[0][0][lists[0][3]] == item:
                here = [x for x in lists if x[0][x[3]] == item]
                score = fsum(x[1][x[3]] for x in here)  # in any order the same
                for x in here:
                    x[3] += 1
                if score >= self.least[item]:
                    found.append((item, score))
            else:
                for x in lists[:pivot]:
                    while x[3] < len(x[0]) and x[0][x[3]] < item:
                        x[3] += 1
            lists = [x for x in lists if x[3] < len(x[0])]
        return found


def build(rows: list[tuple[int | None, str, int]], holds: dict[int, int], n_items: int, mean: float) -> list[Index]:
    """The indexes of some items (id, text, copies), one for each length class; of all ``n_items`` items ``holds`` tells how many have a word, ``mean`` how long they are."""
    items = [x for x in (Item(i, t.lower(), n) for i, t, n in rows if t) if len(x.words)]
    idf = {w: float(np.log1p((n_items - n + 0.5) / (n + 0.5))) for w, n in holds.items()}
    classes: dict[int, list[Item]] = {}
    for x in items:
        classes.setdefault(max(8, 1 << (len(x.words) - 1).bit_length()), []).append(x)
    return [Index(own, length, idf, mean) for length, own in sorted(classes.items())]


def _search(words: np.ndarray, doc: np.ndarray, n_docs: int, index: Index) -> Iterator[tuple[int, int, Item, float, list[float]]]:
    """Document, first word of the passage, item, score and overlaps of each verified meeting."""
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    count = np.diff(first)
    c = index.length
    passages = np.maximum(1, -(-count // c) - (SPAN - 1))
    base = np.concatenate([[0], np.cumsum(passages)])
    known = np.flatnonzero(index.seen[words >> np.uint64(46)])
    term = np.searchsorted(index.vocabulary, words[known])
    term[term == len(index.vocabulary)] = 0
    held = index.vocabulary[term] == words[known]
    known, term = known[held], term[held]
    if not len(known):
        return
    own = doc[known]
    k = (known - first[own]) // c
    size = len(index.vocabulary)
    keys = np.concatenate([((base[own] + k - j) * size + term)[(k >= j) & (k - j < passages[own])] for j in range(SPAN)])
    keys.sort()
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    query, terms = keys // size, keys % size
    starts = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
    ends = np.append(starts, len(query))
    shingles: dict[int, np.ndarray] = {}
    for q, block in zip(*index.passing(terms, ends), strict=True):
        hits = index.walk(terms[ends[q] : ends[q + 1]].tolist(), int(block))
        if not hits:
            continue
        passage = int(query[starts[q]])
        d = int(np.searchsorted(base, passage, "right")) - 1
        lo = int(first[d]) + (passage - int(base[d])) * c
        hi = min(int(first[d + 1]), lo + SPAN * c)
        for item, score in hits:
            x = index.items[item]
            if x.width not in shingles:
                shingles[x.width] = Rolling(words).windows(x.width)
            overlaps = x.overlap(shingles[x.width][lo : max(lo, hi - x.width + 1)])
            if min(overlaps) >= OVERLAP - 1e-9:
                yield d, lo - int(first[d]), x, score, overlaps


def _matches(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        did, crc = batch.column("did"), batch.column("crc")
        data, offsets = common.utf8(batch.column("text"))
        i, n = 0, len(offsets) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PASS, "right")) - 1)
            words, doc = _words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            best: dict[tuple[int, int], tuple] = {}
            for index in shared.value if len(words) else ():
                for d, at, item, score, overlaps in _search(words, doc, j - i, index):
                    known = best.get((d, id(item)))
                    if known is None or (score, -at) > (known[3], -known[2]):
                        best[d, id(item)] = (d, item.item_id, at, score, overlaps[0], overlaps[-1], item.copies)
            if best:
                rows = list(best.values())
                d = pa.array(np.array([r[0] for r in rows]) + i)
                yield pa.RecordBatch.from_arrays(
                    [did.take(d), crc.take(d), *(pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.float64()), (4, pa.float64()), (5, pa.float64()), (6, pa.int64())))],
                    names=["did", "crc", "item_id", "first_word", "score", "question_overlap", "answer_overlap", "copies"])
            i = j


_FOUND = "did long, crc binary, item_id long, first_word long, score double, question_overlap double, answer_overlap double, copies long"


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each item, with its block and copies; the first row of an item has its length, too."""
    for batch in batches:
        for part, text, copies in zip(*(batch.column(c).to_pylist() for c in ("part", "text", "copies")), strict=True):
            item = Item(None, text.lower())
            words = np.unique(item.words)
            n = len(words)
            length = np.zeros(n, np.int64)
            length[:1] = len(item.words)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int64)), pa.array(words.view(np.int64)), pa.array(np.full(n, copies, np.int64)), pa.array(length)], names=["part", "word", "copies", "length"])


def matches(docs: DataFrame, benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``did, crc, item_id, first_word, score, question_overlap, answer_overlap``: the best passage for each item that a row of ``docs`` (``did, crc, text``) holds."""
    common.bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    # equal items are one, with a count: no block grows by repetition
    items = common.keep(items.groupBy("item_id", "text").agg(F.count("*").alias("copies")), "items")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // index_bytes))
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    # how many of all items hold a word, and their mean length: the same whatever the blocks
    words = common.keep(items.mapInArrow(_item_words, "part long, word long, copies long, length long"), "item-words")
    holds = common.keep(words.groupBy("word").agg(F.sum("copies").alias("n")), "holds")
    n_items, length = words.where("length > 0").agg(F.coalesce(F.sum("copies"), F.lit(0)), F.sum(F.col("length") * F.col("copies"))).first()
    lowered = docs.select("did", "crc", F.lower("text").alias("text"))
    found = spark.createDataFrame([], _FOUND)
    for part in range(blocks if n_items else 0):  # a block of items at a time, each against all documents
        rows = items.where(F.col("part") == part).orderBy("item_id", "text").collect()
        held = holds.join(words.where(F.col("part") == part).select("word").distinct(), "word").collect()  # words of the block
        index = build([(r["item_id"], r["text"], r["copies"]) for r in rows], {r["word"] & 0xFFFFFFFFFFFFFFFF: r["n"] for r in held}, n_items, length / n_items)
        shared = spark.sparkContext.broadcast(index)
        some = lowered.mapInArrow(lambda x, s=shared: _matches(x, s), _FOUND)
        if blocks > 1:  # written, so that the next block's index takes this one's place
            some = common.keep(some, "matches")
            shared.unpersist()
        found = some if part == 0 else found.unionByName(some)
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies", "copy")


def contaminated(docs: DataFrame, benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``doc_id, item_id, first_word, score, question_overlap, answer_overlap`` for each item that a row of ``docs`` holds."""
    return matches(common.keyed(docs), benchmark, index_bytes).select(common.doc_id(), "item_id", "first_word", "score", "question_overlap", "answer_overlap")


def op10_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
