"""Byte-level BPE: encodes texts by a rank file, and decodes the ids.

The text is split by a pattern, each match encoded on its own. Two tiers: a minimal
perfect hash over the vocabulary resolves a match that is itself a token; any other match
is merged from its bytes, linked to their neighbours, with a heap that yields the pair of
lowest rank (leftmost first). Special tokens are not known.

The hash, the tokens and the pair ranks are built once on the driver from the rank file,
whose path is a parameter, and broadcast: they are bounded by the vocabulary (at most
``VOCABULARY`` tokens). Tasks are independent of each other. A Python worker remembers what
matches of up to ``SHORT`` characters encode to, also from one task to the next, within ``REMEMBERED`` bytes:
beyond it the half that was not asked for lately goes.

Results for odd input: null and empty texts have no ids and decode to nothing; repeated
rows and null ids are kept as they are; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice
from struct import pack

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.llm import common

VOCABULARY = 1 << 20
#: Bytes of remembered matches in a worker, about, and characters of the longest match kept.
REMEMBERED, SHORT = 80 << 20, 64
#: Texts beyond this many characters are matched piece by piece.
LONG = 1 << 20


def load_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    if sorted(ranks) != list(range(len(ranks))) or len(ranks) > VOCABULARY:
        raise ValueError("ranks must be 0, 1, 2, ... and within VOCABULARY")
    return [ranks[r] for r in range(len(ranks))]


class PerfectHash:
    """Minimal perfect hash by displacement: a key's bucket holds the seed that sends each of its keys to a free slot.

    Buckets are placed from the largest down; those of one key store their slot itself
    (as ``-slot - 1``), so that all slots are filled.
    """

    def __init__(self, keys: list[bytes]):
        self.n, self.buckets = len(keys), max(1, len(keys) * 2 // 3)
        members: dict[int, list[int]] = {}
        digests = [xxhash.xxh64_intdigest(k) for k in keys]
        if len(set(digests)) < len(keys):
            raise ValueError("keys must differ")
        for k, digest in enumerate(digests):
            members.setdefault(digest % self.buckets, []).append(k)
        self.seeds = [0] * self.buckets
        self.key_at = [-1] * self.n
        single = []
        for bucket, own in sorted(members.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(own) == 1:
                single.append((bucket, own[0]))
                continue
            seed, at = 0, []
            while len(set(at)) < len(own) or any(self.key_at[x] >= 0 for x in at):
                seed += 1
                at = [self._slot(digests[k], seed) for k in own]
            self.seeds[bucket] = seed
            for k, x in zip(own, at, strict=True):
                self.key_at[x] = k
        free = (x for x, k in enumerate(self.key_at[:]) if k < 0)
        for bucket, k in single:
            at = next(free)
            self.seeds[bucket], self.key_at[at] = -at - 1, k

    def _slot(self, digest: int, seed: int) -> int:
        return ((digest ^ seed * 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9 >> 31 & 0x7FFFFFFF) % self.n

    def find(self, key: bytes) -> int:
        """The number of a key, or any number for what is none: the caller compares."""
        digest = xxhash.xxh64_intdigest(key)
        seed = self.seeds[digest % self.buckets]
        return self.key_at[-seed - 1 if seed < 0 else self._slot(digest, seed)]


class Encoder:
    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern = tokens, pattern
        self.name = xxhash.xxh3_128_hexdigest(b"\n".join(map(base64.b64encode, tokens)) + pattern.encode())
        self.hash = PerfectHash(tokens)
        number = {t: k for k, t in enumerate(tokens)}
        self.byte = [number.get(bytes([b]), -1) for b in range(256)]
        if min(self.byte) < 0:
            raise ValueError("each byte must be a token")
        self.base = len(tokens)
        self.pairs = {
            number[t[:cut]] * self.base + number[t[cut:]]: k
            for k, t in enumerate(tokens) for cut in range(1, len(t)) if t[:cut] in number and t[cut:] in number
        }

    def encode_match(self, match: bytes) -> list[int]:
        k = self.hash.find(match)
        return [k] if self.tokens[k] == match else self._merge(match)

    def _merge(self, match: bytes) -> list[int]:
        rank_of, base, byte = self.pairs.get, self.base, self.byte
        ids = [byte[b] for b in match]
        n = len(ids)
        shift = n.bit_length()
        mask = (1 << shift) - 1
        heap = []
        for i in range(n - 1):
            rank = rank_of(ids[i] * base + ids[i + 1])
            if rank is not None:
                heap.append(rank << shift | i)
        heapify(heap)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        ids.append(-base * base)  # stands behind the last byte and pairs with nothing
        while heap:
            entry = heappop(heap)
            i, rank = entry & mask, entry >> shift
            j, left = after[i], ids[i]
            if left < 0 or rank_of(left * base + ids[j]) != rank:
                continue  # one side has been merged meanwhile
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = rank_of(rank * base + ids[k])
                if found is not None:
                    heappush(heap, found << shift | i)
            p = before[i]
            if p >= 0:
                found = rank_of(ids[p] * base + rank)
                if found is not None:
                    heappush(heap, found << shift | p)
        return [x for x in ids if x >= 0]


class _Remembered(dict):
    """Matches as the little-endian ids they encode to: a young half, and an old one that moves up when asked for."""

    def __init__(self, encoder: Encoder, limit: int = REMEMBERED):
        self.encoder, self.limit, self.old, self.size = encoder, limit, {}, 0

    def __missing__(self, match: str) -> bytes:
        found = self.old.get(match)
        if found is None:
            ids = self.encoder.encode_match(match.encode())
            found = pack(f"<{len(ids)}I", *ids)
            if len(match) > SHORT:
                return found
        self.size += 200 + 4 * len(match) + len(found)  # about what Python takes for the two and their place
        if 2 * self.size > self.limit:
            self.old = dict(self)
            self.clear()
            self.size = 200 + 4 * len(match) + len(found)
        self[match] = found
        return found


#: What this Python worker remembers, for the encoder it was asked for last.
_WORKER: dict[str, _Remembered] = {}


def _memory(encoder: Encoder) -> _Remembered:
    known = _WORKER.get(encoder.name)
    if known is None:
        _WORKER.clear()
        known = _WORKER[encoder.name] = _Remembered(encoder)
    known.encoder = encoder  # an equal one: lets go of an earlier broadcast
    return known


def _encode(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    encoder = shared.value
    known = _memory(encoder)
    matcher, get, tokens = regex.compile(encoder.pattern), known.__getitem__, encoder.tokens.__getitem__
    for part in common.sliced(batches):
        ids, decoded, rows = [], [], part.column("text")
        for r in range(len(part)):
            text = rows[r].as_py() or ""
            if len(text) <= LONG:
                ids.append(b"".join(map(get, matcher.findall(text))))
            else:
                found, pieces = (m[0] for m in matcher.finditer(text)), []
                while block := list(islice(found, LONG)):
                    pieces.append(b"".join(map(get, block)))
                ids.append(b"".join(pieces))
            decoded.append(b"".join(map(tokens, np.frombuffer(ids[-1], "<u4").tolist())))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"])


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids, decoded`` for each row: ids as little-endian unsigned 32-bit integers, and the bytes they stand for."""
    common.bound_batches(docs.sparkSession)
    encoder = docs.sparkSession.sparkContext.broadcast(Encoder(load_ranks(path), pattern))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda x: _encode(x, encoder), "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``, by default with the public 50k vocabulary."""
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    found = encode_decode(docs, path, pattern)
    return found.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
