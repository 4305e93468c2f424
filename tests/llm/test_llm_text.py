"""Operators on texts against brute force, on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import pickle
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from txnlens.llm import bpe, common, decontaminate, rolling, sharding, simhash, substring_dedup, suffix_dedup
from txnlens.llm.suffixes import suffix_array

WORDS = ["ab", "cé", "d", "xyzzy", "q", "The", "tHe", "ñandú"]
SEP = r"[^\x20\x09-\x0d]+"


def random_words(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    passages = [random_words(rng, rng.randint(40, 150)) for _ in range(5)]
    out = [(1, None), (2, ""), (None, " ".join(passages[0])), (None, None), (3, " ".join(["a"] * 300)), (3, " ".join(passages[0])), (3, " ".join(passages[0])), (4, "abc  " * 90), (2**40, " ".join(passages[1])), (0, "\t x \n")]
    for d in range(10, 60):
        words = []
        for _ in range(rng.randint(1, 4)):
            p, a = rng.choice(passages), rng.randint(0, 20)
            words += p[a : a + rng.randint(20, 140)] if rng.random() < 0.6 else random_words(rng, rng.randint(0, 60))
        out.append((d, rng.choice([" ", "\n", " \t"]).join(words)))
    out.append((70, " ".join(random_words(rng, 9000))))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    clashing = [(d, t, "en", 1, 2, 3, "s", 4) for d, t in rows]
    return spark.createDataFrame(clashing, "doc_id long, text string, lang string, fp int, crc int, did int, row string, start int")


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def same(got, want):
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(500):
        s = [rng.randint(0, rng.choice([1, 2, 9])) for _ in range(rng.randint(0, 40))]
        assert suffix_array(np.array(s, dtype=np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def brute_bytes(rows, width):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + width] for _, b in texts for i in range(len(b) - width + 1))
    for d, b in texts:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        yield d, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), kept


@pytest.mark.parametrize("hot", [4096, 2])
def test_suffix_dedup(docs, rows, hot):
    found = suffix_dedup.suffix_dedup(docs, ["doc_id", "row"], width=48, gram=16, hot=hot)
    got = [(r.row.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found.collect()]
    want = list(brute_bytes(rows, 48))
    same(got, want)
    assert 0 < sum(x[2] for x in want) < sum(x[1] for x in want)


def test_long_texts_in_slices(spark, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PASS", 300)
    long = list(common_batches(rows))
    pieces = [r for b in suffix_dedup._anchors(iter(long), 48, 16) for r in b.to_pylist()]
    covered = {(r["did"], r["crc"], r["start"] + k) for r in pieces for k in range(r["windows"])}
    import zlib

    assert covered == {(d or 0, zlib.crc32((t or "").encode()), i) for d, t in rows for i in range(len((t or "").encode()) - 47)}


def common_batches(rows):
    import zlib

    import pyarrow as pa

    yield pa.RecordBatch.from_arrays([pa.array([d or 0 for d, _ in rows]), pa.array([zlib.crc32((t or "").encode()) for _, t in rows]), pa.array([t for _, t in rows])], names=["did", "crc", "text"])


def test_substring_dedup(docs, rows):
    width, first = 50, {}
    texts = [(d, re.findall(SEP, t or "")) for d, t in rows]
    key = lambda d: -(2**63) if d is None else d
    for d, w in texts:
        for i in range(len(w) - width + 1):
            first[tuple(w[i : i + width])] = min(first.get(tuple(w[i : i + width]), 2**63), key(d))
    want = []
    for d, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < key(d):
                gone[i : i + width] = [True] * width
        want.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()))
    same([(r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in substring_dedup.substring_dedup(docs).collect()], want)
    assert sum(x[2] for x in want) > 0


def patterned(n):
    """Two texts that sums of bytes times powers of an odd base, modulo 2**64, cannot tell apart at some length."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_patterned_texts_are_told_apart(spark):
    one, two = patterned(1024)
    rest = " ".join(f"w{k}" for k in range(49))
    docs = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, f"{two} {rest}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(docs).collect()} == {1: 0, 2: 0, 3: 50}
    one, two = patterned(4096)
    for size in (400, 4096):
        rows = [(1, one[:size]), (2, two[:size])]
        want = list(brute_bytes(rows, 400))
        for hot in (4096, 0):
            found = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"], hot=hot)
            same([(r.row.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found.collect()], want)
        assert size > 400 or not any(x[2] for x in want)


def test_word_hashes():
    words = [b"", b"a", b"a\0", b"\0", b"\0\0", b"12345678", b"12345678\0", b"x" * 256, b"x" * 257, b"y" + b"x" * 256, *(x.encode() for n in (16, 64, 256, 1024) for x in patterned(n))]
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    hashes = rolling.word_hashes(data, starts, ends)
    assert len(set(hashes.tolist())) == len(words)
    shifted = rolling.word_hashes(np.append(np.frombuffer(b"zzz", np.uint8), data), starts + 3, ends + 3)
    assert (shifted == hashes).all()


def test_a_third_of_all_rows_is_one_row(spark, rows):
    """Repeated rows share one set of marks, and give their text to a join once."""
    text = rows[11][1] + " " + rows[12][1]
    many = [*rows[10:40], *[(7, text)] * 400]
    docs = spark.createDataFrame(many, "doc_id long, text string").repartition(4)
    found = suffix_dedup.suffix_dedup(docs, ["doc_id"], width=48, gram=16)
    same([(r.row.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found.collect()], list(brute_bytes(many, 48)))
    marks = common.keyed(docs)
    assert common.once(marks).where("did = 7").count() == 1
    shards = sharding.shard(docs, 10)
    sizes = [r["sum(size)"] for r in shards.groupBy("shard").sum("size").collect()]
    assert max(sizes) - min(sizes) <= 2 * max(len(t.encode()) + 16 for _, t in many)
    assert all(sorted(r.slots) == list(range(len(r.slots))) for r in shards.groupBy("shard").agg(F.collect_list("slot").alias("slots")).collect())


def brute_fingerprint(text):
    words = re.findall(SEP, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if words else 0


@pytest.mark.parametrize("crowd", [256, 2])
def test_simhash(spark, rows, crowd):
    rng = random.Random(7)
    base, more = random_words(rng, 400), list(rows)
    for d in range(200, 240):
        words = list(base)
        for _ in range(rng.randint(0, 12)):
            words[rng.randrange(400)] = rng.choice(WORDS)
        more.append((d, " ".join(words)))
    prints = [brute_fingerprint(t) for _, t in more]
    root = list(range(len(more)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(more)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(more):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    found = simhash.near_duplicates(spark.createDataFrame(more, "doc_id long, text string"), crowd=crowd)
    got = found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id").collect()
    same(got, [(d, f"{prints[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(more)])


def test_bpe_like_tiktoken(docs, rows):
    import public_tokenizers
    import tiktoken

    tokens = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})
    want = []
    for d, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    same(bpe.digests(docs).collect(), want)
    encoder = bpe.Encoder(tokens, public_tokenizers.PATTERN)
    assert all(encoder.hash.find(t) == k for k, t in enumerate(tokens))
    for text in ["日本語 text  \n\n x", "🙂👍🏽" * 20, "a" * 3000, "<|endoftext|> it'll"]:
        got = [k for m in __import__("regex").findall(public_tokenizers.PATTERN, text) for k in encoder.encode_match(m.encode())]
        assert got == library.encode_ordinary(text)


def test_sharding(docs, rows):
    got = sharding.shard(docs, 7).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size) for r in got) == sorted((d is not None, d or 0, len((t or "").encode()) + 16) for d, t in rows)
    total, start = sum(r.size for r in got), 0
    for r in sorted(got, key=lambda r: (r.shard, r.slot)):
        assert r.shard == (start + r.size - r.size // 2 - 1) * 7 // total and r.law == "bytes" and r.grown_shard is None
        start += r.size
    for k in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == k)
        assert slots == list(range(len(slots)))


@pytest.mark.parametrize("index_bytes", [1 << 20, 400])
def test_decontamination(spark, index_bytes):
    rng = random.Random(3)
    words = ["w%d" % k for k in range(300)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(4, 50))) + ".\nAnswer " + " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for k in range(30)] + [(None, "no id here at all. yes"), (50, None), (51, ""), (52, "...")]
    texts = [(d, " ".join(rng.choice(words) for _ in range(rng.randint(0, 400)))) for d in range(40)]
    for d in range(40, 70):
        inside = items[rng.randrange(31)][1].split()
        if rng.random() < 0.4:
            inside[rng.randrange(len(inside))] = "changed"
        texts.append((d, " ".join([rng.choice(words) for _ in range(rng.randint(0, 200))] + inside).upper()))
    texts += [(None, items[0][1]), (90, None), (91, "")]
    known = [decontaminate.Item(k, t.lower()) for k, t in items if t and decontaminate._hashed(t).size]
    want = set()
    for d, t in texts:
        w = decontaminate._hashed((t or "").lower())
        for x in known:
            shingles = decontaminate.Rolling(w).windows(x.width)
            if len(shingles) and min(x.overlap(shingles)) >= 0.8:
                want.add((d, x.item_id))
    found = decontaminate.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), index_bytes)
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert got <= want and len(want) > 20
    # shingles of one item may lie further apart than a passage only by chance
    assert len(want - got) == 0


def test_index_is_as_long_as_its_items():
    """1 MB of items make an index of a few MB, and each block's maxima are those of its items."""
    rng = random.Random(3)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6)) % 60000}" for _ in range(40)) for _ in range(4000)]
    items = [decontaminate.Item(k, t) for k, t in enumerate(texts)]
    holds = Counter(w for x in items for w in set(x.words.tolist()))
    indexes = decontaminate.build([(k, t, 1) for k, t in enumerate(texts)], holds, len(texts), 40.0)
    assert sum(map(len, texts)) > 500_000 and len(pickle.dumps(indexes)) < 10_000_000
    for index in indexes:
        tops = {(t, b): max(xs) for b, lists in enumerate(index.postings) for t, (_, xs) in lists.items()}
        found = {(t, int(index.top_block[k])): index.top[k] for t in range(len(index.vocabulary)) for k in range(index.top_start[t], index.top_start[t + 1])}
        assert found.keys() == tops.keys() and all(tops[k] <= found[k] <= tops[k] * 1.00001 for k in tops)


def test_scores_do_not_depend_on_blocks(spark):
    rng = random.Random(4)
    items = [(k % 30, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.choice([6, 12, 40])))) for k in range(40)]
    items += [items[3]] * 25 + [(None, items[5][1])] * 2
    docs = [(d, " ".join([*(f"x{rng.randrange(99)}" for _ in range(30)), items[rng.randrange(40) if d else 3][1]])) for d in range(50)]
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(tuple, decontaminate.contaminated(*tables, size).collect()), key=repr) for size in (1 << 20, 300))
    assert one == many and any(one.count(r) == 26 for r in one)


def test_copies_with_insertions_at_every_offset(spark):
    item = " ".join(f"q{k}" for k in range(27)) + ".\n" + " ".join(f"a{k}" for k in range(5))
    words = item.split()
    texts = []
    for more in (0, 8, 32, 64):
        for offset in range(32):
            grown = words[:12] + [f"n{k}" for k in range(more)] + words[12:]
            texts.append((len(texts), " ".join([f"b{k}" for k in range(offset)] + grown + [f"c{k}" for k in range(50)])))
    found = decontaminate.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(r.doc_id for r in found.collect()) == [d for d, _ in texts]


def test_rows_of_equal_crc32_are_told_apart(spark):
    """Two texts without an id and of one CRC-32: only the first repeats a passage, and holds an item."""
    import zlib

    import corpus_pipeline

    rng = random.Random(11)
    passage = " ".join("p%d" % rng.randrange(10**6) for _ in range(90))
    other = " ".join("q%d" % rng.randrange(10**6) for _ in range(95))
    ends = {zlib.crc32(f"{passage} {k}".encode()): k for k in (f"{rng.getrandbits(64):016x}" for _ in range(200_000))}
    k = next(k for k in (f"{rng.getrandbits(64):016x}" for _ in range(10**7)) if zlib.crc32(f"{other} {k}".encode()) in ends)
    one, two = f"{passage} {ends[zlib.crc32(f'{other} {k}'.encode())]}", f"{other} {k}"
    assert zlib.crc32(one.encode()) == zlib.crc32(two.encode()) and one != two
    rows = [(None, one), (None, two), (5, f"x {passage}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.row.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(docs, ["doc_id"]).collect()]
    same(got, list(brute_bytes(rows, 400)))
    later = spark.createDataFrame([(9, one), (9, two), (5, passage)], "doc_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in substring_dedup.substring_dedup(later).collect()]
    same(got, [(9, 91, 90, one.split()[-1].encode()), (9, 96, 0, two.encode()), (5, 90, 0, passage.encode())])
    assert sorted(r.text for r in corpus_pipeline.near_dups(spark, docs.where("doc_id is null"), "").collect()) == sorted([one, two])
    found = decontaminate.matches(decontaminate.common.keyed(docs), spark.createDataFrame([(1, passage)], "item_id long, text string"))
    leaks = found.select(F.col("did").alias("__did"), F.col("crc").alias("__crc"))
    assert [r.text for r in decontaminate.common.addressed(docs).join(leaks, ["__did", "__crc"], "left_anti").collect()] == [two]


def test_empty_tables(no_docs):
    assert suffix_dedup.suffix_dedup(no_docs, ["doc_id"]).count() == 0
    assert substring_dedup.substring_dedup(no_docs).count() == 0
    assert simhash.near_duplicates(no_docs).count() == 0
    assert bpe.digests(no_docs).count() == 0
    assert sharding.shard(no_docs).count() == 0
    assert decontaminate.contaminated(no_docs, no_docs.select(F.col("doc_id").alias("item_id"), "text")).count() == 0
