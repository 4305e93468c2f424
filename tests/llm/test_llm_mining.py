"""Exact search, collocations and whitening against brute force, and their structures on their own."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from txnlens.llm import charpoly, collocations, exact_search, hat_trie, whitening

MID = "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")


def duck(sql, **tables):
    con = duckdb.connect()
    for name, path in tables.items():
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con.execute(sql).fetchall()


# Exact search.


def best(rows, queries, k, scale=256):
    """Brute force over (row, vec_id, vector)."""
    whole = {r: [int(np.floor(scale * x)) if abs(x) < 1e300 else int(x) * scale for x in v] for r, _, v in rows}
    most = (1 << 63) - 1
    found = []
    for q, name, v in queries:
        scores = []
        for r, other, w in rows:
            if r != q and len(w) == len(v):
                s = sum(a * b for a, b in zip(whole[q], whole[r], strict=True))
                scores.append((-min(max(s, -most), most), other is None, other or 0))
        found += [(name, rank, None if nameless else other, -s) for rank, (s, nameless, other) in enumerate(sorted(scores)[:k], 1)]
    return sorted(found, key=str)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, row string")


def test_search_matches_sql(spark):
    found = exact_search.op11_exact_topk(spark, MID)
    assert found.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, found.collect())) == sorted(duck(exact_search.ORACLE, embeddings=f"{MID}/embeddings.parquet"))


@pytest.mark.parametrize("part_bytes", [64, 4096, 1 << 22])
def test_search_is_the_same_in_any_parts(spark, part_bytes):
    rng = random.Random(11)
    rows = [(i if i % 9 else i - i % 2, [rng.choice([-1.0, -0.25, 0.0, 0.5, 1.0]) * rng.choice([1, 1, 300]) for _ in range(3 if i % 5 else 2)]) for i in range(120)]
    rows += [(200, [0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (None, [300.0, 300.0, 300.0]), (0, rows[0][1]), (50, [1.5, 2.0, 2.5]), (50, [1.5, 2.0, 2.5])]
    numbered = [(i, *r) for i, r in enumerate(rows)]
    asked = [r for r in numbered if r[1] is not None and r[1] % 50 == 0]
    df = vectors(spark, [(v, e, 1, "x") for v, e in rows])
    found = exact_search.exact_search(df, F.pmod("vec_id", F.lit(50)) == 0, 4, part_bytes=part_bytes)
    assert sorted(map(tuple, found.collect()), key=str) == best(numbered, asked, 4)


def test_search_odd_input(spark):
    rows = [(0, [1.0, 2.0]), (50, [1e308, -1e308]), (1, None), (2, [1.0, None]), (3, [NAN, 1.0]), (4, [INF, 1.0]), (5, []), (100, []), (6, [2.0**45, 3.0]), (7, [-1e-300, 0.0]), (150, [1.0, 1.0, 1.0])]
    sound = [(i, v, e) for i, (v, e) in enumerate(rows) if e is not None and all(x is not None and np.isfinite(x) for x in e)]
    df = vectors(spark, [(v, e, None, "x") for v, e in rows])
    found = exact_search.exact_search(df, F.pmod("vec_id", F.lit(50)) == 0)
    assert sorted(map(tuple, found.collect()), key=str) == best(sound, [r for r in sound if r[1] % 50 == 0], 5)
    assert exact_search.exact_search(df.limit(0), F.pmod("vec_id", F.lit(50)) == 0).count() == 0


def test_cells_bound_every_score():
    rng = np.random.default_rng(0)
    x, q = np.floor(rng.normal(0, 300, (500, 7))), np.floor(rng.normal(0, 300, (40, 7)))
    low, high = exact_search.Cells(x).bounds(q)
    scores = q @ x.T
    assert (low <= scores).all() and (scores <= high).all()
    assert ((high >= np.partition(low, -5, axis=1)[:, -5:-4]).mean()) < 0.2  # the cells alone settle most


# Collocations.


@pytest.mark.parametrize("burst", [1, 3, 50])
def test_trie_counts(burst):
    rng = random.Random(burst)
    trie, truth, spilled = hat_trie.Node(0, burst), Counter(), Counter()
    pack = lambda words: sum(w << hat_trie.BITS * (2 - k) for k, w in enumerate(words))
    for _ in range(60):
        phrases = [pack([rng.randint(1, 4) ** rng.randint(1, 3) for _ in range(rng.randint(1, 3))]) for _ in range(rng.randint(0, 80))]
        truth.update(phrases)
        keys, counts = np.unique(np.array(phrases, dtype=np.int64), return_counts=True)
        trie.add(keys, counts)
        if rng.random() < 0.1:
            for keys, counts in trie.spill(trie.n // 2):
                assert (np.diff(keys) > 0).all()
                spilled.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
    rest = [(k, c) for keys, counts in trie.runs() for k, c in zip(keys.tolist(), counts.tolist(), strict=True)]
    assert [k for k, _ in rest] == sorted({k for k, _ in rest}) and trie.n == len(rest)
    spilled.update(dict(rest))
    assert spilled == truth
    if burst < 50:
        assert any(isinstance(c, hat_trie.Node) for c in trie.children)


def mined(rows, least, top):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + size])] += 1
    out = []
    for lang, f in counts.items():
        rows = []
        for phrase, a in f.items():
            if len(phrase) == 1 or a < least:
                continue
            if any(len(t) == 3 and c >= least and 100 * c >= 50 * a and phrase in (t[:2], t[1:]) for t, c in f.items() if len(phrase) == 2):
                continue
            score, _, l, r = min((1_000_000 * a * a // (f[phrase[:k]] * f[phrase[k:]]), k, f[phrase[:k]], f[phrase[k:]]) for k in range(1, len(phrase)))
            rows.append((-score, -a, " ".join(phrase).encode(), l, r))
        out += [(lang, rank, p.decode(), -a, l, r, total[lang], -s) for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("entries,burst,limit,bits", [(1 << 20, 1 << 14, 1 << 20, 1 << 20), (40, 5, 50, 64), (7, 1, 1, 1 << 15)])
def test_collocations(spark, entries, burst, limit, bits):
    rng = random.Random(12)
    vocabulary = ["the", "The", "of", "naïve", "\x1c", "x y", "a", "b", "ß", "long" * 30]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\t", " ", ". ", "\n", ",", "\x0b "]) for _ in range(rng.choice([0, 1, 30, 300])))) for _ in range(60)]
    rows += [("en", None), ("xx", ""), ("yy", " .,!? \n"), (None, "of the people " * 40), *[("en", "New York city. ")] * 30]
    df = spark.createDataFrame([(i, t, lang, "x") for i, (lang, t) in enumerate(rows)], "n long, text string, lang string, phrase string").repartition(3)
    found = collocations.collocations(df, 10, 20, entries, burst, limit, max(bits, 1 << 15))
    assert sorted(map(tuple, found.collect())) == mined(rows, 10, 20)
    assert collocations.collocations(df.limit(0)).count() == 0


def test_collocations_match_sql(spark):
    found = collocations.op12_collocations(spark, MID)
    assert found.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), *((c, "bigint") for c in ("a", "l", "r", "n", "score"))]
    assert sorted(map(tuple, found.collect())) == sorted(duck(collocations.ORACLE, documents=f"{MID}/documents.parquet"))


def test_scores_past_64_bits(spark):
    """The score of counts whose products need more than 64 bits, as the query writes it."""
    a, l, r = 9 * 10**13 + 7, 9 * 10**13 + 11, 10**14 + 1
    row = spark.sql(f"select cast({a} as decimal(19,0)) a, cast({l} as decimal(19,0)) l, cast({r} as decimal(19,0)) r")
    top = (F.lit(1_000_000).cast("decimal(7,0)") * (F.col("a") * F.col("a")).cast("decimal(31,0)")).cast("decimal(38,0)")
    assert row.select(top.alias("x"), (F.col("l") * F.col("r")).cast("decimal(38,0)").alias("y")).selectExpr("x div y").first()[0] == 10**6 * a * a // (l * r)


# Whitening.


def test_polynomial_is_exact(spark):
    rng = np.random.default_rng(1)
    for size in (1, 2, 5, 9):
        b = rng.integers(-(10**6), 10**6, (size, size)).astype(object)
        a = b @ b.T
        poly = whitening.polynomial(spark, a.tolist())
        total, power = np.zeros((size, size), dtype=object), np.eye(size, dtype=object).astype(int).astype(object)
        for c in reversed(poly):
            total, power = total + c * power, power @ a
        assert poly[0] == 1 and poly[1] == -np.trace(a) and not total.any()  # a matrix is a root of its own polynomial


def test_equal_and_zero_roots():
    a = np.diag([7, 7, 3, 0, 0]).astype(object)
    poly = [1, -17, 91, -147, 0, 0]
    roots = charpoly.roots(poly, 4, 32)
    assert roots == [7 << 32, 7 << 32, 3 << 32, 0]
    v = charpoly.components(a.tolist(), roots[:3], 32)
    assert np.allclose(v @ v.T, np.eye(3), atol=1e-15) and np.allclose(v[:, 3:], 0) and abs(abs(v[2, 2]) - 1) < 1e-15


def test_limbs_are_exact():
    y = np.random.default_rng(2).integers(-(1 << 45), 1 << 45, (50, 4))
    total = sum((part.astype(object) * (1 << power) for power, part in whitening._products(y)), np.zeros((4, 4), dtype=object))
    assert (total == y.astype(object).T @ y.astype(object)).all()


def test_whitening_against_eigh(spark):
    found = whitening.op13_whitening(spark, MID).toPandas()
    rows = spark.read.parquet(f"{MID}/embeddings.parquet").toPandas()
    x = np.floor(np.stack(rows.embedding).astype(float) * 1024) + 100_000
    n = len(x)
    s = x.astype(int).sum(0)
    z = n * x.astype(int) - s
    values, axes = np.linalg.eigh((z / n).T @ (z / n) / n)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(found) == 8 * n and (found.n == n).all() and found.identity_error.nunique() == 1 and found.identity_error[0] < 1e-9
    wide = found.pivot(index="vec_id", columns="component", values="whitened").loc[rows.vec_id].to_numpy()
    theirs = (z / n) @ axes[:, :8] / np.sqrt(values[:8])
    assert np.allclose(np.abs(wide), np.abs(theirs), atol=1e-8)
    assert np.allclose(found.groupby("component").explained.first(), values[:8] / values.sum(), rtol=1e-12)
    assert (found.groupby("vec_id").deviation.first().loc[rows.vec_id].to_numpy() == (z * z).sum(1)).all()


def test_whitening_close_eigenvalues(spark):
    """Two eigenvalues that differ by a part in 10**12: a double-precision solver mixes their axes, exact roots do not."""
    big = 1 << 35
    rows = [(i, [float(x), float(y)]) for i, (x, y) in enumerate([(big, 0), (-big, 0), (0, big + 1 / 32), (0, -big - 1 / 32)])]
    found = whitening.whitening(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    wide = found.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.allclose(np.abs(wide), [[0, 2**0.5]] * 2 + [[2**0.5, 0]] * 2, atol=1e-14) and found.deviation.isna().all()


def test_whitening_odd_input(spark):
    rows = [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (None, [3.0, -2.0], 0), (2, [0.5, 0.25], 0), (3, None, 0), (4, [], 0), (5, [1.0, None], 0), (6, [NAN, 0.0], 0), (7, [INF, 0.0], 0), (8, [1e30, 0.0], 0), (9, [1.0, 1.0, 1.0], 0), (10, [2.0], 0), (11, [4.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component int")
    found = whitening.whitening(df).toPandas()
    assert sorted(found.vec_id.fillna(-1)) == [-1, -1, 1, 1, 1, 1, 2, 2, 10, 11] and set(found.n) == {4, 2}
    assert found[found.vec_id == 10].explained.tolist() == [1.0] and (found.identity_error < 1e-12).all()
    assert whitening.whitening(df.where("vec_id = 9")).count() == 0 and whitening.whitening(df.limit(0)).count() == 0
