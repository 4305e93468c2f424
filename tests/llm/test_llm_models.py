"""Classifiers by held-out accuracy, extraction by fixed pages, vectors and the pipeline by brute force."""

import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from txnlens.llm import embedding_dedup, html_extract, language, quality, suffix_dedup

MID = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, None, None, 0), (-2, "123 !! \n", "en", None, 0), (None, "the and of this was", None, None, 0)], docs.schema)
    found = language.languages(docs.unionByName(odd)).toPandas()
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    known = found[found.doc_id >= 0]
    assert ((known.doc_id.map(lambda d: zlib.crc32(str(int(d)).encode()) % 4 == 2)) == known.held_out).all()
    held = known[known.held_out]
    assert (held.lang_pred == held.doc_id.map(lang)).mean() > 0.98
    assert set(found[found.doc_id < 0].lang_pred) == {"und"} and found.score.between(0, 1).all() and len(found) == 1003


def test_ftrl_is_sparse_and_temperature_fits():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400)
    vectors = [(np.array([k, 7, 100 + rng.integers(50)]), np.array([0.7, 0.5, 0.5])) for k in y]
    weights = language.train(vectors, y, 2)
    assert (weights == 0).mean() > 0.99 and weights[0, 0] > 0 > weights[0, 1]
    logits = rng.normal(size=(4000, 3)) * 2
    labels = np.array([rng.choice(3, p=p) for p in language._softmax(logits / 2.5)])
    assert 2.0 < language.temperature(logits, labels) < 3.1


def test_quality_held_out(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    labels = spark.read.parquet(f"{MID}/labels.parquet")
    odd = spark.createDataFrame([(-1, None, None, None, 0), (-2, "", "en", None, 0), (None, "x", None, None, 0)], docs.schema)
    found = quality.quality_scores(docs.unionByName(odd), labels.unionByName(spark.createDataFrame([(None, 1, 0), (5, None, 0), (10**9, 0, 0)], labels.schema))).toPandas()
    assert len(found) == 1003 and found.score.between(0, 1).all() and ((found.score >= 0.3) == (found.predicted == 1)).all()
    held = found[found.held_out].merge(labels.toPandas(), on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.95
    none = quality.quality_scores(docs, labels.limit(0)).toPandas()
    assert (none.score == 0.5).all()


def test_isotonic_pools():
    _, values = quality.pool(np.arange(6.0), np.array([0, 1, 0, 1, 0.5, 1]), np.ones(6))
    assert (np.diff(values) > 0).all() and values[0] == 0 and values[-1] == 1


PAGES = {
    "<html><head><title>no</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p><b>First  line,\n bold.<br>more<p>Short.</p></article><footer>&copy; x</footer>": "A & B First line, bold. more Short.",
    "<body><div class=menu><ul><li>Home<li>About</ul></div><div id=content><h2>Title</h2><p>A long text, with commas. And sentences, too.</p><p>Short.</p><div class=comments><p>Nice post, thanks, all!</p></div></div><div class=cookie-notice>We use cookies.</div><form>Name</form></body>": "Title A long text, with commas. And sentences, too. Short.",
    "plain &lt;text&gt;": "plain <text>",
    "<p>never closed <i>x": "never closed x",
    "<nav>menu</nav>": "",
    "   ": "",
}


def test_html(spark):
    rows = [(k, f"u{k}", h, 1) for k, h in enumerate(PAGES)] + [(None, None, None, 1), (90, "u", "", 2), (90, "u", "", 2)]
    got = html_extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert [r.text for r in got] == [*PAGES.values(), "", "", ""]
    assert all(r.n_chars == len(r.text) for r in got)
    long = "<article>" + "<p>Word, word. </p>" * 20000
    assert html_extract.extract(long).count("Word") == 20000


LEAD = "A lead of some length, with commas. " * 25
BODY = "What most of the text says, at length. "


@pytest.mark.parametrize("part", ["<ul><li>%s</ul>", "<blockquote><p>%s</p></blockquote>", "<section><p>%s</p></section>", "<table><tr><td>%s</table>", "<div class=body><p>%s</p></div>", "<div><div><p>%s</p><p>Short.</p></div></div>"])
@pytest.mark.parametrize("times", [5, 30, 200])
@pytest.mark.parametrize("page", ["<article>%s</article>", "<main>%s</main>", "<body><nav>no</nav>%s</body>", "<body><div>%s</div><footer>no</footer></body>"])
def test_html_keeps_what_stands_beside_a_majority(part, times, page):
    text = BODY * times
    inner = [text.strip()] + ["Short."] * ("Short." in part)
    assert html_extract.extract(page % f"<h1>A title</h1><p>{LEAD}</p>{part % text}") == " ".join(["A title", LEAD.strip(), *inner])
    assert html_extract.extract(page % f"<h1>A title</h1>{part % text}<p>{LEAD}</p>") == " ".join(["A title", *inner, LEAD.strip()])
    assert html_extract.extract("x" + page % f"<h1>A title</h1><p>{LEAD}</p>{part % text}").endswith(" ".join(["A title", LEAD.strip(), *inner]))
    assert html_extract.extract(page % f"<h1>A title</h1>{part % text}") == " ".join(["A title", *inner])


@pytest.mark.parametrize("name", ["container has-sidebar", "no-sidebar", "with-comments", "layout-header-fixed", "overlay", "wrap sidebar"])
def test_html_wrapper_names_hide_nothing(name):
    page = f"<body><div class='%s'><div class='article-header'><h1>A title</h1></div><p>{LEAD}</p><p>Short.</p><div class='comments'><p>Nice, thanks, all!</p></div><ul class='site-nav'><li>Home</ul></div><div class='site-footer'>no</div></body>"
    want = f"A title {LEAD.strip()} Short."
    assert html_extract.extract(page % name) == want
    assert html_extract.extract((page % name).replace("class='" + name, "id='" + name)) == want


def test_html_small_marked_part_is_not_all():
    page = f"<body><div class='has-sidebar'><h1>A title</h1><p>{LEAD}</p><p>{BODY * 9}</p></div><article><h3>Teaser</h3><p>Read more, here.</p></article></body>"
    got = html_extract.extract(page)
    assert got.startswith(f"A title {LEAD.strip()} {(BODY * 9).strip()}")
    marked = f"<body><div><p>Some words beside, not many.</p></div><article><h1>A title</h1><p>{LEAD}</p></article></body>"
    assert html_extract.extract(marked) == f"A title {LEAD.strip()}"


def unmarked(page, wrapped):
    """The page without a name or tag that tells its parts; ``wrapped``: its article is still an element of its own."""
    page = re.sub(r"<(/?)(nav|footer)>", r"<\1div>", page).replace('class="ad"', 'class="x"')
    return re.sub(r"<(/?)article>", r"<\1div>" if wrapped else "", page)


@pytest.mark.parametrize("wrapped", [True, False])
def test_html_by_ratios_alone(spark, monkeypatch, wrapped):
    pages = [r.html for r in spark.read.parquet(f"{MID}/pages.parquet").select("html").collect()]
    article = [html_extract.extract(re.sub(r"(?s)^.*<article>(.*)</article>.*$", r"<article>\1</article>", p)) for p in pages]
    assert [html_extract.extract(p) for p in pages] == article

    def share():
        return np.mean([html_extract.extract(unmarked(p, wrapped)) == a for p, a in zip(pages, article, strict=True)])

    assert share() >= 0.95
    monkeypatch.setattr(html_extract, "scores", lambda blocks, furniture: dict.fromkeys((x.path for x in blocks), 1.0))  # no ratios
    assert share() < 0.8


@pytest.mark.parametrize("crowd", [1024, 10])
def test_embeddings(spark, crowd):
    rng = np.random.default_rng(1)
    rows = []
    for d in (64, 6, 3):
        centres = rng.normal(size=(8, d))
        for _ in range(100):
            c = centres[rng.integers(8)] * rng.uniform(0.5, 2)
            x = c + rng.normal(size=d) * np.linalg.norm(c) / np.sqrt(d) * rng.choice([0.05, 0.1, 0.15, 0.3, 1])
            rows.append((len(rows) + 5, [float(np.float32(v)) for v in x], int(rng.integers(2))))
    twin = rows[3][1:]
    rows += [(None, *twin), (1, *twin), (1, *twin), (2, None, 1), (3, [0.0] * 64, 1), (4, [math.nan] * 64, 1), (900, [1.0, None, 2.0], 1), (901, [], 0), (902, twin[0], None), (903, [math.inf] * 3, 1)]
    n, units = len(rows), []
    for _, e, label in rows:
        sound = label is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)
        units.append(np.array(e) / np.linalg.norm(e) if sound else None)
    root, degree, least = list(range(n)), [0] * n, {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.98:
                degree[i] += 1
                degree[j] += 1
                root[find(i)] = find(j)
    for i, (v, _, _) in enumerate(rows):
        if v is not None:
            least[find(i)] = min(least.get(find(i), v), v)
    want = [(v, degree[i], least.get(find(i)), v is not None and v == least.get(find(i))) for i, (v, _, _) in enumerate(rows)]
    found = embedding_dedup.embedding_dedup(spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, size int, block string"), crowd=crowd)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr) and sum(degree) > 100


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.languages(docs).count() == 0
    assert quality.quality_scores(docs, spark.createDataFrame([], "doc_id long, quality int")).count() == 0
    assert html_extract.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert embedding_dedup.embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_pipeline_stages(spark):
    """Each stage against a plain rendering of its rule on its own input."""
    from test_llm_text import brute_bytes, brute_fingerprint

    source = spark.read.parquet(f"{MID}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, None, None, 0), (-2, "", "en", None, 0), (None, "some words here", None, None, 0), (7, source.where("doc_id = 7").first().text, "en", "src", 3)], source.schema)
    docs = source.unionByName(odd).withColumn("row", F.lit(1)).withColumn("fp", F.lit("x")).withColumn("score", F.lit(0.5))
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "repeated_bytes", "benchmark", "tokens"]

    kept = corpus_pipeline.quality(spark, docs, MID).cache()
    assert kept.columns == docs.columns
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{MID}/labels.parquet").collect()}
    left = {r.doc_id for r in kept.collect()}
    assert np.mean([(d in left) == (q == 1) for d, q in label.items()]) > 0.97

    rows = kept.collect()
    alone = corpus_pipeline.near_dups(spark, kept, MID).cache()
    prints = np.array([brute_fingerprint(r.text) for r in rows], dtype=np.uint64)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(prints[:i] ^ prints[i]) <= 3):
            root[find(i)] = find(int(j))
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r.doc_id)
    stays = sorted((min((d for d in g if d is not None), default=None) for g in groups.values()), key=repr)
    assert sorted((r.doc_id for r in alone.collect()), key=repr) == stays and alone.columns == docs.columns

    some = alone.where("n_chars < 3000").limit(150).cache()
    cut = {r.doc_id: r for r in corpus_pipeline.repeated_bytes(spark, some, MID).collect()}
    for d, _, _, _, left_bytes in brute_bytes([(r.doc_id, r.text) for r in some.collect()], 400):
        assert cut[d].text == left_bytes.decode("utf-8", "ignore") and cut[d].n_chars == len(cut[d].text)

    item = spark.read.parquet(f"{MID}/benchmark.parquet").first().text
    probe = spark.createDataFrame([(1, f"before {item} after"), (2, "clean words only"), (None, None), (3, None)], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.benchmark(spark, probe, MID).collect()} == {2, None, 3}
    assert corpus_pipeline.benchmark(spark, probe, MID).count() == 3
    assert corpus_pipeline.tokens(spark, probe, MID).count() == 4


def test_pipeline_cuts_in_one_python_step(spark):
    """repeated_bytes decodes where it cuts: a second step in Python doubled the workers beside each executor's JVM."""
    base = "".join(f"word{k} " for k in range(70))
    docs = spark.createDataFrame([(1, "é" + base), (2, "ĩ" + base), (3, "short"), (4, None), (4, ""), (None, "ü")], "doc_id long, text string")
    found = corpus_pipeline.repeated_bytes(spark, docs, "")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    # é and ĩ share their last byte, which goes with the cut and leaves half a character
    assert sorted(((r.doc_id, r.text) for r in found.collect()), key=repr) == [(1, ""), (2, ""), (3, "short"), (4, ""), (4, ""), (None, "ü")]
    assert dict(suffix_dedup.suffix_dedup(docs, ["doc_id"]).dtypes)["kept"] == "binary"
