"""Phrase collocation mining: counts of contiguous phrases by HAT-tries, scored by how often their parts occur.

A text is lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words
``[^\\x20\\x09]+``; phrases stay within a piece. All counts are per language.

1. Each task counts its texts in a trie of ``hat_trie``: words are numbered, containers burst,
   and beyond ``ENTRIES`` entries whole subtrees leave as sorted runs. The runs are dealt by
   language and prefix (the first two words) and merged there.
2. Words are counted first, then phrases of two, then of three. A phrase that occurs ``least``
   times has parts that do, so that a longer phrase is counted only where its words and both of
   its parts one word shorter may be frequent. What is frequent goes to the tasks as a bitmap of
   ``FILTER`` bits, whatever the corpus: a bit set by chance costs a count, never a result.
3. Candidates meet the counts of their parts by joins. The score of a cut into ``l`` and ``r`` is
   ``floor(1000000 * a * a / (l * r))`` in whole decimals; the lowest counts.
4. A candidate goes if a candidate one word longer holds it and has half of its count or
   more: what holds of any longer candidate holds of one in between.
5. The first ``top`` of each language are ranked, cut on the sending side already.

Exact while a count stays below 10**15. Results for odd input: a null text is empty; a null language is ``und`` and joins
a language so called; empty texts and texts of separators only count nothing; a very long text is
counted in slices that overlap by what a phrase needs; repeated rows count each; an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnlens.llm import common
from txnlens.llm.hat_trie import BITS, WORDS, Node
from txnlens.llm.rolling import mix64

LEAST, LONGEST, TOP = 10, WORDS, 2000
SCALE = 1_000_000
#: Entries of a task's trie, entries of a container, words a task knows before it starts anew.
ENTRIES, BURST, VOCABULARY = 1 << 20, 1 << 14, 1 << 19
#: Bits of the bitmap of what may be frequent.
FILTER = 1 << 26
#: Bytes of text taken in one go.
PASS = 4 << 20

_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SEPARATOR = _BREAK.copy()
_SEPARATOR[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RUN = "lang string, phrase string, n long"


def _slices(data: np.ndarray, offsets: np.ndarray, words: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of whole texts, or of slices of a text beyond ``limit`` that share the ``words - 1`` words at a cut."""
    i, n = 0, len(offsets) - 1
    while i < n:
        if offsets[i + 1] - offsets[i] <= limit:
            j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
            yield data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j
            continue
        lo, end, span = int(offsets[i]), int(offsets[i + 1]), limit
        while True:
            hi = min(lo + span, end)
            while hi < end and not _SEPARATOR[data[hi]]:  # up to the end of a word
                ahead = np.flatnonzero(_SEPARATOR[data[hi : hi + limit]])
                hi = hi + int(ahead[0]) if len(ahead) else min(hi + limit, end)
            part = data[lo:hi]
            bounds = np.array([0, len(part)])
            again = hi
            if hi < end and words > 1:
                starts = common.word_bounds(part, bounds, _SEPARATOR)[0]
                if len(starts):
                    again = lo + int(starts[1 - words] if len(starts) >= words else starts[0])
            if again == lo:  # not yet a phrase, so long are its words
                span *= 2
                continue
            yield part, bounds
            if hi == end:
                break
            lo, span = again, limit
        i += 1


class _Counter:
    """A task's words, their numbers and hashes, and its trie of phrases of ``words`` words.

    ``filters`` are the bitmaps of frequent words, pairs, ... below ``words``; a word that is not frequent has number 0.
    """

    def __init__(self, words: int, entries: int, burst: int, filters: list[np.ndarray]):
        self.words, self.entries, self.burst, self.filters = words, entries, burst, filters
        self._restart()

    def _restart(self) -> None:
        self.numbers: dict[str, dict[bytes, int]] = {}
        self.names, self.langs = [b""], [""]
        self.hashes = np.zeros(1, np.uint64)
        self.trie = Node(0, self.burst)

    def _number(self, lang: str, names: list[bytes]) -> np.ndarray:
        known = self.numbers.setdefault(lang, {})
        fresh = [x for x in names if x not in known]
        if fresh and self.filters:
            hashes = word_hashes(lang, fresh)
            may = held_bits(self.filters[0], hashes)
            known.update(dict.fromkeys(fresh, 0))
            fresh = [fresh[k] for k in np.flatnonzero(may).tolist()]
            self.hashes = np.append(self.hashes, hashes[may])
        known.update(zip(fresh, range(len(self.names), len(self.names) + len(fresh)), strict=True))
        self.names += fresh
        self.langs += [lang] * len(fresh)
        return np.fromiter(map(known.__getitem__, names), np.int64, len(names))

    def add(self, lang: str, data: np.ndarray, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Counts some texts; yields the runs that had to go first."""
        data = _LOWER[data]
        start, end, doc = common.word_bounds(data, offsets, _SEPARATOR)
        if len(start) < self.words:
            return
        ends = np.zeros(len(start) + 1, np.int64)
        np.cumsum(end - start, out=ends[1:])
        inside = ~_SEPARATOR[data]
        column = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(data[inside])]).dictionary_encode()
        names = column.dictionary.to_pylist()
        if sum(map(len, self.numbers.values())) + len(names) > VOCABULARY and self.numbers:
            yield from self.rest()
        own = self._number(lang, names)[column.indices.to_numpy()]
        if self.words > 1:
            breaks = np.cumsum(_BREAK[data], dtype=np.int32)[start]
            follows = np.append((doc[1:] == doc[:-1]) & (breaks[1:] == breaks[:-1]), False)
            at = np.flatnonzero(follows if self.words == 2 else follows & np.append(follows[1:], False))
        else:
            at = np.arange(len(own))
        if self.filters:
            may = own > 0
            if self.words > 2:  # both pairs
                may = may & np.append(held_bits(self.filters[1], phrase_hash([self.hashes[own[:-1]], self.hashes[own[1:]]])), False)
                at = at[may[at] & may[at + 1] & (own[at + 2] > 0)]
            else:
                at = at[may[at] & may[at + 1]]
        keys = np.zeros(len(at), np.int64)
        for k in range(self.words):
            keys |= own[at + k] << BITS * (WORDS - 1 - k)
        keys, counts = np.unique(keys, return_counts=True)
        if self.trie.n + len(keys) > self.entries:
            yield from self._runs(self.trie.spill(max(0, self.entries // 2 - len(keys))))
        self.trie.add(keys, counts)

    def rest(self) -> Iterator[pa.RecordBatch]:
        yield from self._runs(self.trie.spill(0))
        self._restart()

    def _runs(self, runs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        names, langs = pa.array(self.names, pa.binary()), pa.array(self.langs).dictionary_encode()
        mask = (1 << BITS) - 1
        for keys, counts in runs:
            for a in range(0, len(keys), 1 << 16):
                part = keys[a : a + (1 << 16)]
                numbers = [part >> BITS * (WORDS - 1 - k) & mask for k in range(self.words)]
                words = [names.take(pa.array(x)) for x in numbers]
                phrase = pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.binary())) if len(words) > 1 else words[0]
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(numbers[0])).cast(pa.string()), phrase.cast(pa.string()), pa.array(counts[a : a + (1 << 16)])], names=["lang", "phrase", "n"])


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed, digest = xxhash.xxh32_intdigest(lang.encode()), xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in words), np.uint64, len(words))


def phrase_hash(hashes: list[np.ndarray]) -> np.ndarray:
    """Hash of each phrase from the hashes of its words."""
    total = hashes[0]
    for h in hashes[1:]:
        total = mix64(total) + h
    return total


def held_bits(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = mix64(hashes) & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _count(batches: Iterator[pa.RecordBatch], words: int, entries: int, burst: int, limit: int, frequent: list) -> Iterator[pa.RecordBatch]:
    counter = _Counter(words, entries, burst, [np.frombuffer(x.value, np.uint8) for x in frequent])
    for batch in batches:
        for lang in pc.unique(batch.column("lang")).to_pylist():
            data, offsets = common.utf8(batch.filter(pc.equal(batch.column("lang"), lang)).column("text"))
            for part, bounds in _slices(data, offsets, words, limit):
                yield from counter.add(lang, part, bounds)
    yield from counter.rest()


def phrase_counts(texts: DataFrame, words: int, frequent: list, entries: int = ENTRIES, burst: int = BURST, limit: int = PASS) -> DataFrame:
    """``lang, phrase, n`` of all phrases of ``words`` words in ``texts`` (``lang, text``) that the broadcast bitmaps ``frequent`` let through."""
    if not 1 <= words <= WORDS:
        raise ValueError(f"words must lie in 1..{WORDS}")
    runs = texts.select("lang", "text").mapInArrow(lambda x: _count(x, words, entries, burst, limit, frequent), _RUN)
    dealt = runs.withColumn("prefix", F.substring_index("phrase", " ", 2)).repartition("lang", "prefix")
    return dealt.groupBy("lang", "prefix", "phrase").agg(F.sum("n").alias("n")).drop("prefix")


def _bits(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang in pc.unique(batch.column("lang")).to_pylist():
            phrases = [x.encode().split(b" ") for x in batch.filter(pc.equal(batch.column("lang"), lang)).column("phrase").to_pylist()]
            hashes = phrase_hash([word_hashes(lang, list(words)) for words in zip(*phrases, strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(mix64(hashes) & np.uint64(size - 1)).astype(np.int64))], names=["bit"])


def frequent_bits(phrases: DataFrame, size: int = FILTER) -> bytes:
    """A bitmap of ``size`` bits (a power of two) with the bit of each of ``phrases`` set: the same length however many there are."""
    width = 1 << 15
    bits = phrases.select("lang", "phrase").mapInArrow(lambda x: _bits(x, size), "bit long")
    rows = bits.groupBy(F.expr(f"bit div {width}").alias("at")).agg(F.bitmap_construct_agg(F.expr(f"bit % {width}")).alias("held")).collect()
    bitmap = bytearray(size // 8)
    for r in rows:
        held = bytes(r["held"])[: width // 8]
        bitmap[r["at"] * width // 8 : r["at"] * width // 8 + len(held)] = held
    return bytes(bitmap)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, entries: int = ENTRIES, burst: int = BURST, limit: int = PASS, filter_bits: int = FILTER) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the best phrases of two and three words of ``docs`` (``lang, text``)."""
    common.bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = common.keep(phrase_counts(texts, 1, [], entries, burst, limit), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    held, frequent = [words.where(F.col("n") >= least)], []
    for size in range(2, LONGEST + 1):
        frequent.append(spark.sparkContext.broadcast(frequent_bits(held[-1], filter_bits)))
        held.append(common.keep(phrase_counts(texts, size, frequent, entries, burst, limit).where(F.col("n") >= least), f"phrases-{size}"))
        common.release(spark)

    def part(size: int, name: str, phrase) -> DataFrame:
        return held[size - 1].select("lang", F.col("phrase").alias(phrase), F.col("n").alias(name))

    scored = []
    for size in range(2, LONGEST + 1):
        rows = held[size - 1].select("lang", "phrase", F.col("n").alias("a"))
        cuts = []
        for k in range(1, size):
            first, rest = f"first{k}", f"rest{k}"
            rows = rows.withColumns({first: F.substring_index("phrase", " ", k), rest: F.substring_index("phrase", " ", k - size)})
            rows = rows.join(part(k, f"l{k}", first), ["lang", first]).join(part(size - k, f"r{k}", rest), ["lang", rest]).drop(first, rest)
            wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", f"l{k}", f"r{k}")}
            numerator = (F.lit(SCALE).cast("decimal(7,0)") * (wide["a"] * wide["a"]).cast("decimal(31,0)")).cast("decimal(38,0)")
            rows = rows.withColumns({f"x{k}": numerator, f"y{k}": (wide[f"l{k}"] * wide[f"r{k}"]).cast("decimal(38,0)")})
            cuts.append(F.struct(F.expr(f"x{k} div y{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        best = F.least(*cuts) if len(cuts) > 1 else cuts[0]
        rows = rows.withColumn("cut", best).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        if size < LONGEST:
            longer = held[size].select("lang", "n", F.explode(F.array(F.substring_index("phrase", " ", size), F.substring_index("phrase", " ", -size))).alias("phrase"))
            longer = longer.groupBy("lang", "phrase").agg(F.max("n").alias("most"))
            rows = rows.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < 50 * F.col("a"))).drop("most")
        scored.append(rows)
    found = scored[0]
    for rows in scored[1:]:
        found = found.unionByName(rows)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = f"""
with pieces as (
  select row_number() over () as p, lang, piece from (
    select coalesce(lang, 'und') as lang,
      unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece
    from documents where text is not null)
), words as (
  select p, lang, unnest(found) as w1, generate_subscripts(found, 1) as i from (
    select p, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as found from pieces)
), grams as (
  select lang, w1, lead(w1) over (partition by p order by i) as w2, lead(w1, 2) over (partition by p order by i) as w3 from words
), f1 as (
  select lang, w1, count(*) as n from grams group by all
), f2 as (
  select lang, w1, w2, count(*) as n from grams where w2 is not null group by all having count(*) >= {LEAST}
), f3 as (
  select lang, w1, w2, w3, count(*) as n from grams where w3 is not null group by all having count(*) >= {LEAST}
), cuts as (
  select b.lang, b.w1 || ' ' || b.w2 as phrase, b.n as a, x.n as l, y.n as r, 1 as k
  from f2 b join f1 x on x.lang = b.lang and x.w1 = b.w1 join f1 y on y.lang = b.lang and y.w1 = b.w2
  where not exists (select 1 from f3 t where t.lang = b.lang and t.w1 = b.w1 and t.w2 = b.w2 and 100 * t.n >= 50 * b.n)
    and not exists (select 1 from f3 t where t.lang = b.lang and t.w2 = b.w1 and t.w3 = b.w2 and 100 * t.n >= 50 * b.n)
  union all
  select t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.n, x.n, y.n, 1
  from f3 t join f1 x on x.lang = t.lang and x.w1 = t.w1 join f2 y on y.lang = t.lang and y.w1 = t.w2 and y.w2 = t.w3
  union all
  select t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.n, x.n, y.n, 2
  from f3 t join f2 x on x.lang = t.lang and x.w1 = t.w1 and x.w2 = t.w2 join f1 y on y.lang = t.lang and y.w1 = t.w3
), scored as (
  select *, ({SCALE}::hugeint * a * a // (l::hugeint * r))::bigint as score from cuts
), chosen as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
), totals as (
  select lang, sum(n)::bigint as n from f1 group by lang
)
select c.lang, row_number() over (partition by c.lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, t.n, score
from chosen c join totals t on t.lang = c.lang
qualify rank <= {TOP}
"""
