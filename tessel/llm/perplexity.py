"""Quality rules with an n-gram perplexity band for each language.

The n-grams are trigrams of code points, whatever the script, and run across word borders
(white space between words is one mark, digits are one symbol).  Spark counts those of all
documents for each value of ``lang`` and makes the modified Kneser-Ney estimates from the
counts: continuation counts for the lower orders, three discounts for each order and
language.  The model is a table of 64-bit hashes of (order, language, n-gram), sorted into
arrays that are looked up by binary search.  All counts enter the estimates; of the
finished model the tasks get the n-grams and contexts of the highest counts, at most about
``MODEL`` of them.  Occurrences of n-grams left out go through a join with the whole table of
estimates, so every document has the same figure as with the whole model in its task.

A document's figure is the mean negative log10 probability of a symbol of its words.
For each language a histogram over all documents that pass the base rules gives the
median and the median absolute deviation; documents beyond ``WIDTH`` deviations above or
below are rejected.

Edge cases: null text: no words, base_failed.  A null language is one like any other.
A document without words has no figure and isn't kept.  Rows are kept one for one,
repeated ones and null ids included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.llm.shared import table, written
from tessel.llm.text import Chunk, chunks, mix64, windows

#: The band's half width in robust standard deviations, and its least half width in log10.
WIDTH, LEAST_WIDTH = 5.0, 0.05
BIN, MOST_COST = 0.002, 8.0
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Entries of the model that tasks get (12 bytes each; the others are joined), and symbols that the last order spreads over.
MODEL, SYMBOLS = 1 << 21, 1 << 16
MARK, NONE, DIGIT = 32, 0, 48
#: Kinds of entries: n-grams of three, two and one symbols, and contexts of two, one and no symbols.
TRI, BI, UNI, TRI_SHARE, BI_SHARE, UNI_SHARE = range(6)
_HELD, _TOGETHER = 4_000_000, 2 << 20


def code_points(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a chunk (digits as one), and how many start before each byte."""
    data = chunk.data
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = data[lead].astype(np.int64)
    far = np.flatnonzero(points >= 0xC0)
    if len(far):
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        first = points[far]
        more = [padded[lead[far] + k].astype(np.int64) & 0x3F for k in (1, 2, 3)]
        two = (first & 0x1F) << 6 | more[0]
        three = (first & 0x0F) << 12 | more[0] << 6 | more[1]
        four = (first & 0x07) << 18 | more[0] << 12 | more[1] << 6 | more[2]
        points[far] = np.where(first < 0xE0, two, np.where(first < 0xF0, three, four))
    points[(points >= 48) & (points <= 57)] = DIGIT
    return points, before


class Words:
    """The words of a chunk, the distinct ones of each language with their inner trigrams, and the trigram at each word's border."""

    def __init__(self, chunk: Chunk, langs: np.ndarray):
        self.starts, self.ends = chunk.words()
        self.hashes, self.owner = chunk.hashes(self.starts, self.ends, False), chunk.owner(self.starts)
        points, before = code_points(chunk)
        start, end = before[self.starts], before[self.ends]
        lang = langs[self.owner]
        _, first, self.which, self.times = np.unique(mix64(self.hashes ^ mix64(lang.view(np.uint64))), return_index=True, return_inverse=True, return_counts=True)
        lengths = (end - start)[first]
        at = np.cumsum(lengths + 2) - lengths - 2
        symbols = np.full(int((lengths + 2).sum()), MARK, np.int64)
        within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        symbols[np.repeat(at + 1, lengths) + within] = points[np.repeat(start[first], lengths) + within]
        self.sizes = lengths  # predicted inside: the second symbol to the last, and the mark behind
        self.of = np.repeat(np.arange(len(first)), lengths)
        place = within + np.repeat(at, lengths)
        self.lang = lang[first][self.of]
        self.inner = symbols[place] << 42 | symbols[place + 1] << 21 | symbols[place + 2]
        last = np.full(len(start), NONE, np.int64)
        if len(start):
            last[1:] = np.where(self.owner[1:] == self.owner[:-1], points[end[:-1] - 1], NONE)
        self.border_lang = lang
        self.border = last << 42 | MARK << 21 | points[start]

    def predicted(self, n: int) -> np.ndarray:
        """How many symbols of each of the chunk's ``n`` texts are predicted."""
        return np.bincount(self.owner, self.sizes[self.which] + 1, minlength=n)


def _merged(lang: np.ndarray, tri: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((tri, lang))
    lang, tri, n = lang[order], tri[order], n[order]
    new = np.flatnonzero(np.r_[True, (lang[1:] != lang[:-1]) | (tri[1:] != tri[:-1])]) if len(tri) else np.zeros(0, np.int64)
    return lang[new], tri[new], np.add.reduceat(n, new) if len(new) else n


def trigram_counts(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """(lang long: hash of the language, tri long: three code points of 21 bits, n long) of all documents; tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tuple(np.zeros(0, np.int64) for _ in range(3))
        for batch in batches:
            langs = batch.column(1).to_numpy()
            for chunk in chunks(batch.column(0), _TOGETHER):
                words = Words(chunk, langs[chunk.first : chunk.first + chunk.n])
                inner, border = _merged(words.lang, words.inner, words.times[words.of]), _merged(words.border_lang, words.border, np.ones(len(words.border), np.int64))
                held = _merged(*[np.concatenate(x) for x in zip(held, inner, border)])
                if len(held[0]) > _HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["lang", "tri", "n"])
                    held = tuple(np.zeros(0, np.int64) for _ in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["lang", "tri", "n"])

    texts = docs.select(F.col(text_column).cast("string").alias("text"), F.xxhash64(F.col(lang_column).cast("string")).alias("lang"))
    return texts.mapInArrow(run, "lang long, tri long, n long").groupBy("lang", "tri").agg(F.sum("n").alias("n"))


def _discounted(grams: DataFrame) -> DataFrame:
    """``grams`` (lang, .., n) with the modified Kneser-Ney discount d of each row's count, from its language's counts of counts."""
    of = grams.groupBy("lang").agg(*[F.sum((F.col("n") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))

    def discount(k: int) -> Column:
        d = k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}"))
        return F.when((d > 0) & (d < k), d).otherwise(0.75).alias(f"d{k}")

    found = written(of.select("lang", discount(1), discount(2), discount(3)), "discounts")  # one row for each language; Spark sees its size
    return grams.join(found, "lang").withColumn("d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))).drop("d1", "d2", "d3")


def _order(grams: DataFrame, context: list[str], lower: DataFrame | None, shared: list[str]) -> tuple[DataFrame, DataFrame]:
    """(n-grams with probability p, contexts with their total n and share for the lower order) of one order."""
    grams = _discounted(grams)
    totals = grams.groupBy(*context).agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("share"))
    if context == ["lang"]:
        totals = written(totals, "totals")
    below = grams.join(lower.select(*shared, F.col("p").alias("below")), shared) if lower is not None else grams.withColumn("below", F.lit(1.0 / SYMBOLS))
    out = below.join(totals, context).withColumn("p", (F.col("n") - F.col("d")) / F.col("total") + F.col("share") * F.col("below"))
    return out.drop("d", "below", "total", "share"), totals


def estimates(counts: DataFrame) -> DataFrame:
    """(kind int, lang, gram long, n long, value float: log10 of a probability or share) of all n-grams and contexts."""
    bits = lambda name, shift: F.shiftrightunsigned(F.col(name), shift).bitwiseAND(F.lit((1 << 21) - 1).cast("long"))
    tri = counts.select("lang", "tri", F.shiftrightunsigned("tri", 21).alias("ab"), F.col("tri").bitwiseAND(F.lit((1 << 42) - 1).cast("long")).alias("bw"), "n")
    bi = tri.groupBy("lang", "bw").agg(F.count(F.lit(1)).alias("n")).withColumn("b", bits("bw", 21)).withColumn("w", bits("bw", 0))  # in how many contexts
    bi = written(bi, "bigrams")
    uni = bi.groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    uni, uni_context = _order(uni, ["lang"], None, [])
    bi, bi_context = _order(bi, ["lang", "b"], uni, ["lang", "w"])
    bi = written(bi, "bigrams")
    tri, tri_context = _order(tri, ["lang", "ab"], bi, ["lang", "bw"])
    rows = [(TRI, tri, F.col("tri"), "n", "p"), (BI, bi, F.col("bw"), "n", "p"), (UNI, uni, F.col("w"), "n", "p")]
    rows += [(TRI_SHARE, tri_context, F.col("ab"), "total", "share"), (BI_SHARE, bi_context, F.col("b"), "total", "share"), (UNI_SHARE, uni_context, F.lit(0).cast("long"), "total", "share")]
    out = None
    for kind, frame, gram, n, value in rows:
        part = frame.select(F.lit(kind).alias("kind"), "lang", gram.alias("gram"), F.col(n).alias("n"), F.log10(F.greatest(F.col(value), F.lit(1e-12))).cast("float").alias("value"))
        out = part if out is None else out.union(part)
    return out


def _names(kind: int, lang: np.ndarray, gram: np.ndarray) -> np.ndarray:
    return mix64(gram.astype(np.uint64) ^ mix64(lang.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (kind + 1) & 0xFFFFFFFFFFFFFFFF)))


class Model:
    """Sorted hashes of n-grams and contexts, and log10 of their probabilities and shares; ``whole`` if none was left out."""

    whole = True

    def __init__(self, kind: np.ndarray, lang: np.ndarray, gram: np.ndarray, value: np.ndarray):
        keys = np.empty(len(kind), np.uint64)
        for k in range(6):
            own = np.flatnonzero(kind == k)
            keys[own] = _names(k, lang[own], gram[own])
        order = np.argsort(keys)
        self.keys, self.values = keys[order], value[order].astype(np.float32)

    @classmethod
    def fit(cls, counts: DataFrame, most: int = MODEL) -> Model:
        return cls.of(written(estimates(counts), "estimates"), most)

    @classmethod
    def of(cls, rows: DataFrame, most: int = MODEL) -> Model:
        """The entries of written estimates with counts high enough to be among about ``most``; steps of counts are kept or left out whole."""
        step = F.floor(F.log2("n") * 16)
        least, held, whole = None, 0, True
        for r in sorted(rows.groupBy(step.alias("step")).count().collect(), reverse=True):  # at most 16 * 63 steps
            held += r["count"]
            if held > most and least is not None:
                whole = False
                break
            least = r["step"]
        found = rows.where(step >= F.lit(least or 0)).select("kind", "lang", "gram", "value").toArrow()
        out = cls(*[found.column(k).to_numpy() for k in range(4)])
        out.whole = whole
        return out

    def find(self, kind: int, lang: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(gram), bool), np.zeros(len(gram))
        names = _names(kind, lang, gram)
        at = np.minimum(np.searchsorted(self.keys, names), len(self.keys) - 1)
        return self.keys[at] == names, self.values[at].astype(float)

    def log10(self, lang: np.ndarray, tri: np.ndarray) -> np.ndarray:
        """Of the last symbol of each trigram after the first two."""
        hit, out = self.find(TRI, lang, tri)
        miss = np.flatnonzero(~hit)
        if len(miss):
            lang, tri = lang[miss], tri[miss]
            known, share = self.find(TRI_SHARE, lang, tri >> 21)
            seen, lower = self.find(BI, lang, tri & (1 << 42) - 1)
            rest = np.flatnonzero(~seen)
            below, bi_share = self.find(BI_SHARE, lang[rest], tri[rest] >> 21 & (1 << 21) - 1)
            one, last = self.find(UNI, lang[rest], tri[rest] & (1 << 21) - 1)
            spread, uni_share = self.find(UNI_SHARE, lang[rest], np.zeros(len(rest), np.int64))
            last = np.where(one, last, np.where(spread, uni_share, 0) - np.log10(SYMBOLS))
            lower[rest] = np.where(below, bi_share, 0) + last
            out[miss] = np.where(known, share, 0) + lower
        return out

    def costs(self, chunk: Chunk, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Sum of negative log10 and number of predicted symbols of each text."""
        inside = np.bincount(words.of, self.log10(words.lang, words.inner), minlength=len(words.sizes))
        each = inside[words.which] + self.log10(words.border_lang, words.border)
        return -np.bincount(words.owner, each, minlength=chunk.n), words.predicted(chunk.n)

    def known_costs(self, chunk: Chunk, words: Words) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """As ``costs``, but of the trigrams that the model has; of the others, text, trigram and how often it is there, by text."""
        hit, value = self.find(TRI, words.lang, words.inner)
        inside = np.bincount(words.of, np.where(hit, value, 0), minlength=len(words.sizes))
        met, border = self.find(TRI, words.border_lang, words.border)
        total = -np.bincount(words.owner, inside[words.which] + np.where(met, border, 0), minlength=chunk.n)
        tri, lacks = words.inner[~hit], np.bincount(words.of[~hit], minlength=len(words.sizes))
        own = np.flatnonzero(lacks[words.which])  # words that hold such trigrams
        sizes = lacks[words.which[own]]
        at = np.repeat((np.cumsum(lacks) - lacks)[words.which[own]], sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        text = np.r_[np.repeat(words.owner[own], sizes), words.owner[~met]].astype(np.int64)
        return total, words.predicted(chunk.n), _merged(text, np.r_[tri[at], words.border[~met]], np.ones(len(text), np.int64))


def _statistics(chunk: Chunk, words: Words) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    n_words = np.bincount(words.owner, minlength=chunk.n)
    in_word = np.zeros(len(chunk.data), bool)
    lengths = words.ends - words.starts
    in_word[np.repeat(words.starts, lengths) + np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = True
    chars = chunk.counts(in_word & ((chunk.data & 0xC0) != 0x80))
    symbols = chunk.counts(np.isin(chunk.data, np.frombuffer(b"#*$%&|<>", np.uint8)))
    starts, ends, doc = chunk.lines()
    filled = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, doc = starts[filled], ends[filled], doc[filled]
    named = mix64(chunk.hashes(starts, ends, False) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(named, return_index=True)
    dup = np.bincount(doc, minlength=chunk.n) - np.bincount(doc[first], minlength=chunk.n)
    found, at = windows(words.hashes, words.owner, 3)
    covered = np.zeros(len(words.owner) + 3, bool)
    if len(found):
        named = mix64(found + words.owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(named)
        same = named[order][1:] == named[order][:-1]
        again = at[order][np.r_[same, False] | np.r_[False, same]]
        for k in range(3):
            covered[again + k] = True
    return [n_words, chars, symbols, dup, np.bincount(words.owner[covered[: len(words.owner)]], minlength=chunk.n)]


def measure(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", whole: DataFrame | None = None) -> DataFrame:
    """(id, the base statistics, lang long: hash, cost double: mean negative log10 of a symbol, null without words) of each row.

    ``whole``: the estimates that ``model`` is a part of, made from these very documents; trigrams that the model
    lacks are looked up there.  Without it they are scored by shorter ones, as unseen trigrams are.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    joined = whole is not None and not model.whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(2).to_numpy()
            for chunk in chunks(batch.column(1), _TOGETHER):
                own = langs[chunk.first : chunk.first + chunk.n]
                words = Words(chunk, own)
                total, size, *rest = sent.value.known_costs(chunk, words) if joined else sent.value.costs(chunk, words)
                statistics = [pa.array(x.astype(np.int64)) for x in _statistics(chunk, words)]
                columns = [batch.column(0).slice(chunk.first, chunk.n), *statistics, pa.array(own), pa.array(total.astype(float)), pa.array(size.astype(float))]
                if joined:
                    text, tri, times = rest[0]
                    ends = pa.array(np.searchsorted(text, np.arange(chunk.n + 1)).astype(np.int32))
                    columns += [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (tri, times)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", *names, "lang", "total", "size", *(["tri", "times"] if joined else [])])

    kind = docs.schema[id_column].dataType.simpleString()
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"), F.xxhash64(F.col(lang_column).cast("string")).alias("lang"))
    schema = f"id {kind}, " + ", ".join(f"{n} long" for n in names) + ", lang long, total double, size double"
    out = texts.mapInArrow(run, schema + (", tri array<long>, times array<long>" if joined else ""))
    if joined:
        out = written(out.withColumn("row", F.monotonically_increasing_id()), "known")
        lacking = out.select("row", "lang", F.explode(F.arrays_zip("tri", "times")).alias("x")).select("row", "lang", F.col("x.tri").alias("gram"), "x.times")
        found = lacking.join(whole.where(F.col("kind") == TRI).select("lang", "gram", "value"), ["gram", "lang"])
        more = found.groupBy("row").agg(F.sum(F.col("times") * F.col("value").cast("double")).alias("more"))
        out = out.join(more, "row", "left").withColumn("total", F.col("total") - F.coalesce("more", F.lit(0.0)))
    return out.select(F.col("id").alias(id_column), *names, "lang", F.try_divide("total", "size").alias("cost"))


def _median(binned: DataFrame, value: Column) -> DataFrame:
    """(lang, middle) from rows (lang, n) with a whole-number value: at most MOST_COST / BIN rows of a language."""
    by = Window.partitionBy("lang")
    counted = binned.groupBy("lang", value.alias("x")).agg(F.sum("n").alias("n"))
    counted = counted.withColumn("upto", F.sum("n").over(by.orderBy("x"))).withColumn("all", F.sum("n").over(by))
    return counted.where("upto * 2 >= all").groupBy("lang").agg(F.min("x").alias("middle"))


def bands(measured: DataFrame) -> DataFrame:
    """(lang, lowest, highest cost) of each language, from a histogram of all its rows."""
    binned = measured.where("cost is not null").groupBy("lang", F.floor(F.least(F.lit(MOST_COST), F.col("cost")) / BIN).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    binned = written(binned, "costs")
    middle = _median(binned, F.col("bin"))
    spread = _median(binned.join(middle, "lang"), F.abs(F.col("bin") - F.col("middle"))).withColumnRenamed("middle", "spread")
    half = F.greatest(F.lit(LEAST_WIDTH), F.lit(WIDTH * 1.4826 * BIN) * F.col("spread"))
    centre = (F.col("middle") + 0.5) * BIN
    return middle.join(spread, "lang").select("lang", (centre - half).alias("lowest"), (centre + half).alias("highest"))


def quality_rules(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", most: int = MODEL) -> DataFrame:
    """Each row's base statistics, base_failed, its cost with its language's band, and kept; ``most`` doesn't change them."""
    whole = written(estimates(written(trigram_counts(docs, text_column, lang_column), "trigrams")), "estimates")
    measured = measure(docs, Model.of(whole, most), id_column, text_column, lang_column, whole)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    measured = written(measured.withColumn("base_failed", failed), "measured")
    band = written(bands(measured.where("not base_failed")), "bands")  # one row for each language; Spark sees its size
    out = measured.join(band, "lang", "left")
    kept = ~F.col("base_failed") & F.coalesce(F.col("cost").between(F.col("lowest"), F.col("highest")), F.lit(False))
    return out.select(id_column, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "cost", "lowest", "highest")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and perplexity bands over all documents."""
    return quality_rules(table(spark, sf_dir, "documents"))
