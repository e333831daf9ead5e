"""Groups of spelling variants: every pair of words one edit apart, by one-edit neighbourhoods over a reduced alphabet.

Words are counted first; the vocabulary is what occurs often enough.  Each letter is hashed to one of
``SYMBOLS`` symbols.  Two words one edit apart have reduced words at most one edit apart, so a word's full
one-edit neighbourhood of its reduced word holds the reduced word of every partner.  The neighbourhood is
enumerated as 64-bit hashes from running sums (a changed, lost or added symbol moves the rest of the sum by one
power), each different string once, so a long word costs memory and rows linear in its length.  The hashes
are joined with those of the reduced vocabulary, and what meets is verified on the original strings.
No pair is lost: equal strings have equal hashes, and other collisions fail the verification.

A word's form is its commonest near word (ties: the smallest in code-point order), if that occurs ``MORE`` times
as often.  Counts rise by that factor along a chain of forms, so the longest chain follows from the largest
count, and doubling the steps reaches the end of all chains in the logarithm of that many joins.

A common word is added up within each task before the shuffle; a reduced word that many words share is
a skewed join, which adaptive execution splits.  Nothing is gathered on the driver but the largest count.

Edge cases: null and empty texts have no words; a null id counts as empty text in the hash; repeated rows count each time; a
run of a million letters is a word like any other; other columns aren't read; without words the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.llm.shared import table, written
from tessel.llm.text import mix64

#: What counts as a word of the query (fixed values).
RUN, EVERY, SHORTEST, FEWEST, MORE = "[A-Za-zÀ-ÿ]+", 199, 6, 5, 5
SYMBOLS = 8
#: Code points of words whose neighbourhoods are made at once; a longer word is cut into stretches of so many.
CHUNK = 1 << 15
#: Code points of pairs that are verified at once.
PAIRED = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_VALUES = mix64(np.arange(1, SYMBOLS + 1, dtype=np.uint64))


def symbols(points: np.ndarray) -> np.ndarray:
    """The symbol of each code point."""
    return (mix64(points.astype(np.uint64) + np.uint64(1)) >> np.uint64(20)).astype(np.int64) % SYMBOLS


def _sums(values: np.ndarray, powers: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers, out=out[1:])
    return out


def _powers(n: int) -> np.ndarray:
    steps = np.full(n, _BASE, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


def reduced(words: list[str]) -> np.ndarray:
    """The hash of each reduced word."""
    return np.array([_final(_sums(_VALUES[s], _powers(len(s)))[-1:], len(s))[0] for s in map(_symbols, words)], np.uint64) if words else np.zeros(0, np.uint64)


def _symbols(word: str) -> np.ndarray:
    return symbols(np.frombuffer(word.encode("utf-32-le"), np.uint32))


def _final(sums: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    return mix64(sums + np.asarray(length, np.uint64) * np.uint64(0xD1342543DE82EF95))


def neighbourhood(word: str) -> Iterator[np.ndarray]:
    """Hashes of all strings at most one edit from the reduced word, each string once, some at a time."""
    s = _symbols(word)
    n = len(s)
    powers = _powers(n + 1)
    sums = _sums(_VALUES[s], powers[:n])
    total, others, before = sums[-1], np.arange(1, SYMBOLS), np.append(-1, s)
    yield _final(sums[-1:], n)
    for at in range(0, n, CHUNK):
        i = np.arange(at, min(n, at + CHUNK))
        changed = _VALUES[(s[i, None] + others) % SYMBOLS]  # another symbol at place i
        yield _final((total + (changed - _VALUES[s[i], None]) * powers[i, None]).ravel(), n)
        runs = i[(i == 0) | (s[i] != s[i - 1])]  # losing any symbol of a run gives one string
        yield _final(sums[runs] + (total - sums[runs + 1]) * _INVERSE, n - 1)
    for at in range(0, n + 1, CHUNK):
        i = np.arange(at, min(n + 1, at + CHUNK))
        added = np.broadcast_to(np.arange(SYMBOLS), (len(i), SYMBOLS))
        new = added != before[i, None]  # after an equal one it is that run again
        yield _final((sums[i, None] + _VALUES[added] * powers[i, None] + (total - sums[i, None]) * _BASE)[new], n + 1)


def occurrences(docs: DataFrame, key: Column, text: Column, every: int = EVERY) -> DataFrame:
    """(word) for each run of letters of each text, A-Z lower-cased, with the planted slips of the contract."""
    runs = docs.select(key.cast("string").alias("key"), F.explode(F.regexp_extract_all(text.cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.char_length("run") >= SHORTEST)  # a deletion only shortens
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    runs = runs.select("key", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", upper, upper.lower())).otherwise(F.col("run")).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat(F.coalesce("key", F.lit("")), F.lit(":"), "run").cast("binary")))
    place = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.char_length("run")))
    return runs.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST) -> DataFrame:
    """(word, n) of the words long and frequent enough."""
    return words.where(F.char_length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= fewest)


def near_pairs(known: DataFrame) -> DataFrame:
    """(id, word, n, near_id, near, near_n): both ways, all pairs of a vocabulary (id long, word, n) that one edit separates."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held, size = [], [], 0
            for number, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for hashes in neighbourhood(word):
                    ids.append(np.full(len(hashes), number, np.int64))
                    held.append(hashes)
                    size += len(hashes)
                    if size >= 1 << 16:
                        yield _rows(held, ids)
                        ids, held, size = [], [], 0
            if size:
                yield _rows(held, ids)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(reduced(batch.column(1).to_pylist()).view(np.int64)), *batch.columns], names=["key", "near_id", "near", "near_n"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _stretches(batch, batch.column(1), batch.column(4)):
                yield part.filter(pa.array(one_edit(part.column(1), part.column(4))))

    # The vocabulary is small beside what is made of it: as many tasks as a shuffle has share that work.
    tasks = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    around = known.select("id", "word").repartition(tasks).mapInArrow(keys, "key long, id long")
    found = around.join(known.select("id", "word", "n").mapInArrow(own, "key long, near_id long, near string, near_n long"), "key").where("id != near_id").drop("key")
    met = found.join(known.select("id", "word", "n"), "id").where(F.abs(F.char_length("word") - F.char_length("near")) <= 1)
    return met.select("id", "word", "n", "near_id", "near", "near_n").mapInArrow(verified, "id long, word string, n long, near_id long, near string, near_n long")


def _stretches(batch: pa.RecordBatch, *texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """Some rows of a batch at a time: about ``PAIRED`` code points of their texts, a longer pair alone."""
    sizes = np.cumsum(sum(pc.utf8_length(t).to_numpy(zero_copy_only=False).astype(np.int64) for t in texts)) if len(batch) else []
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PAIRED, side="right")))
        yield batch.slice(at, to - at)
        at = to


def one_edit(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Whether one inserted, deleted or replaced code point makes a string of the other; the two must differ.

    They are one edit apart where their common beginning and end make up all but one code point of the longer.
    """
    (a, a_ends), (b, b_ends) = _points(left), _points(right)
    a_starts, b_starts = np.append(0, a_ends[:-1]), np.append(0, b_ends[:-1])
    shared = np.minimum(a_ends - a_starts, b_ends - b_starts)
    pair = np.repeat(np.arange(len(shared)), shared)
    place = np.arange(len(pair)) - np.repeat(np.cumsum(shared) - shared, shared)

    def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        length, apart = shared.copy(), np.flatnonzero(x != y)[::-1]
        length[pair[apart]] = place[apart]  # the last write is that of the first difference
        return length

    front = alike(a[a_starts[pair] + place], b[b_starts[pair] + place])
    back = alike(a[a_ends[pair] - 1 - place], b[b_ends[pair] - 1 - place])
    return front + back >= np.maximum(a_ends - a_starts, b_ends - b_starts) - 1


def _points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a column of strings, and where each string ends."""
    ends = np.cumsum(pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    return np.frombuffer("".join(column.to_pylist()).encode("utf-32-le"), np.uint32), ends


def _rows(held: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64)), pa.array(np.concatenate(ids))], names=["key", "id"])


def grouped(words: DataFrame, more: int = MORE, shortest: int = SHORTEST, fewest: int = FEWEST) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the vocabulary of ``words``."""
    known = written(vocabulary(words, shortest, fewest).withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("word"), F.col("near_id").alias("id"))).alias("best")
    near = near_pairs(known).groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), best)
    taken = -F.col("best.less") >= more * F.col("n")
    formed = known.join(near, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best")).alias("best"))
    formed = formed.select("id", "word", "n", "n_near", F.col("best.word").alias("form"), (-F.col("best.less")).alias("form_n"), F.coalesce("best.id", "id").alias("to"), F.coalesce("best.word", "word").alias("root"))
    formed = written(formed, "forms")
    most = formed.agg(F.max("n")).head()[0] or fewest
    longest = int(log(max(1, most / fewest), more) + 1e-9) + 1  # steps of a chain of forms
    steps = formed.select("id", "to", "root")
    for _ in range(ceil(log2(longest)) if longest > 1 else 0):
        far = steps.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("root").alias("end"))
        steps = steps.join(far, "to").select("id", F.col("next").alias("to"), F.col("end").alias("root"))
    return formed.drop("to", "root").join(steps.select("id", "root"), "id").select("word", "form", "root", "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(occurrences(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text")))
