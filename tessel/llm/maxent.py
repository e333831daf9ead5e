"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

Tokens are a text's lower-cased (A-Z) words and one end.  Spark counts the tokens of
all training documents.  The ``HEADS`` most frequent ones are dealt by frequency into
``CLASSES`` classes; all others are the tail class.  Hashed features of the history
(the word before, the word before that, both) give the class's softmax; features
hashed together with the class give the word's softmax within it.  A word of the tail
has its smoothed share of the tail's training tokens.  So every token, known or not,
has a probability, and they sum to at most one.

Training is one pass over all training documents: each task makes gradient steps on
minibatches from the same start (the log shares of the counts) and hands over the rows that it
met.  Those changes are averaged in Spark, in groups of at most ``FAN_IN``, each row
weighted by how often a task met it.  Where there are more input splits than cores, up to
``SPLITS`` of them train in one task, so what is handed over stays small beside the texts.

Words are named by 64-bit hashes.  Exact counts of the words that are frequent enough
to be among ``BROADCAST`` are sent to the tasks; occurrences of all other words go
through a join with the whole count table, so no count is cut off.

Edge cases: a null or empty text is its end alone.  Rows are kept one for one, repeated
ones included; a null id is held out or not like the empty id.  Without training tokens
every score is that of the untrained model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.shared import remainder, table, written
from tessel.llm.text import Chunk, chunks, mix64

CLASSES, PER_CLASS = 32, 64
HEADS = CLASSES * PER_CLASS
FEATURES = 1 << 15
BROADCAST = 1 << 20
BATCH, RATE, FAN_IN, SPLITS = 8192, 0.5, 128, 8
END = np.uint64(0x5EED0E2D5EED0E2D)
_TAILS, _START = 2048, HEADS + 2048
_BLOCK = 512  # rows of a table that travel together
_SHORT = 4  # stretches of rows that are added up place by place


class Stream:
    """The tokens of a chunk's texts in order, each text's end included."""

    def __init__(self, chunk: Chunk):
        starts, ends = chunk.words()
        owner = chunk.owner(starts)
        counts = np.bincount(owner, minlength=chunk.n)
        self.lengths = counts + 1
        self.tokens = np.empty(len(starts) + chunk.n, np.uint64)
        self.tokens[np.cumsum(self.lengths) - 1] = END
        self.tokens[np.arange(len(starts)) + owner] = chunk.hashes(starts, ends, True)
        self.owner = np.repeat(np.arange(chunk.n), self.lengths)

    def take(self, which: np.ndarray) -> Stream:
        out = object.__new__(Stream)
        rows = which[self.owner]
        out.tokens, out.lengths = self.tokens[rows], self.lengths[which]
        out.owner = np.repeat(np.arange(int(which.sum())), out.lengths)
        return out


@dataclass
class Vocabulary:
    """Frequent tokens by hash, with counts and head numbers (-1: tail), and the corpus's totals."""

    hashes: np.ndarray
    counts: np.ndarray
    heads: np.ndarray
    total: int
    distinct: int

    def find(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (-1: not among the frequent) and head number (-1: tail) of each token."""
        if not len(self.hashes):
            return np.full(len(tokens), -1), np.full(len(tokens), -1)
        at = np.minimum(np.searchsorted(self.hashes, tokens), len(self.hashes) - 1)
        hit = self.hashes[at] == tokens
        return np.where(hit, self.counts[at], -1), np.where(hit, self.heads[at], -1)


@dataclass
class Model:
    """Weights: classes by feature row (its last row: bias), words of a class by feature row, and word biases."""

    classes: np.ndarray
    words: np.ndarray
    word_bias: np.ndarray
    tail: float  # log10 of the tail's denominator

    @classmethod
    def start(cls, vocabulary: Vocabulary) -> Model:
        head = np.zeros(HEADS)
        own = vocabulary.heads >= 0
        head[vocabulary.heads[own]] = vocabulary.counts[own]
        tail_tokens, tail_words = vocabulary.total - head.sum(), vocabulary.distinct - int(own.sum())
        classes = np.zeros((FEATURES + 1, CLASSES + 1), np.float32)
        classes[-1] = np.log(np.r_[head.reshape(CLASSES, PER_CLASS).sum(1), tail_tokens] + 1)
        bias = np.where(np.arange(HEADS) < own.sum(), np.log(head + 1), -30).reshape(CLASSES, PER_CLASS)
        return cls(classes, np.zeros((FEATURES, PER_CLASS), np.float32), bias.astype(np.float32), float(np.log10(tail_tokens + tail_words + 1)))


def _feature(kind: int, *parts: np.ndarray) -> np.ndarray:
    value = np.full(len(parts[0]), kind, np.uint64)
    for part in parts:
        value = mix64(value * np.uint64(0x10003) + part.astype(np.uint64))
    return (value % np.uint64(FEATURES)).astype(np.int64)


class History:
    """Feature rows of every token of a stream."""

    def __init__(self, stream: Stream, heads: np.ndarray):
        ids = np.where(heads >= 0, heads, HEADS + (stream.tokens % np.uint64(_TAILS)).astype(np.int64))
        first = np.cumsum(stream.lengths) - stream.lengths
        one, two = np.full(len(ids), _START), np.full(len(ids), _START)
        one[1:] = ids[:-1]
        one[first] = _START
        two[2:] = ids[:-2]
        two[first] = _START
        two[np.minimum(first + 1, len(ids) - 1)[stream.lengths > 1]] = _START
        self.classes = np.stack([_feature(1, one), _feature(2, two), _feature(3, one, two)])
        self.target = np.where(heads >= 0, heads // PER_CLASS, CLASSES)
        self.inner = np.flatnonzero(heads >= 0)
        own = self.target[self.inner]
        self.words = np.stack([_feature(4, one[self.inner], own), _feature(5, two[self.inner], own)])
        self.word = heads[self.inner] % PER_CLASS


def _softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    return z


def _logits(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum of a table's rows (kinds of features by tokens) of each token."""
    out = np.take(table, rows[0], axis=0)
    for kind in rows[1:]:
        out += np.take(table, kind, axis=0)
    return out


def _sums(slope: np.ndarray, order: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of the slopes of each stretch of ``order``; the many short stretches are added up together, place by place."""
    out = np.take(slope, order[starts], axis=0)
    short = sizes <= _SHORT
    for k in range(1, _SHORT):
        own = np.flatnonzero(short & (sizes > k))
        out[own] += np.take(slope, order[starts[own] + k], axis=0)
    if not short.all():
        long = sizes[~short]
        held = np.take(slope, order[np.repeat(~short, sizes)], axis=0)
        out[~short] = np.add.reduceat(held, np.cumsum(long) - long, axis=0)
    return out


def _add(table: np.ndarray, sizes: np.ndarray, seen: np.ndarray, rows: np.ndarray, slope: np.ndarray) -> None:
    """One step on some rows (kinds of features by tokens): slopes are summed per row, and rows that moved much move more slowly."""
    flat = rows.ravel().astype(np.min_scalar_type(len(table)))  # few bytes are sorted by radix
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    times = np.diff(np.r_[starts, len(flat)])
    total = _sums(slope, order % len(slope), starts, times)
    own = ordered[starts].astype(np.int64)
    seen[own] += times
    sizes[own] += np.einsum("ij,ij->i", total, total) / total.shape[1]
    total *= (RATE / np.sqrt(sizes[own] + 1.0))[:, None]
    table[own] -= total


class Learner:
    """Gradient steps on a copy of the model."""

    def __init__(self, model: Model):
        self.model = Model(model.classes.copy(), model.words.copy(), model.word_bias, model.tail)
        self.sizes = [np.zeros(len(t), np.float32) for t in (model.classes, model.words)]
        self.seen = [np.zeros(len(t), np.float32) for t in (model.classes, model.words)]

    def learn(self, history: History) -> None:
        m = self.model
        for at in range(0, len(history.target), BATCH):
            rows, y = history.classes[:, at : at + BATCH], history.target[at : at + BATCH]
            p = _softmax(_logits(m.classes, rows) + m.classes[-1])
            p[np.arange(len(y)), y] -= 1
            _add(m.classes, self.sizes[0], self.seen[0], rows, p)
            self.bias(p)
        for at in range(0, len(history.word), BATCH):
            rows, y = history.words[:, at : at + BATCH], history.word[at : at + BATCH]
            own = history.target[history.inner[at : at + BATCH]]
            p = _softmax(_logits(m.words, rows) + m.word_bias[own])
            p[np.arange(len(y)), y] -= 1
            _add(m.words, self.sizes[1], self.seen[1], rows, p)

    def bias(self, slope: np.ndarray) -> None:
        """A step on the last row of the classes' table, which every token has."""
        total = slope.sum(0)
        self.seen[0][-1] += len(slope)
        self.sizes[0][-1] += (total**2).mean()
        self.model.classes[-1] -= RATE / np.sqrt(self.sizes[0][-1] + 1.0) * total


def log10(model: Model, history: History) -> np.ndarray:
    """Of each token's class and, for a head, of the token within it."""
    out = np.empty(len(history.target))
    for at in range(0, len(out), BATCH):
        rows, y = history.classes[:, at : at + BATCH], history.target[at : at + BATCH]
        p = _softmax(_logits(model.classes, rows) + model.classes[-1])
        out[at : at + BATCH] = np.log10(np.maximum(p[np.arange(len(y)), y], 1e-30))
    for at in range(0, len(history.word), BATCH):
        rows, y, own = history.words[:, at : at + BATCH], history.word[at : at + BATCH], history.inner[at : at + BATCH]
        p = _softmax(_logits(model.words, rows) + model.word_bias[history.target[own]])
        out[own] += np.log10(np.maximum(p[np.arange(len(y)), y], 1e-30))
    return out


def token_counts(texts: DataFrame) -> DataFrame:
    """(token long, n long) of all ``text``s; tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(counts)], names=["token", "n"])

        for batch in batches:
            for chunk in chunks(batch.column(0)):
                held.append(Stream(chunk).tokens)
                size += len(held[-1])
                if size > 4_000_000:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return texts.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The frequent tokens of a written count table: all of at least the least count that keeps them within BROADCAST."""
    step = F.floor(F.log2("n") * 16)
    steps = sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("tokens")).collect(), reverse=True)
    total, distinct = sum(r["tokens"] for r in steps), sum(r["words"] for r in steps)
    least, words = None, 0
    for row in steps:
        words += row["words"]
        if words > BROADCAST:
            break
        least = row["step"]
    frequent = (counts if least is not None else counts.limit(0)).where(step >= F.lit(least if least is not None else 0)).toArrow()
    tokens, n = frequent.column("token").to_numpy().view(np.uint64), frequent.column("n").to_numpy()
    order = np.argsort(tokens)
    tokens, n = tokens[order], n[order]
    rank = np.lexsort((tokens, -n, tokens != END))[:HEADS]  # the end is always a head
    rank = rank[np.lexsort((tokens[rank], -n[rank]))]
    heads = np.full(len(tokens), -1, np.int32)
    heads[rank] = np.arange(len(rank))
    return Vocabulary(tokens, n, heads, int(total), int(distinct))


def _handed(name: str, at: int, part: int, rows: np.ndarray, weight: np.ndarray, change: np.ndarray) -> pa.RecordBatch:
    """Some rows of the block of a table that begins at ``at``: their places in it, weights and weighted changes."""
    held = [np.ascontiguousarray(x, kind).tobytes() for x, kind in ((rows, "<u2"), (weight, "<f4"), (change, "<f4"))]
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at], pa.int32()), pa.array([part], pa.int32()), *[pa.array([x], pa.binary()) for x in held]], names=["name", "at", "part", "rows", "weight", "change"])


def train(texts: DataFrame, words: Vocabulary) -> Model:
    """One pass of gradient steps over all ``text``s."""
    spark = texts.sparkSession
    start = Model.start(words)
    sent = spark.sparkContext.broadcast((words, start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, begun = sent.value
        learner = Learner(begun)
        for batch in batches:
            for chunk in chunks(batch.column(0), 1 << 21):
                stream = Stream(chunk)
                learner.learn(History(stream, known.find(stream.tokens)[1]))
        part = TaskContext.get().partitionId()
        for name, old, new, seen in (("classes", begun.classes, learner.model.classes, learner.seen[0]), ("words", begun.words, learner.model.words, learner.seen[1])):
            for at in range(0, len(old), _BLOCK):
                rows = np.flatnonzero(seen[at : at + _BLOCK])
                if len(rows):
                    weight = seen[at + rows]
                    yield _handed(name, at, part, rows, weight, (new - old)[at + rows] * weight[:, None])

    schema = "name string, at int, part int, rows binary, weight binary, change binary"
    splits = texts.select("text").rdd.getNumPartitions()
    together = texts.select("text").coalesce(max(1, -(-splits // SPLITS), min(splits, spark.sparkContext.defaultParallelism)))
    changes = written(together.mapInArrow(run, schema), "changes")

    def merged(key: tuple, rows: pa.Table) -> pa.Table:
        at = [np.frombuffer(x, "<u2") for x in rows.column("rows").to_pylist()]
        where, place = np.unique(np.concatenate(at), return_inverse=True)
        ends = np.r_[0, np.cumsum([len(x) for x in at])]
        weight, change = np.zeros(len(where)), 0
        for i, (w, c) in enumerate(zip(rows.column("weight").to_pylist(), rows.column("change").to_pylist())):
            own, c = place[ends[i] : ends[i + 1]], np.frombuffer(c, "<f4").reshape(len(at[i]), -1)
            change = np.zeros((len(where), c.shape[1])) if i == 0 else change
            weight[own] += np.frombuffer(w, "<f4")  # a task has a row once
            change[own] += c
        return pa.Table.from_batches([_handed(key[0].as_py(), key[1].as_py(), key[2].as_py(), where, weight, change)])

    parts = (changes.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        parts = -(-parts // FAN_IN)
        changes = changes.withColumn("part", (F.col("part") % parts).cast("int")).groupBy("name", "at", "part").applyInArrow(merged, schema)
        if parts == 1:
            break
    for row in changes.toArrow().to_pylist():  # the model's own size, however large the corpus is
        own = start.classes if row["name"] == "classes" else start.words
        rows, weight = row["at"] + np.frombuffer(row["rows"], "<u2").astype(np.int64), np.frombuffer(row["weight"], "<f4")
        own[rows] += np.frombuffer(row["change"], "<f4").reshape(len(rows), -1) / np.maximum(weight, 1)[:, None]
    return start


def score_texts(docs: DataFrame, training: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, trains boolean, n_tokens, n_known, train_tokens long, base_score, score double) of each row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).alias("id"), training.alias("trains"), F.col(text_column).cast("string").alias("text"))
    counts = written(token_counts(rows.where("trains")), "counts")
    words = vocabulary(counts)
    model = train(rows.where("trains"), words)
    sent = spark.sparkContext.broadcast((words, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, learned = sent.value
        for batch in batches:
            for chunk in chunks(batch.column(2), 1 << 21):
                stream = Stream(chunk)
                n, heads = known.find(stream.tokens)
                value = log10(learned, History(stream, heads))
                frequent = n >= 0
                own = np.where(frequent, np.log10(np.maximum(n, 0) + 1.0), 0)
                value += np.where(frequent & (heads < 0), own, 0) - np.where(heads < 0, learned.tail, 0)
                sums = lambda x: pa.array(np.bincount(stream.owner, x, minlength=chunk.n))  # noqa: E731,B023
                rare = np.flatnonzero(~frequent)
                ends = np.r_[0, np.cumsum(np.bincount(stream.owner[rare], minlength=chunk.n))]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(chunk.first, chunk.n),
                        batch.column(1).slice(chunk.first, chunk.n),
                        pa.array(stream.lengths.astype(np.int64)),
                        pa.array(np.bincount(stream.owner, frequent, minlength=chunk.n).astype(np.int64)),
                        sums(own),
                        sums(value),
                        pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(stream.tokens[rare].view(np.int64))),
                    ],
                    names=["id", "trains", "n_tokens", "known", "own", "value", "rare"],
                )

    kind = docs.schema[id_column].dataType.simpleString()
    scored = rows.mapInArrow(run, f"id {kind}, trains boolean, n_tokens long, known long, own double, value double, rare array<long>")
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode("rare").alias("token")).join(counts, "token", "left")
    more = rare.groupBy("row").agg(F.count("n").alias("more_known"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("more"))
    out = scored.drop("rare").join(more, "row", "left").fillna(0, ["more_known", "more"])
    return out.select(
        F.col("id").alias(id_column),
        "trains",
        "n_tokens",
        (F.col("known") + F.col("more_known")).alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("own") + F.col("more") - F.col("n_tokens") * F.log10(F.lit(float(words.total + words.distinct + 1)))).alias("base_score"),
        (F.col("value") + F.col("more")).alias("score"),
    )


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by a model of those whose crc32 mod 7 isn't 2."""
    held = remainder("doc_id", 7) == 2
    scored = score_texts(table(spark, sf_dir, "documents"), ~held)
    return scored.select("doc_id", (~F.col("trains")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
