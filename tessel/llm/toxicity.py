"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the vectors of its character n-grams (3 to 5 bytes
with word marks, A-Z lowered), hashed into a fixed table; so an unseen misspelling
shares most of its vector with the word it hides.  A window of ``WINDOW`` words is
the mean of its words, and a linear softmax over that says clean or toxic.  A
document is as toxic as its most toxic window, so a long text does not dilute a few
words.  Vectors and softmax are trained jointly in numpy on a bounded sample of
labelled documents, whole texts of any length: every window of a toxic document at first,
then only the one the model finds most toxic, against all windows of the clean ones.  A
part of the sample sets the scale of the scores, by the same maximum over sliding windows
of whole texts as in scoring.

For scoring, the softmax is applied to the n-gram table once; tasks get that table of
``BUCKETS`` numbers.  Sliding windows over whole texts are prefix sums.

Edge cases: a null text is an empty one; a text without words gets the score of no
evidence (that of an all-zero window).  Rows are kept one for one, repeated ones and
null ids included.  Without labels of both kinds every score is 0.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.samples import fitted, labelled
from tessel.llm.shared import remainder, table
from tessel.llm.text import _LOWER, Chunk, chunks, filtered

WINDOW = 4
SIZES = (3, 4, 5)
BITS = 19
BUCKETS = 1 << BITS
DIMENSIONS = 4
#: Most labelled documents, clean and toxic, that the model is fitted on; their texts are taken whole.
SAMPLED = (1000, 1500)
THRESHOLD = 0.7
#: Step size, ridge and the softening of Adam's step: n-grams of few documents have slopes below it, so they are learned more slowly.
RATE, DECAY, SOFT = 0.1, 1e-5, 1e-7


def ngrams(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word number and bucket of each character n-gram, n-gram sizes one after another, and the owner of each word."""
    starts, ends = chunk.words()
    lengths = ends - starts
    n = len(starts)
    marked = np.full(int(lengths.sum()) + n + 1, 32, np.uint8)
    number = np.repeat(np.arange(n), lengths)
    place = np.arange(len(number)) + number + 1
    within = np.arange(len(number)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    marked[place] = _LOWER[chunk.data[np.repeat(starts, lengths) + within]]
    spaces = np.cumsum(marked == 32, dtype=np.int32)
    letters = marked.astype(np.uint32)
    words, buckets = [], []
    hashed = letters[:-1] * np.uint32(0x01000193) + letters[1:] if len(letters) > 1 else letters[:0]
    for size in range(3, max(SIZES) + 1):
        hashed = hashed[:-1] * np.uint32(0x01000193) + letters[size - 1 :]
        m = len(hashed)
        if size in SIZES and m > 0:
            first = np.flatnonzero(spaces[size - 2 : size - 2 + m] == spaces[:m])  # no word mark inside
            words.append(spaces[first] - 1)
            mixed = hashed[first] * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
            buckets.append((mixed * np.uint32(0x85EBCA77) + np.uint32(size)) >> np.uint32(32 - BITS))
    empty = np.zeros(0, np.int32)
    return np.concatenate([empty, *words]), np.concatenate([empty.astype(np.uint32), *buckets]), chunk.owner(starts)


@dataclass
class Model:
    """A score for each n-gram bucket, and the line that turns a window's score into a logit."""

    weights: np.ndarray
    bias: float
    scale: float
    shift: float

    def window_scores(self, chunk: Chunk) -> np.ndarray:
        """The highest window score of each text; ``bias`` where a text has no words."""
        words, buckets, owner = ngrams(chunk)
        n = len(owner)
        best = np.full(chunk.n, self.bias)
        if n:
            each = np.bincount(words, self.weights[buckets], minlength=n) / np.maximum(1, np.bincount(words, minlength=n))
            sums = np.concatenate([[0.0], np.cumsum(each)])
            counts = np.bincount(owner, minlength=chunk.n)
            last = np.cumsum(counts)[owner]
            to = np.minimum(np.arange(n) + WINDOW, last)
            length = to - np.arange(n)
            whole = (length == WINDOW) | (counts[owner] < WINDOW) & (length == counts[owner])
            values = (sums[to] - sums[:-1]) / length + self.bias
            best[np.flatnonzero(counts)] = -np.inf
            np.maximum.at(best, owner[whole], values[whole])
        return best

    def scores(self, chunk: Chunk) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.window_scores(chunk) * self.scale + self.shift, -30, 30)))


def _windows(text: str | None) -> list[str]:
    """All words of a text, WINDOW at a time; an empty window if there are none."""
    words = (text or "").encode("utf-8").split()
    return [b" ".join(words[i : i + WINDOW]).decode("utf-8") for i in range(0, max(1, len(words)), WINDOW)]


class _Bags:
    """Windows as bags of word numbers, words as bags of n-gram buckets."""

    def __init__(self, texts: pa.Array):
        self.n = len(texts)
        words, window = array("i"), array("i")
        known: dict[bytes, int] = {}
        for i, text in enumerate(texts):
            for word in text.as_py().encode("utf-8").lower().split():
                words.append(known.setdefault(word, len(known)))
                window.append(i)
        self.words, self.window = np.array(words, np.int32), np.array(window, np.int32)
        del words, window
        self.share = 1 / np.maximum(1, np.bincount(self.window, minlength=self.n))[self.window]
        of, bucket = [], []
        for part in chunks(pa.array([w.decode("utf-8") for w in known], pa.string())):
            w, b, owner = ngrams(part)
            of.append(owner[w] + part.first)
            bucket.append(b)
        self.of, self.bucket = (np.concatenate(x).astype(np.int32) if x else np.zeros(0, np.int32) for x in (of, bucket))
        self.n_words = len(known)
        self.word_share = (1 / np.maximum(1, np.bincount(self.of, minlength=self.n_words))).astype(np.float32)[self.of]
        self.used = np.flatnonzero(np.bincount(self.bucket, minlength=BUCKETS))
        place = np.zeros(BUCKETS, np.int32)
        place[self.used] = np.arange(len(self.used))
        self.bucket, self.share = place[self.bucket], self.share.astype(np.float32)


def _summed(index: np.ndarray, table: np.ndarray, rows: np.ndarray, share: np.ndarray, n: int) -> np.ndarray:
    """Sums of shares of a table's rows by index, a column at a time."""
    out = np.empty((n, table.shape[1]), np.float32)
    for k in range(table.shape[1]):
        out[:, k] = np.bincount(index, table[:, k].astype(np.float32)[rows] * share, minlength=n)
    return out


def fit(doc: np.ndarray, target: np.ndarray, texts: pa.Array, seed: int = 0, rounds: tuple[int, ...] = (20, 8, 8, 8, 8)) -> Model:
    """Trains vectors and softmax on windows ``texts``, in their order, of documents ``doc`` with the documents' labels ``target``."""
    none = Model(np.zeros(BUCKETS), -30.0, 1.0, 0.0)
    if not len(doc) or target.min() == target.max():
        return none
    names, which = np.unique(doc, return_inverse=True)
    bags = _Bags(texts)
    rng = np.random.default_rng(seed)
    label = np.zeros(len(names))
    label[which] = target
    tuning = rng.random(len(names)) < 0.2
    if len(set(label[tuning])) < 2 or len(set(label[~tuning])) < 2:
        tuning = np.ones(len(names), bool)
        learning = tuning
    else:
        learning = ~tuning
    vectors = rng.normal(0, 0.1, (len(bags.used), DIMENSIONS)).astype(np.float32)
    softmax = rng.normal(0, 0.1, (DIMENSIONS, 2))
    bias = np.zeros(2)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (vectors, softmax, bias)]
    step = 0
    y = target.astype(int)

    def forward() -> tuple[np.ndarray, np.ndarray]:
        words = _summed(bags.of, vectors, bags.bucket, bags.word_share, bags.n_words)
        mean = _summed(bags.window, words, bags.words, bags.share, bags.n)
        return mean, mean @ softmax + bias

    for n, steps in enumerate(rounds):
        weight = learning[which].astype(float)
        if n:
            margin = (lambda z: z[:, 1] - z[:, 0])(forward()[1])
            order = np.lexsort((-margin, which))
            top = np.zeros(len(y), bool)
            top[order[np.r_[True, which[order][1:] != which[order][:-1]]]] = True
            weight[(y == 1) & ~top] = 0
            # A clean document is judged by its worst window too: those weigh as much as all others.
            worst = (y == 0) & top
            weight[worst] *= max(1.0, (weight[(y == 0) & ~top].sum()) / max(1.0, weight[worst].sum()))
        for k in (0, 1):
            weight[y == k] /= max(1e-9, weight[y == k].sum())
        for _ in range(steps):
            mean, z = forward()
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            wrong = p * weight[:, None]
            to_words = _summed(bags.words, wrong @ softmax.T, bags.window, bags.share, bags.n_words)
            slopes = [_summed(bags.bucket, to_words, bags.of, bags.word_share, len(bags.used)), mean.T @ wrong, wrong.sum(0)]
            step += 1
            for x, slope, moment in zip((vectors, softmax, bias), slopes, moments):
                slope = slope + DECAY * x
                moment[0] = 0.9 * moment[0] + 0.1 * slope
                moment[1] = 0.99 * moment[1] + 0.01 * slope**2
                x -= RATE * moment[0] / (1 - 0.9**step) / (np.sqrt(moment[1] / (1 - 0.99**step)) + SOFT)
    weights = np.zeros(BUCKETS)
    weights[bags.used] = vectors @ (softmax[:, 1] - softmax[:, 0])
    model = Model(weights, float(bias[1] - bias[0]), 1.0, 0.0)
    rows = np.flatnonzero(tuning[which])
    rows = rows[np.argsort(which[rows], kind="stable")]
    cuts = np.flatnonzero(np.diff(which[rows])) + 1
    whole = pa.array([" ".join(texts.take(pa.array(part)).to_pylist()) for part in np.split(rows, cuts)], pa.string())
    best = np.concatenate([model.window_scores(part) for part in chunks(whole, 1 << 20)])
    model.scale, model.shift = _line(best, label[tuning])
    return model


def _line(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic fit of labels on scores (ridge, Newton steps); the clean documents weigh three times the toxic ones."""
    centre, spread = float(x.mean()), float(x.std()) or 1.0
    features = np.stack([(x - centre) / spread, np.ones_like(x)], 1)
    weight = np.where(y == 1, 0.25 / max(1, (y == 1).sum()), 0.75 / max(1, (y == 0).sum()))
    found = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-features @ found))
        slope = features.T @ (weight * (p - y)) + 0.002 * found
        curve = (features * (weight * p * (1 - p))[:, None]).T @ features + 0.002 * np.eye(2)
        found -= np.linalg.solve(curve, slope)
    return found[0] / spread, found[1] - found[0] * centre / spread


def fit_rows(rows: pa.Table) -> Model:
    """A model from rows (text, target)."""
    cut = [pa.array(_windows(text.as_py()), pa.string()) for text in rows.column("text")]
    doc = np.repeat(np.arange(len(cut)), [len(x) for x in cut])
    model = fit(doc, rows.column("target").to_numpy()[doc], pa.concat_arrays(cut) if cut else pa.array([], pa.string()))
    model.weights = model.weights.astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", allowed: F.Column | None = None) -> Model:
    """A model from at most SAMPLED labelled documents, fitted in one task."""
    return fitted(labelled(docs, labels, target, F.lit(True) if allowed is None else allowed, SAMPLED), fit_rows)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score double) of each row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1), 1 << 20):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.n), pa.array(sent.value.scores(chunk))], names=["id", "score"])

    kind = docs.schema[id_column].dataType.simpleString()
    out = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, f"id {kind}, score double")
    return out.withColumnRenamed("id", id_column)


def kept(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(filtered(docs.columns.index("text"), lambda chunk: sent.value.scores(chunk) < threshold), docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; learned only from ids whose crc32 mod 3 isn't 1."""
    docs = table(spark, sf_dir, "documents")
    held = remainder("doc_id", 3) == 1
    model = train(docs, table(spark, sf_dir, "labels"), "toxic", ~held)
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
