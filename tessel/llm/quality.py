"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad.  Its potentials are linear in features of the line and of
its two neighbours; a 2 x 2 table scores neighbouring labels.  A document's quality is
the mean of its lines' marginal probabilities of good, weighted by line length.

Labels say good or bad of documents, not of lines: a bad document has good lines too.
So the field is trained in numpy, on a bounded sample of labelled documents, in two
parts: first by its exact likelihood, each line carrying its document's label, then by
the likelihood of the documents' labels under the weighted means of the marginals, the
lines' labels being hidden.  There the table learns how labels of neighbours go
together.  The slopes of marginals are covariances, which two further runs of
forward-backward give.

Whole texts are scored in batches: the recursions run over line numbers, for all
documents of a chunk at once.

Edge cases: a null text is an empty one, and an empty text is one empty line of
weight one.  Rows are kept one for one, repeated ones and null ids included.
Without labels of both kinds every score is 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.samples import fitted, labelled
from tessel.llm.shared import remainder, table
from tessel.llm.text import Chunk, chunks, filtered, windows

THRESHOLD = 0.3
#: Most labelled documents of each class that the field is fitted on; their texts are taken whole.
PER_CLASS = 1500
#: Training steps on the lines, then on the documents.
STEPS = (80, 60)

_CLASSES = {
    "upper": np.arange(65, 91),
    "lower": np.arange(97, 123),
    "digit": np.arange(48, 58),
    "symbol": np.frombuffer(b"#*$%&|<>", np.uint8),
    "bang": np.frombuffer(b"!?", np.uint8),
    "stop": np.frombuffer(b".", np.uint8),
    "markup": np.frombuffer(b"/\\{}[]()=_~@^+;:\"'`", np.uint8),
    "high": np.arange(128, 256),
}
_MARKS = np.zeros((len(_CLASSES), 256), bool)
for _k, _bytes in enumerate(_CLASSES.values()):
    _MARKS[_k, _bytes] = True
N_OWN = len(_CLASSES) + 7


def line_features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line and its neighbours, text number, length in bytes) of all lines."""
    starts, ends, doc = chunk.lines()
    lengths = ends - starts
    share = np.maximum(1, lengths).astype(float)
    own = np.zeros((len(starts), N_OWN), np.float32)
    for k, marks in enumerate(_MARKS):
        total = np.concatenate([[0], np.cumsum(marks[chunk.data], dtype=np.int32)])
        own[:, k] = np.minimum(1, 4 * (total[ends] - total[starts]) / share) if k > 1 else (total[ends] - total[starts]) / share
    w_start, w_end = chunk.words()
    at = np.concatenate([np.searchsorted(w_start, starts), [len(w_start)]])
    at_end = np.searchsorted(w_start, ends)
    n_words = at_end - at[:-1]
    k = len(_CLASSES)
    own[:, k] = np.minimum(1, lengths / np.maximum(1, n_words) / 20)  # word length
    own[:, k + 1] = np.log1p(n_words) / 6
    own[:, k + 2] = lengths == 0
    hashes, owner = chunk.hashes(w_start, w_end, True), chunk.owner(w_start)
    repeated = np.zeros(len(w_start) + 1)
    found, first = windows(hashes, owner, 3)
    if len(found):
        keyed = found ^ (owner[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(keyed, kind="stable")
        same = keyed[order][1:] == keyed[order][:-1]
        repeated[first[order[1:][same]]] = 1  # a run of three words that came before
    total = np.concatenate([[0.0], np.cumsum(repeated)])
    own[:, k + 3] = (total[at_end] - total[at[:-1]]) / np.maximum(1, n_words)
    line_hash = chunk.hashes(starts, ends, False) ^ (doc.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    order = np.argsort(line_hash, kind="stable")
    own[order[1:][(line_hash[order][1:] == line_hash[order][:-1])], k + 4] = 1  # an earlier line again
    own[:, k + 4] *= n_words > 0
    filled = lengths > 0
    own[filled, k + 5] = _MARKS[[0]][0][chunk.data[starts[filled]]]
    own[filled, k + 6] = np.isin(chunk.data[ends[filled] - 1], np.frombuffer(b".!?:", np.uint8))
    before, after = np.zeros_like(own), np.zeros_like(own)
    inner = doc[1:] == doc[:-1]
    before[1:][inner] = own[:-1][inner]
    after[:-1][inner] = own[1:][inner]
    return np.concatenate([own, before, after, np.ones((len(own), 1), np.float32)], 1), doc, lengths


def marginals(logit: np.ndarray, doc: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and expected counts of neighbouring labels per line (with its predecessor)."""
    counts = np.bincount(doc)
    starts = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    starts, counts = starts[order], counts[order]
    psi = np.stack([np.ones_like(logit), np.exp(np.clip(logit, -30, 30))], 1)
    step = np.exp(table)
    forward, backward = np.empty_like(psi), np.ones_like(psi)
    longest = int(counts[0]) if len(counts) else 0
    active = np.searchsorted(-counts, -np.arange(longest), side="left")  # texts with more than t lines
    for t in range(longest):
        rows = starts[: active[t]] + t
        now = psi[rows] * (forward[rows - 1] @ step if t else 1)
        forward[rows] = now / now.sum(1, keepdims=True)
    pairs = np.zeros((len(logit), 2, 2))
    for t in range(longest - 1, 0, -1):
        rows = starts[: active[t]] + t
        right = psi[rows] * backward[rows]
        joint = forward[rows - 1][:, :, None] * step * right[:, None, :]
        pairs[rows] = joint / joint.sum((1, 2), keepdims=True)
        back = right @ step.T
        backward[rows - 1] = back / back.sum(1, keepdims=True)
    both = forward * backward
    return both[:, 1] / both.sum(1), pairs


@dataclass
class Field:
    weights: np.ndarray
    table: np.ndarray

    def scores(self, chunk: Chunk) -> np.ndarray:
        features, doc, lengths = line_features(chunk)
        good, _ = marginals(features @ self.weights, doc, self.table)
        return np.clip(np.bincount(doc, good * _shares(lengths, doc), minlength=chunk.n), 0, 1)


def _shares(lengths: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Each line's share in its document's score."""
    weight = np.maximum(lengths, 1e-3)
    return weight / np.bincount(doc, weight)[doc] if len(doc) else weight


def document_slopes(logit: np.ndarray, doc: np.ndarray, table: np.ndarray, pull: np.ndarray, small: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of sum(pull * marginals) by the logits and by the table, from marginals of logits moved along ``pull``."""
    size = max(1e-300, np.abs(pull).max(initial=0))
    (up, pairs_up), (down, pairs_down) = (marginals(logit + sign * small / size * pull, doc, table) for sign in (1, -1))
    scale = size / (2 * small)
    return (up - down) * scale, (pairs_up.sum(0) - pairs_down.sum(0)) * scale


def fit(texts: pa.Array, target: np.ndarray, steps: tuple[int, int] = STEPS, ridge: float = 1e-4) -> Field:
    """Trains the field on whole texts and their labels, both labels weighing the same."""
    width = 3 * N_OWN + 1
    if not len(target) or target.min() == target.max():
        return Field(np.r_[np.zeros(width - 1), 30.0], np.zeros((2, 2)))
    parts = [(c.first, *line_features(c)) for c in chunks(texts)]
    features = np.concatenate([p[1] for p in parts])
    doc = np.concatenate([p[0] + p[2] for p in parts])
    share = _shares(np.concatenate([p[3] for p in parts]), doc)
    y = target[doc].astype(float)
    counts = np.bincount(doc)
    balance = np.array([0.5 / max(1, (target == k).sum()) for k in (0, 1)])[target]  # of each document
    weight = balance[doc] / counts[doc]  # a document weighs one, however many lines it has
    inner = np.r_[False, doc[1:] == doc[:-1]]
    seen = np.zeros((len(y), 2, 2))
    rows = np.flatnonzero(inner)
    seen[rows, y[rows].astype(int), y[rows].astype(int)] = 1
    found = [np.zeros(width), np.zeros((2, 2))]
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in found]
    for step in range(1, sum(steps) + 1):
        logit = features @ found[0]
        good, pairs = marginals(logit, doc, found[1])
        if step <= steps[0]:
            by_logit, by_table = weight * (good - y), ((pairs - seen) * weight[:, None, None]).sum(0)
        else:
            score = np.clip(np.bincount(doc, good * share), 1e-3, 1 - 1e-3)
            pull = (balance * (score - target) / (score * (1 - score)))[doc] * share
            by_logit, by_table = document_slopes(logit, doc, found[1], pull)
        slopes = [features.T @ by_logit + ridge * found[0], by_table + 1e-2 * found[1]]
        rate = 0.1 if step <= steps[0] else 0.03
        for x, slope, moment in zip(found, slopes, moments):
            moment[0] = 0.9 * moment[0] + 0.1 * slope
            moment[1] = 0.99 * moment[1] + 0.01 * slope**2
            x -= rate * moment[0] / (1 - 0.9**step) / (np.sqrt(moment[1] / (1 - 0.99**step)) + 1e-8)
    return Field(*found)


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", allowed: F.Column | None = None) -> Field:
    """A field from at most PER_CLASS labelled documents of each class, fitted in one task."""
    sample = labelled(docs, labels, target, F.lit(True) if allowed is None else allowed, (PER_CLASS, PER_CLASS))
    return fitted(sample, lambda rows: fit(rows.column("text").combine_chunks(), rows.column("target").to_numpy()))


def score(docs: DataFrame, field: Field, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score double) of each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.n), pa.array(field.scores(chunk))], names=["id", "score"])

    kind = docs.schema[id_column].dataType.simpleString()
    out = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, f"id {kind}, score double")
    return out.withColumnRenamed("id", id_column)


def kept(docs: DataFrame, field: Field, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least the threshold."""
    return docs.mapInArrow(filtered(docs.columns.index("text"), lambda chunk: field.scores(chunk) >= threshold), docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality; learned only from ids whose crc32 mod 5 isn't 0."""
    docs = table(spark, sf_dir, "documents")
    held = remainder("doc_id", 5) == 0
    field = train(docs, table(spark, sf_dir, "labels"), "quality", ~held)
    return score(docs, field).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
