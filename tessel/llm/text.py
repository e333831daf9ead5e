"""Word, line and character positions of whole batches of texts, as numpy arrays.

A batch is an Arrow string column.  It is cut into chunks of about
``CHUNK_BYTES`` so that the work arrays of a task have a bounded size; a single
text longer than that makes a chunk of its own.  Words are maximal runs of
bytes other than space, \\t, \\n, \\v, \\f, \\r.  A word, line or n-gram is named by
a 64-bit hash: a polynomial over a fixed table of random numbers, mixed at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_TABLE_LOWER = _TABLE[_LOWER]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


class Chunk:
    """Some whole texts of a batch: ``data`` holds their UTF-8 bytes, text i at offsets[i]:offsets[i+1]."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets
        self.n = len(offsets) - 1

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of maximal runs of marked bytes; a run never leaves its text."""
        if not len(self.data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        cuts = self.offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(inside))]
        opens = inside & ~before
        opens[cuts] = inside[cuts]
        closes = before & ~inside
        closes[cuts] = before[cuts]
        ends = np.flatnonzero(closes)
        if inside[-1]:
            ends = np.append(ends, len(inside))
        return np.flatnonzero(opens), ends

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.spans(~_SPACE[self.data])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text numbers of all \\n-split lines, empty ones too (an empty text is one empty line)."""
        breaks = np.flatnonzero(self.data == 10)
        owner = np.searchsorted(self.offsets, breaks, side="right") - 1
        starts = np.concatenate([self.offsets[:-1], breaks + 1])
        ends = np.concatenate([self.offsets[1:], breaks])
        doc = np.concatenate([np.arange(self.n), owner])
        order = np.lexsort((starts, doc))
        starts, doc = starts[order], doc[order]
        order = np.lexsort((ends, np.concatenate([np.arange(self.n), owner])))
        return starts, ends[order], doc

    def owner(self, starts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, starts, side="right") - 1

    def counts(self, marks: np.ndarray) -> np.ndarray:
        """Marked bytes of each text."""
        total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
        """64-bit hash of each span of bytes; with ``lower``, A-Z count as a-z."""
        up, down = _powers(len(self.data) + 1)
        sums = np.empty(len(self.data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((_TABLE_LOWER if lower else _TABLE)[self.data] * up[:-1], out=sums[1:])
        return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def chunks(column: pa.Array | pa.ChunkedArray, most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of a column in order (null: empty), some at a time."""
    for array in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        array = array.fill_null("").cast(pa.large_string())
        if not len(array):
            continue
        offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
        data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] else np.zeros(0, np.uint8)
        at = 0
        while at < len(array):
            to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
            to = min(max(to, at + 1), len(array))
            yield Chunk(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            at = to


def filtered(text_at: int, keep: Callable[[Chunk], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that keeps whole rows by a mask made from their texts (column number ``text_at``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(text_at), 1 << 20):
                yield batch.slice(chunk.first, chunk.n).filter(pa.array(keep(chunk)))

    return run


def windows(hashes: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` neighbouring words of one text, and the number of its first word."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(hashes) - size + 1
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total *= _BASE
        total += hashes[k : k + n]
    first = np.flatnonzero(doc[:n] == doc[size - 1 :])
    return mix64(total[first]), first


def distinct(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, hash) pairs, sorted by text, then hash; ``doc`` must be sorted."""
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[new], hashes[new]
