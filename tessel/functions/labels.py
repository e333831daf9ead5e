"""Connected components inside grids, for whole Arrow batches at once: the one thing that DataFrame functions can't express.

A batch's grids are one flat array of cells.  Components are found by hooking each cell to the smallest one next to it and
halving the ways to the roots, all cells together, so no grid or cell is visited by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def flood(group: list[list[int]], eight: bool) -> tuple[list[list[int]], list[list[tuple[int, int]]]]:
    """Of one grid: labels from 1 on (0: where ``group`` is negative) of equal neighbours in reading order, and their cells."""
    cells = Cells.of(pa.array([group], pa.list_(pa.list_(pa.int32()))))
    inside = cells.values >= 0
    root = connected(len(inside), *cells.neighbours(eight, inside, cells.values))
    names, label = np.unique(root[inside], return_inverse=True)
    out = np.zeros(len(inside), int)
    out[inside] = label + 1
    w = len(group[0]) if group else 0
    return out.reshape(len(group), w).tolist(), [[divmod(int(i), w) for i in np.flatnonzero(inside)[label == k]] for k in range(len(names))]


class Cells:
    """The cells of a batch of grids, row by row; a null grid has none."""

    def __init__(self, column: pa.Array, values: np.ndarray, rows: np.ndarray, ends: np.ndarray):
        self.column, self.values, self.row_ends, self.ends = column, values, rows, ends
        h = np.diff(ends)
        widths = np.diff(rows)
        row = np.repeat(np.arange(len(widths)), widths)
        self.grid = np.repeat(np.arange(len(h)), h)[row]
        self.r = row - ends[self.grid]
        self.c = np.arange(len(values)) - rows[row]
        self.w = widths[row]
        self.h = h[self.grid]

    @classmethod
    def of(cls, column: pa.Array | pa.ChunkedArray) -> Cells:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(), 0)
        rows = column.flatten()
        widths = rows.value_lengths().fill_null(0).to_numpy()
        values = rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        return cls(column, values, np.r_[0, np.cumsum(widths)].astype(np.int64), np.r_[0, np.cumsum(lengths)].astype(np.int64))

    def neighbours(self, eight: bool, inside: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of cells beside each other (with ``eight``, over corners too) that are both inside and of one group."""
        i = np.arange(len(self.values))
        down, right = self.r + 1 < self.h, self.c + 1 < self.w
        steps = [(right, 1), (down, self.w)] + [(down & right, self.w + 1), (down & (self.c > 0), self.w - 1)] * eight
        one, other = [], []
        for good, step in steps:
            a = i[good & inside]
            b = a + (step if np.isscalar(step) else step[a])
            same = inside[b] & (group[a] == group[b])
            one.append(a[same])
            other.append(b[same])
        return np.concatenate(one), np.concatenate(other)

    def as_grids(self, values: np.ndarray) -> pa.Array:
        """Other values for the same cells."""
        rows = pa.ListArray.from_arrays(pa.array(self.row_ends.astype(np.int32)), pa.array(values.astype(np.int32)))
        return pa.ListArray.from_arrays(pa.array(self.ends.astype(np.int32)), rows, mask=pa.array(~self.column.is_valid().to_numpy(zero_copy_only=False)))


def connected(n: int, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component."""
    root = np.arange(n)
    while len(one):
        a, b = root[one], root[other]
        apart = a != b
        if not apart.any():
            break
        one, other, a, b = one[apart], other[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            shorter = root[root]
            if np.array_equal(shorter, root):
                break
            root = shorter
    return root


def _holes(cells: Cells, label: np.ndarray, n: int) -> np.ndarray:
    """Gaps of each object that sides don't connect with its outside, by Euler's formula: an object is one piece, so its holes
    are 1 less its windows of 2 x 2 cells with one of it, more those with three, more twice those with two over a corner, all / 4."""
    w = cells.w
    at = np.arange(len(label))
    out = np.zeros(n + 1, np.int64)

    def part(dr: int, dc: int, r: int, c: int) -> np.ndarray:
        """Labels at window corner (dr, dc), seen from the cell that is at corner (r, c) of it."""
        y, x = cells.r + dr - r, cells.c + dc - c
        good = (y >= 0) & (x >= 0) & (y < cells.h) & (x < w)
        return np.where(good, label[np.where(good, at + (dr - r) * w + dc - c, 0)], 0) if len(label) else label

    for r in (0, 1):
        for c in (0, 1):  # every window, from each of its cells that is in an object
            corners = [part(dr, dc, r, c) == label for dr in (0, 1) for dc in (0, 1)]
            count = np.sum(corners, 0)
            across = (corners[0] & corners[3] & ~corners[1] & ~corners[2]) | (corners[1] & corners[2] & ~corners[0] & ~corners[3])
            # Each window is met once from each of its ``count`` cells: weights add up to 12 / 12.
            score = np.where(count == 1, 12, np.where(count == 3, -4, np.where(across, -12, 0)))
            out += np.bincount(label, score, minlength=n + 1).astype(np.int64)
    return (1 - out // 48)[1:]


def objects(column: pa.Array, seg: str) -> tuple[pa.Array, pa.Array]:
    """Of each grid: labels in object order (top row, left column, size, then colour and reading order), each object's holes."""
    many, eight = seg[0] == "m", seg[-1] == "8"
    cells = Cells.of(column)
    inside = cells.values != 0
    group = np.where(inside, 0 if many else cells.values, -1)
    root = connected(len(inside), *cells.neighbours(eight, inside, group))
    first, which = np.unique(root[inside], return_inverse=True)
    n = len(first)
    top, left = np.full(n, 1 << 30), np.full(n, 1 << 30)
    np.minimum.at(top, which, cells.r[inside])
    np.minimum.at(left, which, cells.c[inside])
    grid = cells.grid[first]
    order = np.lexsort((first, group[first], np.bincount(which, minlength=n), left, top, grid))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)  # over the whole batch
    label = np.zeros(len(inside), np.int64)
    label[inside] = place[which] + 1
    counts = np.bincount(grid, minlength=len(cells.ends) - 1)
    ends = np.r_[0, np.cumsum(counts)]
    holes = _holes(cells, label, n)
    own = np.where(inside, label - ends[:-1][cells.grid], 0) if n else label
    nulls = pa.array(~cells.column.is_valid().to_numpy(zero_copy_only=False))
    return cells.as_grids(own), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(holes.astype(np.int32)), mask=nulls)


def region_labels(column: pa.Array, values: list[int]) -> pa.Array:
    """Of each grid: labels, in reading order, of the 4-connected regions of cells whose value is among ``values``."""
    cells = Cells.of(column)
    inside = np.isin(cells.values, values)
    root = connected(len(inside), *cells.neighbours(False, inside, np.zeros(len(inside), np.int8)))
    first, which = np.unique(root[inside], return_inverse=True)
    ends = np.r_[0, np.cumsum(np.bincount(cells.grid[first], minlength=len(cells.ends) - 1))]
    label = np.zeros(len(inside), np.int64)
    label[inside] = which + 1 - ends[:-1][cells.grid[inside]]
    return cells.as_grids(label)


def labelled(grid: Column, seg: str) -> Column:
    """Struct lab (a grid of object numbers, 0: none), holes (of each object) of the segmentation c4, c8, m4 or m8."""

    @F.arrow_udf("lab array<array<int>>, holes array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for grids in batches:
            yield pa.StructArray.from_arrays(list(objects(grids, seg)), names=["lab", "holes"])

    return run.asNondeterministic()(grid)


def regions(grid: Column, values: list[int]) -> Column:
    """Labels of the 4-connected regions of cells whose value is among ``values`` (they count as alike)."""

    @F.arrow_udf("array<array<int>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for grids in batches:
            yield region_labels(grids, values)

    return run.asNondeterministic()(grid)
