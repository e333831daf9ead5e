"""Arrows that follow markers, for whole Arrow batches at once.

A panel has a background and one other colour: an arrow and the markers of its path.  The arrow is mirrored along its
heading, and one cell wide at its tip only.  Its tip goes to the nearest marker ahead; with none ahead it turns, if there
are markers on one side only.  The result is the arrow alone, as it stands when every marker is used up; a panel whose
arrow can't use them all, or would leave the panel, has none.

Markers may touch the arrow, so up to ``LOOSE`` cells of a component may be markers; the largest arrow that reaches the
end counts, and if arrows of that size end differently there is no result.

Candidates (a component less some of its cells) are rows of arrays ``WIDE`` cells wide.  All of a batch's walk together, a
marker at a time, ``PART`` of them at once, which bounds memory; every walk uses up a marker in each step, so it ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessel.functions.labels import Cells, connected

# Cells of a panel's other colour, cells of an arrow's component, such components, markers among an arrow's component.
CELLS = (4, 60)
ARROW = (3, 12)
ARROWS = (1, 3)
LOOSE = 2
WIDE = ARROW[1]
PART = 1 << 14
_NONE = 1 << 14  # sorts behind every cell r * 32 + c


@dataclass
class Grounds:
    """Background of each panel of a batch, and which panels have one other colour."""

    back: np.ndarray
    front: np.ndarray
    two: np.ndarray

    @classmethod
    def of(cls, cells: Cells) -> Grounds:
        n = len(cells.ends) - 1
        kinds, kind = np.unique(cells.grid * 64 + cells.values, return_inverse=True)
        edge = np.bincount(kind, (cells.r == 0) * 1 + (cells.r == cells.h - 1) + (cells.c == 0) + (cells.c == cells.w - 1), minlength=len(kinds))
        first = np.full(len(kinds), len(kind))
        np.minimum.at(first, kind, np.arange(len(kind)))
        grid = kinds // 64
        order = np.lexsort((first, -np.bincount(kind, minlength=len(kinds)), -edge, grid))
        rank = np.arange(len(kinds)) - np.searchsorted(grid, grid)  # ``kinds`` is sorted by panel, and so is ``order``
        back, front = np.full(n, -1), np.full(n, -1)
        back[grid[rank == 0]] = (kinds % 64)[order[rank == 0]]
        front[grid[rank == 1]] = (kinds % 64)[order[rank == 1]]
        return cls(back, front, np.bincount(grid, minlength=n) == 2)


def ranks(group: np.ndarray) -> np.ndarray:
    """The place of each element within its group; groups are in order."""
    return np.arange(len(group)) - np.searchsorted(group, group)


def joined(r: np.ndarray, c: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Are the held cells of each row one piece, corners included?"""
    beside = (abs(r[:, :, None] - r[:, None]) <= 1) & (abs(c[:, :, None] - c[:, None]) <= 1) & held[:, :, None] & held[:, None]
    reached = held & (np.cumsum(held, 1) == 1)
    for _ in range(WIDE - 1):
        reached |= (beside & reached[:, None]).any(2)
    return (reached == held).all(1)


def pointed(along: np.ndarray, across: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which way (-1, 1; 0: neither) the held cells of each row point, and which cell is the tip."""
    least, most = np.where(held, along, _NONE).min(1, keepdims=True), np.where(held, along, -_NONE).max(1, keepdims=True)
    low, high = np.where(held, across, _NONE).min(1, keepdims=True), np.where(held, across, -_NONE).max(1, keepdims=True)
    keys = lambda x: np.sort(np.where(held, along * 32 + x, _NONE), 1)
    mirrored = (keys(across) == keys(low + high - across)).all(1)
    at_least, at_most = held & (along == least), held & (along == most)
    a, b = at_least.sum(1), at_most.sum(1)
    way = np.where(mirrored & (a == 1) & (b > 1), -1, np.where(mirrored & (b == 1) & (a > 1), 1, 0))
    return way, np.where(way < 0, at_least.argmax(1), at_most.argmax(1))


def walked(tip: np.ndarray, heading: np.ndarray, marks: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each tip ends, how often it has turned by a quarter, and whether it has used up its markers (``left`` of ``marks``)."""
    tip, heading, left = tip.copy(), heading.copy(), left.copy()
    turns = np.zeros(len(tip), int)
    going = np.flatnonzero(left.any(1))
    while len(going):
        d, h, open_ = marks[going] - tip[going, None], heading[going, None], left[going]
        ahead = (d * h).sum(2)
        aside = d[:, :, 1] * h[:, :, 0] - d[:, :, 0] * h[:, :, 1]
        ways = np.stack([open_ & (aside == 0) & (ahead > 0), open_ & (ahead == 0) & (aside > 0), open_ & (ahead == 0) & (aside < 0)], 1)
        seen = ways.any(2)
        # Straight on, or towards the one side that has markers.
        way = np.where(seen[:, 0], 0, np.where(seen[:, 1], 1, 2))
        moves = seen[:, 0] | (seen[:, 1] != seen[:, 2])
        going, way, distance = going[moves], way[moves], np.where(ways, (abs(ahead) + abs(aside))[:, None], _NONE)[moves]
        nearest = distance[np.arange(len(way)), way].argmin(1)
        tip[going] = marks[going, nearest]
        left[going, nearest] = False
        quarter = np.array([0, 1, 3])[way]
        turns[going] += quarter
        heading[going] = turned(heading[going], quarter)
        going = going[left[going].any(1)]
    return tip, turns % 4, ~left.any(1)


def turned(points: np.ndarray, quarters: np.ndarray) -> np.ndarray:
    """Points (.., 2) turned by quarters about the origin, each row by its own number."""
    table = np.array([[[1, 0], [0, 1]], [[0, 1], [-1, 0]], [[-1, 0], [0, -1]], [[0, -1], [1, 0]]])
    return np.einsum("n...i,nij->n...j", points, table[quarters % 4])


def choices(size: int) -> np.ndarray:
    """Every way to keep all but up to ``LOOSE`` of so many cells, as rows of truth values."""
    out = [[i not in gone for i in range(size)] for k in range(LOOSE + 1) if size - k >= ARROW[0] for gone in combinations(range(size), k)]
    return np.array(out, bool)


def ends(body: np.ndarray, held: np.ndarray, marks: np.ndarray, left: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted cells of each candidate's arrow at the end of its path, and whether it gets there.

    ``body`` (n, WIDE, 2) with ``held`` cells, ``marks`` (n, m, 2) with ``left`` ones, the panel's ``shape`` (n, 2).
    """
    way_c, tip_c = pointed(body[:, :, 1], body[:, :, 0], held)
    way_r, tip_r = pointed(body[:, :, 0], body[:, :, 1], held)
    good = ((way_c != 0) != (way_r != 0)) & left.any(1)
    good[good] = joined(body[good, :, 0], body[good, :, 1], held[good])
    cells = np.full(held.shape, _NONE)
    k = np.flatnonzero(good)
    tip = body[k, np.where(way_c[k] != 0, tip_c[k], tip_r[k])]
    at, quarters, arrived = walked(tip, np.stack([way_r[k], way_c[k]], 1), marks[k], left[k])
    final = turned(body[k] - tip[:, None], quarters) + at[:, None]
    inside = ((final >= 0) & (final < shape[k, None])).all(2) | ~held[k]
    arrived &= inside.all(1)
    cells[k] = np.sort(np.where(held[k], final[:, :, 0] * 32 + final[:, :, 1], _NONE), 1)
    good[k] = arrived
    return cells, good


def followed(panels: pa.Array) -> pa.Array:
    """Of each panel (a list of rows) its result, null without any."""
    cells = Cells.of(panels)
    n, ground = len(panels), Grounds.of(cells)
    fore = np.flatnonzero(ground.two[cells.grid] & (cells.values == ground.front[cells.grid]))
    total = np.bincount(cells.grid[fore], minlength=n)
    fore = fore[((total >= CELLS[0]) & (total <= CELLS[1]))[cells.grid[fore]]]
    inside = np.zeros(len(cells.values), bool)
    inside[fore] = True
    root = connected(len(inside), *cells.neighbours(True, inside, np.zeros(len(inside), np.int8)))[fore]
    point = np.stack([cells.r, cells.c], 1)

    # Foreground of each panel, as wide rows.
    marked, row = np.unique(cells.grid[fore], return_inverse=True)
    marks, there, part = np.zeros((len(marked), CELLS[1], 2), int), np.zeros((len(marked), CELLS[1]), bool), np.full((len(marked), CELLS[1]), -1)
    place = ranks(row)
    marks[row, place], there[row, place], part[row, place] = point[fore], True, root

    shape = np.stack([cells.h, cells.w], 1)[cells.row_ends[cells.ends[marked]]]
    names, body_of, size = np.unique(root, return_inverse=True, return_counts=True)
    fits = (size >= ARROW[0]) & (size <= ARROW[1])
    owner = np.searchsorted(marked, cells.grid[names])
    several = np.bincount(owner[fits], minlength=len(marked))
    fits &= ((several >= ARROWS[0]) & (several <= ARROWS[1]))[owner]
    order = np.argsort(body_of, kind="stable")
    starts = np.r_[0, np.cumsum(size)]

    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for s in range(ARROW[0], ARROW[1] + 1):
        bodies, kept = np.flatnonzero(fits & (size == s)), choices(s)
        for at in range(0, len(bodies), max(1, PART // len(kept))):
            own = bodies[at : at + max(1, PART // len(kept))]
            held = np.zeros((len(own) * len(kept), WIDE), bool)
            held[:, :s] = np.tile(kept, (len(own), 1))
            body = np.zeros((len(own), WIDE, 2), int)
            body[:, :s] = point[fore[order[starts[own][:, None] + np.arange(s)]]]
            body, home = np.repeat(body, len(kept), 0), np.repeat(owner[own], len(kept))
            loose = np.zeros((len(own), len(kept), CELLS[1]), bool)  # markers among the component's own cells
            mine = part[owner[own]] == names[own][:, None]
            which, column = np.nonzero(mine)
            loose[which, :, column] = ~kept[:, ranks(which)].T
            left = (there[home] & ~np.repeat(mine, len(kept), 0)) | loose.reshape(-1, CELLS[1])
            cell, good = ends(body, held, marks[home], left, shape[home])
            found.append((home[good], held[good].sum(1), cell[good]))

    out, valid = ground.back[cells.grid], np.zeros(n, bool)
    if found:
        home, weight, cell = (np.concatenate(x) for x in zip(*found))
        most = np.zeros(len(marked), int)
        np.maximum.at(most, home, weight)
        best = weight == most[home]
        home, cell = home[best], cell[best]
        named, first, back = np.unique(home, return_index=True, return_inverse=True)
        alike = np.ones(len(named), bool)
        np.logical_and.at(alike, back, (cell == cell[first][back]).all(1))
        named, cell = named[alike], cell[first][alike]
        valid[marked[named]] = True
        which, column = np.nonzero(cell < _NONE)
        key, grid = cell[which, column], marked[named[which]]
        out[cells.row_ends[cells.ends[grid] + key // 32] + key % 32] = ground.front[grid]
    rows = pa.ListArray.from_arrays(pa.array(cells.row_ends.astype(np.int32)), pa.array(out.astype(np.int32)))
    return pa.ListArray.from_arrays(pa.array(cells.ends.astype(np.int32)), rows, mask=pa.array(~valid))


def following(panels: Column) -> Column:
    """Of an array of panels: each one's result, null for those without any."""

    @F.arrow_udf("array<array<array<int>>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            batch = batch.combine_chunks() if isinstance(batch, pa.ChunkedArray) else batch
            none = ~batch.is_valid().to_numpy(zero_copy_only=False)
            counts = np.where(none, 0, batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            yield pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), followed(batch.flatten()), mask=pa.array(none))

    return run.asNondeterministic()(panels)
