"""Arrows that follow markers, against a plain version that tries one candidate after another."""

from itertools import combinations

import numpy as np
import pyarrow as pa

from tessel.operators.paths import ranks, followed
from tessel.plans.steps import QUERIES

GRIDS = pa.list_(pa.list_(pa.int32()))


def pieces(points):
    left, out = set(points), []
    while left:
        grown, new = set(), {min(left)}
        while new:
            grown |= new
            new = {p for p in left - grown if any(max(abs(p[0] - q[0]), abs(p[1] - q[1])) == 1 for q in new)}
        left -= grown
        out.append(sorted(grown))
    return out


def arrow(points):
    """(heading, tip), None for what isn't an arrow."""
    found = []
    for heading in ((0, 1), (1, 0), (0, -1), (-1, 0)):
        along = lambda p: p[0] * heading[0] + p[1] * heading[1]  # noqa: E731, B023
        across = lambda p: p[0] * heading[1] + p[1] * heading[0]  # noqa: E731, B023
        far, near, middle = max(map(along, points)), min(map(along, points)), min(map(across, points)) + max(map(across, points))
        tips, tails = [p for p in points if along(p) == far], [p for p in points if along(p) == near]
        if len(tips) == 1 < len(tails) and {(along(p), across(p)) for p in points} == {(along(p), middle - across(p)) for p in points}:
            found.append((heading, tips[0]))
    return found[0] if len(found) == 1 else None


def plain(grid):
    """The cells that are drawn, None for a refused panel."""
    h, w = len(grid), len(grid[0])
    count = {}
    for r in range(h):
        for c in range(w):
            edge = (r == 0) + (r == h - 1) + (c == 0) + (c == w - 1)
            a, b, first = count.get(grid[r][c], (0, 0, -(r * w + c)))
            count[grid[r][c]] = (a + edge, b + 1, first)
    if len(count) != 2:
        return None
    back = max(count, key=count.get)
    front = {(r, c) for r in range(h) for c in range(w) if grid[r][c] != back}
    bodies = [p for p in pieces(front) if 3 <= len(p) <= 12]
    if not 4 <= len(front) <= 60 or not 1 <= len(bodies) <= 3:
        return None
    ends = {}
    for piece in bodies:
        for gone in range(3):
            for body in combinations(piece, len(piece) - gone):
                if len(body) >= 3 and len(pieces(body)) == 1 and arrow(body) and front - set(body):
                    (heading, tip), left, turns, start = arrow(body), front - set(body), 0, arrow(body)[1]
                    while left:
                        sights = {}
                        for k in range(4):
                            way = [heading, (-heading[1], heading[0]), (-heading[0], -heading[1]), (heading[1], -heading[0])][k]
                            line = [(tip[0] + way[0] * i, tip[1] + way[1] * i) for i in range(1, 30)]
                            sights[k] = next((p for p in line if p in left), None)
                        ways = [0] if sights[0] else [k for k in (1, 3) if sights[k]]
                        if len(ways) != 1:
                            break
                        tip = sights[ways[0]]
                        left = left - {tip}
                        for _ in range(ways[0]):
                            heading, turns = (-heading[1], heading[0]), turns + 1
                    if not left:
                        drawn = [(r - start[0], c - start[1]) for r, c in body]
                        for _ in range(turns):
                            drawn = [(-c, r) for r, c in drawn]
                        drawn = frozenset((r + tip[0], c + tip[1]) for r, c in drawn)
                        if all(0 <= r < h and 0 <= c < w for r, c in drawn):
                            ends.setdefault(len(body), set()).add(drawn)
    if not ends or len(ends[max(ends)]) != 1:
        return None
    (drawn,) = ends[max(ends)]
    colour = next(v for v in count if v != back)
    return [[colour if (r, c) in drawn else back for c in range(w)] for r in range(h)]


SHAPES = ["010 111", "00100 01110 11111", "010 111 010", "010 101", "1 1 1", "010 111 101", "11 11", "0110 1001"]


def drawn(rng):
    """A panel with an arrow, turned at random, and markers that lie on a path of it, beside it or anywhere."""
    h, w = rng.integers(6, 15, 2)
    g = np.zeros((h, w), int)
    shape = np.rot90(np.array([[int(v) for v in row] for row in SHAPES[rng.integers(len(SHAPES))].split()]), rng.integers(4))
    r, c = rng.integers(0, h - shape.shape[0] + 1) if h > shape.shape[0] else 0, rng.integers(0, w - shape.shape[1] + 1) if w > shape.shape[1] else 0
    g[r : r + shape.shape[0], c : c + shape.shape[1]] = shape[: h - r, : w - c]
    y, x = r + shape.shape[0] // 2, c + shape.shape[1] // 2
    for _ in range(rng.integers(0, 4)):
        if rng.random() < 0.5:
            y = rng.integers(h)
        else:
            x = rng.integers(w)
        g[y, x] = 1
    if rng.random() < 0.1:
        g[rng.integers(h), rng.integers(w)] = rng.integers(3)
    return (g * int(rng.integers(1, 4)) if rng.random() < 0.8 else 1 - np.minimum(g, 1)).tolist()


def test_against_one_candidate_after_another():
    rng = np.random.default_rng(5)
    panels = [drawn(rng) for _ in range(1500)]
    got = followed(pa.array(panels, GRIDS)).to_pylist()
    wanted = [plain(p) for p in panels]
    assert got == wanted
    assert 100 < sum(x is not None for x in wanted) < 1400


def test_odd_panels():
    assert followed(pa.array([], GRIDS)).to_pylist() == []
    assert followed(pa.array([None, [[1]], [[0, 0], [0, 0]], None], GRIDS)).to_pylist() == [None] * 4
    assert ranks(np.array([0, 0, 3, 3, 3])).tolist() == [0, 1, 0, 1, 2]


def test_query_moves_arrows(spark):
    rows = QUERIES["layer_follow_marker_path"](spark, "/root/testdata/sf0.001").groupBy("gid").pivot("v", [-1, 0, 2]).count().fillna(0).collect()
    ends = {(r["-1"], r["0"], r["2"]) for r in rows}
    assert ends == {(1, 0, 0), (0, 140, 4)}
