"""Labels of whole batches against a flood fill of one cell after another."""

import numpy as np
import pyarrow as pa
import pytest

from tessel.functions.labels import objects, region_labels

KIND = pa.list_(pa.list_(pa.int32()))


def flooded(same, eight):
    """Components of cells where ``same`` holds a value (not None), in reading order."""
    h, w, seen, out = len(same), len(same[0]), set(), []
    for start in [(r, c) for r in range(h) for c in range(w)]:
        if start in seen or same[start[0]][start[1]] is None:
            continue
        part = [start]
        seen.add(start)
        for r, c in part:
            for y in (-1, 0, 1):
                for x in (-1, 0, 1):
                    n = (r + y, c + x)
                    if (eight or not (y and x)) and n not in seen and 0 <= n[0] < h and 0 <= n[1] < w and same[n[0]][n[1]] == same[r][c]:
                        seen.add(n)
                        part.append(n)
        out.append(part)
    return out


def holes(part):
    r0, c0 = min(r for r, _ in part) - 1, min(c for _, c in part) - 1
    h, w = max(r for r, _ in part) - r0 + 2, max(c for _, c in part) - c0 + 2
    gaps = [[None if (r + r0, c + c0) in part else 0 for c in range(w)] for r in range(h)]
    return len(flooded(gaps, False)) - 1


def plain(grid, seg):
    many, eight = seg[0] == "m", seg[1] == "8"
    parts = flooded([[None if v == 0 else 0 if many else v for v in row] for row in grid], eight)
    parts.sort(key=lambda p: (min(r for r, _ in p), min(c for _, c in p), len(p), 0 if many else grid[p[0][0]][p[0][1]], p[0]))
    labels = [[0] * len(row) for row in grid]
    for n, part in enumerate(parts, 1):
        for r, c in part:
            labels[r][c] = n
    return labels, [holes(p) for p in parts]


def grids():
    rng = np.random.default_rng(0)
    out = [rng.choice([0, 1, 2], (rng.integers(1, 12), rng.integers(1, 12)), p=[0.4, 0.4, 0.2]).tolist() for _ in range(120)]
    return [*out, [[0]], [[3]], [[0, 0], [0, 0]], [[1] * 30 for _ in range(30)], [[(r + c) % 2 for c in range(9)] for r in range(9)]]


@pytest.mark.parametrize("seg", ["c4", "c8", "m4", "m8"])
def test_objects(seg):
    some = grids()
    labels, found = objects(pa.array([None, *some, None], KIND), seg)
    assert labels[0].as_py() is None and found[len(some) + 1].as_py() is None
    for i, grid in enumerate(some, 1):
        assert (labels[i].as_py(), found[i].as_py()) == plain(grid, seg)


def test_part_of_a_batch():
    some = grids()
    whole = pa.array(some, KIND)
    assert objects(whole.slice(50, 20), "c8")[0].to_pylist() == [plain(g, "c8")[0] for g in some[50:70]]
    assert objects(whole.slice(0, 0), "c8")[0].to_pylist() == []


def test_regions():
    some = grids()
    found = region_labels(pa.array([*some, None], KIND), [0, 2])
    for grid, got in zip(some, found.to_pylist()):
        parts = flooded([[0 if v in (0, 2) else None for v in row] for row in grid], False)
        wanted = [[0] * len(row) for row in grid]
        for n, part in enumerate(parts, 1):
            for r, c in part:
                wanted[r][c] = n
        assert got == wanted
    assert found[len(some)].as_py() is None
