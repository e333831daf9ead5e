"""Placed grids: valid, the same for the same seed, and each kind with what it promises."""

import numpy as np
import pytest

from tessel.sources import placements
from tessel.sources.generators import generate


@pytest.mark.parametrize("name", sorted(placements.KINDS))
def test_kind(name):
    grids = [placements.KINDS[name](placements.Draw(seed, name)) for seed in range(60)]
    again = [placements.KINDS[name](placements.Draw(seed, name)) for seed in range(60)]
    assert all(np.array_equal(a, b) for a, b in zip(grids, again))
    assert all(1 <= n <= 30 for g in grids for n in g.shape) and all(set(np.unique(g)) <= {0, 1, 2, 3} for g in grids)
    assert len({g.tobytes() for g in grids}) > 30
    if name == "lined":
        assert all((g == 1).all(0).any() or (g == 1).all(1).any() for g in grids)
    if name == "attract":
        assert all(any((side == 2).all() for side in (g[0], g[-1], g[:, 0], g[:, -1])) for g in grids)
    if name == "symmask":
        assert all((((g == g[:, ::-1]) | (g == 0) | (g[:, ::-1] == 0))).all() for g in grids)
    if name == "corners":
        assert all((g == v).sum() in (0, 2) for g in grids for v in (1, 2, 3))
    if name == "prefixrows":
        for row in (row for g in grids for row in g if row.any()):
            n = np.flatnonzero(row)[-1] + 1
            assert n < len(row) and any(n > 2 * k and (row[k:n] == row[: n - k]).all() for k in (1, 2, 3))
    if name == "rings":
        assert sum(bool((g == 0).any() and g.any()) for g in grids) == len(grids)
    if name == "template":
        assert all(np.isin(g, (1, 2)).sum() >= 3 for g in grids)
    if name == "tiledx":
        for g in grids:
            whole = [(y, x) for y in range(1, g.shape[0] + 1) for x in range(1, g.shape[1] + 1) if g.shape[0] % y == 0 and g.shape[1] % x == 0]
            assert any(all(len(set(g[r::y, c::x].ravel()) - {0}) == 1 for r in range(y) for c in range(x)) for y, x in whole)


def test_things_keep_their_distance():
    for seed in range(40):
        d = placements.Draw(seed, "put")
        for v in (1, 2, 3):
            d.put(np.full((2, 2), v))
        for r, c in np.argwhere(d.grid):
            near = d.grid[max(0, r - 1) : r + 2, max(0, c - 1) : c + 2]
            assert set(np.unique(near)) <= {0, d.grid[r, c]}


def test_generated_rows(spark):
    rows = generate(spark.range(30).withColumnRenamed("id", "gid"), "containers").collect()
    assert len(rows) == 30 and all(r["err"] is None and len(r["g"]) == r["h"] and len(r["g"][0]) == r["w"] for r in rows)
