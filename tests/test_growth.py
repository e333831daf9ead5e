"""What kept queries from ending on larger tables: work done again for every use, and lines handed over one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.operators import panels, steps
from tessel.sources.grids import from_lineitem

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("orders", [16, 4])
def test_grids_are_added_up_as_bits(spark, orders):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").collect()
    want = {}
    for x in lines:
        g = want.setdefault(x.l_orderkey // orders, np.zeros((12, 12), int))
        at = x.l_partkey % 12, int(x.l_quantity) % 12
        g[at] = max(g[at], 1 + x.l_linenumber % 3)
    grids = from_lineitem(spark, SF, orders)
    assert {r.gid: r.g for r in grids.collect()} == {k: g.tolist() for k, g in want.items()}
    assert "collect_list" not in grids._jdf.queryExecution().executedPlan().toString()


def test_panel_programs_read_their_pairs_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("array<array<int>>")
    def counted(g):
        read.add(1)
        return g

    rows = [(k, [[k % 2, 0, 0, 1], [1, 1, 0, 1]], [[0, 0], [0, 8 * 1]]) for k in range(5)]
    pairs = spark.createDataFrame(rows, "task_id long, g array<array<int>>, wanted array<array<int>>")
    found = panels.fitted(pairs.withColumn("g", counted.asNondeterministic()("g"))).collect()
    assert read.value == 5 and {r.task_id for r in found} == set(range(5))


def test_separators_are_whole_lines(spark):
    pair = [(1, [[1, 2, 5, 5, 2, 0]], [[2, 2]]), (2, [[1, 2], [3, 3], [3, 3], [0, 1]], [[1, 1]]), (3, [[1, 2, 3]], [[1]])]
    frame = spark.createDataFrame(pair, "task_id long, g array<array<int>>, wanted array<array<int>>")
    cut = frame.select("task_id", F.explode(panels._partitions(F.col("g"), F.col("wanted"))).alias("p")).select("task_id", "p.*").collect()
    assert {(r.task_id, r.split, r.axis, r["count"], r.color, tuple(r.starts), r.size) for r in cut} == {
        (1, "separator", 1, 2, 5, (0, 4), 2), (1, "equal", 1, 3, -1, (0, 2, 4), 2), (2, "equal", 0, 4, -1, (0, 1, 2, 3), 1), (2, "separator", 0, 2, 3, (0, 3), 1), (3, "equal", 1, 3, -1, (0, 1, 2), 1), (3, "separator", 1, 2, 2, (0, 2), 1),
    }


def plain_boxes(grid, bg, parts, ring):
    out, seen = [[*row] for row in grid], [v for row in grid for v in row]
    for part in sorted(parts, key=lambda p: (seen.index(grid[p[0][0]][p[0][1]]), p[0])):
        own = grid[part[0][0]][part[0][1]]
        rows, columns = [r for r, _ in part], [c for _, c in part]
        box = [(r, c) for r in range(min(rows), max(rows) + 1) for c in range(min(columns), max(columns) + 1)]
        box = [(r, c) for r, c in box if not ring or r in (min(rows), max(rows)) or c in (min(columns), max(columns))]
        if any(out[r][c] not in (bg, own) for r, c in box):
            return None
        for r, c in part:
            out[r][c] = bg
        for r, c in box:
            out[r][c] = own
    return out


@pytest.mark.parametrize("ring", [False, True])
def test_boxes_against_a_plain_version(ring):
    from tessel.functions.labels import flood

    rng, refused = np.random.default_rng(4), 0
    for _ in range(500):
        grid = rng.choice([0, 1, 2], tuple(rng.integers(1, 9, 2)), p=[0.7, 0.2, 0.1])
        parts = flood(np.where(grid > 0, grid, -1).tolist(), False)[1]
        got = steps.boxed(grid, 0, [np.array([r * 32 + c for r, c in p]) for p in parts], ring)
        assert got == plain_boxes(grid.tolist(), 0, parts, ring)
        refused += got is None
    assert 0 < refused < 500
