"""Features of every ordered pair of a grid's colour layers, background included."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.grids import Frame, cells
from tessel.functions.labels import Cells, connected

COLORS = 10


def distances(column: pa.Array) -> np.ndarray:
    """(grids, 10, 10): the least Manhattan distance between two colours' cells in each grid; 999 where one is absent.

    A colour's distance map comes from running minima down, up, right and left, for all grids of the batch at once.
    """
    at = Cells.of(column)
    n, h, w = len(at.ends) - 1, int(at.h.max(initial=0)), int(at.w.max(initial=0))
    full = np.full((n, h, w), -1)
    full[at.grid, at.r, at.c] = at.values
    out = np.full((n, COLORS, COLORS), 999)
    for v in range(COLORS):
        way = np.where(full == v, 0, 999)
        for axis in (1, 2):
            for flip in (False, True):
                seen = np.flip(way, axis) if flip else way
                steps = np.arange(seen.shape[axis]).reshape([-1 if a == axis else 1 for a in range(3)])
                seen = np.minimum.accumulate(seen - steps, axis) + steps
                way = np.flip(seen, axis) if flip else seen
        for u in range(COLORS):
            out[:, v, u] = np.where(full == u, way, 999).reshape(n, -1).min(1, initial=999)
    return np.minimum(out, 999)


def components(column: pa.Array) -> np.ndarray:
    """(grids, 10): how many 4-connected pieces each colour has."""
    at = Cells.of(column)
    inside = np.ones(len(at.values), bool)
    root = connected(len(inside), *at.neighbours(False, inside, at.values))
    own = root == np.arange(len(root))
    out = np.zeros((len(at.ends) - 1, COLORS), np.int64)
    np.add.at(out, (at.grid[own], at.values[own]), 1)
    return out


def _measured(grid: Column) -> Column:
    """Struct far (10 x 10 distances, row by row), pieces (10)."""

    @F.arrow_udf("far array<int>, pieces array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for grids in batches:
            far, pieces = distances(grids), components(grids)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1).astype(np.int32)), x[0].size if len(x) else 1).cast(pa.list_(pa.int32())) for x in (far, pieces)]
            yield pa.StructArray.from_arrays(lists, names=["far", "pieces"])

    return run.asNondeterministic()(grid)


#: A crop's eight turns: where cell (r, c) of an h x w crop goes.
_TURNS = [lambda r, c, h, w: (r, c), lambda r, c, h, w: (r, w - 1 - c), lambda r, c, h, w: (h - 1 - r, c), lambda r, c, h, w: (h - 1 - r, w - 1 - c), lambda r, c, h, w: (c, r), lambda r, c, h, w: (c, h - 1 - r), lambda r, c, h, w: (w - 1 - c, r), lambda r, c, h, w: (w - 1 - c, h - 1 - r)]


def edges(grids: DataFrame) -> DataFrame:
    """(gid, a, b and 17 features) for every ordered pair of colours that a grid has, a colour with itself too.

    Boxes: iou, a_in_b, b_in_a, overlap_r, overlap_c, above, below, left, right.  Cells: touching (a side in common),
    nearness (1 / (1 + least Manhattan distance)), same_shape (up to the eight turns), same_area, area_ratio, same_row and
    same_column (centres less than half a cell apart), pieces_ratio.
    """
    f = Frame(grids.where("g IS NOT NULL"))
    measured = f.let(_measured(f.g))
    everything = f.let(cells(f.g))
    colors = f.let(F.array_sort(F.array_distinct(F.flatten(f.g))))

    def node(v: Column) -> Column:
        own = F.filter(everything, lambda x: x["v"] == v)
        row, column = F.transform(own, lambda x: x["r"]), F.transform(own, lambda x: x["c"])
        return F.struct(v.alias("v"), own.alias("cells"), F.size(own).alias("area"), F.array_min(row).alias("r0"), F.array_max(row).alias("r1"), F.array_min(column).alias("c0"), F.array_max(column).alias("c1"), F.get(measured["pieces"], v).alias("pieces"))

    nodes = f.let(F.transform(colors, node))

    def shape(x: Column) -> Column:
        h, w = x["r1"] - x["r0"] + 1, x["c1"] - x["c0"] + 1

        def turned(turn) -> Column:
            placed = F.transform(x["cells"], lambda y: (lambda p: p[0] * 32 + p[1])(turn(y["r"] - x["r0"], y["c"] - x["c0"], h, w)))
            return F.array_join(F.array_sort(placed).cast("array<string>"), ",")

        return F.array_min(F.array(*[turned(t) for t in _TURNS]))

    mean = lambda x, name: F.aggregate(x["cells"], F.lit(0), lambda n, y: n + y[name]) / x["area"]
    known = f.let(F.transform(nodes, lambda x: x.withField("shape", shape(x)).withField("r", mean(x, "r")).withField("c", mean(x, "c")).dropFields("cells")))
    rows = f.df.select("gid", F.explode(known).alias("a"), known.alias("_all"), measured["far"].alias("_far")).select("gid", "a", F.explode("_all").alias("b"), "_far")
    a, b = F.col("a"), F.col("b")
    inter = lambda lo, hi: F.greatest(F.lit(0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]) + 1)
    box = lambda x: (x["r1"] - x["r0"] + 1) * (x["c1"] - x["c0"] + 1)
    both = inter("r0", "r1") * inter("c0", "c1")
    within = lambda x, y: (y["r0"] <= x["r0"]) & (x["r1"] <= y["r1"]) & (y["c0"] <= x["c0"]) & (x["c1"] <= y["c1"])
    overlap = lambda lo, hi: inter(lo, hi) / (F.greatest(a[hi], b[hi]) - F.least(a[lo], b[lo]) + 1)
    far = F.get("_far", a["v"] * COLORS + b["v"])
    alone = (a["v"] == b["v"]) & (a["pieces"] == a["area"])  # single cells touch nothing of their own colour
    features = {
        "iou": both / (box(a) + box(b) - both), "touching": F.when(a["v"] == b["v"], ~alone).otherwise(far == 1), "nearness": 1 / (1 + far), "a_in_b": within(a, b), "b_in_a": within(b, a), "same_shape": a["shape"] == b["shape"], "same_area": a["area"] == b["area"],
        "overlap_r": overlap("r0", "r1"), "overlap_c": overlap("c0", "c1"), "same_row": F.abs(a["r"] - b["r"]) < 0.5, "same_column": F.abs(a["c"] - b["c"]) < 0.5, "above": a["r1"] < b["r0"], "below": a["r0"] > b["r1"], "left": a["c1"] < b["c0"], "right": a["c0"] > b["c1"],
        "area_ratio": F.least(a["area"], b["area"]) / F.greatest(a["area"], b["area"]), "pieces_ratio": F.least(a["pieces"], b["pieces"]) / F.greatest(F.lit(1), a["pieces"], b["pieces"]),
    }
    return rows.select("gid", a["v"].alias("a"), b["v"].alias("b"), *[x.alias(name) for name, x in features.items()])
