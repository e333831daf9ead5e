"""Relation operators that need no objects: colours, mirror images, periods and rectangles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.grids import MAX_SIZE, Frame, at, cells
from tessel.operators.base import operator
from tessel.operators.geometry import SOURCES
from tessel.operators.lines import DOWN, LEFT, RIGHT, UP, looking

AROUND_4 = [UP, DOWN, LEFT, RIGHT]
AROUND_8 = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]


def neighbours(f: Frame, r: Column, c: Column, offsets: list[tuple[int, int]], outside: int = -1) -> Column:
    return F.array(*[F.coalesce(f.at(r + dy, c + dx), F.lit(outside)) for dy, dx in offsets])


@operator("relation")
def connect_to_target(f: Frame, mover: int, target: int) -> DataFrame:
    def cell(r: Column, c: Column, v: Column) -> Column:
        hit = F.lit(False)
        for dy, dx in AROUND_4:
            ahead, behind = looking(f, r, c, dy, dx), looking(f, r, c, -dy, -dx)
            hit = hit | F.coalesce((ahead["v"] == target) & (behind["v"] == mover), F.lit(False))
        return F.when((v == 0) & hit, mover).otherwise(v)

    return f.same(cell)


@operator("relation")
def react_touching(f: Frame, a: int, b: int, color: int) -> DataFrame:
    touches = lambda r, c, k: F.array_contains(neighbours(f, r, c, AROUND_8), k)
    f.fail(~F.exists(cells(f.g), lambda x: (x["v"] == a) & touches(x["r"], x["c"], b)), "no contact")
    return f.same(lambda r, c, v: F.when((v == a) & touches(r, c, b), color).when((v == b) & touches(r, c, a), 0).otherwise(v))


@operator("relation")
def recolor_mirrored(f: Frame, axis: int, color: int) -> DataFrame:
    name = ["flip_v", "flip_h", "rot180"][axis]
    return f.same(lambda r, c, v: F.when((v != 0) & (v == f.at(*SOURCES[name](r, c, f.h, f.w))), color).otherwise(v))


@operator("relation")
def mirror_over_line(f: Frame, line: int) -> DataFrame:
    full = lambda x: F.forall(x, lambda v: v == line)
    rows = f.let(F.filter(F.transform(f.g, lambda row, i: F.when(full(row), i)), lambda i: i.isNotNull()))
    column = lambda c: F.transform(f.g, lambda row: F.get(row, c))
    columns = f.let(F.filter(F.transform(F.get(f.g, F.lit(0)), lambda _, c: F.when(full(column(c)), c)), lambda i: i.isNotNull()))
    f.fail(F.size(rows) + F.size(columns) != 1, "need exactly one line")
    row, col = F.get(rows, F.lit(0)), F.get(columns, F.lit(0))
    image = lambda r, c: F.coalesce(F.when(row.isNotNull(), f.at(2 * row - r, c)).otherwise(f.at(r, 2 * col - c)), F.lit(0))
    return f.same(lambda r, c, v: F.when(v == 0, image(r, c)).otherwise(v))


@operator("relation")
def draw_rect_between(f: Frame, fill: bool, color: int) -> DataFrame:
    everything = f.let(cells(f.g))

    def pair(k: Column) -> Column:
        own = F.filter(everything, lambda x: x["v"] == k)
        row, column = F.transform(own, lambda x: x["r"]), F.transform(own, lambda x: x["c"])
        return F.when(F.size(own) == 2, F.struct(k.alias("k"), F.array_min(row).alias("r0"), F.array_max(row).alias("r1"), F.array_min(column).alias("c0"), F.array_max(column).alias("c1")))

    boxes = f.let(F.filter(F.transform(F.sequence(F.lit(1), F.lit(9)), pair), lambda b: b.isNotNull()))
    f.fail(F.size(boxes) == 0, "no pixel pair")

    def cell(r: Column, c: Column, v: Column) -> Column:
        def on(b: Column) -> Column:
            inside = (r >= b["r0"]) & (r <= b["r1"]) & (c >= b["c0"]) & (c <= b["c1"])
            return inside if fill else inside & ((r == b["r0"]) | (r == b["r1"]) | (c == b["c0"]) | (c == b["c1"]))

        last = F.array_max(F.transform(F.filter(boxes, on), lambda b: b["k"]))
        return F.when(v == 0, F.when(last.isNotNull(), last if color < 0 else F.lit(color)).otherwise(0)).otherwise(v)

    return f.same(cell)


@operator("relation")
def color_histogram(f: Frame, vertical: bool) -> DataFrame:
    ordered, tie = f.ranked()
    most = F.get(ordered, F.lit(0))["n"]
    f.fail(tie | (F.size(ordered) < 2) | (most > MAX_SIZE), "need distinct counts")
    bar = lambda i, k: F.when(k < F.get(ordered, i)["n"], F.get(ordered, i)["v"]).otherwise(0)
    if vertical:
        return f.out(most, F.size(ordered), lambda r, c: bar(c, most - 1 - r))
    return f.out(F.size(ordered), most, bar)


@operator("relation")
def repair_symmetry(f: Frame, mask: int, mode: str, crop: bool) -> DataFrame:
    names = {"h": ["flip_h"], "v": ["flip_v"], "both": ["flip_h", "flip_v", "rot180"], "rot": ["rot90", "rot180", "rot270"]}[mode]
    if mode == "rot":
        f.fail(f.h != f.w, "not square")
    box = f.box(lambda x: x["v"] == mask)
    partner = lambda r, c, n: F.nullif(f.at(*SOURCES[n](r, c, f.h, f.w)), F.lit(mask))
    grid = f.let(F.transform(f.g, lambda row, r: F.transform(row, lambda v, c: F.when(v == mask, F.coalesce(*[partner(r, c, n) for n in names], F.lit(mask))).otherwise(v))))
    f.fail(box["r0"].isNull() | F.exists(F.flatten(grid), lambda v: v == mask), "cannot repair")
    if crop:
        return f.out(box["r1"] - box["r0"] + 1, box["c1"] - box["c0"] + 1, lambda r, c: at(grid, box["r0"] + r, box["c0"] + c))
    return f.finish(f.h, f.w, grid)


@operator("relation")
def repair_tiling(f: Frame, mask: int, crop: bool) -> DataFrame:
    """The period of smallest area (at most half the grid; of equal areas the lower one) that all unmasked cells agree with and know whole."""
    box = f.box(lambda x: x["v"] == mask)
    known = f.let(F.filter(cells(f.g), lambda x: x["v"] != mask))
    f.fail(box["r0"].isNull() | (F.size(known) == 0), "no mask")
    sizes = F.flatten(F.transform(F.sequence(F.lit(1), f.h), lambda y: F.transform(F.sequence(F.lit(1), f.w), lambda x: F.struct((y * x).alias("area"), y.alias("y"), x.alias("x")))))

    def fits(s: Column) -> Column:
        place = lambda k: (k["r"] % s["y"]) * s["x"] + k["c"] % s["x"]
        seen = F.array_distinct(F.transform(known, lambda k: F.struct(place(k), k["v"])))
        places = F.array_distinct(F.transform(known, place))
        return (F.size(seen) == s["area"]) & (F.size(places) == s["area"])

    best = f.let(F.get(F.array_sort(F.filter(F.filter(sizes, lambda s: 2 * s["area"] <= f.h * f.w), fits)), F.lit(0)))
    f.fail(best.isNull(), "no period")
    value = lambda r, c: F.get(F.filter(known, lambda k: (k["r"] % best["y"] == r % best["y"]) & (k["c"] % best["x"] == c % best["x"])), F.lit(0))["v"]
    cell = lambda r, c: F.when(f.at(r, c) == mask, value(r, c)).otherwise(f.at(r, c))
    if crop:
        return f.out(box["r1"] - box["r0"] + 1, box["c1"] - box["c0"] + 1, lambda r, c: cell(box["r0"] + r, box["c0"] + c))
    return f.same(lambda r, c, v: cell(r, c))


@operator("relation")
def extend_periodic(f: Frame, axis: int) -> DataFrame:
    """Each line whose part up to its last foreground cell has a period (the smallest, at most half of it) goes on to the border."""
    lines = f.g if axis == 1 else f.let(F.transform(F.get(f.g, F.lit(0)), lambda _, c: F.transform(f.g, lambda row: F.get(row, c))))

    def continued(line: Column) -> Column:
        seen = F.coalesce(F.array_max(F.transform(line, lambda v, i: F.when(v != 0, i + 1))), F.lit(0))
        halves = F.filter(F.sequence(F.lit(1), F.size(line)), lambda p: 2 * p <= seen)
        agrees = lambda p: F.forall(F.transform(line, lambda v, i: (i >= seen) | (v == F.get(line, i % p))), lambda x: x)
        p = F.get(F.filter(halves, agrees), F.lit(0))
        return F.when(p.isNotNull() & (seen < F.size(line)), F.transform(line, lambda v, i: F.get(line, i % p))).otherwise(line)

    grid = f.let(F.transform(lines, continued))
    if axis == 0:
        grid = F.transform(F.get(grid, F.lit(0)), lambda _, r: F.transform(grid, lambda column: F.get(column, r)))
    return f.finish(f.h, f.w, grid)
