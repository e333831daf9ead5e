"""Object operators: select objects of a segmentation and edit, move, count or crop them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.grids import Frame, at, bound, cells
from tessel.functions.labels import regions
from tessel.functions.selectors import Objects
from tessel.operators.base import operator
from tessel.operators.relations import AROUND_4, AROUND_8, neighbours


class Chosen(Objects):
    def __init__(self, f: Frame, sel: dict, seg: str):
        super().__init__(f, seg)
        self.chosen = self.select(sel)
        self.numbers = f.let(F.transform(self.chosen, lambda o: o["k"]))

    def here(self, r: Column, c: Column) -> Column:
        """Is a chosen object's cell here?"""
        return F.array_contains(self.numbers, self.label(r, c))

    def last(self, test) -> Column:
        """The last chosen object, in object order, that passes."""
        found = F.filter(self.chosen, test)
        return F.get(found, F.size(found) - 1)


@operator("object")
def recolor_objects(f: Frame, sel: dict, seg: str, color: int) -> DataFrame:
    o = Chosen(f, sel, seg)
    return f.same(lambda r, c, v: F.when(o.here(r, c), color).otherwise(v))


@operator("object")
def recolor_split(f: Frame, sel: dict, seg: str, yes: int, no: int) -> DataFrame:
    o = Chosen(f, sel, seg)
    return f.same(lambda r, c, v: F.when(o.here(r, c), yes).when(o.label(r, c) > 0, no).otherwise(v))


@operator("object")
def delete_objects(f: Frame, sel: dict, seg: str) -> DataFrame:
    o = Chosen(f, sel, seg)
    return f.same(lambda r, c, v: F.when(o.here(r, c), 0).otherwise(v))


@operator("object")
def keep_objects(f: Frame, sel: dict, seg: str) -> DataFrame:
    o = Chosen(f, sel, seg)
    return f.same(lambda r, c, v: F.when(o.here(r, c), v).otherwise(0))


@operator("object")
def recolor_by_size_rank(f: Frame, colors: list[int], seg: str) -> DataFrame:
    o = Objects(f, seg)
    sizes = f.let(F.reverse(F.array_sort(F.array_distinct(o.of("size")))))
    to = F.array(*map(F.lit, colors))
    ranked = lambda k: F.get(to, (F.array_position(sizes, o.get(k)["size"]) - 1).cast("int"))
    return f.same(lambda r, c, v: F.when(o.label(r, c) > 0, F.coalesce(ranked(o.label(r, c)), v)).otherwise(v))


@operator("object")
def recolor_by_holes(f: Frame, colors: list[int], seg: str) -> DataFrame:
    o = Objects(f, seg)
    to = F.array(*map(F.lit, colors))
    return f.same(lambda r, c, v: F.when(o.label(r, c) > 0, F.get(to, F.least(o.get(o.label(r, c))["holes"], F.lit(2)))).otherwise(v))


@operator("object")
def move_objects(f: Frame, sel: dict, seg: str, dy: int, dx: int) -> DataFrame:
    o = Chosen(f, sel, seg)
    f.fail(F.exists(o.chosen, lambda x: (x["r0"] + dy < 0) | (x["c0"] + dx < 0) | (x["r1"] + dy >= f.h) | (x["c1"] + dx >= f.w)), "off the grid")
    return f.same(lambda r, c, v: F.when(o.here(r - dy, c - dx), f.at(r - dy, c - dx)).when(o.here(r, c), 0).otherwise(v))


@operator("object")
def copy_objects(f: Frame, sel: dict, seg: str, dy: int, dx: int) -> DataFrame:
    o = Chosen(f, sel, seg)
    return f.same(lambda r, c, v: F.when(o.here(r - dy, c - dx), f.at(r - dy, c - dx)).otherwise(v))


def _in_place(f: Frame, o: Chosen, source) -> DataFrame:
    """Each chosen object redrawn in its own box from where ``source`` says; the last one drawn shows."""

    def cell(r: Column, c: Column, v: Column) -> Column:
        def shows(x: Column) -> Column:
            inside = (r >= x["r0"]) & (r <= x["r1"]) & (c >= x["c0"]) & (c <= x["c1"])
            return inside & (o.label(*source(x, r, c)) == x["k"])

        top = o.last(shows)
        return F.when(top.isNotNull(), f.at(*source(top, r, c))).when(o.here(r, c), 0).otherwise(v)

    return f.same(cell)


@operator("object")
def flip_objects(f: Frame, sel: dict, seg: str, axis: int) -> DataFrame:
    return _in_place(f, Chosen(f, sel, seg), lambda x, r, c: (x["r0"] + x["r1"] - r, c) if axis == 0 else (r, x["c0"] + x["c1"] - c))


@operator("object")
def rotate_objects(f: Frame, sel: dict, seg: str, k: int) -> DataFrame:
    o = Chosen(f, sel, seg)
    o.chosen = f.let(F.filter(o.chosen, lambda x: x["h"] == x["w"]))
    o.numbers = f.let(F.transform(o.chosen, lambda x: x["k"]))
    ways = {
        0: lambda x, r, c: (r, c),
        1: lambda x, r, c: (x["r0"] + c - x["c0"], x["c1"] - (r - x["r0"])),
        2: lambda x, r, c: (x["r0"] + x["r1"] - r, x["c0"] + x["c1"] - c),
        3: lambda x, r, c: (x["r1"] - (c - x["c0"]), x["c0"] + r - x["r0"]),
    }
    return _in_place(f, o, ways[k % 4])


@operator("object")
def outline_objects(f: Frame, sel: dict, seg: str, color: int) -> DataFrame:
    o = Chosen(f, sel, seg)

    def cell(r: Column, c: Column, v: Column) -> Column:
        near = F.filter(F.array(*[o.label(r + dy, c + dx) for dy, dx in AROUND_8]), lambda k: F.array_contains(o.numbers, k))
        last = F.array_max(near)
        return F.when((v == 0) & last.isNotNull(), o.get(last)["color"] if color < 0 else F.lit(color)).otherwise(v)

    return f.same(cell)


@operator("object")
def bbox_fill(f: Frame, sel: dict, seg: str, color: int) -> DataFrame:
    o = Chosen(f, sel, seg)
    inside = lambda r, c: F.exists(o.chosen, lambda x: (r >= x["r0"]) & (r <= x["r1"]) & (c >= x["c0"]) & (c <= x["c1"]))
    return f.same(lambda r, c, v: F.when((v == 0) & inside(r, c), color).otherwise(v))


def _ring(r: Column, c: Column, r0: Column, r1: Column, c0: Column, c1: Column) -> Column:
    return (r >= r0) & (r <= r1) & (c >= c0) & (c <= c1) & ((r == r0) | (r == r1) | (c == c0) | (c == c1))


@operator("object")
def frame_objects(f: Frame, sel: dict, seg: str, color: int) -> DataFrame:
    o = Chosen(f, sel, seg)
    framing = lambda r, c: o.last(lambda x: _ring(r, c, x["r0"] - 1, x["r1"] + 1, x["c0"] - 1, x["c1"] + 1))
    return f.same(lambda r, c, v: F.when((v == 0) & framing(r, c).isNotNull(), framing(r, c)["color"] if color < 0 else F.lit(color)).otherwise(v))


@operator("object")
def bbox_frame_all(f: Frame, color: int, pad: int) -> DataFrame:
    box = f.box(lambda x: x["v"] != 0)
    f.fail(box["r0"].isNull(), "empty")
    return f.same(lambda r, c, v: F.when((v == 0) & _ring(r, c, box["r0"] - pad, box["r1"] + pad, box["c0"] - pad, box["c1"] + pad), color).otherwise(v))


def _inner(o: Chosen, r: Column, c: Column, offsets: list[tuple[int, int]]) -> Column:
    around = F.array(*[o.label(r + dy, c + dx) for dy, dx in offsets])
    return o.here(r, c) & F.forall(around, lambda k: k == o.label(r, c))


@operator("object")
def hollow_objects(f: Frame, sel: dict, seg: str) -> DataFrame:
    o = Chosen(f, sel, seg)
    return f.same(lambda r, c, v: F.when(_inner(o, r, c, AROUND_4), 0).otherwise(v))


@operator("object")
def paint_interior(f: Frame, sel: dict, seg: str, color: int) -> DataFrame:
    o = Chosen(f, sel, seg)
    return f.same(lambda r, c, v: F.when(_inner(o, r, c, AROUND_8), color).otherwise(v))


@operator("object")
def mark_centers(f: Frame, sel: dict, seg: str, color: int) -> DataFrame:
    o = Chosen(f, sel, seg)
    centre = lambda r, c: F.exists(o.chosen, lambda x: (x["h"] % 2 == 1) & (x["w"] % 2 == 1) & (r * 2 == x["r0"] + x["r1"]) & (c * 2 == x["c0"] + x["c1"]))
    return f.same(lambda r, c, v: F.when(centre(r, c), color).otherwise(v))


def _single(f: Frame, o: Chosen) -> Column:
    f.fail(F.size(o.chosen) != 1, "selection is not unique")
    return f.let(F.get(o.chosen, F.lit(0)))


@operator("object")
def crop_to_object(f: Frame, sel: dict, seg: str) -> DataFrame:
    return f.crop(_single(f, Chosen(f, sel, seg)))


@operator("object")
def crop_object_only(f: Frame, sel: dict, seg: str) -> DataFrame:
    o = Chosen(f, sel, seg)
    x = _single(f, o)
    return f.out(x["h"], x["w"], lambda r, c: F.when(o.label(x["r0"] + r, x["c0"] + c) == x["k"], f.at(x["r0"] + r, x["c0"] + c)).otherwise(0))


@operator("object")
def count_objects_bar(f: Frame, sel: dict, seg: str, color: int) -> DataFrame:
    return f.out(1, F.size(Chosen(f, sel, seg).chosen), lambda r, c: F.lit(color))


@operator("object")
def count_bar_fixed(f: Frame, sel: dict, seg: str, color: int, width: int) -> DataFrame:
    n = f.let(F.size(Chosen(f, sel, seg).chosen))
    f.fail((n == 0) | (n > width), "bad count")
    return f.out(1, width, lambda r, c: F.when(c < n, color).otherwise(0))


@operator("object")
def object_color_cell(f: Frame, sel: dict, seg: str) -> DataFrame:
    colors = f.let(F.array_distinct(F.transform(Chosen(f, sel, seg).chosen, lambda x: x["color"])))
    f.fail(F.size(colors) != 1, "colours differ")
    return f.out(1, 1, lambda r, c: F.get(colors, F.lit(0)))


@operator("object")
def swap_object_colors(f: Frame, seg: str) -> DataFrame:
    o = Objects(f, seg)
    values = lambda r, c: o.get(o.label(r, c))["values"]
    return f.same(lambda r, c, v: F.when((o.label(r, c) > 0) & (F.size(values(r, c)) == 2), F.get(values(r, c), F.lit(0)) + F.get(values(r, c), F.lit(1)) - v).otherwise(v))


def _enclosed(f: Frame) -> tuple[Column, Column]:
    """Labels of background regions, and those that don't touch the border."""
    lab = f.let(regions(f.g, [0]))
    everything = f.let(F.filter(cells(lab), lambda x: x["v"] > 0))
    outer = F.filter(everything, lambda x: (x["r"] == 0) | (x["c"] == 0) | (x["r"] == f.h - 1) | (x["c"] == f.w - 1))
    return lab, f.let(F.array_except(F.transform(everything, lambda x: x["v"]), F.transform(outer, lambda x: x["v"])))


@operator("object")
def fill_holes(f: Frame, color: int) -> DataFrame:
    lab, inner = _enclosed(f)
    return f.same(lambda r, c, v: F.when(F.array_contains(inner, at(lab, r, c)), color).otherwise(v))


@operator("relation")
def fill_holes_by_area(f: Frame, colors: list[int]) -> DataFrame:
    lab, inner = _enclosed(f)
    all_labels = f.let(F.flatten(lab))
    area = lambda r, c: F.size(F.filter(all_labels, lambda k: k == at(lab, r, c)))
    paint = lambda r, c: F.when(area(r, c) == 1, colors[0]).when(area(r, c) <= 4, colors[1]).otherwise(colors[2])
    return f.same(lambda r, c, v: F.when(F.array_contains(inner, at(lab, r, c)), paint(r, c)).otherwise(v))


@operator("relation")
def flood_from_seed(f: Frame, seed: int, color: int) -> DataFrame:
    lab = f.let(regions(f.g, [0, seed]))
    f.fail(~F.exists(F.flatten(f.g), lambda v: v == seed), "no seed")
    seeded = f.let(F.array_distinct(F.transform(F.filter(cells(f.g, k=lab), lambda x: x["v"] == seed), lambda x: x["k"])))
    return f.same(lambda r, c, v: F.when((v == 0) & F.array_contains(seeded, at(lab, r, c)), seed if color < 0 else color).otherwise(v))


@operator("object")
def dilate(f: Frame, conn: int) -> DataFrame:
    """A background cell takes the first foreground neighbour's colour: below, above, right, left, then the diagonals."""
    order = [(1, 0), (-1, 0), (0, 1), (0, -1)] + [(1, 1), (1, -1), (-1, 1), (-1, -1)] * (conn == 8)
    first = lambda r, c: F.coalesce(*[F.nullif(f.at(r + dy, c + dx), F.lit(0)) for dy, dx in order], F.lit(0))
    return f.same(lambda r, c, v: F.when(v == 0, first(r, c)).otherwise(v))


@operator("object")
def erode(f: Frame, conn: int) -> DataFrame:
    around = lambda r, c: neighbours(f, r, c, AROUND_8 if conn == 8 else AROUND_4, 0)
    return f.same(lambda r, c, v: F.when(F.array_contains(around(r, c), 0), 0).otherwise(v))


@operator("object")
def majority_filter(f: Frame, conn: int) -> DataFrame:
    """A cell takes the one commonest value of itself and its neighbours; a tie keeps the cell."""

    def cell(r: Column, c: Column, v: Column) -> Column:
        counted = lambda near: F.transform(F.array_distinct(near), lambda k: F.struct(F.size(F.filter(near, lambda x: x == k)).alias("n"), k.alias("v")))
        single = lambda counts, top: F.size(F.filter(counts, lambda x: x["n"] == top["n"])) == 1
        chosen = lambda counts: bound(F.array_max(counts), lambda top: F.when(single(counts, top), top["v"]).otherwise(v))
        return bound(neighbours(f, r, c, (AROUND_8 if conn == 8 else AROUND_4) + [(0, 0)]), lambda near: bound(F.filter(counted(near), lambda x: x["v"] >= 0), chosen))

    return f.same(cell)


def _lines(f: Frame, dir: str) -> tuple[Column, bool, bool]:
    """The grid as lines along a direction, its end last where ``forward``."""
    down = dir in ("up", "down")
    lines = f.let(F.transform(F.get(f.g, F.lit(0)), lambda _, c: F.transform(f.g, lambda row: F.get(row, c)))) if down else f.g
    return lines, down, dir in ("down", "right")


def _unlined(f: Frame, lines: Column, down: bool) -> DataFrame:
    lines = f.let(lines)
    return f.same(lambda r, c, v: at(lines, c, r) if down else at(lines, r, c))


def _stacked(line: Column, forward: bool) -> Column:
    full, empty = F.filter(line, lambda v: v != 0), F.filter(line, lambda v: v == 0)
    return F.concat(empty, full) if forward else F.concat(full, empty)


@operator("object")
def gravity_cells(f: Frame, dir: str) -> DataFrame:
    lines, down, forward = _lines(f, dir)
    return _unlined(f, F.transform(lines, lambda line: _stacked(line, forward)), down)


@operator("object")
def slide_cells(f: Frame, src: int, dir: str) -> DataFrame:
    """Cells of src fall until something stops them: in each stretch between other cells they end up at its far side."""
    lines, down, forward = _lines(f, dir)

    def fallen(line: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("done"), F.lit(0).alias("empty"), F.lit(0).alias("own"))
        run = lambda a: F.concat(a["done"], F.array_repeat(F.lit(0 if forward else src), a["empty"] if forward else a["own"]), F.array_repeat(F.lit(src if forward else 0), a["own"] if forward else a["empty"]))
        step = lambda a, v: F.when(v == 0, F.struct(a["done"].alias("done"), (a["empty"] + 1).alias("empty"), a["own"].alias("own"))).when(v == src, F.struct(a["done"].alias("done"), a["empty"].alias("empty"), (a["own"] + 1).alias("own"))).otherwise(F.struct(F.concat(run(a), F.array(v)).alias("done"), F.lit(0).alias("empty"), F.lit(0).alias("own")))
        return F.aggregate(line, start, step, run)

    return _unlined(f, F.transform(lines, fallen), down)


@operator("object")
def sort_columns_by_height(f: Frame, order: str) -> DataFrame:
    lines, _, _ = _lines(f, "down")
    keyed = F.transform(lines, lambda line, i: F.struct((F.size(F.filter(line, lambda v: v != 0)) * (1 if order == "asc" else -1)).alias("n"), i.alias("i"), _stacked(line, True).alias("line")))
    return _unlined(f, F.transform(F.array_sort(keyed), lambda x: x["line"]), True)


@operator("relation")
def recolor_from_marker(f: Frame, erase: bool) -> DataFrame:
    o = Objects(f, "c8")
    markers = f.let(F.filter(o.all, lambda x: x["size"] == 1))
    touching = lambda b: F.filter(markers, lambda m: F.exists(b["cells"], lambda x: (F.abs(x["r"] - m["r0"]) <= 1) & (F.abs(x["c"] - m["c0"]) <= 1)))
    bodies = F.transform(F.filter(o.all, lambda x: x["size"] > 1), lambda b: F.struct(b["k"].alias("k"), F.array_distinct(F.transform(touching(b), lambda m: m["color"])).alias("colors"), F.transform(touching(b), lambda m: m["k"]).alias("markers")))
    taken = f.let(F.filter(bodies, lambda b: F.size(b["colors"]) == 1))
    gone = f.let(F.flatten(F.transform(taken, lambda b: b["markers"])))
    new = lambda k: F.get(F.get(F.filter(taken, lambda b: b["k"] == k), F.lit(0))["colors"], F.lit(0))
    kept = lambda r, c, v: F.when(F.array_contains(gone, o.label(r, c)), 0).otherwise(v) if erase else v
    return f.same(lambda r, c, v: F.coalesce(new(o.label(r, c)), kept(r, c, v)))


@operator("relation")
def recolor_contained(f: Frame, mode: str) -> DataFrame:
    """Each object strictly inside the box of a larger one of another colour takes its colour (inherit) or gives it its own (invert); smallest box, then first, holds."""
    o = Objects(f, "c8")

    def holder(b: Column) -> Column:
        able = F.filter(o.all, lambda a: (a["size"] > b["size"]) & (a["r0"] < b["r0"]) & (a["c0"] < b["c0"]) & (a["r1"] > b["r1"]) & (a["c1"] > b["c1"]) & (a["color"] != b["color"]))
        return F.array_min(F.transform(able, lambda a: F.struct((a["h"] * a["w"]).alias("area"), a["k"].alias("k"), a["color"].alias("color"))))

    pairs = F.transform(o.all, lambda b: F.struct(b["k"].alias("inner"), b["color"].alias("inner_color"), holder(b).alias("outer")))
    held = f.let(F.filter(pairs, lambda p: p["outer"].isNotNull()))

    def new(k: Column) -> Column:
        own = F.filter(held, lambda p: (p["inner"] if mode == "inherit" else p["outer"]["k"]) == k)
        last = F.get(own, F.size(own) - 1)
        return last["outer"]["color"] if mode == "inherit" else last["inner_color"]

    return f.same(lambda r, c, v: F.coalesce(new(o.label(r, c)), v))


@operator("relation")
def stamp_template(f: Frame, marker: int, recolor: bool) -> DataFrame:
    """The one object of several cells, centred on every single-cell object of colour ``marker`` (below 0: of any)."""
    o = Objects(f, "m8")
    bodies = f.let(F.filter(o.all, lambda x: x["size"] > 1))
    f.fail(F.size(bodies) != 1, "need one template")
    t = f.let(F.get(bodies, F.lit(0)))
    marks = f.let(F.filter(o.all, lambda x: (x["size"] == 1) & ((x["color"] == marker) if marker >= 0 else F.lit(True))))
    f.fail(F.size(marks) == 0, "no marker")

    def cell(r: Column, c: Column, v: Column) -> Column:
        source = lambda m: (r - m["r0"] + F.floor(t["h"] / 2).cast("int") + t["r0"], c - m["c0"] + F.floor(t["w"] / 2).cast("int") + t["c0"])
        hits = F.filter(marks, lambda m: o.label(*source(m)) == t["k"])
        top = F.get(hits, F.size(hits) - 1)
        return F.when(top.isNotNull(), top["color"] if recolor else f.at(*source(top))).otherwise(v)

    return f.same(cell)


@operator("relation")
def object_histogram(f: Frame, seg: str) -> DataFrame:
    o = Objects(f, seg)
    colors = o.of("color")
    pairs = F.transform(F.array_distinct(colors), lambda k: F.struct((-F.size(F.filter(colors, lambda x: x == k))).alias("n"), k.alias("v")))
    ranked = f.let(F.array_sort(pairs))
    f.fail((F.size(ranked) < 2) | (F.size(F.array_distinct(F.transform(ranked, lambda x: x["n"]))) < F.size(ranked)), "need distinct counts")
    return f.out(F.size(ranked), -F.get(ranked, F.lit(0))["n"], lambda r, c: F.when(c < -F.get(ranked, r)["n"], F.get(ranked, r)["v"]).otherwise(0))


@operator("relation")
def unify_multicolor(f: Frame, mode: str, seg: str) -> DataFrame:
    o = Objects(f, seg)
    sign = 1 if mode == "minor" else -1
    counted = lambda x: F.array_sort(F.transform(x["values"], lambda k: F.struct((F.size(F.filter(x["cells"], lambda y: y["v"] == k)) * sign).alias("n"), k.alias("v"))))
    ranked = f.let(F.transform(o.all, counted))
    f.fail(F.exists(ranked, lambda x: F.coalesce(F.get(x, F.lit(0))["n"] == F.get(x, F.lit(1))["n"], F.lit(False))), "tie")
    return f.same(lambda r, c, v: F.when(o.label(r, c) > 0, F.get(F.get(ranked, o.label(r, c) - 1), F.lit(0))["v"]).otherwise(v))


@operator("relation")
def recolor_by_shape_match(f: Frame, src: int) -> DataFrame:
    o = Objects(f, "c8")
    models = f.let(F.filter(o.all, lambda x: x["color"] != src))

    def new(k: Column) -> Column:
        own = o.get(k)
        alike = F.array_distinct(F.transform(F.filter(models, lambda x: x["shape"] == own["shape"]), lambda x: x["color"]))
        return F.when((own["color"] == src) & (F.size(alike) == 1), F.get(alike, F.lit(0)))

    return f.same(lambda r, c, v: F.when(o.label(r, c) > 0, F.coalesce(new(o.label(r, c)), v)).otherwise(v))


@operator("relation")
def step_toward(f: Frame, mover: int, target: int, steps: int) -> DataFrame:
    """Objects of colour mover take steps (diagonal ones too) to the target cell nearest to their centre, row-major on ties."""
    o = Objects(f, "c8")
    goals = f.let(F.filter(cells(f.g), lambda x: x["v"] == target))
    f.fail(F.size(goals) == 0, "no target")

    def moved(x: Column) -> Column:
        mean = lambda name: F.aggregate(x["cells"], F.lit(0.0), lambda a, y: a + y[name]) / x["size"]
        cy, cx = mean("r"), mean("c")
        near = F.array_min(F.transform(goals, lambda t: F.struct((F.abs(t["r"] - cy) + F.abs(t["c"] - cx)).alias("d"), t["r"].alias("r"), t["c"].alias("c"))))
        return F.struct(x["k"].alias("k"), (F.signum(near["r"] - cy) * steps).cast("int").alias("dy"), (F.signum(near["c"] - cx) * steps).cast("int").alias("dx"), x["r0"].alias("r0"), x["r1"].alias("r1"), x["c0"].alias("c0"), x["c1"].alias("c1"))

    movers = f.let(F.transform(F.filter(o.all, lambda x: x["color"] == mover), moved))
    f.fail(F.exists(movers, lambda x: (x["r0"] + x["dy"] < 0) | (x["c0"] + x["dx"] < 0) | (x["r1"] + x["dy"] >= f.h) | (x["c1"] + x["dx"] >= f.w)), "out of bounds")
    numbers = f.let(F.transform(movers, lambda x: x["k"]))

    def cell(r: Column, c: Column, v: Column) -> Column:
        hits = F.filter(movers, lambda x: o.label(r - x["dy"], c - x["dx"]) == x["k"])
        return F.when(F.size(hits) > 0, mover).when(F.array_contains(numbers, o.label(r, c)), 0).otherwise(v)

    return f.same(cell)


# --- order-dependent simulations: one small kernel for each grid -------------------------


def slid(grid: list[list[int]], parts: list[list[tuple[int, int]]], dy: int, dx: int) -> list[list[int]]:
    """Parts (lists of cells) slide one after another, the foremost first, until the border or something in the way."""
    h, w, out = len(grid), len(grid[0]), [[*row] for row in grid]
    for r, c in (p for part in parts for p in part):
        out[r][c] = 0
    for part in sorted(parts, key=lambda p: -max(r * dy + c * dx for r, c in p)):
        k = 0
        while all(0 <= r + (k + 1) * dy < h and 0 <= c + (k + 1) * dx < w and not out[r + (k + 1) * dy][c + (k + 1) * dx] for r, c in part):
            k += 1
        for r, c in part:
            out[r + k * dy][c + k * dx] = grid[r][c]
    return out


def _sight(grid: np.ndarray, r: int, c: int, way: tuple[int, int]) -> tuple[int, int] | None:
    """Distance and value of the first filled cell seen from a cell in one direction."""
    ray = {(-1, 0): grid[:r, c][::-1], (1, 0): grid[r + 1 :, c], (0, -1): grid[r, :c][::-1], (0, 1): grid[r, c + 1 :]}[way]
    filled = np.flatnonzero(ray)
    return (int(filled[0]) + 1, int(ray[filled[0]])) if len(filled) else None


def flown(grid: list[list[int]], parts: list[list[tuple[int, int]]], target: int) -> list[list[int]] | None:
    """Parts leave the grid, then fly in one after another towards the target that is nearest straight ahead of any side of
    theirs, unless something else is nearer on that side, and stop beside it; those that face none stay.  Equal ways: up, then left, right, down.

    A part's own places never block its view.  None where a part would leave over the lower or right side; over the upper or
    left side its cells come in again at the opposite one, as the reference has it.
    """
    before = np.array(grid)
    now = before.copy()
    for part in parts:
        now[tuple(np.array(part).T)] = 0
    for part in parts:
        cells, free, ahead = np.array(part), [], now.copy()
        ahead[tuple(cells.T)] = 0
        for way in sorted(AROUND_4):
            seen = [s for s in (_sight(ahead, r, c, way) for r, c in part) if s]
            nearest = min(seen, key=lambda s: s[0], default=(0, 0))
            if nearest[1] == target:
                free.append((nearest[0] - 1, way))
        steps, way = min(free, default=(0, (0, 0)))
        to = cells + steps * np.array(way)
        if (to >= now.shape).any():
            return None
        now[tuple(to.T)] = before[tuple(cells.T)]
    return now.tolist()


def largest_empty(grid: list[list[int]]) -> list[int] | None:
    """The largest all-background rectangle [r0, r1, c0, c1] of at least two cells, if only one is that large."""
    h, w, best, found = len(grid), len(grid[0]), 1, []
    for r0 in range(h):
        free = [True] * w
        for r1 in range(r0, h):
            free = [a and not v for a, v in zip(free, grid[r1])]
            start = 0
            for c in range(w + 1):
                if c == w or not free[c]:
                    area = (c - start) * (r1 - r0 + 1)
                    if area > best:
                        best, found = area, []
                    if area == best and best > 1:
                        found.append([r0, r1, start, c - 1])
                    start = c + 1
    return found[0] if len(found) == 1 else None


def _kernel(run, kind: str):
    """A vectorised function over (grid, parts) rows."""

    @F.pandas_udf(kind)
    def each(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for grids, parts in batches:
            out = []
            for g, p in zip(grids, parts):
                plain = None if g is None else [[int(v) for v in row] for row in g]
                out.append(None if plain is None else run(plain, [[(int(k) // 32, int(k) % 32) for k in part] for part in ([] if p is None else p)]))
            yield pd.Series(out, dtype=object)

    return each.asNondeterministic()


def _parts(objects: Column) -> Column:
    return F.transform(objects, lambda o: F.transform(o["cells"], lambda x: x["r"] * 32 + x["c"]))


@operator("object")
def slide_objects(f: Frame, sel: dict, seg: str, dir: str) -> DataFrame:
    dy, dx = {"up": (-1, 0), "down": (1, 0), "left": (0, -1), "right": (0, 1)}[dir]
    o = Chosen(f, sel, seg)
    return f.finish(f.h, f.w, f.let(_kernel(lambda g, p: slid(g, p, dy, dx), "array<array<int>>")(f.g, f.let(_parts(o.chosen)))))


@operator("relation")
def slide_toward(f: Frame, mover: int, target: int) -> DataFrame:
    o = Objects(f, "c8")
    movers = f.let(F.filter(o.all, lambda x: x["color"] == mover))
    f.fail(F.size(movers) == 0, "no mover")
    out = f.let(_kernel(lambda g, p: flown(g, p, target), "array<array<int>>")(f.g, f.let(_parts(movers))))
    f.fail(out.isNull(), "off the grid")
    return f.finish(f.h, f.w, out)


@operator("relation")
def fill_largest_empty_rect(f: Frame, color: int) -> DataFrame:
    none = F.array().cast("array<array<int>>")
    box = f.let(_kernel(lambda g, _: largest_empty(g), "array<int>")(f.g, f.let(none)))
    f.fail(box.isNull(), "no unique largest rectangle")
    side = lambda i: F.get(box, F.lit(i))
    return f.same(lambda r, c, v: F.when((r >= side(0)) & (r <= side(1)) & (c >= side(2)) & (c <= side(3)), color).otherwise(v))


