"""Object steps, layer operations and search steps: three banks on an inferred background that refuse instead of clipping.

They share names with the main bank but not its edge rules, so each has a registry of its own.  Components are cells of
one colour joined by their sides; colour 0 counts like any other where it isn't the background.  The background of the
object steps is the commonest border value (corners count twice; ties: the smallest).  That of the others is the value
of most border cells, then of most cells, then the first in reading order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.grids import MAX_SIZE, Frame, at, cells, flat
from tessel.functions.labels import regions
from tessel.functions.selectors import Objects
from tessel.operators.geometry import SOURCES, TURNED, commonest
from tessel.operators.panels import Panels, logic
from tessel.operators.paths import following

OBJECT_STEPS: dict[str, Callable[..., DataFrame]] = {}
LAYER_STEPS: dict[str, Callable[..., DataFrame]] = {}
SEARCH_STEPS: dict[str, Callable[..., DataFrame]] = {}
WAYS = {"down": (1, 0), "left": (0, -1), "up": (-1, 0), "right": (0, 1)}
TURNS = ("id", "rot90", "rot180", "rot270", "flip_h", "transpose", "flip_v", "anti_transpose")


class Ground:
    """A grid and its background."""

    def __init__(self, f: Frame, by_place: bool):
        self.f = f
        last = F.get(f.g, f.h - 1)
        edges = f.let(F.concat(F.get(f.g, F.lit(0)), last, F.transform(f.g, lambda row: F.get(row, F.lit(0))), F.transform(f.g, lambda row: F.get(row, f.w - 1))))
        if by_place:
            every = f.let(flat(f.g))
            count = lambda values, v: F.size(F.filter(values, lambda x: x == v))
            ranked = F.transform(F.array_distinct(every), lambda v: F.struct(count(edges, v).alias("edge"), count(every, v).alias("all"), (-F.array_position(every, v)).alias("first"), v.alias("v")))
            self.bg = f.let(F.array_max(ranked)["v"])
        else:
            self.bg = f.let(commonest(edges, 0))
        self.everything = f.let(cells(f.g))

    def layer(self, colour: int) -> Column:
        """The cells of a colour; a grid without any, or whose background it is, is refused."""
        own = self.f.let(F.filter(self.everything, lambda x: x["v"] == colour))
        self.f.fail((F.size(own) == 0) | (self.bg == colour), "layer is missing")
        return own

    def objects(self, colour: int | None = None) -> Objects:
        """Components of the foreground or of one colour, by colour, then in reading order of their first cells."""
        counted = (lambda v: v != self.bg) if colour is None else (lambda v: (v == colour) & (v != self.bg))
        o = Objects(self.f, "c4", self.f.let(F.transform(self.f.g, lambda row: F.transform(row, lambda v: F.when(counted(v), v + 1).otherwise(0)))))
        return o

    def picked(self, selector: str, colour: int | None, canonical: bool = False) -> Picked:
        o = self.objects(colour)
        return Picked(self, o, selected(o, selector, canonical))

    def blocked(self, value: Column, own: Column | int) -> Column:
        return ~((value == self.bg) | (value == own))


class Picked:
    """Chosen components, ``list``, by colour and then in reading order."""

    def __init__(self, ground: Ground, o: Objects, test: Callable[[Column], Column]):
        f = self.f = ground.f
        self.o = o
        keyed = F.transform(F.filter(o.all, test), lambda x: F.struct(x["color"].alias("color"), (F.get(x["cells"], F.lit(0))["r"] * 32 + F.get(x["cells"], F.lit(0))["c"]).alias("first"), x.alias("o")))
        self.list = f.let(F.transform(F.array_sort(keyed), lambda y: y["o"]))
        self.numbers = f.let(F.transform(self.list, lambda x: x["k"]))
        f.fail(F.size(self.list) == 0, "nothing is selected")

    def here(self, r: Column, c: Column) -> Column:
        return F.array_contains(self.numbers, self.o.label(r, c))

    def box(self) -> Column:
        end = lambda way, n: way(F.transform(self.list, lambda x: x[n])).alias(n)
        return self.f.let(F.struct(end(F.array_min, "r0"), end(F.array_max, "r1"), end(F.array_min, "c0"), end(F.array_max, "c1")))

    def last(self, test: Callable[[Column], Column]) -> Column:
        found = F.filter(self.list, test)
        return F.get(found, F.size(found) - 1)


def canonical_shape(o: Column) -> Column:
    """A shape's 8 x 8 picture, the least of its eight turns; small shapes are blown up, large ones thinned."""
    held = F.transform(o["cells"], lambda x: (x["r"] - o["r0"]) * 32 + x["c"] - o["c0"])

    def picture(name: str) -> Column:
        h, w = (o["w"], o["h"]) if name in TURNED else (o["h"], o["w"])
        most = F.greatest(h, w)
        factor = F.greatest(F.lit(1), F.floor(F.lit(8) / most))
        place = lambda i, n: F.when(most <= 8, F.floor((i - F.floor((8 - n * factor) / 2)) / factor)).otherwise(F.floor(i * n / 8)).cast("int")

        def bit(i: Column) -> Column:
            r, c = place(F.floor(i / 8), h), place(i % 8, w)
            y, x = SOURCES[name](r, c, o["h"], o["w"])
            return F.when((r >= 0) & (r < h) & (c >= 0) & (c < w) & F.array_contains(held, y * 32 + x), "1").otherwise("0")

        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), "")

    return F.array_min(F.array(*[picture(n) for n in TURNS]))


def selected(o: Objects, selector: str, canonical: bool) -> Callable[[Column], Column]:
    by = {"border": "touches_border", "interior": "inner"}.get(selector, selector)
    kind, _, name = selector.partition("_")
    if kind not in ("unique", "repeated"):
        return o._test(by, None)
    key = (lambda x: x["size"]) if name == "area" else canonical_shape if canonical else (lambda x: x["shape"])
    keys = o.f.let(F.transform(o.all, key))
    often = lambda x: F.size(F.filter(keys, lambda y: y == F.get(keys, x["k"] - 1)))
    return lambda x: (often(x) == 1) if kind == "unique" else (often(x) > 1)


def _bank(registry: dict[str, Callable[..., DataFrame]], by_place: bool) -> Callable:
    def register(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        registry[build.__name__.strip("_")] = lambda grids, **given: build(Ground(Frame(grids), by_place), **given)
        return build

    return register


object_step, layer_step, search_step = _bank(OBJECT_STEPS, False), _bank(LAYER_STEPS, True), _bank(SEARCH_STEPS, True)


def _in_box(x: Column, r: Column, c: Column) -> Column:
    return (r >= x["r0"]) & (r <= x["r1"]) & (c >= x["c0"]) & (c <= x["c1"])


def _on_ring(x: Column, r: Column, c: Column) -> Column:
    return _in_box(x, r, c) & ((r == x["r0"]) | (r == x["r1"]) | (c == x["c0"]) | (c == x["c1"]))


# --- object steps ----------------------------------------------------------------------


@object_step
def keep_selected(g: Ground, selector: str = "all", source: int | None = None) -> DataFrame:
    p = g.picked(selector, source, True)
    return g.f.same(lambda r, c, v: F.when(p.here(r, c), v).otherwise(g.bg))


@object_step
def delete_selected(g: Ground, selector: str = "all", source: int | None = None) -> DataFrame:
    p = g.picked(selector, source, True)
    return g.f.same(lambda r, c, v: F.when(p.here(r, c), g.bg).otherwise(v))


@object_step
def recolor_selected(g: Ground, target: int, selector: str = "all", source: int | None = None) -> DataFrame:
    p = g.picked(selector, source, True)
    return g.f.same(lambda r, c, v: F.when(p.here(r, c), target).otherwise(v))


@object_step
def crop_selected(g: Ground, selector: str = "all", source: int | None = None) -> DataFrame:
    p = g.picked(selector, source, True)
    b = p.box()
    return g.f.out(b["r1"] - b["r0"] + 1, b["c1"] - b["c0"] + 1, lambda r, c: F.when(p.here(b["r0"] + r, b["c0"] + c), g.f.at(b["r0"] + r, b["c0"] + c)).otherwise(g.bg))


def _boxed(g: Ground, p: Picked, paints: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """Each chosen object gives way to what ``paints`` marks of its box; later ones go over earlier ones."""

    def cell(r: Column, c: Column, v: Column) -> Column:
        top = p.last(lambda x: paints(x, r, c) | (p.o.label(r, c) == x["k"]))
        return F.when(top.isNull(), v).when(paints(top, r, c), top["color"]).otherwise(g.bg)

    return g.f.same(cell)


@object_step
def fill_selected_bbox(g: Ground, selector: str = "all", source: int | None = None) -> DataFrame:
    return _boxed(g, g.picked(selector, source, True), _in_box)


@object_step
def outline_selected_bbox(g: Ground, selector: str = "all", source: int | None = None) -> DataFrame:
    return _boxed(g, g.picked(selector, source, True), _on_ring)


@object_step
def transform_selected(g: Ground, transform: int, selector: str = "all", source: int | None = None) -> DataFrame:
    """Each chosen object is turned in place, its box's upper left corner kept, one after another."""
    f, p, name = g.f, g.picked(selector, source, True), TURNS[transform]
    sides = lambda x: (x["w"], x["h"]) if name in TURNED else (x["h"], x["w"])

    def lands(x: Column, r: Column, c: Column) -> Column:
        h, w = sides(x)
        y, z = SOURCES[name](r - x["r0"], c - x["c0"], x["h"], x["w"])
        return (r >= x["r0"]) & (c >= x["c0"]) & (r < x["r0"] + h) & (c < x["c0"] + w) & (p.o.label(x["r0"] + y, x["c0"] + z) == x["k"])

    f.fail(F.exists(p.list, lambda x: (x["r0"] + sides(x)[0] > f.h) | (x["c0"] + sides(x)[1] > f.w)), "off the grid")
    landing = lambda r, c: F.filter(F.transform(p.list, lambda x, i: F.when(lands(x, r, c), i)), lambda i: i.isNotNull())
    # A cell that belonged to object number n is cleared again when n's turn comes.
    turn = lambda r, c: F.coalesce(F.array_position(p.numbers, p.o.label(r, c)) - 1, F.lit(-1))

    def collides(r: Column, c: Column, v: Column) -> Column:
        held, own = landing(r, c), turn(r, c)
        again = F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(held) - 1)), lambda n: (F.size(held) > 1) & ~((F.get(held, n - 1) < own) & (own <= F.get(held, n))))
        return (F.size(held) > 0) & (((own < 0) & (v != g.bg)) | again)

    f.fail(F.exists(g.everything, lambda x: collides(x["r"], x["c"], x["v"])), "in the way")

    def cell(r: Column, c: Column, v: Column) -> Column:
        held = landing(r, c)
        last = F.get(held, F.size(held) - 1)
        return F.when(last >= turn(r, c), F.get(p.list, last)["color"]).when(turn(r, c) >= 0, g.bg).otherwise(v)

    return f.same(cell)


@object_step
def gravity_selected(g: Ground, direction: str = "down", selector: str = "all", source: int | None = None) -> DataFrame:
    """All chosen objects fall as one block until one of their cells meets the border or another cell."""
    f, p, (dy, dx) = g.f, g.picked(selector, source, True), WAYS[direction]
    chosen = f.let(F.filter(g.everything, lambda x: p.here(x["r"], x["c"])))
    free = lambda r, c: F.coalesce((f.at(r, c) == g.bg) | p.here(r, c), F.lit(False))
    stops = lambda k: F.exists(chosen, lambda x: ~free(x["r"] + (k + 1) * dy, x["c"] + (k + 1) * dx))
    k = f.let(F.coalesce(F.get(F.filter(F.sequence(F.lit(0), F.lit(MAX_SIZE)), stops), F.lit(0)), F.lit(0)))
    return f.same(lambda r, c, v: F.when(p.here(r - k * dy, c - k * dx), f.at(r - k * dy, c - k * dx)).when(p.here(r, c), g.bg).otherwise(v))


# --- layer operations ----------------------------------------------------------------------


def _simulated(run: Callable[..., list[list[int]] | None]) -> Callable[..., Column]:
    """A small kernel over (grid, background, cells of each component as r * 32 + c)."""

    @F.pandas_udf("array<array<int>>")
    def each(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for grids, grounds, parts in batches:
            yield pd.Series([None if g is None else run(np.array([list(row) for row in g]), int(bg), [np.array(p) for p in ([] if held is None else held)]) for g, bg, held in zip(grids, grounds, parts)], dtype=object)

    return each.asNondeterministic()


def settled(grid: np.ndarray, bg: int, parts: list[np.ndarray], direction: str) -> list[list[int]]:
    """Components fall one after another, the foremost first (then the one furthest to the left as seen along the fall)."""
    way = np.array(WAYS[direction])
    side = np.array([way[1], way[0]]) * (1 if direction in ("down", "left") else -1) * (1 if direction in ("down", "up") else -1)
    placed = [np.stack([p // 32, p % 32], 1) for p in parts]
    first = {int(v): i for i, v in reversed(list(enumerate(grid.ravel())))}
    number = lambda p: min((tuple(map(int, (x @ way, x @ side))) for x in p))
    placed.sort(key=lambda p: (-int((p @ way).max()), int((p @ side).min()), first[int(grid[tuple(p[0])])], number(p)))
    out = grid.copy()
    for part in placed:
        colour = grid[tuple(part[0])]
        out[part[:, 0], part[:, 1]] = bg
        while True:
            to = part + way
            if (to < 0).any() or (to >= out.shape).any() or (out[to[:, 0], to[:, 1]] != bg).any():
                break
            part = to
        out[part[:, 0], part[:, 1]] = colour
    return out.tolist()


@layer_step
def gravity_objects(g: Ground, direction: str, source: int | None = None) -> DataFrame:
    """Every component falls on its own, as a rigid body."""
    f, o = g.f, g.objects(source)
    f.fail(F.size(o.all) == 0, "nothing falls")
    parts = f.let(F.transform(o.all, lambda x: F.transform(x["cells"], lambda y: y["r"] * 32 + y["c"])))
    return f.finish(f.h, f.w, f.let(_simulated(lambda grid, bg, held: settled(grid, bg, held, direction))(f.g, g.bg, parts)))


def landed(line: np.ndarray, bg: int, source: int, marker: int) -> np.ndarray | None:
    """One line, read along the fall, after its strips of source and marker cells have fallen; None without any source.

    The foremost strip falls first, and no strip passes one that has landed, so what is free ends where the last one begins.
    A strip without a marker goes right there, over whatever stays; one with a marker stops before the first cell that stays.
    """
    ends = np.flatnonzero(np.diff(np.isin(line, (source, marker)), prepend=False, append=False)).reshape(-1, 2)
    strips = [line[a:b] for a, b in ends]
    falls = [source in strip for strip in strips]
    if not any(falls):
        return None
    out = line.copy()
    for (a, b), fall in zip(ends, falls):
        out[a:b] = bg if fall else out[a:b]
    stays, free = np.append(np.flatnonzero(out != bg), len(line)), len(line)
    for (_, b), strip, fall in reversed(list(zip(ends, strips, falls))):
        if fall:
            stop = min(free, int(stays[np.searchsorted(stays, b)])) if marker in strip else free
            free = stop - len(strip)
            out[free:stop] = strip
    return out


def dropped(grid: np.ndarray, bg: int, source: int, marker: int, direction: str) -> list[list[int]] | None:
    """Strips of source and marker cells fall along their own line: marked ones onto anything, others onto landed strips only."""
    out = grid.copy()
    lines = out if direction in ("left", "right") else out.T
    lines = lines if direction in ("right", "down") else lines[:, ::-1]
    moved = [landed(line, bg, source, marker) for line in lines]
    for line, new in zip(lines, moved):
        if new is not None:
            line[:] = new
    return None if all(new is None for new in moved) else out.tolist()


@layer_step
def conditional_line_gravity(g: Ground, source: int, marker: int, direction: str) -> DataFrame:
    f = g.f
    f.fail((g.bg == source) | (g.bg == marker) | F.lit(source == marker), "layer is missing")
    out = f.let(_simulated(lambda grid, bg, _: dropped(grid, bg, source, marker, direction))(f.g, g.bg, f.let(F.array().cast("array<array<int>>"))))
    f.fail(out.isNull(), "nothing falls")
    return f.finish(f.h, f.w, out)


def _beside(g: Ground, way: str) -> Callable[[Column, Column], Column]:
    """The first value that isn't background, seen from a cell towards a side."""
    f = g.f
    down = way in ("up", "down")
    lines = f.let(F.transform(F.get(f.g, F.lit(0)), lambda _, c: F.transform(f.g, lambda row: F.get(row, c)))) if down else f.g
    full = lambda part: F.filter(part, lambda v: v != g.bg)

    def seen(r: Column, c: Column) -> Column:
        line, i = (F.get(lines, c), r) if down else (F.get(lines, r), c)
        if way in ("up", "left"):
            before = full(F.slice(line, F.lit(1), i))
            return F.get(before, F.size(before) - 1)
        return F.get(full(F.slice(line, i + 2, F.lit(MAX_SIZE))), F.lit(0))

    return seen


@layer_step
def connect_layer(g: Ground, source: int, axis: str) -> DataFrame:
    """Background between two cells of the layer in a line, with nothing else between, is filled."""
    g.f.fail(g.bg == source, "layer is missing")
    pairs = [("left", "right")] * (axis in ("rows", "both")) + [("up", "down")] * (axis in ("columns", "both"))
    sides = [(_beside(g, a), _beside(g, b)) for a, b in pairs]
    between = lambda r, c: F.greatest(F.lit(False), *[F.coalesce((a(r, c) == source) & (b(r, c) == source), F.lit(False)) for a, b in sides])
    return g.f.same(lambda r, c, v: F.when((v == g.bg) & between(r, c), source).otherwise(v))


@layer_step
def extend_rays(g: Ground, source: int, direction: str) -> DataFrame:
    g.f.fail(g.bg == source, "layer is missing")
    behind = _beside(g, {"down": "up", "up": "down", "left": "right", "right": "left"}[direction])
    return g.f.same(lambda r, c, v: F.when((v == g.bg) & (behind(r, c) == source), source).otherwise(v))


@layer_step
def complete_symmetry(g: Ground, source: int, axis: str, frame: str = "grid") -> DataFrame:
    f, own = g.f, g.layer(source)
    if frame == "bbox":
        row, column = F.transform(own, lambda x: x["r"]), F.transform(own, lambda x: x["c"])
        b = f.let(F.struct(F.array_min(row).alias("r0"), F.array_max(row).alias("r1"), F.array_min(column).alias("c0"), F.array_max(column).alias("c1")))
    else:
        b = f.let(F.struct(F.lit(0).alias("r0"), (f.h - 1).alias("r1"), F.lit(0).alias("c0"), (f.w - 1).alias("c1")))
    h, w = b["r1"] - b["r0"] + 1, b["c1"] - b["c0"] + 1
    names = {"left_right": ["flip_h"], "up_down": ["flip_v"], "rot180": ["rot180"], "both": ["flip_h", "flip_v", "rot180"], "diagonal": ["transpose"]}[axis]
    if axis == "diagonal":
        f.fail(h != w, "not square")

    def image(name: str, r: Column, c: Column) -> Column:
        y, x = SOURCES[name](r - b["r0"], c - b["c0"], h, w)
        return F.coalesce(f.at(b["r0"] + y, b["c0"] + x) == source, F.lit(False))

    marked = lambda r, c: _in_box(b, r, c) & F.greatest(F.lit(False), *[image(n, r, c) for n in names])
    f.fail(F.exists(g.everything, lambda x: marked(x["r"], x["c"]) & g.blocked(x["v"], source)), "in the way")
    return f.same(lambda r, c, v: F.when(marked(r, c), source).otherwise(v))


@layer_step
def repeat_objects(g: Ground, source: int, axis: str, scope: str = "forward") -> DataFrame:
    """Equal components at equal distances along an axis go on to the border, or to both borders."""
    f, o = g.f, g.objects(source)
    across = axis == "horizontal"
    alike = f.let((F.size(o.all) >= 2) & (F.size(F.array_distinct(o.of("shape"))) == 1))
    anchors = f.let(F.array_sort(F.transform(o.all, lambda x: F.struct((x["c0"] if across else x["r0"]).alias("a"), (x["r0"] if across else x["c0"]).alias("b"), x["k"].alias("k")))))
    steps = F.transform(F.slice(anchors, F.lit(2), F.greatest(F.lit(0), F.size(anchors) - 1)), lambda x, i: F.struct((x["a"] - F.get(anchors, i)["a"]).alias("a"), (x["b"] - F.get(anchors, i)["b"]).alias("b")))
    steps = f.let(F.array_distinct(steps))
    d = f.let(F.get(steps, F.lit(0)))
    row = f.let(F.coalesce(alike & (F.size(steps) == 1) & (d["a"] > 0) & (d["b"] == 0), F.lit(False)))
    f.fail(~row, "no row of equal objects")
    one = f.let(o.get(F.get(anchors, F.lit(0))["k"]))
    by = lambda n: (F.lit(0), n * d["a"]) if across else (n * d["a"], F.lit(0))
    inside = lambda n: (one["r0"] + by(n)[0] >= 0) & (one["c0"] + by(n)[1] >= 0) & (one["r1"] + by(n)[0] < f.h) & (one["c1"] + by(n)[1] < f.w)
    # Most grids have no such row; they get no copies, so nothing is looked for in their cells.
    numbers = F.sequence(F.lit(-MAX_SIZE if scope == "both" else 0), F.lit(MAX_SIZE))
    copies = f.let(F.when(row, F.filter(numbers, lambda n: F.coalesce(inside(n), F.lit(False)))))
    drawn = lambda r, c: F.exists(copies, lambda n: o.label(r - by(n)[0], c - by(n)[1]) == one["k"])
    f.fail(row & F.exists(g.everything, lambda x: g.blocked(x["v"], source) & drawn(x["r"], x["c"])), "in the way")
    return f.same(lambda r, c, v: F.when(drawn(r, c), source).otherwise(v))


@layer_step
def stamp_markers(g: Ground, source: int, marker: int, anchor: str = "top_left", paint: str = "source", keep_template: bool = True) -> DataFrame:
    """The layer's one component drawn at every marker cell, which goes."""
    f, own, marks = g.f, g.objects(source), g.objects(marker)
    f.fail((g.bg == source) | (g.bg == marker) | F.lit(source == marker) | (F.size(own.all) != 1) | (F.size(marks.all) == 0) | F.exists(marks.all, lambda m: m["size"] != 1), "need one template and single markers")
    t = f.let(F.get(own.all, F.lit(0)))
    colour = marker if paint == "marker" else source
    dy, dx = F.lit(0), F.lit(0)
    if anchor == "center":
        f.fail((t["h"] % 2 == 0) | (t["w"] % 2 == 0), "no centre")
        dy, dx = F.floor(t["h"] / 2).cast("int"), F.floor(t["w"] / 2).cast("int")
    gone = (lambda v: v == marker) if keep_template else (lambda v: (v == marker) | (v == source))
    left = lambda v: F.when(gone(v), g.bg).otherwise(v)
    spots = f.let(F.flatten(F.transform(marks.all, lambda m: F.transform(t["cells"], lambda x: F.struct((m["r0"] + x["r"] - t["r0"] - dy).alias("r"), (m["c0"] + x["c"] - t["c0"] - dx).alias("c"))))))
    f.fail(F.exists(spots, lambda s: f.at(s["r"], s["c"]).isNull() | g.blocked(left(f.at(s["r"], s["c"])), colour)), "in the way or off the grid")
    return f.same(lambda r, c, v: F.when(F.exists(spots, lambda s: (s["r"] == r) & (s["c"] == c)), colour).otherwise(left(v)))


@layer_step
def panel_boolean(g: Ground, axis: int, mode: str, target: int, gap: int = 1, output_bg: int | None = None) -> DataFrame:
    """Two halves, beside a uniform line where there is a gap, compared by what isn't background in them."""
    f = g.f
    n = f.h if axis == 0 else f.w
    f.fail((n <= gap) | ((n - gap) % 2 != 0), "cannot split evenly")
    half = f.let(F.floor((n - gap) / 2).cast("int"))
    if gap:
        line = F.get(f.g, half) if axis == 0 else F.transform(f.g, lambda row: F.get(row, half))
        f.fail(F.size(F.array_distinct(line)) != 1, "no separator")

    def cell(r: Column, c: Column) -> Column:
        a, b = f.at(r, c) != g.bg, (f.at(r + half + gap, c) if axis == 0 else f.at(r, c + half + gap)) != g.bg
        marked = {"or": a | b, "and": a & b, "xor": a != b, "a_minus_b": a & ~b, "b_minus_a": b & ~a, "neither": ~(a | b)}[mode]
        return F.when(marked, target).otherwise(g.bg if output_bg is None else F.lit(output_bg))

    return f.out(half if axis == 0 else f.h, f.w if axis == 0 else half, cell)


def _inner(g: Ground, wall: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
    """Is a cell in a region of cells other than walls that doesn't reach the border?"""
    f = g.f
    lab = f.let(regions(f.let(F.transform(f.g, lambda row: F.transform(row, lambda v: F.when(wall(v), 1).otherwise(0)))), [0]))
    everything = f.let(F.filter(cells(lab), lambda x: x["v"] > 0))
    outer = F.filter(everything, lambda x: (x["r"] == 0) | (x["c"] == 0) | (x["r"] == f.h - 1) | (x["c"] == f.w - 1))
    inner = f.let(F.array_except(F.transform(everything, lambda x: x["v"]), F.transform(outer, lambda x: x["v"])))
    return lambda r, c: F.array_contains(inner, at(lab, r, c))


@layer_step
def follow_marker_path(g: Ground) -> DataFrame:
    """The arrow at the end of the path that markers of its colour show.  Where whole lines of one colour cut the grid into equal
    panels, all panels must lead to the same picture, which is the result."""
    f = g.f

    def cut(n: Column, line: Callable[[Column], Column]) -> tuple[Column, Column]:
        """Size of the panels (null without any) and their number."""
        at_ = f.let(F.filter(F.sequence(F.lit(0), n - 1), lambda i: (F.size(F.array_distinct(line(i))) == 1) & (F.get(line(i), F.lit(0)) != g.bg)))
        k = F.size(at_)
        size = f.let(F.floor((n - k) / (k + 1)).cast("int"))
        even = (k > 0) & (size > 0) & (at_ == F.transform(at_, lambda _, i: ((i + 1) * size + i).cast("int"))) & ((n - k) % (k + 1) == 0)
        return f.let(F.when(even & (F.size(F.array_distinct(F.transform(at_, lambda i: F.get(line(i), F.lit(0))))) == 1), size)), k + 1

    (high, rows), (wide, columns) = cut(f.h, lambda i: F.get(f.g, i)), cut(f.w, lambda i: F.transform(f.g, lambda row: F.get(row, i)))
    f.fail(high.isNotNull() & wide.isNotNull(), "cut both ways")
    numbers = lambda n: F.sequence(F.lit(0), n - 1)
    below = F.transform(numbers(rows), lambda i: F.slice(f.g, i * (high + 1) + 1, high))
    beside = F.transform(numbers(columns), lambda i: F.transform(f.g, lambda row: F.slice(row, i * (wide + 1) + 1, wide)))
    panels = f.let(F.when(high.isNotNull() & wide.isNotNull(), F.lit(None)).when(high.isNotNull(), below).when(wide.isNotNull(), beside).otherwise(F.array(f.g)))
    ends = f.let(following(panels))
    f.fail(F.exists(ends, lambda x: x.isNull()) | (F.size(F.array_distinct(ends)) != 1), "no path to follow")
    one = f.let(F.get(ends, F.lit(0)))
    return f.finish(F.size(one), F.size(F.get(one, F.lit(0))), one)


@layer_step
def fill_enclosures(g: Ground, target: int, source: int | None = None) -> DataFrame:
    inner = _inner(g, (lambda v: v != g.bg) if source is None else (lambda v: v == source))
    return g.f.same(lambda r, c, v: F.when((v == g.bg) & inner(r, c), target).otherwise(v))


@layer_step
def crop_foreground(g: Ground) -> DataFrame:
    return g.f.crop(g.f.box(lambda x: x["v"] != g.bg))


# --- search steps ---------------------------------------------------------------------------


def _turned(g: Ground, name: str) -> DataFrame:
    f = g.f
    return f.out(*((f.w, f.h) if name in TURNED else (f.h, f.w)), lambda r, c: f.at(*SOURCES[name](r, c, f.h, f.w)))


@search_step
def rotate_grid(g: Ground, turns: int) -> DataFrame:
    return _turned(g, TURNS[turns % 4])


@search_step
def reflect_grid(g: Ground, axis: str) -> DataFrame:
    return _turned(g, {"rows": "flip_v", "columns": "flip_h", "transpose": "transpose"}[axis])


def _shifted(g: Ground, source: int, own: Column, dr: Column, dc: Column, erase: bool = True) -> DataFrame:
    f = g.f
    to = lambda x: f.at(x["r"] + dr, x["c"] + dc)
    f.fail(F.exists(own, lambda x: to(x).isNull() | g.blocked(to(x), source)), "in the way or off the grid")
    return f.same(lambda r, c, v: F.when(f.at(r - dr, c - dc) == source, source).when((v == source) & F.lit(erase), g.bg).otherwise(v))


@search_step
def translate_layer(g: Ground, source: int, dr: int, dc: int) -> DataFrame:
    return _shifted(g, source, g.layer(source), F.lit(dr), F.lit(dc))


@search_step
def copy_layer(g: Ground, source: int, dr: int, dc: int) -> DataFrame:
    return _shifted(g, source, g.layer(source), F.lit(dr), F.lit(dc), erase=False)


@search_step
def align_layers(g: Ground, source: int, target: int, axis: int, anchor: str) -> DataFrame:
    """The layer moves along an axis until its least, greatest or middle place there is the target's."""
    f, a, b = g.f, g.layer(source), f_cells(g, target)
    places = lambda x: F.transform(x, lambda y: y["r" if axis == 0 else "c"])
    twice = lambda x: {"min": 2 * F.array_min(places(x)), "max": 2 * F.array_max(places(x)), "center": F.array_min(places(x)) + F.array_max(places(x))}[anchor]
    d = f.let(twice(b) - twice(a))
    f.fail(d % 2 != 0, "no whole step")
    step = f.let(F.floor(d / 2).cast("int"))
    return _shifted(g, source, a, *((step, F.lit(0)) if axis == 0 else (F.lit(0), step)))


def f_cells(g: Ground, colour: int) -> Column:
    """The cells of a colour that may be the background; a grid without any is refused."""
    own = g.f.let(F.filter(g.everything, lambda x: x["v"] == colour))
    g.f.fail(F.size(own) == 0, "layer is missing")
    return own


@search_step
def move_layer_until_touch(g: Ground, source: int, target: int, direction: str) -> DataFrame:
    f, own, (dy, dx) = g.f, g.layer(source), WAYS[direction]
    f_cells(g, target)
    to = lambda x, k, a=0, b=0: f.at(x["r"] + k * dy + a, x["c"] + k * dx + b)
    free = lambda k: F.forall(own, lambda x: F.coalesce(~g.blocked(to(x, k), source), F.lit(False)))
    touches = lambda k: F.exists(own, lambda x: F.exists(F.array(*[to(x, k, a, b) for a, b in WAYS.values()]), lambda v: F.coalesce(v == target, F.lit(False))))
    k = f.let(F.get(F.filter(F.sequence(F.lit(0), F.lit(MAX_SIZE)), lambda k: ~free(k) | touches(k)), F.lit(0)))
    f.fail(k.isNull(), "no contact")
    return _shifted(g, source, own, k * dy, k * dx)


@search_step
def recolor_layer(g: Ground, source: int, target: int) -> DataFrame:
    g.f.fail(g.bg == source, "layer is missing")
    return g.f.same(lambda r, c, v: F.when(v == source, target).otherwise(v))


@search_step
def swap_layers(g: Ground, source: int, target: int) -> DataFrame:
    g.f.fail(g.bg == source, "layer is missing")
    f_cells(g, target)
    return g.f.same(lambda r, c, v: F.when(v == source, target).when(v == target, source).otherwise(v))


@search_step
def fill_layer_holes(g: Ground, source: int) -> DataFrame:
    g.f.fail(g.bg == source, "layer is missing")
    inner = _inner(g, lambda v: v == source)
    return g.f.same(lambda r, c, v: F.when((v == g.bg) & inner(r, c), source).otherwise(v))


@search_step
def keep_objects_(g: Ground, selector: str = "all", source: int | None = None) -> DataFrame:
    p = g.picked(selector, source)
    return g.f.same(lambda r, c, v: F.when(p.here(r, c), v).otherwise(g.bg))


@search_step
def delete_objects_(g: Ground, selector: str = "all", source: int | None = None) -> DataFrame:
    p = g.picked(selector, source)
    return g.f.same(lambda r, c, v: F.when(p.here(r, c), g.bg).otherwise(v))


@search_step
def crop_objects(g: Ground, selector: str = "all", source: int | None = None) -> DataFrame:
    return crop_selected(_Plain(g), selector, source)


class _Plain:
    """A ground whose selectors compare shapes as they are."""

    def __init__(self, g: Ground):
        self.f, self.bg, self.picked = g.f, g.bg, lambda selector, source, _: g.picked(selector, source)


@search_step
def recolor_objects_(g: Ground, target: int, selector: str = "all", source: int | None = None) -> DataFrame:
    p = g.picked(selector, source)
    return g.f.same(lambda r, c, v: F.when(p.here(r, c), target).otherwise(v))


def boxed(grid: np.ndarray, bg: int, parts: list[np.ndarray], ring: bool) -> list[list[int]] | None:
    """Each component gives way to its filled box, or to the box's ring, one after another: by the colours' first places in the
    grid, then in reading order.  None where a box would go over another colour, as it stands when its turn comes."""
    out, flat_ = grid.copy(), grid.ravel().tolist()
    colour = lambda p: int(grid[p[0] // 32, p[0] % 32])
    for part in sorted(parts, key=lambda p: (flat_.index(colour(p)), int(p[0]))):
        r, c, own = part // 32, part % 32, colour(part)
        box = out[r.min() : r.max() + 1, c.min() : c.max() + 1]
        painted = np.ones(box.shape, bool)
        if ring:
            painted[1:-1, 1:-1] = False
        held = box[painted]
        if ((held != bg) & (held != own)).any():
            return None
        out[r, c] = bg
        box[painted] = own
    return out.tolist()


def _boxes(g: Ground, p: Picked, ring: bool) -> DataFrame:
    """As ``_boxed``, but refused where a box would go over another colour."""
    f = g.f
    parts = f.let(F.transform(p.list, lambda x: F.transform(x["cells"], lambda y: y["r"] * 32 + y["c"])))
    out = f.let(_simulated(lambda grid, bg, held: boxed(grid, bg, held, ring))(f.g, g.bg, parts))
    f.fail(out.isNull(), "in the way")
    return f.finish(f.h, f.w, out)


@search_step
def fill_object_boxes(g: Ground, selector: str = "all", source: int | None = None) -> DataFrame:
    return _boxes(g, g.picked(selector, source), False)


@search_step
def outline_object_boxes(g: Ground, selector: str = "all", source: int | None = None) -> DataFrame:
    return _boxes(g, g.picked(selector, source), True)


def _over(i: Column, n: int) -> Column:
    return F.floor(i / n).cast("int")


@search_step
def scale_pixels(g: Ground, rows: int, columns: int) -> DataFrame:
    return g.f.out(g.f.h * rows, g.f.w * columns, lambda r, c: g.f.at(_over(r, rows), _over(c, columns)))


@search_step
def reduce_blocks(g: Ground, rows: int, columns: int) -> DataFrame:
    f = g.f
    f.fail((f.h % rows != 0) | (f.w % columns != 0), "not divisible")
    f.fail(F.exists(g.everything, lambda x: x["v"] != f.at(_over(x["r"], rows) * rows, _over(x["c"], columns) * columns)), "block is not uniform")
    return f.out(F.floor(f.h / rows), F.floor(f.w / columns), lambda r, c: f.at(r * rows, c * columns))


@search_step
def tile_grid(g: Ground, rows: int, columns: int) -> DataFrame:
    return g.f.out(g.f.h * rows, g.f.w * columns, lambda r, c: g.f.at(r % g.f.h, c % g.f.w))


@search_step
def mirror_tile(g: Ground, rows: int, columns: int) -> DataFrame:
    folded = lambda i, n: F.when(F.floor(i / n) % 2 == 1, n - 1 - i % n).otherwise(i % n)
    return g.f.out(g.f.h * rows, g.f.w * columns, lambda r, c: g.f.at(folded(r, g.f.h), folded(c, g.f.w)))


@search_step
def trim_uniform_border(g: Ground) -> DataFrame:
    """Rings of the corner's colour go from outside, down to two rows or columns."""
    f = g.f
    corner = f.let(f.at(F.lit(0), F.lit(0)))
    ring = lambda x, k: (x["r"] == k) | (x["c"] == k) | (x["r"] == f.h - 1 - k) | (x["c"] == f.w - 1 - k)
    outside = lambda x, k: (x["r"] < k) | (x["c"] < k) | (x["r"] > f.h - 1 - k) | (x["c"] > f.w - 1 - k)
    plain = lambda k: F.forall(g.everything, lambda x: outside(x, k) | ~ring(x, k) | (x["v"] == corner))
    k = f.let(F.get(F.filter(F.sequence(F.lit(0), F.lit(MAX_SIZE)), lambda k: (F.least(f.h, f.w) - 2 * k <= 2) | ~plain(k)), F.lit(0)))
    return f.out(f.h - 2 * k, f.w - 2 * k, lambda r, c: f.at(r + k, c + k))


@search_step
def select_panel(g: Ground, partition: dict, index: int) -> DataFrame:
    p = Panels(g.f, partition)
    return g.f.out(p.h, p.w, lambda r, c: p.at(index, r, c))


@search_step
def panel_logic(g: Ground, partition: dict, mode: str, backgrounds: list[int], paint: int, output_bg: int) -> DataFrame:
    p = Panels(g.f, partition)
    return g.f.out(p.h, p.w, lambda r, c: F.when(logic(mode, [p.at(i, r, c) != b for i, b in enumerate(backgrounds)]), paint).otherwise(output_bg))


@search_step
def panel_overlay(g: Ground, partition: dict, order: list[int], backgrounds: list[int], output_bg: int) -> DataFrame:
    """Panels drawn over each other, the last of ``order`` on top."""
    p = Panels(g.f, partition)
    return g.f.out(p.h, p.w, lambda r, c: F.coalesce(*[F.when(p.at(i, r, c) != backgrounds[i], p.at(i, r, c)) for i in reversed(order)], F.lit(output_bg)))
