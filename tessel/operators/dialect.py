"""The relation dialect: 19 operators on whole colour layers, with an inferred background.

They differ from the main bank in their edge rules (nothing is clipped or overwritten: such grids are refused), so they
have a registry of their own.  ``source`` and ``target`` are colours; the background is the commonest border value
(corners count twice; ties: the smallest).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.grids import Frame, at, cells, make
from tessel.functions.labels import regions
from tessel.operators.geometry import commonest

RELATIONS: dict[str, Callable[..., DataFrame]] = {}


class Layers:
    def __init__(self, f: Frame, source: int, target: int | None, needs_target: bool):
        self.f, self.source, self.target = f, source, target
        g = f.g
        last = F.get(g, f.h - 1)
        edges = F.concat(F.get(g, F.lit(0)), last, F.transform(g, lambda row: F.get(row, F.lit(0))), F.transform(g, lambda row: F.get(row, f.w - 1)))
        self.bg = f.let(commonest(f.let(edges), 0))
        everything = f.let(cells(g))
        self.src = f.let(F.filter(everything, lambda x: x["v"] == source))
        self.tgt = f.let(F.filter(everything, lambda x: x["v"] == (-1 if target is None else target)))
        f.fail((F.size(self.src) == 0) | (F.size(self.tgt) == 0 if needs_target else F.lit(False)), "layer is missing")
        row, column = F.transform(self.src, lambda x: x["r"]), F.transform(self.src, lambda x: x["c"])
        self.box = f.let(F.struct(F.array_min(row).alias("r0"), F.array_max(row).alias("r1"), F.array_min(column).alias("c0"), F.array_max(column).alias("c1")))

    def inside(self, r: Column, c: Column) -> Column:
        b = self.box
        return (r >= b["r0"]) & (r <= b["r1"]) & (c >= b["c0"]) & (c <= b["c1"])

    def toward(self, sign: int) -> tuple[Column, Column]:
        """One step along the axis on which the layers' centres are further apart; rows win ties."""
        mean = lambda x, n: F.try_divide(F.aggregate(x, F.lit(0.0), lambda a, y: a + y[n]), F.size(x))
        f = self.f
        dy, dx = f.let(mean(self.tgt, "r") - mean(self.src, "r")), f.let(mean(self.tgt, "c") - mean(self.src, "c"))
        down = F.abs(dy) >= F.abs(dx)
        return f.let(F.when(down, F.when(dy > 0, sign).otherwise(-sign)).otherwise(0)), f.let(F.when(down, 0).otherwise(F.when(dx > 0, sign).otherwise(-sign)))

    def moved(self, dy: Column, dx: Column, erase: bool = True) -> DataFrame:
        f, source = self.f, self.source
        place = lambda x: f.at(x["r"] + dy, x["c"] + dx)
        f.fail(F.exists(self.src, lambda x: place(x).isNull() | ~((place(x) == self.bg) | (place(x) == source))), "in the way or off the grid")
        return f.same(lambda r, c, v: F.when(f.at(r - dy, c - dx) == source, source).when((v == source) & F.lit(erase), self.bg).otherwise(v))

    def until(self, dy: Column, dx: Column, touch: bool) -> tuple[Column, Column]:
        """The way until the next step leaves the grid or meets the target, or the layers touch."""
        f = self.f
        here = lambda x, k, a=0, b=0: f.at(x["r"] + k * dy + a, x["c"] + k * dx + b)

        def stops(k: Column) -> Column:
            blocked = F.exists(self.src, lambda x: here(x, k + 1).isNull() | (here(x, k + 1) == self.target))
            if not touch:
                return blocked
            beside = lambda x: F.array_contains(F.array(*[F.coalesce(here(x, k, a, b), F.lit(-1)) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))]), self.target)
            return blocked | F.exists(self.src, beside)

        k = f.let(F.coalesce(F.get(F.filter(F.sequence(F.lit(0), 2 * F.greatest(f.h, f.w)), stops), F.lit(0)), 2 * F.greatest(f.h, f.w)))
        return f.let(k * dy), f.let(k * dx)


def relation(needs_target: bool) -> Callable[[Callable[[Layers], DataFrame]], Callable[[Layers], DataFrame]]:
    def register(build: Callable[[Layers], DataFrame]) -> Callable[[Layers], DataFrame]:
        RELATIONS[build.__name__] = lambda grids, source, target=None: build(Layers(Frame(grids), source, target, needs_target))
        return build

    return register


RELATIONS["identity"] = lambda grids, source=None, target=None: grids


@relation(True)
def recolor_as_context(x: Layers) -> DataFrame:
    return x.f.same(lambda r, c, v: F.when(v == x.source, x.target).otherwise(v))


@relation(True)
def swap_source_context_colors(x: Layers) -> DataFrame:
    return x.f.same(lambda r, c, v: F.when(v == x.source, x.target).when(v == x.target, x.source).otherwise(v))


@relation(False)
def delete_source(x: Layers) -> DataFrame:
    return x.f.same(lambda r, c, v: F.when(v == x.source, x.bg).otherwise(v))


@relation(False)
def fill_bbox(x: Layers) -> DataFrame:
    return x.f.same(lambda r, c, v: F.when(x.inside(r, c), x.source).otherwise(v))


@relation(False)
def outline_bbox(x: Layers) -> DataFrame:
    b = x.box
    edge = lambda r, c: x.inside(r, c) & ((r == b["r0"]) | (r == b["r1"]) | (c == b["c0"]) | (c == b["c1"]))
    return x.f.same(lambda r, c, v: F.when(edge(r, c), x.source).when(v == x.source, x.bg).otherwise(v))


@relation(False)
def fill_holes(x: Layers) -> DataFrame:
    f, b = x.f, x.box
    mask = f.let(make(F.coalesce(b["r1"] - b["r0"] + 3, F.lit(1)), F.coalesce(b["c1"] - b["c0"] + 3, F.lit(1)), lambda r, c: F.when(x.inside(r + b["r0"] - 1, c + b["c0"] - 1) & (f.at(r + b["r0"] - 1, c + b["c0"] - 1) == x.source), 1).otherwise(0)))
    lab = f.let(regions(mask, [0]))
    hole = lambda r, c: at(lab, r - b["r0"] + 1, c - b["c0"] + 1) > 1  # noqa: E731  the ring around it is region 1
    return f.same(lambda r, c, v: F.when(x.inside(r, c) & hole(r, c), x.source).otherwise(v))


def _turned(x: Layers, source_of, swaps: bool) -> DataFrame:
    """The source's mask turned in place, its upper left corner kept."""
    f, b = x.f, x.box
    h, w = b["r1"] - b["r0"] + 1, b["c1"] - b["c0"] + 1
    th, tw = (w, h) if swaps else (h, w)

    def lands(r: Column, c: Column) -> Column:
        y, z = source_of(r - b["r0"], c - b["c0"], h, w)
        within = (r >= b["r0"]) & (c >= b["c0"]) & (r < b["r0"] + th) & (c < b["c0"] + tw)
        return within & F.coalesce(f.at(b["r0"] + y, b["c0"] + z) == x.source, F.lit(False))

    f.fail((b["r0"] + th > f.h) | (b["c0"] + tw > f.w) | F.exists(cells(f.g), lambda k: lands(k["r"], k["c"]) & (k["v"] != x.bg) & (k["v"] != x.source)), "in the way or off the grid")
    return f.same(lambda r, c, v: F.when(lands(r, c), x.source).when(v == x.source, x.bg).otherwise(v))


@relation(False)
def rotate90(x: Layers) -> DataFrame:
    return _turned(x, lambda r, c, h, w: (c, w - 1 - r), True)


@relation(False)
def rotate180(x: Layers) -> DataFrame:
    return _turned(x, lambda r, c, h, w: (h - 1 - r, w - 1 - c), False)


@relation(False)
def reflect_left_right(x: Layers) -> DataFrame:
    return _turned(x, lambda r, c, h, w: (r, w - 1 - c), False)


@relation(False)
def reflect_up_down(x: Layers) -> DataFrame:
    return _turned(x, lambda r, c, h, w: (h - 1 - r, c), False)


@relation(True)
def move_toward(x: Layers) -> DataFrame:
    return x.moved(*x.toward(1))


@relation(True)
def move_away(x: Layers) -> DataFrame:
    return x.moved(*x.toward(-1))


@relation(True)
def copy_toward(x: Layers) -> DataFrame:
    return x.moved(*x.toward(1), erase=False)


@relation(True)
def move_until_touch(x: Layers) -> DataFrame:
    return x.moved(*x.until(*x.toward(1), touch=True))


@relation(True)
def move_away_until_border(x: Layers) -> DataFrame:
    return x.moved(*x.until(*x.toward(-1), touch=False))


@relation(True)
def align_row(x: Layers) -> DataFrame:
    first = lambda cells: F.array_min(F.transform(cells, lambda y: y["r"]))
    return x.moved(x.f.let(first(x.tgt) - first(x.src)), F.lit(0))


@relation(True)
def align_column(x: Layers) -> DataFrame:
    first = lambda cells: F.array_min(F.transform(cells, lambda y: y["c"]))
    return x.moved(F.lit(0), x.f.let(first(x.tgt) - first(x.src)))


@relation(True)
def connect_source_to_context(x: Layers) -> DataFrame:
    """A path from the nearest source cell, first along its column, then along the target cell's row."""
    f = x.f
    pairs = F.flatten(F.transform(x.src, lambda a: F.transform(x.tgt, lambda b: F.struct((F.abs(a["r"] - b["r"]) + F.abs(a["c"] - b["c"])).alias("d"), a["r"].alias("r"), a["c"].alias("c"), b["r"].alias("tr"), b["c"].alias("tc")))))
    p = f.let(F.array_min(pairs))
    between = lambda i, a, b: (i >= F.least(a, b)) & (i <= F.greatest(a, b))
    down = lambda r, c: (c == p["c"]) & between(r, p["r"], p["tr"])
    along = lambda r, c: (r == p["tr"]) & between(c, p["c"], p["tc"])
    ends = lambda r, c: ((r == p["tr"]) & (c == p["tc"])) | ((r == p["r"]) & (c == p["c"]))
    return f.same(lambda r, c, v: F.when((down(r, c) | along(r, c)) & ~ends(r, c), x.source).otherwise(v))
