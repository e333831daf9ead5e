"""Line operators, and those of grids that separator lines cut into panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.grids import Frame, cells
from tessel.operators.base import operator
from tessel.operators.geometry import commonest

UP, DOWN, LEFT, RIGHT = (-1, 0), (1, 0), (0, -1), (0, 1)
UL, UR, DL, DR = (-1, -1), (-1, 1), (1, -1), (1, 1)
#: The named sets of ray directions and of stamp offsets.
RAYS = {
    "up": [UP], "down": [DOWN], "left": [LEFT], "right": [RIGHT], "h": [LEFT, RIGHT], "v": [UP, DOWN], "cross": [UP, DOWN, LEFT, RIGHT],
    "diag": [UL, UR, DL, DR], "ul": [UL], "ur": [UR], "dl": [DL], "dr": [DR], "star": [UP, DOWN, LEFT, RIGHT, UL, UR, DL, DR],
}
STAMPS = {"plus": [UP, DOWN, LEFT, RIGHT], "x": [UL, UR, DL, DR], "ring": [UL, UP, UR, LEFT, RIGHT, DL, DOWN, DR], "row": [LEFT, RIGHT], "col": [UP, DOWN]}


def looking(f: Frame, r: Column, c: Column, dy: int, dx: int) -> Column:
    """The first foreground cell from (r, c) in a direction: struct k (distance), v; null if there is none."""
    steps = F.sequence(F.lit(1), F.greatest(f.h, f.w))
    k = F.get(F.filter(steps, lambda k: F.coalesce(f.at(r + k * dy, c + k * dx), F.lit(0)) != 0), F.lit(0))
    return F.when(k.isNotNull(), F.struct(k.alias("k"), f.at(r + k * dy, c + k * dx).alias("v"), (r + k * dy).alias("r"), (c + k * dx).alias("c")))


@operator("line")
def shoot_rays(f: Frame, src: int, dir: str) -> DataFrame:
    """A background cell takes the colour of the source it sees against a ray; of several, the last in row-major order."""

    def cell(r: Column, c: Column, v: Column) -> Column:
        seen = F.array(*[looking(f, r, c, -dy, -dx) for dy, dx in RAYS[dir]])
        hits = F.filter(seen, lambda x: x.isNotNull() & ((x["v"] == src) if src >= 0 else F.lit(True)))
        last = F.array_max(F.transform(hits, lambda x: F.struct(x["r"], x["c"], x["v"].alias("v"))))
        return F.when(v == 0, F.coalesce(last["v"], F.lit(0))).otherwise(v)

    return f.same(cell)


@operator("line")
def connect_pairs(f: Frame, src: int, line: int, axis: int = 2) -> DataFrame:
    """Cells between two neighbouring matching cells of one colour in a row (0), column (1) or either; rows come first."""

    def between(r: Column, c: Column, dy: int, dx: int) -> Column:
        steps = F.sequence(F.lit(1), F.greatest(f.h, f.w))

        def near(s: int) -> Column:
            value = lambda k: F.coalesce(f.at(r + k * (s * dy), c + k * (s * dx)), F.lit(0))
            hit = F.get(F.filter(steps, lambda k: (value(k) == src) if src >= 0 else (value(k) != 0)), F.lit(0))
            return F.when(hit.isNotNull(), value(hit))

        one, other = near(-1), near(1)
        return F.when(one == other, one if line < 0 else F.lit(line))

    ways = [(0, 1)] * (axis in (0, 2)) + [(1, 0)] * (axis in (1, 2))
    return f.same(lambda r, c, v: F.when(v == 0, F.coalesce(*[between(r, c, dy, dx) for dy, dx in ways], F.lit(0))).otherwise(v))


@operator("line")
def fill_lines(f: Frame, src: int, axis: int, color: int) -> DataFrame:
    own = f.let(F.filter(cells(f.g), lambda x: x["v"] == src))
    rows, columns = f.let(F.transform(own, lambda x: x["r"])), f.let(F.transform(own, lambda x: x["c"]))
    in_row = lambda r: F.array_contains(rows, r) if axis in (0, 2) else F.lit(False)
    in_column = lambda c: F.array_contains(columns, c) if axis in (1, 2) else F.lit(False)
    return f.same(lambda r, c, v: F.when((v == 0) & (in_row(r) | in_column(c)), color).otherwise(v))


@operator("line")
def stamp_shape(f: Frame, src: int, shape: str, color: int) -> DataFrame:
    near = lambda r, c: F.array_contains(F.array(*[F.coalesce(f.at(r - dy, c - dx), F.lit(-1)) for dy, dx in STAMPS[shape]]), src)
    return f.same(lambda r, c, v: F.when((v == 0) & near(r, c), src if color < 0 else color).otherwise(v))


@operator("line")
def full_lines(f: Frame, src: int, dir: str) -> DataFrame:
    """Background cells on a line through a source cell, over any obstacle."""
    own = f.let(F.filter(cells(f.g), lambda x: x["v"] == src))

    def on(r: Column, c: Column) -> Column:
        def met(x: Column) -> Column:
            tests = []
            for dy, dx in RAYS[dir]:
                y, z = r - x["r"], c - x["c"]
                k = y * dy if dy else z * dx
                tests.append((k > 0) & (y == k * dy) & (z == k * dx))
            hit = tests[0]
            for t in tests[1:]:
                hit = hit | t
            return hit

        return F.exists(own, met)

    return f.same(lambda r, c, v: F.when((v == 0) & on(r, c), src).otherwise(v))


@operator("line")
def connect_diag(f: Frame, src: int, line: int) -> DataFrame:
    """Background cells between two cells of one colour that face each other along a diagonal; of two diagonals, the later pair's."""

    def cell(r: Column, c: Column, v: Column) -> Column:
        pairs = []
        for dx in (1, -1):
            up, down = looking(f, r, c, -1, -dx), looking(f, r, c, 1, dx)
            matches = (up["v"] == down["v"]) & ((up["v"] == src) if src >= 0 else F.lit(True))
            pairs.append(F.when(matches, F.struct(up["r"], up["c"], down["r"], down["c"], up["v"].alias("v"))))
        last = F.array_max(F.array(*pairs))
        return F.when(v == 0, F.when(last.isNotNull(), last["v"] if line < 0 else F.lit(line)).otherwise(0)).otherwise(v)

    return f.same(cell)


class Panels:
    """The panels between separator lines: ``spans`` of rows and of columns (structs a, b; b excluded)."""

    def __init__(self, f: Frame):
        self.f = f
        columns = f.let(F.transform(F.get(f.g, F.lit(0)), lambda _, c: F.transform(f.g, lambda row: F.get(row, c))))
        uniform = lambda line: (F.get(line, F.lit(0)) != 0) & (F.size(F.array_distinct(line)) == 1)
        first = F.get(F.filter(F.concat(f.g, columns), uniform), F.lit(0))
        self.separator = f.let(F.get(first, F.lit(0)))
        self.rows, self.columns = (f.let(self._spans(lines, n)) for lines, n in ((f.g, f.h), (columns, f.w)))
        self.n = f.let(F.size(self.rows) * F.size(self.columns))
        f.fail(self.separator.isNull() | (self.n < 2), "no panels")

    def _spans(self, lines: Column, n: Column) -> Column:
        separator = self.separator
        cut = lambda line: F.forall(line, lambda v: v == separator)
        cuts = self.f.let(F.concat(F.array(F.lit(-1)), F.filter(F.transform(lines, lambda line, i: F.when(cut(line), i)), lambda i: i.isNotNull()), F.array(n)))
        pairs = F.transform(F.slice(cuts, 1, F.greatest(F.size(cuts) - 1, F.lit(1))), lambda x, i: F.struct((x + 1).alias("a"), F.get(cuts, i + 1).alias("b")))
        return F.filter(pairs, lambda s: s["b"] > s["a"])

    def all(self) -> Column:
        """The panels row by row: structs i, j, r, s (span of rows), c, d (of columns), values."""
        f = self.f
        inside = lambda y, x: F.flatten(F.transform(F.slice(f.g, y["a"] + 1, y["b"] - y["a"]), lambda row: F.slice(row, x["a"] + 1, x["b"] - x["a"])))
        columns = self.columns
        return f.let(F.flatten(F.transform(self.rows, lambda y, i: F.transform(columns, lambda x, j: F.struct(i.alias("i"), j.alias("j"), y["a"].alias("r"), y["b"].alias("s"), x["a"].alias("c"), x["b"].alias("d"), inside(y, x).alias("values"))))))


def _filled(values: Column) -> Column:
    return F.size(F.filter(values, lambda v: v != 0))


@operator("structure")
def select_cell(f: Frame, mode: str) -> DataFrame:
    panels = Panels(f).all()
    counts = f.let(F.transform(panels, lambda p: _filled(p["values"])))
    best = f.let(F.array_max(counts) if mode == "most" else F.array_min(counts))
    f.fail(F.size(F.filter(counts, lambda n: n == best)) != 1, "not unique")
    own = f.let(F.get(panels, (F.array_position(counts, best) - 1).cast("int")))
    return f.out(own["s"] - own["r"], own["d"] - own["c"], lambda r, c: f.at(own["r"] + r, own["c"] + c))


@operator("structure")
def overlay_cells(f: Frame, order: str) -> DataFrame:
    panels = Panels(f).all()
    listed = panels if order == "fwd" else f.let(F.reverse(panels))
    one = F.get(panels, F.lit(0))
    h, w = one["s"] - one["r"], one["d"] - one["c"]
    f.fail(F.exists(panels, lambda p: (p["s"] - p["r"] != h) | (p["d"] - p["c"] != w)), "sizes differ")
    value = lambda r, c: F.get(F.filter(F.transform(listed, lambda p: f.at(p["r"] + r, p["c"] + c)), lambda v: v != 0), F.lit(0))
    return f.out(h, w, lambda r, c: F.coalesce(value(r, c), F.lit(0)))


@operator("structure")
def cells_to_pixels(f: Frame) -> DataFrame:
    p = Panels(f)
    panels = p.all()
    colors = f.let(F.transform(panels, lambda x: F.when(_filled(x["values"]) > 0, commonest(x["values"], 1)).otherwise(0)))
    w = F.size(p.columns)
    return f.out(F.size(p.rows), w, lambda r, c: F.get(colors, r * w + c))


@operator("relation")
def fill_cells(f: Frame, mode: str, color: int) -> DataFrame:
    panels = Panels(f).all()
    chosen = F.filter(panels, lambda p: (_filled(p["values"]) > 0) if mode == "nonempty" else (_filled(p["values"]) == 0))
    if color < 0 and mode == "empty":
        f.fail(F.size(chosen) > 0, "needs an explicit colour")
    painted = f.let(F.transform(chosen, lambda p: F.struct(p["r"].alias("r"), p["s"].alias("s"), p["c"].alias("c"), p["d"].alias("d"), (commonest(p["values"], 1) if color < 0 else F.lit(color)).alias("v"))))
    inside = lambda r, c: F.get(F.filter(painted, lambda p: (r >= p["r"]) & (r < p["s"]) & (c >= p["c"]) & (c < p["d"])), F.lit(0))["v"]
    return f.same(lambda r, c, v: F.coalesce(inside(r, c), v))


