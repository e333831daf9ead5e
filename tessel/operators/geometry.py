"""Geometry operators: moves, crops, tilings and symmetries of whole grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.grids import Frame, at, cells, flat, lit, make
from tessel.operators.base import operator

#: Where cell (r, c) of a transformed h x w grid comes from.
SOURCES = {
    "id": lambda r, c, h, w: (r, c),
    "flip_h": lambda r, c, h, w: (r, w - 1 - c),
    "flip_v": lambda r, c, h, w: (h - 1 - r, c),
    "rot180": lambda r, c, h, w: (h - 1 - r, w - 1 - c),
    "rot90": lambda r, c, h, w: (c, w - 1 - r),
    "rot270": lambda r, c, h, w: (h - 1 - c, r),
    "transpose": lambda r, c, h, w: (c, r),
    "anti_transpose": lambda r, c, h, w: (h - 1 - c, w - 1 - r),
}
TURNED = {"rot90", "rot270", "transpose", "anti_transpose"}
_SYMMETRY = {"h": [["flip_h"]], "v": [["flip_v"]], "both": [["flip_h"], ["flip_v"]], "rot": [["rot90"], ["rot180"], ["rot270"]], "d4": [["rot90"], ["rot180"], ["rot270"], ["flip_h"]]}


def transformed(f: Frame, name: str) -> DataFrame:
    h, w = (f.w, f.h) if name in TURNED else (f.h, f.w)
    return f.out(h, w, lambda r, c: f.at(*SOURCES[name](r, c, f.h, f.w)))


@operator("geometry")
def rot90(f: Frame, k: int) -> DataFrame:
    return transformed(f, ["id", "rot90", "rot180", "rot270"][k % 4])


@operator("geometry")
def flip(f: Frame, axis: int) -> DataFrame:
    return transformed(f, "flip_v" if axis == 0 else "flip_h")


@operator("geometry")
def transpose(f: Frame) -> DataFrame:
    return transformed(f, "transpose")


@operator("geometry")
def anti_transpose(f: Frame) -> DataFrame:
    return transformed(f, "anti_transpose")


@operator("geometry")
def translate(f: Frame, dy: int, dx: int, wrap: bool) -> DataFrame:
    if wrap:
        return f.same(lambda r, c, v: f.at(F.pmod(r - dy, f.h), F.pmod(c - dx, f.w)))
    f.fail((F.abs(lit(dy)) >= f.h) | (F.abs(lit(dx)) >= f.w), "shift too large")
    return f.same(lambda r, c, v: F.coalesce(f.at(r - dy, c - dx), F.lit(0)))


@operator("geometry")
def crop_to_content(f: Frame) -> DataFrame:
    return f.crop(f.box(lambda x: x["v"] != 0))


@operator("geometry")
def crop_to_color(f: Frame, color: int, inner: bool) -> DataFrame:
    box = f.box(lambda x: x["v"] == color)
    d = int(inner)
    return f.crop(f.let(F.struct((box["r0"] + d).alias("r0"), (box["r1"] - d).alias("r1"), (box["c0"] + d).alias("c0"), (box["c1"] - d).alias("c1"))))


@operator("geometry")
def pad(f: Frame, n: int, color: int) -> DataFrame:
    return f.out(f.h + 2 * n, f.w + 2 * n, lambda r, c: F.coalesce(f.at(r - n, c - n), F.lit(color)))


@operator("geometry")
def pad_replicate(f: Frame, n: int, corners: bool) -> DataFrame:
    inside = lambda i, size: F.least(F.greatest(i - n, F.lit(0)), size - 1)
    beyond = lambda i, size: (i < n) | (i >= size + n)
    value = lambda r, c: f.at(inside(r, f.h), inside(c, f.w))
    return f.out(f.h + 2 * n, f.w + 2 * n, lambda r, c: F.when(beyond(r, f.h) & beyond(c, f.w), 0).otherwise(value(r, c)) if corners else value(r, c))


@operator("geometry")
def scale_up(f: Frame, k: int) -> DataFrame:
    return f.out(f.h * k, f.w * k, lambda r, c: f.at(F.floor(r / k).cast("int"), F.floor(c / k).cast("int")))


@operator("geometry")
def scale_by_colors(f: Frame) -> DataFrame:
    ordered, _ = f.ranked()
    k = f.let(F.size(ordered))
    f.fail(k < 2, "one colour")
    return f.out(f.h * k, f.w * k, lambda r, c: f.at(F.floor(r / k).cast("int"), F.floor(c / k).cast("int")))


def _block(f: Frame, r: Column, c: Column, k: int) -> Column:
    """The cells of a k x k block, cut off at the border."""
    return F.flatten(F.transform(F.slice(f.g, r * k + 1, k), lambda row: F.slice(row, c * k + 1, k)))


@operator("geometry")
def scale_down(f: Frame, k: int) -> DataFrame:
    f.fail((f.h % k != 0) | (f.w % k != 0), "not divisible")
    h, w = f.let(F.greatest(F.lit(1), F.floor(f.h / k)).cast("int")), f.let(F.greatest(F.lit(1), F.floor(f.w / k)).cast("int"))
    uniform = f.let(flat(make(h, w, lambda r, c: F.size(F.array_distinct(_block(f, r, c, k))))))
    f.fail(F.exists(uniform, lambda n: n != 1), "block is not uniform")
    return f.out(h, w, lambda r, c: f.at(r * k, c * k))


def commonest(values: Column, least: int) -> Column:
    """Commonest of the values from ``least`` on; ties: the smallest."""
    return -F.array_max(F.transform(F.sequence(F.lit(least), F.lit(9)), lambda v: F.struct(F.size(F.filter(values, lambda x: x == v)), (-v).alias("v"))))["v"]


@operator("geometry")
def pool(f: Frame, k: int, mode: str) -> DataFrame:
    f.fail((f.h % k != 0) | (f.w % k != 0), "not divisible")

    def cell(r: Column, c: Column) -> Column:
        block = _block(f, r, c, k)
        if mode == "any":
            return F.when(F.exists(block, lambda v: v != 0), commonest(block, 1)).otherwise(0)
        if mode == "major":
            return commonest(block, 0)
        return F.when(F.size(F.array_distinct(block)) == 1, F.get(block, F.lit(0))).otherwise(0)

    return f.out(F.floor(f.h / k), F.floor(f.w / k), cell)


@operator("geometry")
def tile(f: Frame, ny: int, nx: int) -> DataFrame:
    f.fail(F.lit(ny * nx < 2), "one tile")
    return f.out(f.h * ny, f.w * nx, lambda r, c: f.at(r % f.h, c % f.w))


@operator("geometry")
def tile_flip(f: Frame, ny: int, nx: int) -> DataFrame:
    f.fail(F.lit(ny * nx < 2), "one tile")
    folded = lambda i, n: F.when(F.floor(i / n) % 2 == 1, n - 1 - i % n).otherwise(i % n)
    return f.out(f.h * ny, f.w * nx, lambda r, c: f.at(folded(r, f.h), folded(c, f.w)))


@operator("geometry")
def mirror_concat(f: Frame, mode: str) -> DataFrame:
    across, down = mode in ("h", "both"), mode in ("v", "both")
    folded = lambda i, n: F.when(i < n, i).otherwise(2 * n - 1 - i)
    return f.out(f.h * (1 + down), f.w * (1 + across), lambda r, c: f.at(folded(r, f.h), folded(c, f.w)))


def completed(f: Frame, grid: Column, h: Column, w: Column, mode: str) -> Column:
    """``grid`` overlaid with its mirrored or turned copies one after another; what is there first stays."""
    for (name,) in _SYMMETRY[mode]:
        grid = f.let(make(h, w, lambda r, c, g=grid, n=name: F.when(at(g, r, c) != 0, at(g, r, c)).otherwise(F.coalesce(at(g, *SOURCES[n](r, c, h, w)), F.lit(0)))))
    return grid


@operator("geometry")
def symmetrize(f: Frame, mode: str) -> DataFrame:
    if mode in ("rot", "d4"):
        f.fail(f.h != f.w, "not square")
    return f.finish(f.h, f.w, completed(f, f.g, f.h, f.w, mode))


@operator("geometry")
def symmetrize_bbox(f: Frame, mode: str) -> DataFrame:
    box = f.box(lambda x: x["v"] != 0)
    h, w = f.let(F.coalesce(box["r1"] - box["r0"] + 1, F.lit(1))), f.let(F.coalesce(box["c1"] - box["c0"] + 1, F.lit(1)))
    f.fail(box["r0"].isNull(), "empty")
    if mode in ("rot", "d4"):
        f.fail(h != w, "not square")
    part = completed(f, f.let(make(h, w, lambda r, c: F.coalesce(f.at(box["r0"] + r, box["c0"] + c), F.lit(0)))), h, w, mode)
    return f.same(lambda r, c, v: F.coalesce(at(part, r - box["r0"], c - box["c0"]), v))


@operator("geometry")
def half(f: Frame, which: str) -> DataFrame:
    down = which in ("top", "bottom")
    n = f.h if down else f.w
    size = F.floor(n / 2).cast("int")
    start = F.floor((n + 1) / 2).cast("int") if which in ("bottom", "right") else F.lit(0)
    return f.out(size if down else f.h, f.w if down else size, lambda r, c: f.at(r + start, c) if down else f.at(r, c + start))


def combined(mode: str, a: Column, b: Column) -> Column:
    return {"and": a & b, "or": a | b, "xor": a != b, "nor": ~(a | b), "a_not_b": a & ~b}[mode]


@operator("geometry")
def half_logic(f: Frame, axis: int, mode: str, color: int) -> DataFrame:
    n = f.w if axis == 1 else f.h
    f.fail(n < 3, "too small")
    size, start = F.floor(n / 2).cast("int"), F.floor((n + 1) / 2).cast("int")

    def cell(r: Column, c: Column) -> Column:
        other = f.at(r, c + start) if axis == 1 else f.at(r + start, c)
        return F.when(combined(mode, f.at(r, c) != 0, other != 0), color).otherwise(0)

    return f.out(f.h if axis == 1 else size, size if axis == 1 else f.w, cell)


@operator("geometry")
def self_logic(f: Frame, tf: str, mode: str, color: int) -> DataFrame:
    if tf in TURNED:
        f.fail(f.h != f.w, "shape mismatch")
    return f.same(lambda r, c, v: F.when(combined(mode, v != 0, F.coalesce(f.at(*SOURCES[tf](r, c, f.h, f.w)), F.lit(0)) != 0), color).otherwise(0))


@operator("geometry")
def concat_with(f: Frame, axis: int, tf: str, swap: bool) -> DataFrame:
    th, tw = (f.w, f.h) if tf in TURNED else (f.h, f.w)
    f.fail((th != f.h) if axis == 1 else (tw != f.w), "shape mismatch")
    first = (th if swap else f.h) if axis == 0 else (tw if swap else f.w)

    def cell(r: Column, c: Column) -> Column:
        i = r if axis == 0 else c
        own = lambda d: f.at(r - d, c) if axis == 0 else f.at(r, c - d)
        turned = lambda d: f.at(*SOURCES[tf](r - d if axis == 0 else r, c if axis == 0 else c - d, f.h, f.w))
        zero = F.lit(0)
        return F.when(i < first, turned(zero) if swap else own(zero)).otherwise(own(first) if swap else turned(first))

    return f.out(f.h + th if axis == 0 else f.h, f.w if axis == 0 else f.w + tw, cell)


@operator("geometry")
def fractal(f: Frame) -> DataFrame:
    block = lambda i, n: F.floor(i / n).cast("int")
    return f.out(f.h * f.h, f.w * f.w, lambda r, c: F.when(f.at(block(r, f.h), block(c, f.w)) != 0, f.at(r % f.h, c % f.w)).otherwise(0))


@operator("geometry")
def draw_border(f: Frame, color: int) -> DataFrame:
    return f.same(lambda r, c, v: F.when((r == 0) | (c == 0) | (r == f.h - 1) | (c == f.w - 1), color).otherwise(v))


@operator("geometry")
def remove_border(f: Frame) -> DataFrame:
    return f.out(f.h - 2, f.w - 2, lambda r, c: f.at(r + 1, c + 1))


@operator("geometry")
def draw_grid_lines(f: Frame, period: int, color: int) -> DataFrame:
    return f.same(lambda r, c, v: F.when(((r + 1) % period == 0) | ((c + 1) % period == 0), color).otherwise(v))


@operator("geometry")
def dedupe_adjacent(f: Frame, axis: int) -> DataFrame:
    """Lines equal to the one before are left out: rows (0), columns (1) or rows, then columns (2)."""
    grid = f.g
    unlike = lambda g: F.filter(g, lambda row, i: (i == 0) | ~row.eqNullSafe(F.get(g, i - 1)))
    turned = lambda g: F.transform(F.get(g, F.lit(0)), lambda _, c: F.transform(g, lambda row: F.get(row, c)))
    if axis in (0, 2):
        grid = f.let(unlike(grid))
    if axis in (1, 2):
        grid = f.let(turned(f.let(unlike(f.let(turned(grid))))))
    return f.finish(F.size(grid), F.size(F.get(grid, F.lit(0))), grid)


@operator("geometry")
def rot_quad(f: Frame, cw: bool) -> DataFrame:
    f.fail(f.h != f.w, "not square")
    one, other = ("rot270", "rot90") if cw else ("rot90", "rot270")

    def cell(r: Column, c: Column) -> Column:
        part = lambda n: f.at(*SOURCES[n](r % f.h, c % f.w, f.h, f.w))
        return F.when(r < f.h, F.when(c < f.w, part("id")).otherwise(part(one))).otherwise(F.when(c < f.w, part(other)).otherwise(part("rot180")))

    return f.out(f.h * 2, f.w * 2, cell)


@operator("geometry")
def shear(f: Frame, step: int, axis: int) -> DataFrame:
    return f.same(lambda r, c, v: f.at(r, F.pmod(c - r * step, f.w)) if axis == 1 else f.at(F.pmod(r - c * step, f.h), c))


@operator("geometry")
def crop_fixed(f: Frame, corner: str, h: int, w: int) -> DataFrame:
    f.fail((F.lit(h) > f.h) | (F.lit(w) > f.w), "too big")
    top = F.lit(0) if corner[0] == "t" else f.h - h
    left = F.lit(0) if corner[1] == "l" else f.w - w
    return f.out(h, w, lambda r, c: f.at(top + r, left + c))


@operator("geometry")
def extract_period(f: Frame) -> DataFrame:
    divisors = lambda n: F.filter(F.sequence(F.lit(1), n), lambda d: n % d == 0)
    sizes = F.flatten(F.transform(divisors(f.h), lambda y: F.transform(divisors(f.w), lambda x: F.struct((y * x).alias("area"), y.alias("y"), x.alias("x")))))
    everything = f.let(cells(f.g))
    good = F.filter(sizes, lambda s: ((s["y"] != f.h) | (s["x"] != f.w)) & F.forall(everything, lambda k: k["v"] == f.at(k["r"] % s["y"], k["c"] % s["x"])))
    best = f.let(F.array_min(good))
    f.fail(best.isNull(), "not periodic")
    return f.out(best["y"], best["x"], f.at)


@operator("geometry")
def take_part(f: Frame, ny: int, nx: int, idx: int) -> DataFrame:
    f.fail(F.lit(ny * nx < 2 or idx >= ny * nx) | (f.h % ny != 0) | (f.w % nx != 0), "cannot split evenly")
    h, w = F.floor(f.h / ny).cast("int"), F.floor(f.w / nx).cast("int")
    return f.out(h, w, lambda r, c: f.at(h * (idx // nx) + r, w * (idx % nx) + c))


@operator("geometry")
def overlay_parts(f: Frame, ny: int, nx: int, order: list[int]) -> DataFrame:
    order = order or list(range(ny * nx))
    f.fail(F.lit(ny * nx < 2 or sorted(order) != list(range(ny * nx))) | (f.h % ny != 0) | (f.w % nx != 0), "cannot split evenly")
    h, w = F.floor(f.h / ny).cast("int"), F.floor(f.w / nx).cast("int")
    return f.out(h, w, lambda r, c: F.coalesce(*[F.nullif(f.at(h * (i // nx) + r, w * (i % nx) + c), F.lit(0)) for i in order], F.lit(0)))


@operator("geometry")
def keep_center_line(f: Frame, axis: int) -> DataFrame:
    n = f.w if axis == 1 else f.h
    f.fail(n % 2 == 0, "even size")
    return f.same(lambda r, c, v: F.when((c if axis == 1 else r) == F.floor(n / 2), v).otherwise(0))


