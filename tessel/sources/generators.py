"""Random grids: one for each row of a DataFrame with a ``seed``, by a counter-based hash that any engine can repeat.

The generators match the distributions and rules of their kind (densities, sizes, palettes), not anyone's byte stream.
A grid depends on its seed alone, so a lost partition comes back the same.  Densities, sides and counts of the kinds below are
fixed values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.grids import Frame, at, lit, make

PRIME = 1_000_003
COLORS = 3
GENERATORS: dict[str, Callable[[Frame, Column], tuple[Column, Column, Column]]] = {}


def draw(seed: Column, salt: int, r: object = 0, c: object = 0) -> Column:
    """A number from 0 to PRIME - 1 for each seed, salt and place."""
    x = (seed * 7919 + lit(r).cast("long") * 104_729 + lit(c).cast("long") * 1_299_709 + salt * 15_485_863) % PRIME
    for add in (12_345, 67_891):
        x = (x * x + x * 31 + add) % PRIME
    return x


def chance(p: float, seed: Column, salt: int, r: object = 0, c: object = 0) -> Column:
    return draw(seed, salt, r, c) < int(p * PRIME)


def pick(low: int, high: int, seed: Column, salt: int, r: object = 0, c: object = 0) -> Column:
    """A whole number from low to high."""
    return (low + draw(seed, salt, r, c) % (high - low + 1)).cast("int")


def color(seed: Column, salt: int, r: object = 0, c: object = 0) -> Column:
    return pick(1, COLORS, seed, salt, r, c)


def generator(build: Callable[[Frame, Column], tuple[Column, Column, Column]]) -> Callable:
    GENERATORS[build.__name__] = build
    return build


def generate(seeds: DataFrame, name: str) -> DataFrame:
    """(gid, h, w, g, err) for each row's ``gid``, which is its seed."""
    return drawn(seeds.select("gid"), name, F.col("gid").cast("long"))


def drawn(rows: DataFrame, name: str, seed: Column) -> DataFrame:
    """``rows`` with a grid (g, h, w, err) for each row's seed."""
    types = {"g": "array<array<int>>", "h": "int", "w": "int", "err": "string"}
    f = Frame(rows.withColumns({column: F.lit(None).cast(kind) for column, kind in types.items()}))
    h, w, grid = GENERATORS[name](f, seed)
    return f.finish(h, w, grid)


def _random(f: Frame, seed: Column, h: object, w: object, p: float, salt: int = 10) -> tuple[Column, Column, Column]:
    h, w = f.let(lit(h)), f.let(lit(w))
    return h, w, make(h, w, lambda r, c: F.when(chance(p, seed, salt, r, c), color(seed, salt + 1, r, c)).otherwise(0))


@generator
def sparse(f: Frame, seed: Column):
    return _random(f, seed, pick(5, 12, seed, 1), pick(5, 12, seed, 2), 0.13)


@generator
def noise(f: Frame, seed: Column):
    return _random(f, seed, pick(5, 12, seed, 1), pick(5, 12, seed, 2), 0.5)


@generator
def odd(f: Frame, seed: Column):
    return _random(f, seed, 2 * pick(2, 6, seed, 1) + 1, 2 * pick(2, 6, seed, 2) + 1, 0.35)


@generator
def small(f: Frame, seed: Column):
    h, w, grid = _random(f, seed, pick(2, 5, seed, 1), pick(2, 5, seed, 2), 0.55)
    grid = f.let(grid)
    empty = f.let(~F.exists(F.flatten(grid), lambda v: v != 0))
    return h, w, make(h, w, lambda r, c: F.when(empty & (r == 0) & (c == 0), color(seed, 3)).otherwise(at(grid, r, c)))


@generator
def blocky(f: Frame, seed: Column):
    h, w, grid = _random(f, seed, pick(2, 6, seed, 1), pick(2, 6, seed, 2), 0.5)
    grid = f.let(grid)
    half = lambda i: F.floor(i / 2).cast("int")
    return h * 2, w * 2, make(h * 2, w * 2, lambda r, c: at(grid, half(r), half(c)))


@generator
def blocky_noise(f: Frame, seed: Column):
    h, w, grid = blocky(f, seed)
    grid = f.let(grid)
    return h, w, make(h, w, lambda r, c: F.when(chance(0.1, seed, 20, r, c), color(seed, 21, r, c)).otherwise(at(grid, r, c)))


@generator
def bars(f: Frame, seed: Column):
    h, w = f.let(pick(5, 12, seed, 1)), f.let(pick(5, 12, seed, 2))
    tall = lambda c: draw(seed, 10, 0, c) % (h + 1)
    paint = lambda c: F.when(chance(0.8, seed, 11, 0, c), color(seed, 12)).otherwise(color(seed, 13, 0, c))
    return h, w, make(h, w, lambda r, c: F.when(r >= h - tall(c), paint(c)).otherwise(0))


@generator
def few(f: Frame, seed: Column):
    h, w = f.let(pick(5, 12, seed, 1)), f.let(pick(5, 12, seed, 2))
    dots = f.let(F.transform(F.sequence(F.lit(1), pick(2, 6, seed, 3)), lambda k: F.struct((draw(seed, 4, k) % h).alias("r"), (draw(seed, 5, k) % w).alias("c"), color(seed, 6, k).alias("v"))))
    last = lambda r, c: F.element_at(F.filter(dots, lambda d: (d["r"] == r) & (d["c"] == c)), -1)["v"]
    here = lambda r, c: F.exists(dots, lambda d: (d["r"] == r) & (d["c"] == c))
    return h, w, make(h, w, lambda r, c: F.when(here(r, c), last(r, c)).otherwise(0))


@generator
def gridded(f: Frame, seed: Column):
    separator, (ch, cw), (ny, nx) = color(seed, 1), (f.let(pick(2, 4, seed, 2)), f.let(pick(2, 4, seed, 3))), (f.let(pick(1, 3, seed, 4)), f.let(pick(2, 3, seed, 5)))
    h, w = f.let(ny * ch + ny - 1), f.let(nx * cw + nx - 1)
    inner = lambda r, c: (separator - 1 + pick(1, COLORS - 1, seed, 11, r, c)) % COLORS + 1
    return h, w, make(h, w, lambda r, c: F.when((r % (ch + 1) == ch) | (c % (cw + 1) == cw), separator).when(chance(0.4, seed, 10, r, c), inner(r, c)).otherwise(0))


@generator
def halves(f: Frame, seed: Column):
    n, h = f.let(pick(3, 7, seed, 1)), f.let(pick(3, 8, seed, 2))
    side = lambda c: F.when(c < n, color(seed, 3)).otherwise(color(seed, 4))
    return h, 2 * n + 1, make(h, 2 * n + 1, lambda r, c: F.when(c == n, color(seed, 5)).when(chance(0.5, seed, 10, r, c), side(c)).otherwise(0))


@generator
def parts(f: Frame, seed: Column):
    a, b = f.let(pick(2, 6, seed, 1)), f.let(pick(2, 6, seed, 2))
    which = lambda r, c: F.when(r >= a, 2).otherwise(0) + F.when(c >= b, 1).otherwise(0)
    return 2 * a, 2 * b, make(2 * a, 2 * b, lambda r, c: F.when(chance(0.4, seed, 10, r, c), (color(seed, 3) - 1 + which(r, c)) % COLORS + 1).otherwise(0))


@generator
def periodic(f: Frame, seed: Column):
    y, x = f.let(pick(1, 4, seed, 1)), f.let(pick(1, 4, seed, 2))
    h, w = f.let(y * pick(2, 4, seed, 3)), f.let(x * pick(2, 4, seed, 4))
    full = lambda r, c: ((r == 0) & (c == 0)) | chance(0.8, seed, 10, r, c)
    return h, w, make(h, w, lambda r, c: F.when(full(r % y, c % x), color(seed, 11, r % y, c % x)).otherwise(0))


@generator
def stretched(f: Frame, seed: Column):
    def repeats(salt: int, n: Column) -> Column:
        return f.let(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_repeat(i, pick(1, 3, seed, salt, i)))))

    rows, columns = repeats(3, f.let(pick(2, 5, seed, 1))), repeats(4, f.let(pick(2, 5, seed, 2)))
    base = lambda r, c: F.when(chance(0.7, seed, 10, r, c), color(seed, 11, r, c)).otherwise(0)
    return F.size(rows), F.size(columns), F.transform(rows, lambda r: F.transform(columns, lambda c: base(r, c).cast("int")))
