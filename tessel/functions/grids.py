"""Grid expressions: a grid is an ``array<array<int>>`` column, one row of a DataFrame for each grid.

Operators are written as what an output cell pulls from the input, so a program of
operators stays a chain of projections: no shuffle, however many grids there are.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_SIZE = 30
_NAMES = count()


def lit(value: object) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def at(grid: Column, r: Column, c: Column) -> Column:
    """The cell, null outside the grid."""
    return F.get(F.get(grid, r), c)


def sequence(n: Column) -> Column:
    """0 .. n - 1, empty for n < 1."""
    return F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i < n)


def make(h: Column, w: Column, cell: Callable[[Column, Column], Column]) -> Column:
    return F.transform(sequence(lit(h)), lambda r: F.transform(sequence(lit(w)), lambda c: cell(r, c).cast("int")))


def flat(grid: Column) -> Column:
    return F.flatten(grid)


def cells(grid: Column, **more: Column) -> Column:
    """All cells as structs of r, c, v and the same cell of further grids, row by row."""
    rows = F.transform(grid, lambda row, r: F.transform(row, lambda v, c: F.struct(r.alias("r"), c.alias("c"), v.alias("v"), *[at(g, r, c).alias(n) for n, g in more.items()])))
    return F.flatten(rows)


def among(value: Column, options: list[int]) -> Column:
    return value.isin(options)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it; for use inside a function of a cell."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Frame:
    """The grids of a DataFrame (columns g, h, w, err) while an operator is built over them.

    ``let`` names an intermediate value, which is computed once for each grid.  ``fail`` marks
    grids that the operator refuses: their g becomes null and err the reason.
    """

    def __init__(self, df: DataFrame):
        self.df, self.keep = df, df.columns
        self.g, self.h, self.w = F.col("g"), F.col("h"), F.col("w")
        self.refused: list[tuple[Column, str]] = []

    def let(self, value: Column) -> Column:
        name = f"_{next(_NAMES)}"
        # rand() keeps Catalyst from copying the value into a function that is called for every cell.
        self.df = self.df.withColumn(name, F.when(F.rand(0) + F.lit(1.0) > 0, value))
        return F.col(name)

    def fail(self, when: Column, reason: str) -> None:
        self.refused.append((F.coalesce(when, F.lit(True)), reason))

    def at(self, r: Column, c: Column) -> Column:
        return at(self.g, r, c)

    def counts(self) -> Column:
        """How often each of 0..9 occurs."""
        all_cells = self.let(flat(self.g))
        return self.let(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.size(F.filter(all_cells, lambda v: v == k))))

    def ranked(self) -> tuple[Column, Column]:
        """Foreground colours by descending count (structs of n, v; ties: smallest first), and whether two counts are equal."""
        n = self.counts()
        pairs = F.filter(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda v: F.struct(F.get(n, v).alias("n"), (-v).alias("v"))), lambda x: x["n"] > 0)
        ordered = self.let(F.transform(F.reverse(F.array_sort(pairs)), lambda x: F.struct(x["n"].alias("n"), (-x["v"]).alias("v"))))
        return ordered, F.size(F.array_distinct(F.transform(ordered, lambda x: x["n"]))) < F.size(ordered)

    def box(self, marked: Callable[[Column], Column]) -> Column:
        """Struct r0, r1, c0, c1 of the cells (structs r, c, v) that are marked; null fields without any."""
        own = self.let(F.filter(cells(self.g), marked))
        row, column = F.transform(own, lambda x: x["r"]), F.transform(own, lambda x: x["c"])
        return self.let(F.struct(F.array_min(row).alias("r0"), F.array_max(row).alias("r1"), F.array_min(column).alias("c0"), F.array_max(column).alias("c1")))

    def crop(self, box: Column) -> DataFrame:
        return self.out(box["r1"] - box["r0"] + 1, box["c1"] - box["c0"] + 1, lambda r, c: self.at(box["r0"] + r, box["c0"] + c))

    def same(self, cell: Callable[[Column, Column, Column], Column]) -> DataFrame:
        """A grid of the input's size; ``cell`` gets r, c and the input's value."""
        return self.finish(self.h, self.w, F.transform(self.g, lambda row, r: F.transform(row, lambda v, c: lit(cell(r, c, v)).cast("int"))))

    def out(self, h: object, w: object, cell: Callable[[Column, Column], Column]) -> DataFrame:
        h, w = self.let(lit(h).cast("int")), self.let(lit(w).cast("int"))
        self.fail((h > MAX_SIZE) | (w > MAX_SIZE) | (h < 1) | (w < 1), "bad size")
        return self.finish(h, w, make(h, w, cell))

    def finish(self, h: Column, w: Column, grid: Column) -> DataFrame:
        err = F.col("err")
        for when, reason in self.refused:
            err = F.coalesce(err, F.when(when, F.lit(reason)))
        self.df = self.df.withColumn("_err", err)
        good = F.col("_err").isNull()
        # Named anew in two steps: inside a function, a name would mean the new column of its own select.
        new = {"g": F.when(good, grid), "h": F.when(good, h), "w": F.when(good, w), "err": F.col("_err")}
        return self.df.select(*[F.col(c) for c in self.keep if c not in new], *[x.alias(f"_new_{c}") for c, x in new.items()]).select(*[F.col(f"_new_{c}").alias(c) if c in new else F.col(c) for c in self.keep])
