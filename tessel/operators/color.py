"""Colour operators: every cell by its own value, or by how often values occur."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.functions.grids import Frame
from tessel.operators.base import operator


@operator("color")
def recolor(f: Frame, src: int, dst: int) -> DataFrame:
    return f.same(lambda r, c, v: F.when(v == src, dst).otherwise(v))


@operator("color")
def swap_colors(f: Frame, a: int, b: int) -> DataFrame:
    return f.same(lambda r, c, v: F.when(v == a, b).when(v == b, a).otherwise(v))


@operator("color")
def keep_color(f: Frame, color: int) -> DataFrame:
    return f.same(lambda r, c, v: F.when(v == color, v).otherwise(0))


@operator("color")
def remove_color(f: Frame, color: int) -> DataFrame:
    return f.same(lambda r, c, v: F.when(v == color, 0).otherwise(v))


@operator("color")
def recolor_all(f: Frame, color: int) -> DataFrame:
    return f.same(lambda r, c, v: F.when(v != 0, color).otherwise(0))


@operator("color")
def shift_colors(f: Frame, s: int) -> DataFrame:
    return f.same(lambda r, c, v: F.when(v != 0, F.pmod(v - 1 + s, F.lit(9)) + 1).otherwise(0))


@operator("color")
def invert_binary(f: Frame, color: int) -> DataFrame:
    return f.same(lambda r, c, v: F.when(v == 0, color).otherwise(0))


@operator("color")
def fill_bg(f: Frame, color: int) -> DataFrame:
    return f.same(lambda r, c, v: F.when(v == 0, color).otherwise(v))


@operator("color")
def majority_fill(f: Frame) -> DataFrame:
    ordered, _ = f.ranked()
    f.fail(F.size(ordered) == 0, "empty")
    return f.same(lambda r, c, v: F.get(ordered, F.lit(0))["v"])


@operator("color")
def dominant_color_cell(f: Frame) -> DataFrame:
    ordered, _ = f.ranked()
    first, second = F.get(ordered, F.lit(0)), F.get(ordered, F.lit(1))
    f.fail((F.size(ordered) == 0) | F.coalesce(first["n"] == second["n"], F.lit(False)), "no dominant colour")
    return f.out(1, 1, lambda r, c: first["v"])


@operator("color")
def colors_by_frequency(f: Frame) -> DataFrame:
    ordered, tie = f.ranked()
    f.fail(tie | (F.size(ordered) == 0), "need distinct counts")
    return f.out(F.size(ordered), 1, lambda r, c: F.get(ordered, r)["v"])


@operator("color")
def recolor_by_frequency_rank(f: Frame, colors: list[int]) -> DataFrame:
    ordered, tie = f.ranked()
    f.fail(tie | (F.size(ordered) < 2), "need distinct counts")
    values, to = f.let(F.transform(ordered, lambda x: x["v"])), F.array(*map(F.lit, colors))
    return f.same(lambda r, c, v: F.coalesce(F.get(to, (F.array_position(values, v) - 1).cast("int")), v))


@operator("color")
def swap_extreme_colors(f: Frame) -> DataFrame:
    ordered, _ = f.ranked()
    n = F.transform(ordered, lambda x: x["n"])
    most, least = F.get(ordered, F.lit(0)), F.get(ordered, F.size(ordered) - 1)
    once = lambda m: F.size(F.filter(n, lambda x: x == m)) == 1
    f.fail((F.size(ordered) < 2) | ~once(most["n"]) | ~once(least["n"]), "no unique extremes")
    return f.same(lambda r, c, v: F.when(v == most["v"], least["v"]).when(v == least["v"], most["v"]).otherwise(v))
