"""Grids as panels of equal size, and rules between panels that are fitted from examples.

A partition is {"split": "equal", "axis", "count"} or {"split": "separator", "axis", "count", "color"}: axis 0 has panels
below each other, axis 1 beside each other, and separators are whole lines of one colour.  A grid that doesn't fall into
``count`` panels of equal size is refused.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.grids import Frame, bound, cells
from tessel.plans.store import written

LOGICS = ("and", "or", "xor", "nor", "nand", "xnor")


def logic(mode: str, marks: list[Column]) -> Column:
    """A truth value of two to four others; xor is true for an odd number of true ones."""
    positive = {"nor": "or", "nand": "and", "xnor": "xor"}.get(mode, mode)
    out = reduce({"and": lambda a, b: a & b, "or": lambda a, b: a | b, "xor": lambda a, b: a != b}[positive], marks)
    return out if mode == positive else ~out


def starts_and_size(g: Column, h: Column, w: Column, axis: int, count: int, color: Column | None) -> Column:
    """Struct starts (array of the panels' first lines), size; null where the grid has no such panels."""
    n = h if axis == 0 else w
    if color is None:
        size = F.floor(n / count).cast("int")
        return F.when(n % count == 0, F.struct(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: (i * size).cast("int")).alias("starts"), size.alias("size")))
    line = lambda i: F.get(g, i) if axis == 0 else F.transform(g, lambda row: F.get(row, i))
    divides = lambda i: F.forall(line(i), lambda v: v == color)
    kept = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~divides(i))
    starts = F.filter(kept, lambda i: ~F.array_contains(kept, i - 1))
    ends = F.filter(kept, lambda i: ~F.array_contains(kept, i + 1))
    sizes = F.array_distinct(F.zip_with(starts, ends, lambda a, b: b - a + 1))
    return F.when((F.size(starts) == count) & (F.size(sizes) == 1), F.struct(starts.alias("starts"), F.get(sizes, F.lit(0)).alias("size")))


class Panels:
    def __init__(self, f: Frame, partition: dict):
        self.f, self.axis = f, partition["axis"]
        color = F.lit(partition["color"]) if partition["split"] == "separator" else None
        found = f.let(starts_and_size(f.g, f.h, f.w, self.axis, partition["count"], color))
        f.fail(found.isNull(), "no such panels")
        self.starts = f.let(found["starts"])
        size = f.let(found["size"])
        self.h, self.w = (size, f.w) if self.axis == 0 else (f.h, size)

    def at(self, index: int, r: Column, c: Column) -> Column:
        start = F.get(self.starts, F.lit(index))
        return self.f.at(r + start, c) if self.axis == 0 else self.f.at(r, c + start)


def _partitions(g: Column, wanted: Column) -> Column:
    """Structs split, axis, count, color, starts, size: each way to cut a grid into two to four panels of the wanted grid's size.

    Only colours of whole lines can separate, so each line is read once and other colours aren't tried.
    """
    h, w = F.size(g), F.size(F.get(g, F.lit(0)))
    wanted_h, wanted_w = F.size(wanted), F.size(F.get(wanted, F.lit(0)))

    def cut(split: str, axis: int, count: Column, color: Column, starts: Column, size: Column) -> Column:
        return F.struct(F.lit(split).alias("split"), F.lit(axis).alias("axis"), count.cast("int").alias("count"), color.alias("color"), starts.alias("starts"), size.cast("int").alias("size"))

    def separated(axis: int, n: Column) -> Column:
        lines = g if axis == 0 else F.transform(F.get(g, F.lit(0)), lambda _, c: F.transform(g, lambda row: F.get(row, c)))
        whole = F.transform(lines, lambda line: F.when(F.forall(line, lambda v: v == F.get(line, F.lit(0))), F.get(line, F.lit(0))))

        def by(colors: Column, v: Column) -> Column:
            kept = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.get(colors, i) != v, F.lit(True)))
            starts = lambda k: F.filter(k, lambda i: ~F.array_contains(k, i - 1))
            ends = lambda k: F.filter(k, lambda i: ~F.array_contains(k, i + 1))
            sizes = lambda k: F.array_distinct(F.zip_with(starts(k), ends(k), lambda a, b: b - a + 1))
            return bound(kept, lambda k: bound(F.struct(starts(k).alias("starts"), sizes(k).alias("sizes")), lambda x: F.when(F.size(x["sizes"]) == 1, cut("separator", axis, F.size(x["starts"]), v, x["starts"], F.get(x["sizes"], F.lit(0))))))

        return bound(whole, lambda colors: F.transform(F.array_distinct(F.array_compact(colors)), lambda v: by(colors, v)))

    def even(axis: int, n: Column, count: int) -> Column:
        size = F.floor(n / count).cast("int")
        starts = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: (i * size).cast("int"))
        return F.when(n % count == 0, cut("equal", axis, F.lit(count), F.lit(-1), starts, size))

    equal = [even(axis, n, count) for count in (2, 3, 4) for axis, n in ((0, h), (1, w))]
    every = F.concat(F.array(*equal), separated(0, h), separated(1, w))
    fits = lambda p: F.when(p["axis"] == 0, (wanted_h == p["size"]) & (wanted_w == w)).otherwise((wanted_h == h) & (wanted_w == p["size"]))
    return F.filter(every, lambda p: p["count"].between(2, 4) & fits(p))


_KEY = ["task_id", "split", "axis", "count", "color"]


def _tables(pairs: DataFrame) -> DataFrame:
    """(task_id, split, axis, count, color, rows array of values, target): ``truth_tables`` with one row for each partition of a task."""
    pairs = written(pairs.where("g is not null and wanted is not null").select("task_id", "g", "wanted"), "pairs")
    n_pairs = pairs.groupBy("task_id").agg(F.count(F.lit(1)).alias("n_pairs"))
    split = pairs.select("task_id", "g", "wanted", F.explode(_partitions(F.col("g"), F.col("wanted"))).alias("p")).select("task_id", "g", "wanted", "p.*")
    values = lambda x: F.transform("starts", lambda s: F.when(F.col("axis") == 0, F.get(F.get(F.col("g"), x["r"] + s), x["c"])).otherwise(F.get(F.get(F.col("g"), x["r"]), x["c"] + s)))
    entries = F.transform(cells(F.col("wanted")), lambda x: F.struct(values(x).alias("values"), x["v"].alias("target")))
    # Each pair gives its distinct entries, at most one for each cell, before the shuffle, and one without values, by which pairs are counted.
    one = F.array(F.struct(F.array().cast("array<int>").alias("values"), F.lit(0).alias("target")))
    entry = split.select(*_KEY, F.explode(F.concat(F.array_distinct(entries), one)).alias("e"))
    table = entry.groupBy(*_KEY, F.col("e.values").alias("values")).agg(F.min("e.target").alias("target"), F.max("e.target").alias("other"), F.count(F.lit(1)).alias("n"))
    is_count = F.size("values") == 0
    listed = table.groupBy(*_KEY).agg(
        F.max(F.when(is_count, F.col("n"))).alias("n"), F.bool_or(~is_count & (F.col("target") != F.col("other"))).alias("wrong"), F.collect_list(F.when(~is_count, F.struct("values", "target"))).alias("rows")  # at most 10 ** 4 rows each
    )
    return listed.where("not wrong").join(n_pairs, "task_id").where("n = n_pairs").select(*_KEY, "rows")


def truth_tables(pairs: DataFrame) -> DataFrame:
    """(task_id, split, axis, count, color, values array<int>, target int): for each partition of a task's pairs into panels of
    the output's size, what the panels' values at a place become, where that is always the same.

    ``pairs``: task_id, g, wanted (both grids).  Only two to four panels; separator colours are those of the grid.  A
    partition needs to fit all pairs of its task; rows are added up per table entry, so a task may have any number of pairs.
    """
    return _tables(pairs).select(*_KEY, F.inline("rows"))


def fitted(pairs: DataFrame) -> DataFrame:
    """(task_id, split, axis, count, color, op, mode, background, paint, output_bg, priority array<int>): all panel programs
    that make every pair of a task: a truth value of what isn't background, or panels drawn over each other.

    Backgrounds are values that occur in every panel; outputs of a truth value are just two.
    """
    key = _KEY
    listed = _tables(pairs).withColumn("outputs", F.array_sort(F.array_distinct(F.transform("rows", lambda e: e["target"]))))
    in_panel = lambda b: F.forall(F.sequence(F.lit(0), F.col("count") - 1), lambda i: F.exists("rows", lambda e: F.get(e["values"], i) == b))
    listed = listed.withColumn("background", F.explode(F.filter(F.array_distinct(F.flatten(F.transform("rows", lambda e: e["values"]))), in_panel)))
    background = F.col("background")
    n_marked = lambda e: F.size(F.filter(e["values"], lambda v: v != background))

    def truth(mode: str) -> Callable[[Column], Column]:
        return {
            "and": lambda e: n_marked(e) == F.col("count"), "or": lambda e: n_marked(e) > 0, "xor": lambda e: n_marked(e) % 2 == 1,
            "nand": lambda e: n_marked(e) < F.col("count"), "nor": lambda e: n_marked(e) == 0, "xnor": lambda e: n_marked(e) % 2 == 0,
        }[mode]

    def compares(mode: str, on: Column, bg: Column) -> Column:
        return (F.size("outputs") == 2) & F.forall("rows", lambda e: e["target"] == F.when(truth(mode)(e), on).otherwise(bg))

    def overlays(order: tuple[int, ...]) -> Column:
        over = lambda e: F.coalesce(*[F.nullif(F.get(e["values"], F.lit(i)), background) for i in reversed(order)], background)
        return (F.col("count") == len(order)) & F.forall("rows", lambda e: e["target"] == over(e))

    none, no_order = F.lit(None).cast("int"), F.lit(None).cast("array<int>")
    programs = []
    for mode in LOGICS:
        for out, paint in ((0, 1), (1, 0)):
            bg, on = F.get("outputs", F.lit(out)), F.get("outputs", F.lit(paint))
            programs.append(F.when(compares(mode, on, bg), F.struct(F.lit("panel_boolean").alias("op"), F.lit(mode).alias("mode"), on.alias("paint"), bg.alias("output_bg"), no_order.alias("priority"))))
    for count in (2, 3, 4):
        for order in permutations(range(count)):
            programs.append(F.when(overlays(order), F.struct(F.lit("panel_priority_overlay").alias("op"), F.lit(None).cast("string").alias("mode"), none.alias("paint"), F.col("background").alias("output_bg"), F.array(*map(F.lit, order)).alias("priority"))))
    found = listed.withColumn("program", F.explode(F.array_compact(F.array(*programs))))
    return found.select(*key, "program.op", "program.mode", "background", "program.paint", "program.output_bg", "program.priority")
