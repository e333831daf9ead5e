"""Objects of a grid as an array column, and the predicates that select among them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessel.functions.grids import Frame, at, cells
from tessel.functions.labels import labelled

SELECTORS = (
    "all", "largest", "smallest", "tallest", "widest", "leftmost", "topmost", "rightmost", "bottommost", "common_color", "rare_color", "common_shape", "dup_shape", "unique_shape",
    "touching", "holes_eq", "has_hole", "no_hole", "square", "symmetric", "color", "not_color", "size_eq", "size_gt", "size_lt", "touches_border", "inner", "rect", "not_rect", "multicolor",
)
#: How often a sampler chooses each selector (fixed values); enumeration tries them in this order.
WEIGHTS = {
    "largest": 10, "smallest": 10, "color": 14, "not_color": 4, "size_gt": 8, "size_lt": 8, "size_eq": 4, "touches_border": 6, "inner": 6, "rect": 5, "not_rect": 5, "has_hole": 6, "no_hole": 4, "tallest": 3, "widest": 3, "all": 3, "multicolor": 2,
    "leftmost": 4, "rightmost": 4, "topmost": 4, "bottommost": 4, "common_color": 3, "rare_color": 3, "touching": 6, "square": 2, "symmetric": 2, "dup_shape": 4, "unique_shape": 4, "common_shape": 3, "holes_eq": 3,
}
#: Selectors with a value: a colour of the objects, a size of at most ``MOST_SIZE``, a number of holes.
BY_COLOR, BY_SIZE, BY_HOLES, MOST_SIZE, HOLES = ("color", "not_color", "touching"), ("size_eq", "size_gt", "size_lt"), ("holes_eq",), 60, (0, 1, 2)
_AROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]


class Objects:
    """``lab``: the grid of object numbers; ``all``: an array of structs, one for each object in object order.

    ``grid``, if given, is what is segmented (0: no object) in place of the grid itself.
    """

    def __init__(self, f: Frame, seg: str, grid: Column | None = None):
        self.f = f
        found = f.let(labelled(f.g if grid is None else grid, seg))
        self.lab, holes = f.let(found["lab"]), found["holes"]
        everything = f.let(F.filter(cells(f.g, k=self.lab), lambda x: x["k"] > 0))
        parts = f.let(F.transform(holes, lambda _, i: F.filter(everything, lambda x: x["k"] == i + 1)))
        boxed = F.transform(
            parts,
            lambda p, i: F.struct(
                (i + 1).alias("k"),
                p.alias("cells"),
                F.size(p).alias("size"),
                F.array_min(F.transform(p, lambda x: x["r"])).alias("r0"),
                F.array_max(F.transform(p, lambda x: x["r"])).alias("r1"),
                F.array_min(F.transform(p, lambda x: x["c"])).alias("c0"),
                F.array_max(F.transform(p, lambda x: x["c"])).alias("c1"),
                (-F.array_max(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda v: F.struct(F.size(F.filter(p, lambda x: x["v"] == v)), (-v).alias("v"))))["v"]).alias("color"),
                F.array_sort(F.array_distinct(F.transform(p, lambda x: x["v"]))).alias("values"),
                F.get(holes, i).alias("holes"),
            ),
        )
        shaped = lambda o: F.array_join(F.transform(o["cells"], lambda x: (x["r"] - o["r0"]) * 32 + x["c"] - o["c0"]), ",")
        self.all = f.let(F.transform(f.let(boxed), lambda o: o.withField("h", o["r1"] - o["r0"] + 1).withField("w", o["c1"] - o["c0"] + 1).withField("shape", shaped(o))))

    def get(self, k: Column) -> Column:
        return F.get(self.all, k - 1)

    def label(self, r: Column, c: Column) -> Column:
        return F.coalesce(at(self.lab, r, c), F.lit(0))

    def of(self, name: str) -> Column:
        return F.transform(self.all, lambda o: o[name])

    def select(self, sel: dict) -> Column:
        """The selected objects, in order.  ``sel``: {"by": name[, "value": number]}; both may be columns, so that every grid has its own."""
        by, value = sel["by"], sel.get("value")
        if isinstance(by, Column):
            return self.f.let(F.filter(self.all, self.test_of(value)(by)))
        if by not in SELECTORS:
            self.f.fail(F.size(self.all) > 0, "unknown selector")
            return self.f.let(F.slice(self.all, 1, 0))
        return self.f.let(F.filter(self.all, self._test(by, value)))

    def test_of(self, value: Column):
        """From a column of selector names: whether an object passes."""
        tests = {name: self._test(name, value) for name in SELECTORS}

        def named(by: Column, value: Column | None = None):
            known = tests if value is None else {name: tests[name] if name not in BY_COLOR + BY_SIZE + BY_HOLES else self._test(name, value) for name in SELECTORS}

            def test(o: Column) -> Column:
                out = F.when(F.lit(False), F.lit(False))
                for name, passes in known.items():
                    out = out.when(by == name, passes(o))
                return F.coalesce(out, F.lit(False))

            return test

        return named

    def enumerated(self) -> Column:
        """Structs by, value, picks (object numbers): the first selector for each set of objects that any picks, and ``all`` always."""
        let = self.f.let
        chosen = lambda by, value: F.transform(F.filter(self.all, self._test(by, value)), lambda o: o["k"])
        one = lambda by, value: F.struct(F.lit(by).alias("by"), (value if isinstance(value, Column) else F.lit(value)).cast("int").alias("value"), chosen(by, value).alias("picks"))
        valued = BY_COLOR + BY_SIZE + BY_HOLES
        colors, sizes = let(F.array_sort(F.array_distinct(self.of("color")))), let(F.array_sort(F.array_distinct(F.filter(self.of("size"), lambda n: n <= MOST_SIZE))))
        parts = [F.array(*[one(by, None) for by in WEIGHTS if by not in valued])]
        each = lambda values, by: F.transform(values, lambda v: one(by, v))
        parts += [each(values, by) for bys, values in ((BY_COLOR, colors), (BY_SIZE, sizes), (BY_HOLES, F.array(*map(F.lit, HOLES)))) for by in bys]
        found = let(F.concat(*[let(part) for part in parts]))
        sets = let(F.transform(found, lambda x: F.array_join(x["picks"].cast("array<string>"), ",")))
        return let(F.filter(found, lambda x, i: (F.size(x["picks"]) > 0) & ((x["by"] == "all") | (F.array_position(sets, F.get(sets, i)) == i + 1))))

    def _test(self, by: str, value: int | Column | None):
        let, f = self.f.let, self.f
        extremes = {"largest": ("size", max), "smallest": ("size", min), "tallest": ("h", max), "widest": ("w", max), "leftmost": ("c0", min), "topmost": ("r0", min), "rightmost": ("c1", max), "bottommost": ("r1", max)}
        if by in extremes:
            name, way = extremes[by]
            best = let((F.array_max if way is max else F.array_min)(self.of(name)))
            return lambda o: o[name] == best
        if by in ("common_color", "rare_color", "common_shape", "dup_shape", "unique_shape"):
            names = let(self.of("color" if "color" in by else "shape"))
            key = lambda o: o["color"] if "color" in by else o["shape"]
            often = lambda o: F.size(F.filter(names, lambda n: n == key(o)))
            if by == "dup_shape":
                return lambda o: often(o) > 1
            if by == "unique_shape":
                return lambda o: often(o) == 1
            counts = F.transform(names, lambda n: F.size(F.filter(names, lambda m: m == n)))
            best = let(F.array_min(counts) if by == "rare_color" else F.array_max(counts))
            return lambda o: often(o) == best
        if by == "touching":
            near = lambda x: F.array_contains(F.array(*[F.when(self.label(x["r"] + dy, x["c"] + dx) != x["k"], f.at(x["r"] + dy, x["c"] + dx)) for dy, dx in _AROUND]), value)
            return lambda o: F.exists(o["cells"], lambda x: F.coalesce(near(x), F.lit(False)))
        if by == "symmetric":
            held = lambda o: F.transform(o["cells"], lambda x: x["r"] * 32 + x["c"])
            return lambda o: F.forall(o["cells"], lambda x: F.array_contains(held(o), x["r"] * 32 + o["c0"] + o["c1"] - x["c"])) | F.forall(o["cells"], lambda x: F.array_contains(held(o), (o["r0"] + o["r1"] - x["r"]) * 32 + x["c"]))
        rect = lambda o: o["size"] == o["h"] * o["w"]
        border = lambda o: (o["r0"] == 0) | (o["c0"] == 0) | (o["r1"] == f.h - 1) | (o["c1"] == f.w - 1)
        return {
            "all": lambda o: F.lit(True),
            "holes_eq": lambda o: o["holes"] == value,
            "has_hole": lambda o: o["holes"] > 0,
            "no_hole": lambda o: o["holes"] == 0,
            "square": lambda o: rect(o) & (o["h"] == o["w"]),
            "color": lambda o: o["color"] == value,
            "not_color": lambda o: o["color"] != value,
            "size_eq": lambda o: o["size"] == value,
            "size_gt": lambda o: o["size"] > value,
            "size_lt": lambda o: o["size"] < value,
            "touches_border": border,
            "inner": lambda o: ~border(o),
            "rect": rect,
            "not_rect": lambda o: ~rect(o),
            "multicolor": lambda o: F.size(o["values"]) > 1,
        }[by]
