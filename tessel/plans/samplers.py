"""Operators whose parameters are data: every grid its own step, drawn by weights or enumerated from what the grid holds.

A step is a row's columns ``branch`` (a number: operator and those parameters that shape the plan), ``a``, ``b`` (whole
numbers) and ``by``, ``value`` (a selector).  ``applied`` runs each row's own step: rows are written in a folder for each
branch, and each branch reads its folder alone, so all rows are read once however many branches there are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.grids import Frame, bound
from tessel.functions.selectors import BY_COLOR, BY_HOLES, BY_SIZE, MOST_SIZE, WEIGHTS, Objects
from tessel.operators import OPERATORS
from tessel.plans.store import written
from tessel.sources.generators import PRIME, draw

STEP = "branch int, a int, b int, by string, value int"
#: Segmentations and how often a sampler chooses each (fixed values).
SEGMENTS = {"c8": 0.4, "c4": 0.25, "m8": 0.2, "m4": 0.15}


@dataclass(frozen=True)
class Choice:
    """An operator of a pool: its parameters with fixed alternatives (``fixed``, drawn by ``weights``), those drawn from data (``open``: name to kind), and the kinds of grids that it starts from."""

    op: str
    open: dict[str, str] = field(default_factory=dict)
    fixed: tuple[dict, ...] = ({},)
    weights: tuple[float, ...] | None = None
    gens: tuple[str, ...] = ("sparse", "few", "noise")


_SEG = tuple({"seg": seg} for seg in SEGMENTS)
_SHARES = tuple(SEGMENTS.values())
#: Kinds: a colour that the grid has, any colour, one that it lacks, a cyclic shift, a move, a selector.
CHOICES = [
    Choice("recolor", {"src": "present", "dst": "color"}),
    Choice("swap_colors", {"a": "present", "b": "present"}),
    Choice("keep_color", {"color": "present"}),
    Choice("remove_color", {"color": "present"}),
    Choice("recolor_all", {"color": "color"}),
    Choice("shift_colors", {"s": "shift"}),
    Choice("invert_binary", {"color": "color"}),
    Choice("fill_bg", {"color": "new"}),
    Choice("rot90", fixed=({"k": 1}, {"k": 2}, {"k": 3})),
    Choice("flip", fixed=({"axis": 0}, {"axis": 1})),
    Choice("transpose"),
    Choice("anti_transpose"),
    Choice("translate", {"dy": "move", "dx": "move"}, fixed=({"wrap": False}, {"wrap": True})),
    Choice("crop_to_content"),
    Choice("pad", {"color": "color"}, fixed=({"n": 1}, {"n": 2})),
    Choice("scale_up", fixed=({"k": 2}, {"k": 3})),
    Choice("scale_down", fixed=({"k": 2},), gens=("blocky",)),
    Choice("mirror_concat", fixed=({"mode": "h"}, {"mode": "v"}, {"mode": "both"}), gens=("small", "few")),
    Choice("half", fixed=({"which": "top"}, {"which": "bottom"}, {"which": "left"}, {"which": "right"})),
    Choice("draw_border", {"color": "color"}),
    Choice("remove_border"),
    Choice("recolor_objects", {"sel": "sel", "color": "color"}, fixed=_SEG, weights=_SHARES),
    Choice("keep_objects", {"sel": "sel"}, fixed=_SEG, weights=_SHARES),
    Choice("delete_objects", {"sel": "sel"}, fixed=_SEG, weights=_SHARES),
    Choice("crop_to_object", {"sel": "sel"}, fixed=_SEG, weights=_SHARES),
]


def pool(names: list[str], segments: tuple[str, ...] = tuple(SEGMENTS)) -> list[Choice]:
    """The choices of these operators, with these segmentations alone."""
    known = {c.op: c for c in CHOICES}
    out = []
    for name in names:
        c = known[name]
        keep = [i for i, x in enumerate(c.fixed) if x.get("seg", segments[0]) in segments]
        out.append(Choice(c.op, c.open, tuple(c.fixed[i] for i in keep), tuple(c.weights[i] for i in keep) if c.weights else None, c.gens))
    return out


@dataclass(frozen=True)
class Branch:
    """One alternative of a choice: the plan that its rows share."""

    number: int
    choice: int
    op: str
    fixed: dict
    open: dict[str, str]

    @property
    def numbers(self) -> dict[str, str]:
        """Parameters that are whole numbers, by the column that holds them."""
        return dict(zip([p for p, kind in self.open.items() if kind != "sel"], ("a", "b")))

    def parameters(self) -> dict:
        selector = {p: {"by": F.col("by"), "value": F.col("value")} for p, kind in self.open.items() if kind == "sel"}
        return self.fixed | {p: F.col(c) for p, c in self.numbers.items()} | selector

    def text(self) -> Column:
        """``op(k=v, ..)`` as ``programs.text`` writes it."""
        shown = []
        for p in OPERATORS[self.op].parameters:
            if p in self.fixed:
                value = self.fixed[p]
                column = F.lit(str(value).lower() if isinstance(value, bool) else str(value))
            elif self.open[p] == "sel":
                column = F.concat("by", F.coalesce(F.concat(F.lit("("), F.col("value").cast("string"), F.lit(")")), F.lit("")))
            else:
                column = F.col(self.numbers[p]).cast("string")
            shown += [F.lit(f"{', ' if shown else ''}{p}="), column]
        return F.concat(F.lit(f"{self.op}("), *shown, F.lit(")"))


def branches(choices: list[Choice]) -> list[Branch]:
    each = [(k, c, fixed) for k, c in enumerate(choices) for fixed in c.fixed]
    return [Branch(n, k, c.op, fixed, c.open) for n, (k, c, fixed) in enumerate(each)]


def step_text(all_branches: list[Branch]) -> Column:
    """The text of each row's step."""
    return F.coalesce(*[F.when(F.col("branch") == b.number, b.text()) for b in all_branches])


def applied(rows: DataFrame, all_branches: list[Branch], before: Callable[[DataFrame, Branch], DataFrame] = lambda df, _: df) -> DataFrame:
    """``rows`` (g, h, w, err, step columns and any others) after each row's own step; ``before`` may add a branch's parameters."""
    stored = written(rows, "steps", by="branch")
    return reduce(DataFrame.unionByName, [OPERATORS[b.op](before(stored.where(F.col("branch") == b.number), b), **b.parameters()) for b in all_branches])


# --- drawing ---------------------------------------------------------------------------


def weighted(options: list, weights: list[float], u: Column) -> Column:
    """One of the options by its weight; ``u`` is a number of ``draw``."""
    total, so_far, edges = sum(weights), 0.0, []
    for weight in weights:
        so_far += weight
        edges.append(int(so_far / total * PRIME))
    edges[-1] = PRIME
    return F.get(F.array(*map(F.lit, options)), F.size(F.filter(F.array(*map(F.lit, edges)), lambda edge: edge <= u)))


def one_of(values: Column, u: Column) -> Column:
    return F.get(values, (u % F.greatest(F.size(values), F.lit(1))).cast("int"))


def present(g: Column) -> Column:
    """The colours of a grid but background, ascending."""
    return F.array_sort(F.array_distinct(F.filter(F.flatten(g), lambda v: v > 0)))


def drawn_number(kind: str, held: Column, u: Column) -> Column:
    """A whole number of a kind; ``held``: the colours of the grid."""
    free = F.filter(F.sequence(F.lit(1), F.lit(9)), lambda v: ~F.array_contains(held, v))
    any_color = (1 + u % 9).cast("int")
    out = {
        "present": lambda: F.coalesce(one_of(held, u), any_color),
        "color": lambda: any_color,
        "new": lambda: F.coalesce(one_of(free, u), any_color),
        "shift": lambda: (1 + u % 8).cast("int"),
        "move": lambda: (u % 7 - 3).cast("int"),
    }[kind]()
    return out.cast("int")


def drawn_selector(o: Objects, held: Column, seed: Column, salt: int, tries: int = 30) -> Column:
    """Struct by, value: the first of some draws by weight that picks some but not all objects (``all`` may pick all); else ``all``."""
    sizes = o.f.let(F.array_sort(F.array_distinct(F.filter(o.of("size"), lambda n: n <= MOST_SIZE))))
    names, weights = list(WEIGHTS), list(WEIGHTS.values())
    test = o.test_of(F.lit(None).cast("int"))

    def one(t: Column) -> Column:
        by, u = weighted(names, weights, draw(seed, salt, t)), draw(seed, salt + 1, t)
        value = F.when(by.isin(*BY_COLOR), drawn_number("present", held, u)).when(by.isin(*BY_HOLES), (u % 3).cast("int")).when(by.isin(*BY_SIZE), F.coalesce(one_of(sizes, u), F.lit(1)))
        return F.struct(by.alias("by"), value.cast("int").alias("value"))

    def fits(x: Column) -> Column:
        n = F.size(F.filter(o.all, test(x["by"], x["value"])))
        return (n > 0) & ((x["by"] == "all") | (n < F.size(o.all)))

    # Draws after the first good one aren't looked at.
    first = F.aggregate(F.sequence(F.lit(0), F.lit(tries - 1)), F.lit(None).cast("struct<by:string,value:int>"), lambda found, t: F.when(found.isNotNull(), found).otherwise(bound(one(t), lambda x: F.when(fits(x), x))))
    return o.f.let(F.coalesce(first, F.struct(F.lit("all").alias("by"), F.lit(None).cast("int").alias("value"))))


def drawn_step(rows: DataFrame, branch: Branch, seed: Column, salt: int) -> DataFrame:
    """``rows`` with the parameters (a, b, by, value) of one branch drawn for each grid."""
    f = Frame(rows)
    held = f.let(present(f.g))
    new = {"a": F.lit(None).cast("int"), "b": F.lit(None).cast("int"), "by": F.lit(None).cast("string"), "value": F.lit(None).cast("int")}
    for k, (p, column) in enumerate(branch.numbers.items()):
        new[column] = drawn_number(branch.open[p], held, draw(seed, salt + k))
    if "sel" in branch.open.values():
        found = drawn_selector(Objects(f, branch.fixed["seg"]), held, seed, salt + 5)
        new |= {"by": found["by"], "value": found["value"]}
    columns = [c for c in rows.columns if c not in new]
    return f.df.select(*columns, *[x.alias(c) for c, x in new.items()])


def drawn_branch(all_branches: list[Branch], choices: list[Choice], choice: Column, u: Column) -> Column:
    """The branch of a choice number, by the choice's weights."""
    out = F.lit(None).cast("int")
    for k, c in enumerate(choices):
        numbers = [b.number for b in all_branches if b.choice == k]
        out = F.when(choice == k, weighted(numbers, list(c.weights or [1.0] * len(numbers)), u)).otherwise(out)
    return out


# --- enumeration -----------------------------------------------------------------------

MOVES = [(dy, dx) for dy in range(-2, 3) for dx in range(-2, 3) if dy or dx]


def candidates(f: Frame, all_branches: list[Branch], outs: Column) -> Column:
    """Every step worth a try on a grid, as an array of structs: colours of the grid where one is looked for, of the wanted grids (``outs``) where one is painted, selectors one for each set of objects."""
    held = f.let(present(f.g))
    painted = f.let(outs)
    none, text = F.lit(None).cast("int"), F.lit(None).cast("string")
    segments = {b.fixed["seg"] for b in all_branches if "sel" in b.open.values()}
    found = {seg: Objects(f, seg).enumerated() for seg in sorted(segments)}
    values = {"present": held, "color": painted, "new": painted, "shift": F.sequence(F.lit(1), F.lit(8))}

    def of(b: Branch) -> Column:
        kinds = [kind for kind in b.open.values() if kind != "sel"]
        made = lambda a=none, c=none, by=text, value=none: F.struct(F.lit(b.number).alias("branch"), a.cast("int").alias("a"), c.cast("int").alias("b"), by.alias("by"), value.alias("value"))
        if "sel" in b.open.values():
            inner = lambda s: F.transform(values[kinds[0]], lambda a: made(a, none, s["by"], s["value"])) if kinds else F.array(made(none, none, s["by"], s["value"]))
            return F.flatten(F.transform(found[b.fixed["seg"]], inner))
        if kinds == ["move", "move"]:
            return F.array(*[made(F.lit(dy), F.lit(dx)) for dy, dx in MOVES])
        if len(kinds) == 2:
            return F.flatten(F.transform(values[kinds[0]], lambda a: F.transform(F.filter(values[kinds[1]], lambda c: c != a), lambda c: made(a, c))))
        return F.transform(values[kinds[0]], lambda a: made(a)) if kinds else F.array(made())

    return f.let(F.concat(*[f.let(of(b)) for b in all_branches]))
