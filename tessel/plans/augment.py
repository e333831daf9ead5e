"""Augmentation keys: a grid's turns, transposition and colours changed and changed back, and examples put in another order.

A key is a chain of operations after a first name, as "base.rot90.transpose.permute0213456789.ex201": ``rot90`` (against the
clock), ``transpose``, ``permute`` with the ten new colours, and, for tasks, ``ex`` with the examples to take, in order
(numbers over nine are separated by ``-``).  Names that start with copy, out or run change nothing.  What undoes a key is
its operations' opposites in reverse order, so a guess for a changed grid becomes one for the grid itself.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The eight turns of a square, as keys.
TURNS = [".".join(["base", *(["transpose"] * t), *(["rot90"] * k)]) for t in (0, 1) for k in range(4)]


def _transposed(g: Column) -> Column:
    return F.transform(F.get(g, F.lit(0)), lambda _, c: F.transform(g, lambda row: F.get(row, c)))


def _permuted(g: Column, colors: list[int]) -> Column:
    to = F.array(*map(F.lit, colors))
    return F.transform(g, lambda row: F.transform(row, lambda v: F.get(to, v)))


def _steps(key: str) -> list[tuple[str, list[int]]]:
    out = []
    for step in key.split(".")[1:]:
        if step in ("rot90", "transpose"):
            out.append((step, []))
        elif step.startswith("permute"):
            out.append(("permute", [int(c) for c in step[len("permute") :] if c.isdigit()]))
        elif step.startswith("ex"):
            out.append(("ex", [int(n) for n in (step[2:].split("-") if "-" in step else step[2:])]))
        elif not step.startswith(("copy", "out", "run")):
            raise ValueError(f"unknown step of a key: {step}")
    return out


def _applied(g: Column, steps: list[tuple[str, list[int]]]) -> Column:
    """The grid after quarter turns (``rot90`` against the clock, ``back`` with it), transpositions and permutations, however many:
    one transposition at most, then rows and columns reversed or not, then one new colour for each old one."""
    over, rows, columns, colors = False, False, False, list(range(10))
    for step, given in steps:
        if step == "permute":
            if sorted(given) != list(range(10)):
                raise ValueError(f"not a permutation of ten colours: {given}")
            colors = [given[v] for v in colors]
        elif step == "transpose":
            over, rows, columns = not over, columns, rows
        elif step == "rot90":
            over, rows, columns = not over, not columns, rows
        elif step == "back":
            over, rows, columns = not over, columns, not rows
    g = _transposed(g) if over else g
    g = F.reverse(g) if rows else g
    g = F.transform(g, lambda row: F.reverse(row)) if columns else g
    return g if colors == list(range(10)) else _permuted(g, colors)


def forward(g: Column, key: str) -> Column:
    """The grid as ``key`` says."""
    return _applied(g, _steps(key))


def inverse(g: Column, key: str) -> Column:
    """The grid that ``key`` made this one of."""
    undone = {"rot90": lambda given: ("back", given), "permute": lambda given: ("permute", [given.index(v) for v in range(10)]), "transpose": lambda given: ("transpose", given)}
    return _applied(g, [undone[step](given) for step, given in reversed(_steps(key)) if step in undone])


def ordered(examples: Column, key: str) -> Column:
    """A task's examples (an array) in the order of the key's ``ex`` steps."""
    for step, given in _steps(key):
        if step == "ex":
            taken, examples = examples, F.array(*[F.get(examples, F.lit(n)) for n in given])
            examples = F.filter(examples, lambda x: x.isNotNull()) if given else F.slice(taken, 1, 0)
    return examples
