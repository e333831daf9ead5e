"""Tasks as token arrays: ids with the row, column and grid of each token, and demonstrations drawn to fit a length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.sources.generators import draw

#: Token names in the order of their ids; a parameter of ``encoded``.
TOKENS = ("<pad>", "<bos>", "<eos>", "<train>", "<in>", "</in>", "<out>", "</out>", "<test>", "<prog>", "<nl>", *(f"c{v}" for v in range(10)))
#: Largest row or column number and largest grid number that a token gets (fixed values).
LAST_PLACE, LAST_GRID = 31, 23


def _token(tokens: tuple[str, ...], name: str, row: object = 0, column: object = 0, grid: object = 0) -> Column:
    fields = {"id": tokens.index(name) if isinstance(name, str) else name, "row": row, "col": column, "seg": grid}
    return F.struct(*[(x if isinstance(x, Column) else F.lit(x)).cast("int").alias(k) for k, x in fields.items()])


def _grid(tokens: tuple[str, ...], g: Column, number: Column) -> Column:
    """A grid's tokens row by row, each row closed by ``<nl>``; rows count from 1, columns from 0."""
    first, last = tokens.index("c0"), F.lit(LAST_PLACE)
    number = F.least(number, F.lit(LAST_GRID))

    def line(cells: Column, r: Column) -> Column:
        row = F.least(r + 1, last)
        body = F.transform(cells, lambda v, c: _token(tokens, first + v, row, F.least(c, last), number))
        return F.concat(body, F.array(_token(tokens, "<nl>", row, F.least(F.size(cells), last), number)))

    return F.flatten(F.transform(g, line))


def encoded(tasks: DataFrame, tokens: tuple[str, ...] = TOKENS) -> DataFrame:
    """``tasks`` (demos array<struct<input, output>>, query) with ``tokens``: structs id, row, col, seg of the prompt.

    Marks have row, column and grid 0; the grids of the k-th demonstration (from 0) are 2 k + 1 and 2 k + 2, the query is the next.
    """
    marks = lambda *names: F.array(*[_token(tokens, n) for n in names])

    def demo(p: Column, k: Column) -> Column:
        return F.concat(marks("<in>"), _grid(tokens, p["input"], 2 * k + 1), marks("</in>", "<out>"), _grid(tokens, p["output"], 2 * k + 2), marks("</out>"))

    shown = F.flatten(F.transform("demos", demo))
    asked = F.concat(marks("<test>", "<in>"), _grid(tokens, F.col("query"), 2 * F.size("demos") + 1), marks("</in>", "<prog>"))
    return tasks.withColumn("tokens", F.concat(marks("<bos>", "<train>"), shown, asked))


def _cells(g: Column) -> Column:
    """Tokens of a grid."""
    return F.size(g) + F.aggregate(g, F.lit(0), lambda n, row: n + F.size(row))


def resampled(tasks: DataFrame, most: int, seed: Column, program: Column) -> DataFrame:
    """``tasks`` (``pairs``: array of structs input, output) with ``order`` (pair numbers as shuffled), ``k`` and ``length``.

    The first k shuffled pairs are demonstrations and the next one's input is the query: k is drawn from 2 to 4, one less than there are
    pairs at most, and falls until the prompt and a program of ``program`` tokens have at most ``most``; null where
    not even 2 fit.  The shuffle is a sort by a hash of the seed and the pair's number, so it is the same on every run.
    """
    numbered = F.transform("pairs", lambda p, i: F.struct(draw(seed, 301, i).alias("u"), i.alias("i"), (_cells(p["input"])).alias("a"), (_cells(p["output"])).alias("b")))
    out = tasks.withColumn("_by", F.array_sort(numbered)).withColumn("_most", F.least(F.size("pairs") - 1, (2 + draw(seed, 302) % 3).cast("int")))
    # Two marks open a prompt, four stand around a demonstration's grids, four around the query.
    demos = lambda k: F.aggregate(F.slice("_by", F.lit(1), k), F.lit(0), lambda n, x: n + 4 + x["a"] + x["b"])
    length = lambda k: 2 + demos(k) + 4 + F.get("_by", k)["a"] + program + 1
    fits = F.filter(F.array(*[F.lit(k) for k in (4, 3, 2)]), lambda k: (k <= F.col("_most")) & (length(k) <= most))
    out = out.withColumn("order", F.transform("_by", lambda x: x["i"])).withColumn("k", F.get(fits, F.lit(0)))
    return out.withColumn("length", F.when(F.col("k").isNotNull(), length(F.coalesce("k", F.lit(0)))).cast("int")).drop("_by", "_most")


def drawn_example(tasks: DataFrame) -> DataFrame:
    """What ``resampled`` chose as ``demos`` and ``query``, for ``encoded``."""
    at = lambda i: F.get("pairs", F.get("order", i))
    return tasks.where("k IS NOT NULL").withColumns({"demos": F.transform(F.sequence(F.lit(0), F.col("k") - 1), at), "query": at(F.col("k"))["input"]})
