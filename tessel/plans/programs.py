"""Programs: lists of (operator, parameters), run over all grids of a DataFrame in one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.operators import OPERATORS

Program = list[tuple[str, dict]]


def run(grids: DataFrame, program: Program) -> DataFrame:
    """``grids`` after all steps; what one step refuses stays refused."""
    return reduce(lambda df, step: OPERATORS[step[0]](df, **step[1]), program, grids)


def trace(grids: DataFrame, program: Program) -> DataFrame:
    """Every stage of a program: ``grids`` (step 0) and its grids after each step."""
    stages = [run(grids, program[:k]).withColumn("step", F.lit(k)) for k in range(len(program) + 1)]
    return reduce(DataFrame.unionByName, stages)


def text(program: Program) -> str:
    """``a(k=v, ..) | b(..)`` with lower-case booleans."""

    def shown(value: object) -> str:
        if isinstance(value, dict):
            return value["by"] + (f"({value['value']})" if "value" in value else "")
        return str(value).lower() if isinstance(value, bool) else str(value)

    return " | ".join(f"{name}({', '.join(f'{k}={shown(v)}' for k, v in parameters.items())})" for name, parameters in program)


def check(pairs: DataFrame, program: Program) -> DataFrame:
    """(task_id, ok): does the program turn every input g of a task into its ``wanted`` grid?"""
    done = run(pairs, program)
    return done.groupBy("task_id").agg(F.bool_and(F.coalesce(F.col("g") == F.col("wanted"), F.lit(False))).alias("ok"))


def explaining(pairs: DataFrame, programs: list[Program]) -> DataFrame:
    """(task_id, program): which of the candidate programs explain which tasks.

    All candidates are projections of one scan of the pairs: each adds whether it makes the wanted grid, and one
    aggregation says which hold for all pairs of a task.
    """
    made, flags = pairs, []
    for n, program in enumerate(programs):
        kept, flag = made.columns, f"_ok_{n}"
        done = run(made.select(*kept, F.struct("g", "h", "w", "err").alias("_own")), program)
        ok = F.coalesce(F.col("g") == F.col("wanted"), F.lit(False)).alias(flag)
        made = done.select(*[F.col(f"_own.{c}").alias(c) if c in ("g", "h", "w", "err") else F.col(c) for c in kept], ok)
        flags.append(flag)
    fits = made.groupBy("task_id").agg(*[F.bool_and(flag).alias(flag) for flag in flags])
    named = F.array_compact(F.array(*[F.when(F.col(flag), F.lit(text(p))) for flag, p in zip(flags, programs)]))
    return fits.select("task_id", F.explode(named).alias("program"))


def error(g: str = "g", wanted: str = "wanted") -> F.Column:
    """How far a grid is from the wanted one: differing cells, or for other sizes 400 + 25 for each line too many or few and half the difference of the colour counts."""
    rows = lambda x: F.size(x)
    width = lambda x: F.size(F.get(x, F.lit(0)))
    dh, dw = F.abs(rows(F.col(g)) - rows(F.col(wanted))), F.abs(width(F.col(g)) - width(F.col(wanted)))
    count = lambda x, k: F.size(F.filter(F.flatten(F.col(x)), lambda v: v == k))
    spread = F.aggregate(F.sequence(F.lit(0), F.lit(9)), F.lit(0), lambda a, k: a + F.abs(count(g, k) - count(wanted, k)))
    same = F.size(F.filter(F.zip_with(F.flatten(F.col(g)), F.flatten(F.col(wanted)), lambda a, b: a != b), lambda x: x))
    return F.when((dh == 0) & (dw == 0), same).otherwise(400 + 25 * dh + 25 * dw + F.floor(spread / 2)).cast("long")
