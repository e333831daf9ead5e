"""Table-level work on tasks, guesses and results: histograms, dedup, choice among guesses, scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def operator_usage(records: DataFrame) -> DataFrame:
    """(op, n): how often each operator occurs in the records' ``ops``."""
    return records.select(F.explode("ops").alias("op")).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


def program_lengths(records: DataFrame) -> DataFrame:
    return records.groupBy(F.size("ops").alias("length")).agg(F.count(F.lit(1)).alias("n"))


def unused(records: DataFrame, known: DataFrame) -> DataFrame:
    """The known operators (column op) that no record uses."""
    return known.join(records.select(F.explode("ops").alias("op")).distinct(), "op", "left_anti")


def first_of_each_content(records: DataFrame) -> DataFrame:
    """(id, hash): of records with the same ops, in order, the one of the smallest id; hash: 8 hex digits of their SHA-1."""
    hashed = records.select("id", F.substring(F.sha1(F.array_join("ops", ",").cast("binary")), 1, 8).alias("hash"), F.array_join("ops", ",").alias("content"))
    return hashed.groupBy("content").agg(F.min("id").alias("id"), F.first("hash").alias("hash")).select("id", "hash")


def _ranked(scored: DataFrame) -> DataFrame:
    order = Window.partitionBy("base_key").orderBy(F.desc("score"), "first_key")
    return scored.withColumn("rank", F.row_number().over(order))


def by_agreement(guesses: DataFrame) -> DataFrame:
    """(base_key, solution, score, rank): guesses that agree, less the mean of their mean augmented scores; ties: first seen."""
    mean = F.aggregate("score_aug", F.lit(0.0), lambda a, x: a + x) / F.size("score_aug")
    scored = guesses.groupBy("base_key", "solution").agg((F.count(F.lit(1)) - F.avg(mean)).alias("score"), F.min("sub_key").alias("first_key"))
    return _ranked(scored).select("base_key", "solution", "score", "rank")


def by_product(guesses: DataFrame, base: float = 3.0) -> DataFrame:
    """(base_key, solution, score, rank): sums of base - beam score, plus the mean of the augmented sums of base - score."""
    augmented = F.aggregate("score_aug", F.lit(0.0), lambda a, x: a + (F.lit(base) - x))
    scored = guesses.groupBy("base_key", "solution").agg((F.sum(F.lit(base) - F.col("beam_score")) + F.avg(augmented)).alias("score"), F.min("sub_key").alias("first_key"))
    return _ranked(scored).select("base_key", "solution", "score", "rank")


def attempts(ranked: DataFrame, keys: DataFrame, default: str) -> DataFrame:
    """(base_key, attempt_1, attempt_2): the two best solutions of every key, a default where there is none."""
    best = ranked.where("rank <= 2").groupBy("base_key").agg(F.max(F.when(F.col("rank") == 1, F.col("solution"))).alias("attempt_1"), F.max(F.when(F.col("rank") == 2, F.col("solution"))).alias("attempt_2"))
    joined = keys.select("base_key").distinct().join(best, "base_key", "left")
    return joined.select("base_key", *[F.coalesce(c, F.lit(default)).alias(c) for c in ("attempt_1", "attempt_2")])


def credit(tried: DataFrame, truth: DataFrame) -> DataFrame:
    """(puzzle, credit): each test of a puzzle gives 1 / its tests if one of its two attempts is right."""
    joined = truth.join(tried, "base_key", "left")
    right = F.coalesce((F.col("attempt_1") == F.col("solution")) | (F.col("attempt_2") == F.col("solution")), F.lit(False))
    return joined.groupBy("puzzle").agg(F.avg(right.cast("double")).alias("credit"))


def precision(results: DataFrame) -> DataFrame:
    """One row of ``results`` (accepted, correct): tasks, accepted ones, precision among them, share answered rightly."""
    accepted = F.col("accepted")
    return results.agg(F.count(F.lit(1)).alias("tasks"), F.count_if(accepted).alias("accepted"), F.avg(F.when(accepted, F.col("correct").cast("double"))).alias("precision"), F.avg((accepted & F.col("correct")).cast("double")).alias("answered"))


def categories(records: DataFrame, known: DataFrame) -> DataFrame:
    """(id, categories): the sorted distinct categories of a record's operators; ``known``: op, category."""
    used = records.select("id", F.explode("ops").alias("op")).join(F.broadcast(known), "op")
    return used.groupBy("id").agg(F.array_sort(F.collect_set("category")).alias("categories"))


def pool(known: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, within: list[str] | None = None) -> DataFrame:
    """The known operators (op, category) that are asked for; none at all is an error when the rows are read."""
    rows = known
    if include:
        rows = rows.where(F.col("op").isin(include))
    if exclude:
        rows = rows.where(~F.col("op").isin(exclude))
    if within:
        rows = rows.where(F.col("category").isin(within))
    if rows.isEmpty():
        raise ValueError("no operations selected")
    return rows


def coverage(results: DataFrame) -> DataFrame:
    """One row (tasks, covered, pct) of ``results`` (id, op: null where none was found)."""
    return results.agg(F.count(F.lit(1)).alias("tasks"), F.count("op").alias("covered"), (100.0 * F.count("op") / F.count(F.lit(1))).alias("pct"))


def top(values: DataFrame, name: str, k: int, first: str | None = None) -> DataFrame:
    """(value, n, rank): the k commonest values; ties: first seen (by ``first``), or smallest."""
    counted = values.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.min(first or name).alias("_first"))
    best = counted.orderBy(F.desc("n"), "_first").limit(k)
    return best.select(name, "n", F.row_number().over(Window.orderBy(F.desc("n"), "_first")).alias("rank"))  # k rows


def skeleton(text: Column, known: list[str]) -> Column:
    """The operator names of a program text, joined by |; null where one is unknown or there aren't one to four."""
    steps = F.split(text, r"\|")
    names = F.transform(steps, lambda s: F.regexp_extract(s, r"^\s*([a-z_][a-z0-9_]*)\s*\(", 1))
    good = F.forall(names, lambda n: n.isin(known)) & F.size(names).between(1, 4)
    return F.when(good, F.array_join(names, "|"))


def means(results: DataFrame, names: list[str]) -> DataFrame:
    """One row: evaluated and skipped results, and the mean of each of ``names`` over those that weren't skipped."""
    done = ~F.coalesce(F.col("skipped"), F.lit(False))
    return results.agg(F.count_if(done).alias("evaluated"), F.count_if(~done).alias("skipped"), *[F.avg(F.when(done, F.col(n).cast("double"))).alias(n) for n in names])


def by_category(tokens: DataFrame) -> DataFrame:
    """(category, n, accuracy, loss) of predicted tokens (category, hit, loss)."""
    return tokens.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("hit").cast("double")).alias("accuracy"), F.avg("loss").alias("loss"))


def prior(values: DataFrame, name: str) -> DataFrame:
    """One row (n, entropy in nats, share of the commonest) of the values' frequencies."""
    counted = values.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log("n")).alias("s"), F.max("n").alias("most"))
    return total.select("n", (F.log("n") - F.col("s") / F.col("n")).alias("entropy"), (F.col("most") / F.col("n")).alias("mode_share"))


def selection_benchmark(guesses: DataFrame, truth: DataFrame, algorithms: dict[str, Callable[[DataFrame], DataFrame]], n_guesses: int = 2) -> DataFrame:
    """(algorithm, right, credit, puzzles): keys of ``truth`` (base_key, solution, puzzle) answered by one of the first guesses;
    each gives its puzzle one part of as many as it has keys."""
    parts = truth.withColumn("part", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("puzzle")))
    out = None
    for name, choose in algorithms.items():
        found = choose(guesses).where(F.col("rank") <= n_guesses).select("base_key", F.col("solution").alias("guess"))
        hit = parts.join(found, (parts["base_key"] == found["base_key"]) & (parts["solution"] == found["guess"]), "left_semi")
        row = hit.agg(F.count(F.lit(1)).alias("right"), F.coalesce(F.sum("part"), F.lit(0.0)).alias("credit")).crossJoin(truth.agg(F.count_distinct("puzzle").alias("puzzles")))  # one row each
        row = row.select(F.lit(name).alias("algorithm"), "right", "credit", "puzzles")
        out = row if out is None else out.union(row)
    return out


def calibrated(margins: DataFrame, least_margin: float, least_score: float, share: float = 0.6) -> DataFrame:
    """(task_id, used, required, passed, median_margin, median_positive, reliable): may a critic be trusted on a task?

    ``margins``: task_id, n (its examples), margin and positive of held-out examples (null where there was nothing to
    compare).  At least ``share`` of the examples must be used and pass, and both medians be large enough.
    """
    rows = margins.groupBy("task_id").agg(
        F.max("n").alias("n"), F.count("margin").alias("used"), F.count_if(F.col("margin") >= least_margin).alias("passed"), F.median("margin").alias("median_margin"), F.median(F.when(F.col("margin").isNotNull(), F.col("positive"))).alias("median_positive")
    )
    rows = rows.withColumn("required", F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("n"))).cast("long"))
    good = (F.col("used") >= F.col("required")) & (F.col("passed") >= F.col("required")) & (F.col("median_margin") >= least_margin) & (F.col("median_positive") >= least_score)
    return rows.select("task_id", "used", "required", "passed", "median_margin", "median_positive", F.coalesce(good, F.lit(False)).alias("reliable"))


#: Roles of a grid's colour layers: the one layer that has the most or least of something, or alone has a property.
ROLES = {
    "rarest": ("area", "min"), "most_frequent": ("area", "max"), "fewest_components": ("components", "min"), "most_components": ("components", "max"),
    "smallest_object_layer": ("smallest", "min"), "largest_object_layer": ("largest", "max"),
}


def layer_roles(layers: DataFrame, key: str, background: DataFrame | None = None) -> DataFrame:
    """(key, role, v) of the roles that exactly one layer of a grid has.

    ``layers``: key, v, area, components, smallest, largest, holes, touches; a row for each colour but the background.
    ``background``: key, v, which is a role too.  The second largest layer is one of three at least.
    """
    by = Window.partitionBy(key)
    has = {role: F.col(field) == (F.min if way == "min" else F.max)(field).over(by) for role, (field, way) in ROLES.items()}
    has |= {"only_foreground": F.count(F.lit(1)).over(by) == 1, "has_hole": F.col("holes") > 0, "border_touching": F.col("touches"), "interior_only": ~F.col("touches")}
    has["second_largest_layer"] = (F.count(F.lit(1)).over(by) >= 3) & (F.dense_rank().over(by.orderBy(F.desc("area"))) == 2)
    marked = layers.select(key, "v", F.array(*[F.when(test, F.lit(role)) for role, test in has.items()]).alias("roles"))
    each = marked.select(key, "v", F.explode(F.array_compact("roles")).alias("role"))
    found = each.groupBy(key, "role").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v")).where("n = 1").select(key, "role", "v")
    return found if background is None else found.unionByName(background.select(key, F.lit("background").alias("role"), "v"))


def valid_tasks(stages: DataFrame) -> DataFrame:
    """(task_id) of tasks that teach something, from all stages (task_id, idx, step, g) of a program on each of their grids.

    Inputs differ from each other; no output equals its input; none of both is background alone; every step changes at
    least half of the grids; there are two different outputs at least; no step refused a grid.
    """
    stages = stages.withColumn("was", F.lag("g").over(Window.partitionBy("task_id", "idx").orderBy("step"))).withColumn("last", F.max("step").over(Window.partitionBy("task_id")))
    step = stages.where("step > 0").groupBy("task_id", "step").agg((2 * F.count_if(F.coalesce(F.col("g") != F.col("was"), F.lit(False))) >= F.count(F.lit(1))).alias("changes"))
    ends = stages.groupBy("task_id", "idx").agg(F.max(F.when(F.col("step") == 0, F.col("g"))).alias("input"), F.max(F.when(F.col("step") == F.col("last"), F.col("g"))).alias("output"), F.bool_and(F.col("g").isNotNull()).alias("whole"))
    full = lambda name: F.exists(F.flatten(name), lambda v: v != 0)
    task = ends.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("input").alias("inputs"), F.count_distinct("output").alias("outputs"), F.bool_and(F.coalesce(F.col("whole") & (F.col("input") != F.col("output")) & full("input") & full("output"), F.lit(False))).alias("good")
    )
    return task.where("good and inputs = n and outputs >= 2").join(step.where("not changes"), "task_id", "left_anti").select("task_id")
