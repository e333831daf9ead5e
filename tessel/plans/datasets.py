"""Random programs that fit the grids they act on, and tasks made of them, one for each index.

Everything is drawn by a counter-based hash of (seed, index, attempt, step, try), so a task is the same whatever
the partitioning and however often a part is run again.  Tries are rows, not a loop: all tries of a step are taken at
once and the first good one stays.  Indices whose attempts all failed, or made a task that is there already, come again in
the next round with new attempts; results go to a ``Results`` store, so an interrupted run goes on where it stopped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.plans.samplers import Choice, applied, branches, drawn_branch, drawn_step, step_text, weighted
from tessel.plans.store import Results, written
from tessel.sources.generators import PRIME, draw, drawn

#: How often programs of each length are drawn, and the bounds of train and test pairs (fixed values).
LENGTHS, TRAIN, TEST = {1: 0.2, 2: 0.4, 3: 0.3, 4: 0.1}, (2, 5), (1, 2)
#: Parameters tried for a step; attempts of an index taken at once; inputs drawn for each pair that is needed.
TRIES, ATTEMPTS, SPARE = 15, 3, 3
#: Tries that are made for every seed; the others are for those without a good one among them.
EARLY = 2

_ONE = "branch int, a int, b int, by string, value int, text string"


def program_length(seed: Column, least: int = 1, most: int = 4) -> Column:
    """A length from least to most by its weight."""
    lengths = [n for n in LENGTHS if least <= n <= most]
    return weighted(lengths, [LENGTHS[n] for n in lengths], draw(seed, 201)).cast("int")


def _mixed(*parts: Column | int) -> Column:
    """A seed from several numbers."""
    return F.pmod(F.xxhash64(*[F.lit(p).cast("long") if isinstance(p, int) else p.cast("long") for p in parts]), F.lit(PRIME * 1_000_000))


def _from_kinds(rows: DataFrame, kinds: list[str], seed: Column) -> DataFrame:
    """``rows`` (with the name of a kind in ``gen``) with a grid of that kind for each."""
    stored = written(rows.drop("g", "h", "w", "err"), "seeds", by="gen")
    return reduce(DataFrame.unionByName, [drawn(stored.where(F.col("gen") == kind), kind, seed) for kind in kinds])


def sampled_programs(seeds: DataFrame, choices: list[Choice], tries: int = TRIES, most: int = max(LENGTHS)) -> DataFrame:
    """(seed, gen, steps, program) of the seeds whose every step could be drawn; ``seeds``: seed long, length int (``most`` at most).

    The first operator fixes the kind of grid that the probe is.  Each step's operator differs from the one before;
    of its tries the first counts whose parameters, drawn from the probe as it is by then, are not refused and change it.
    """
    known = branches(choices)
    kinds = sorted({kind for c in choices for kind in c.gens})
    states = seeds.select("seed", "length", F.lit(None).cast("int").alias("last"), F.lit(None).cast("string").alias("gen"), F.array().cast(f"array<struct<{_ONE.replace(' ', ':').replace(',:', ',')}>>").alias("steps"))
    for step in range(most):
        due, done = states.where(F.col("length") > step), states.where(F.col("length") <= step)
        salt = 1000 + 100 * step
        n = len(choices)
        u = draw(F.col("seed"), salt)
        other = (F.col("last") + 1 + u % F.lit(max(1, n - 1))) % n  # any but the last one
        due = due.withColumn("choice", F.coalesce(other, u % n).cast("int"))
        kept = None
        # Later tries are made for those seeds alone whose first ones all failed.
        for tried in [range(min(EARLY, tries)), range(EARLY, tries)]:
            if not tried:
                continue
            rows = due.withColumn("t", F.explode(F.sequence(F.lit(tried[0]), F.lit(tried[-1]))))
            if not step:
                gens = F.lit(None).cast("string")
                for k, c in enumerate(choices):
                    gens = F.when(F.col("choice") == k, weighted(list(c.gens), [1.0] * len(c.gens), draw(F.col("seed"), salt + 1))).otherwise(gens)
                rows = _from_kinds(rows.withColumn("gen", gens).withColumn("own", _mixed(F.col("seed"), F.col("t"))), kinds, F.col("own"))
            rows = rows.withColumn("own", _mixed(F.col("seed"), F.col("t"), step)).withColumn("branch", drawn_branch(known, choices, F.col("choice"), draw(F.col("seed"), salt + 2, F.col("t")))).withColumn("before", F.col("g"))
            took = applied(rows, known, lambda df, b, salt=salt: drawn_step(df, b, F.col("own"), salt + 10))
            took = took.where(F.col("err").isNull() & (F.col("g") != F.col("before"))).withColumn("text", step_text(known))
            one = F.struct("branch", "a", "b", "by", "value", "text")
            found = took.groupBy("seed").agg(F.min_by(F.struct("length", F.col("choice").alias("last"), "gen", F.concat("steps", F.array(one)).alias("steps"), "g", "h", "w", "err"), "t").alias("x")).select("seed", "x.*")
            if tried[-1] + 1 < tries:
                found = written(found, "found")
                due = due.join(found.select("seed"), "seed", "left_anti")
            kept = found if kept is None else kept.unionByName(found)
        if not step:
            done = done.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("g", "array<array<int>>"), ("h", "int"), ("w", "int"), ("err", "string"))])
        states = written(kept.unionByName(done), "programs")
    return states.where(F.size("steps") > 0).select("seed", "gen", "steps", F.array_join(F.transform("steps", lambda s: s["text"]), " | ").alias("program"))


def run(rows: DataFrame, choices: list[Choice], most: int = max(LENGTHS)) -> DataFrame:
    """``rows`` (g, h, w, err and ``steps``, ``most`` at most) after all their own steps, with ``changed``: whether each step changed the grid."""
    known = branches(choices)
    states = rows.withColumn("changed", F.array().cast("array<boolean>"))
    for step in range(most):
        longer = F.size("steps") > step
        now = F.get("steps", F.lit(step))
        due = states.where(longer & F.col("err").isNull()).withColumns({c: now[c] for c in ("branch", "a", "b", "by", "value")}).withColumn("before", F.col("g"))
        took = applied(due, known).withColumn("changed", F.concat("changed", F.array(F.coalesce(F.col("g") != F.col("before"), F.lit(False)))))
        states = written(took.select(*states.columns).unionByName(states.where(~longer | F.col("err").isNotNull())), "run")
    return states


def built(seeds: DataFrame, choices: list[Choice], least: int = 1, most: int = 4) -> DataFrame:
    """(seed, gen, program, ops, train, test, id) of the seeds that make a valid task.

    Inputs are drawn until there are enough pairs whose output differs from the input, neither of them empty, no input twice;
    each step must change at least half of them, and the outputs must not all be alike.  ``id``: eight hex digits of the content.
    """
    made = sampled_programs(seeds.select("seed", program_length(F.col("seed"), least, most).alias("length")), choices, most=most)
    pick = lambda bounds, salt: (bounds[0] + draw(F.col("seed"), salt) % (bounds[1] - bounds[0] + 1)).cast("int")
    made = made.withColumns({"n_train": pick(TRAIN, 203), "n_test": pick(TEST, 204)}).withColumn("need", F.col("n_train") + F.col("n_test"))
    rows = made.withColumn("j", F.explode(F.sequence(F.lit(1), F.col("need") * SPARE + 5)))
    rows = _from_kinds(rows.withColumn("own", _mixed(F.col("seed"), F.col("j") + 1000)), sorted({kind for c in choices for kind in c.gens}), F.col("own"))
    pairs = run(rows.withColumn("input", F.col("g")), choices, most).where("err IS NULL")
    filled = lambda g: F.exists(F.flatten(g), lambda v: v != 0)
    pairs = pairs.where((F.col("g") != F.col("input")) & filled("g") & filled("input"))
    pairs = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("seed", "input").orderBy("j"))).where("_n = 1")
    pairs = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("seed").orderBy("j"))).where(F.col("_n") <= F.col("need"))
    whole = pairs.groupBy("seed").agg(*[F.first(c).alias(c) for c in ("gen", "program", "n_train", "need")], F.first("steps").alias("steps"), F.array_sort(F.collect_list(F.struct("j", "input", F.col("g").alias("output"), "changed"))).alias("pairs"))  # at most ``need`` rows
    mattered = F.forall(F.sequence(F.lit(0), F.size("steps") - 1), lambda k: 2 * F.size(F.filter("pairs", lambda p: F.get(p["changed"], k))) >= F.size("pairs"))
    apart = F.size(F.array_distinct(F.transform("pairs", lambda p: p["output"]))) >= 2
    pairs_of = lambda part: F.transform(part, lambda p: F.struct(p["input"].alias("input"), p["output"].alias("output")))
    good = whole.where((F.size("pairs") == F.col("need")) & mattered & apart)
    good = good.select("seed", "gen", "program", F.transform("steps", lambda s: F.substring_index(s["text"], "(", 1)).alias("ops"), pairs_of(F.slice("pairs", F.lit(1), F.col("n_train"))).alias("train"), pairs_of(F.slice("pairs", F.col("n_train") + 1, F.col("need") - F.col("n_train"))).alias("test"))
    return good.withColumn("id", F.substring(F.sha1(F.to_json(F.struct("train", "test"))), 1, 8))


def generate(spark: SparkSession, indices: DataFrame, path: str, choices: list[Choice], seed: int = 0, rounds: int = 8, least: int = 1, most: int = 4) -> DataFrame:
    """(index, id, gen, program, ops, train, test): a task for each of ``indices`` (index long), kept at ``path``.

    A round takes ``ATTEMPTS`` attempts of all indices without a task, keeps each one's first valid attempt, drops what has the content
    of a task that is kept or of a smaller index, and keeps the rest.  Rounds end when no index is missing.  Calling it again
    with the same path goes on from there, and returns at once if all are there.
    """
    store = Results(spark, path, "index", "round")
    for number in range(rounds):
        missing = written(store.missing(indices.select(F.col("index").cast("long")).distinct()), "missing")
        if missing.isEmpty():
            break
        kept = store.latest()
        tries = missing.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(ATTEMPTS - 1))))
        # The round is part of the seed: an interrupted run repeats the same attempts for the same missing indices.
        tries = tries.withColumn("seed", _mixed(seed, F.col("index"), F.lit(number * ATTEMPTS) + F.col("attempt")))
        found = built(tries.select("seed"), choices, least, most).join(tries, "seed")
        first = found.withColumn("_n", F.row_number().over(Window.partitionBy("index").orderBy("attempt"))).where("_n = 1")
        first = first.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("index"))).where("_n = 1")
        if kept is not None:
            first = first.join(kept.select("id"), "id", "left_anti")
        store.put(first.select("index", F.lit(number).alias("round"), "id", "gen", "program", "ops", "train", "test"), f"{seed}-{number}")
    out = store.latest()
    return out.join(indices.select(F.col("index").cast("long")).distinct(), "index", "left_semi").drop("round")
