"""Queries over the given tables for object tables, augmentations, layer features and task analytics, with DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions.grids import Frame
from tessel.functions.selectors import SELECTORS, Objects
from tessel.operators import OPERATORS
from tessel.plans import analytics, augment, programs
from tessel.plans.queries import _BASE, _labels
from tessel.sources.grids import from_lineitem, to_cells


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The object table of every grid (segmentation c8)."""
    f = Frame(from_lineitem(spark, sf_dir))
    o = Objects(f, "c8")
    rows = f.df.select("gid", F.explode(o.all).alias("o"))
    return rows.select("gid", F.col("o.color").alias("color"), *[F.col(f"o.{n}").alias(n) for n in ("size", "r0", "r1", "c0", "c1")], (F.col("o.size") == F.col("o.h") * F.col("o.w")).alias("rect"))


def selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gid, selector, n): how many objects each of the 30 selectors picks; value 2 where one is needed."""
    f = Frame(from_lineitem(spark, sf_dir))
    o = Objects(f, "m4")
    counts = [F.struct(F.lit(name).alias("selector"), F.size(o.select({"by": name, "value": 2})).alias("n")) for name in SELECTORS]
    return f.df.select("gid", F.explode(F.array(*counts)).alias("s")).select("gid", "s.selector", "s.n")


def augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gid, key, r, c, v): every grid turned k quarters, then transposed or not, with colours cycled by one."""
    grids = OPERATORS["shift_colors"](from_lineitem(spark, sf_dir), s=1)
    f = Frame(grids)
    g = f.let(f.g)
    t = f.let(F.transform(F.get(g, F.lit(0)), lambda _, c: F.transform(g, lambda row: F.get(row, c))))
    over = lambda x: F.transform(x, lambda row: F.reverse(row))
    # A grid and its transpose, with rows, columns, both or none reversed, are all eight.
    made = {"rot0": g, "rot0.transpose": t, "rot1": F.reverse(t), "rot1.transpose": over(g), "rot2": F.reverse(over(g)), "rot2.transpose": F.reverse(over(t)), "rot3": over(t), "rot3.transpose": F.reverse(g)}
    rows = f.df.select("gid", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), x.alias("g")) for k, x in made.items()])).alias("x"))
    return rows.select(F.struct("gid", "x.key").alias("gid"), "x.g").transform(to_cells).select("gid.gid", "gid.key", "r", "c", "v")


def restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gid, key, step, r, c, v): every grid changed by ten keys, and what is left after changing it back."""
    keys = [*augment.TURNS, "base.permute0213456789", "base.rot90.permute1023456789.transpose.run1"]
    grids = from_lineitem(spark, sf_dir)
    one = F.array(*[F.struct(F.lit(k).alias("key"), augment.forward(F.col("g"), k).alias("g")) for k in keys])
    changed = grids.select("gid", F.explode(one).alias("x")).select("gid", "x.key", "x.g")
    back = F.coalesce(*[F.when(F.col("key") == k, augment.inverse(F.col("g"), k)) for k in keys])
    both = changed.withColumn("x", F.explode(F.array(F.struct(F.lit("changed").alias("step"), "g"), F.struct(F.lit("restored").alias("step"), back.alias("g")))))
    return both.select(F.struct("gid", "key", "x.step").alias("gid"), "x.g").transform(to_cells).select("gid.gid", "gid.key", "gid.step", "r", "c", "v")


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gid, v, n, objects, largest, r0, r1, c0, c1, border): a node for each colour of a grid, with its 4-connected components."""
    f = Frame(from_lineitem(spark, sf_dir))
    o = Objects(f, "c4")
    rows = f.df.select("gid", F.explode(o.all).alias("o"), (f.h - 1).alias("hh"), (f.w - 1).alias("ww"))
    edge = (F.col("o.r0") == 0) | (F.col("o.c0") == 0) | (F.col("o.r1") == F.col("hh")) | (F.col("o.c1") == F.col("ww"))
    return rows.groupBy("gid", F.col("o.color").alias("v")).agg(
        F.sum("o.size").alias("n"), F.count(F.lit(1)).alias("objects"), F.max("o.size").alias("largest"), F.min("o.r0").alias("r0"), F.max("o.r1").alias("r1"), F.min("o.c0").alias("c0"), F.max("o.c1").alias("c1"), F.bool_or(edge).alias("border")
    )


def pipeline_of_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program of three steps with the trace of all its stages."""
    steps = [("keep_color", {"color": 3}), ("crop_to_content", {}), ("mirror_concat", {"mode": "h"})]
    traced = programs.trace(from_lineitem(spark, sf_dir), steps)
    return traced.select(F.struct("gid", "step").alias("gid"), "g").transform(to_cells).select("gid.gid", "gid.step", "r", "c", "v")


def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task_id, program): grids of four in a row are a task whose hidden rule is a flip or a recolouring; candidates that fit all its pairs."""
    grids = from_lineitem(spark, sf_dir).withColumn("task_id", F.floor(F.col("gid") / 4))
    rules = [[("flip", {"axis": 1})], [("recolor", {"src": 1, "dst": 2})], [("rot90", {"k": 2})]]
    hidden = [programs.run(grids.where(F.col("task_id") % 3 == k), rule).select("gid", F.col("g").alias("wanted")) for k, rule in enumerate(rules)]
    return programs.explaining(grids.join(reduce(DataFrame.unionByName, hidden), "gid"), rules)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as task records: an order's lines are its steps, named by flag and status."""
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("op"))
    grouped = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "op"))).alias("steps"))
    return grouped.select("id", F.transform("steps", lambda s: s["op"]).alias("ops"))


def _guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as guesses: a user's event types are solutions, with their values as scores."""
    events = _read(spark, sf_dir, "events")
    return events.select(F.col("user_id").alias("base_key"), F.col("event_id").alias("sub_key"), F.col("event_type").alias("solution"), F.col("value").alias("beam_score"), F.array(F.col("value"), F.col("value") / 2).alias("score_aug"))


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events")
    return events.groupBy(F.col("user_id").alias("base_key")).agg(F.min_by("event_type", "event_id").alias("solution")).withColumn("puzzle", F.col("base_key") % 50)


def operator_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.operator_usage(_records(spark, sf_dir))


def program_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.program_lengths(_records(spark, sf_dir))


def first_of_each_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.first_of_each_content(_records(spark, sf_dir))


def chosen_by_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = analytics.by_agreement(_guesses(spark, sf_dir)).where("rank <= 2")
    return ranked.select("base_key", "solution", F.round("score", 6).alias("score"), "rank")


def chosen_by_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = analytics.by_product(_guesses(spark, sf_dir)).where("rank <= 2")
    return ranked.select("base_key", "solution", F.round("score", 6).alias("score"), "rank")


def submission_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    guesses, truth = _guesses(spark, sf_dir), _truth(spark, sf_dir)
    tried = analytics.attempts(analytics.by_agreement(guesses), truth, "none")
    return analytics.credit(tried, truth).select("puzzle", F.round("credit", 9).alias("credit"))


def holdout_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as results: good documents are accepted, correct if not toxic."""
    labels = _read(spark, sf_dir, "labels")
    return analytics.precision(labels.select((F.col("quality") == 1).alias("accepted"), (F.col("toxic") == 0).alias("correct"))).select("tasks", "accepted", F.round("precision", 9).alias("precision"), F.round("answered", 9).alias("answered"))


QUERIES = {f.__name__: f for f in (objects, selected, augmented, restored, layers, pipeline_of_steps, explained, operator_usage, program_lengths, first_of_each_content, chosen_by_agreement, chosen_by_product, submission_credit, holdout_precision)}

_RECORDS = "WITH rec AS (SELECT l_orderkey AS id, list(l_returnflag || l_linestatus ORDER BY l_linenumber, l_returnflag || l_linestatus) AS ops FROM lineitem GROUP BY l_orderkey)"


def _choice(score: str) -> str:
    return f"""SELECT base_key, solution, round(score, 6) AS score, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY base_key ORDER BY score DESC, first_key) AS rank FROM (
    SELECT user_id AS base_key, event_type AS solution, {score} AS score, min(event_id) AS first_key FROM events GROUP BY ALL)) WHERE rank <= 2"""


def _turned(key: str, r: str, c: str, v: str = "v") -> str:
    return f"SELECT gid, '{key}' AS key, {r} AS r, {c} AS c, {v} AS v FROM cells"


# A step of rot90 takes (r, c) to (11 - c, r), transpose to (c, r).
_RESTORED = f"""WITH {_BASE}, changed AS ({" UNION ALL ".join([
    _turned("base", "r", "c"), _turned("base.rot90", "11 - c", "r"), _turned("base.rot90.rot90", "11 - r", "11 - c"), _turned("base.rot90.rot90.rot90", "c", "11 - r"),
    _turned("base.transpose", "c", "r"), _turned("base.transpose.rot90", "11 - r", "c"), _turned("base.transpose.rot90.rot90", "11 - c", "11 - r"), _turned("base.transpose.rot90.rot90.rot90", "r", "11 - c"),
    _turned("base.permute0213456789", "r", "c", "CASE v WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE v END"),
    _turned("base.rot90.permute1023456789.transpose.run1", "r", "11 - c", "CASE v WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE v END"),
])}) SELECT gid::BIGINT AS gid, key, 'changed' AS step, r::INT AS r, c::INT AS c, v::INT AS v FROM changed
  UNION ALL SELECT gid, key, 'restored', r, c, v FROM cells CROSS JOIN (SELECT DISTINCT key FROM changed)"""  # fmt: skip

ORACLE_SQL = {
    "objects": f"WITH RECURSIVE {_BASE}, {_labels(True)} SELECT gid::BIGINT AS gid, v::INT AS color, size::INT AS size, r0::INT AS r0, r1::INT AS r1, c0::INT AS c0, c1::INT AS c1, size = (r1 - r0 + 1) * (c1 - c0 + 1) AS rect FROM o",
    "layers": f"WITH RECURSIVE {_BASE}, {_labels(False)} SELECT gid::BIGINT AS gid, v::INT AS v, sum(size)::BIGINT AS n, count(*)::BIGINT AS objects, max(size)::INT AS largest, min(r0)::INT AS r0, max(r1)::INT AS r1, min(c0)::INT AS c0, max(c1)::INT AS c1, bool_or(r0 = 0 OR c0 = 0 OR r1 = 11 OR c1 = 11) AS border FROM o GROUP BY gid, v",
    "augmented": f"WITH {_BASE}, s AS (SELECT gid, r, c, CASE WHEN v > 0 THEN v + 1 ELSE 0 END AS v FROM cells), t AS (SELECT 'rot0' AS key, gid, r, c, v FROM s UNION ALL SELECT 'rot1', gid, 11 - c, r, v FROM s UNION ALL SELECT 'rot2', gid, 11 - r, 11 - c, v FROM s UNION ALL SELECT 'rot3', gid, c, 11 - r, v FROM s) SELECT gid::BIGINT AS gid, key, r::INT AS r, c::INT AS c, v::INT AS v FROM t UNION ALL SELECT gid, key || '.transpose', c::INT, r::INT, v::INT FROM t",
    "restored": _RESTORED,
    "pipeline_of_steps": f"""WITH {_BASE}, box AS (SELECT gid, min(r) r0, max(r) r1, min(c) c0, max(c) c1 FROM cells WHERE v = 3 GROUP BY gid),
  a AS (SELECT gid, r, c, CASE WHEN v = 3 THEN 3 ELSE 0 END AS v FROM cells), b AS (SELECT gid, r - r0 AS r, c - c0 AS c, v, c1 - c0 + 1 AS w FROM a JOIN box USING (gid) WHERE r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1)
  SELECT gid::BIGINT AS gid, step::INT AS step, r::INT AS r, c::INT AS c, v::INT AS v FROM (SELECT gid, 0 AS step, r, c, v FROM cells UNION ALL SELECT gid, 1, r, c, v FROM a UNION ALL SELECT gid, 2, r, c, v FROM b
    UNION ALL SELECT gid, 3, r, c, v FROM b UNION ALL SELECT gid, 3, r, 2 * w - 1 - c, v FROM b UNION ALL SELECT gid, s, -1, -1, -1 FROM ids, (VALUES (2), (3)) x(s) WHERE gid NOT IN (SELECT gid FROM box))""",
    "operator_usage": "SELECT l_returnflag || l_linestatus AS op, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL",
    "program_lengths": _RECORDS + " SELECT len(ops)::INT AS length, count(*)::BIGINT AS n FROM rec GROUP BY ALL",
    "first_of_each_content": _RECORDS + " SELECT min(id) AS id, sha1(array_to_string(ops, ','))[:8] AS hash FROM rec GROUP BY ops",
    "chosen_by_agreement": _choice("count(*) - avg((value + value / 2) / 2)"),
    "chosen_by_product": _choice("sum(3.0 - value) + avg((3.0 - value) + (3.0 - value / 2))"),
    "submission_credit": f"""WITH best AS ({_choice("count(*) - avg((value + value / 2) / 2)")}), truth AS (SELECT user_id AS base_key, min_by(event_type, event_id) AS solution FROM events GROUP BY ALL)
  SELECT base_key % 50 AS puzzle, round(avg(CASE WHEN solution IN (SELECT solution FROM best b WHERE b.base_key = t.base_key) THEN 1.0 ELSE 0.0 END), 9) AS credit FROM truth t GROUP BY ALL""",
    "holdout_precision": "SELECT count(*)::BIGINT AS tasks, count(*) FILTER (quality = 1)::BIGINT AS accepted, round(avg(CASE WHEN toxic = 0 THEN 1.0 ELSE 0.0 END) FILTER (quality = 1), 9) AS precision, round(avg(CASE WHEN quality = 1 AND toxic = 0 THEN 1.0 ELSE 0.0 END), 9) AS answered FROM labels",
}
