"""Queries for the work on task tables: pools, coverage, skeletons, means, choice among guesses, calibration, roles, valid tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions.grids import Frame
from tessel.functions.selectors import Objects
from tessel.plans import analytics, programs
from tessel.plans.queries import _BASE, _labels
from tessel.plans.tables import _RECORDS, _choice, _guesses, _read, _records, _truth
from tessel.sources import tasks
from tessel.sources.grids import from_lineitem, to_cells


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flag and status of a line as operators, the flag as their category."""
    return _read(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("op"), F.col("l_returnflag").alias("category")).distinct()


def record_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.categories(_records(spark, sf_dir), _known(spark, sf_dir)).select("id", F.array_join("categories", ",").alias("categories"))


def operator_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.pool(_known(spark, sf_dir), exclude=["AF"], within=["A", "R"])


def unused_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of any flag, or X, and any status that no line has."""
    lines = _read(spark, sf_dir, "lineitem")
    flags = lines.select("l_returnflag").distinct().union(spark.range(1).select(F.lit("X")))
    known = flags.crossJoin(lines.select("l_linestatus").distinct())  # a few of each
    return analytics.unused(_records(spark, sf_dir), known.select(F.concat("l_returnflag", "l_linestatus").alias("op")))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of up to four lines as solved tasks: the first line's operator is the one found."""
    return _records(spark, sf_dir).select("id", F.when(F.size("ops") <= 4, F.get("ops", F.lit(0))).alias("op"))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.coverage(_results(spark, sf_dir)).select("tasks", "covered", F.round("pct", 6).alias("pct"))


def coverage_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.top(_results(spark, sf_dir), "op", 25)


def skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve commonest operator sequences of program texts; ties: first seen."""
    text = F.array_join(F.transform("ops", lambda op: F.concat(F.lower(op), F.lit("(color=1)"))), " | ")
    known = ["af", "ao", "nf", "no", "rf", "ro"]
    rows = _records(spark, sf_dir).select("id", analytics.skeleton(text, known).alias("skeleton"))
    return analytics.top(rows, "skeleton", 12, "id")


def evaluation_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as evaluated tasks: clicks are skipped ones."""
    events = _read(spark, sf_dir, "events").select((F.col("event_type") == "click").alias("skipped"), (F.col("value") > 50).alias("verified"), F.col("value").alias("valid"))
    return analytics.means(events, ["verified", "valid"]).select("evaluated", "skipped", F.round("verified", 6).alias("verified"), F.round("valid", 6).alias("valid"))


def category_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as predicted tokens, by type."""
    tokens = _read(spark, sf_dir, "events").select(F.col("event_type").alias("category"), (F.col("value") > 20).alias("hit"), F.col("value").alias("loss"))
    return analytics.by_category(tokens).select("category", "n", F.round("accuracy", 6).alias("accuracy"), F.round("loss", 6).alias("loss"))


def prior_of_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.prior(_read(spark, sf_dir, "events"), "event_type").select("n", F.round("entropy", 6).alias("entropy"), F.round("mode_share", 6).alias("mode_share"))


def selection_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    algorithms = {"agreement": analytics.by_agreement, "product": analytics.by_product}
    found = analytics.selection_benchmark(_guesses(spark, sf_dir), _truth(spark, sf_dir), algorithms, n_guesses=1)
    return found.select("algorithm", "right", F.round("credit", 6).alias("credit"), "puzzles")


def cheapest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, cost, place): orders by their quantity, those of the least first; ties by id."""
    cost = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_quantity").cast("long").alias("cost"))
    return tasks.placed(cost.withColumn("by", F.struct("cost", "id")), "by").select("id", "cost", F.col("place").cast("long").alias("place"))


def every_third_of_a_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers after the first ten: every third, of these every other, of these the first hundred."""
    return tasks.part(_read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", offset=10, limit=100, stride=3, shards=2, shard=1)


def critic_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as tasks and their events as held-out examples; purchases have nothing to compare with."""
    events = _read(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.when(F.col("event_type") != "purchase", F.col("value") - 20).alias("margin"), F.col("value").alias("positive"))
    counted = events.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"))
    found = analytics.calibrated(events.join(counted, "task_id"), 1.0, 25.0)
    return found.select("task_id", "used", "required", "passed", F.round("median_margin", 6).alias("median_margin"), F.round("median_positive", 6).alias("median_positive"), "reliable")


def layer_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gid, role, v) of every grid's colours (c4 components, background 0)."""
    f = Frame(from_lineitem(spark, sf_dir))
    o = Objects(f, "c4")
    rows = f.df.select("gid", F.explode(o.all).alias("o"), (f.h - 1).alias("hh"), (f.w - 1).alias("ww"))
    edge = (F.col("o.r0") == 0) | (F.col("o.c0") == 0) | (F.col("o.r1") == F.col("hh")) | (F.col("o.c1") == F.col("ww"))
    layers = rows.groupBy("gid", F.col("o.color").alias("v")).agg(
        F.sum("o.size").alias("area"), F.count(F.lit(1)).alias("components"), F.min("o.size").alias("smallest"), F.max("o.size").alias("largest"), F.sum("o.holes").alias("holes"), F.bool_or(edge).alias("touches")
    )
    return analytics.layer_roles(layers, "gid", f.df.select("gid", F.lit(0).alias("v")))


def object_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gid, node, color, area, r0, r1, c0, c1, centre_r, centre_c, share, touches): the sixteen largest objects of each grid."""
    f = Frame(from_lineitem(spark, sf_dir))
    o = Objects(f, "c4")
    keyed = F.transform(o.all, lambda x: F.struct((-x["size"]).alias("a"), (F.get(x["cells"], F.lit(0))["r"] * 32 + F.get(x["cells"], F.lit(0))["c"]).alias("b"), x.alias("o")))
    rows = f.df.select("gid", "h", "w", F.posexplode(F.slice(F.array_sort(keyed), 1, 16)).alias("node", "k"))
    x = F.col("k.o")
    mean = lambda n: F.aggregate(x["cells"], F.lit(0.0), lambda a, y: a + y[n]) / x["size"]
    edge = (x["r0"] == 0) | (x["c0"] == 0) | (x["r1"] == F.col("h") - 1) | (x["c1"] == F.col("w") - 1)
    return rows.select(
        "gid", "node", x["color"].alias("color"), x["size"].alias("area"), *[x[n].alias(n) for n in ("r0", "r1", "c0", "c1")], F.round(mean("r"), 6).alias("centre_r"), F.round(mean("c"), 6).alias("centre_c"), F.round(x["size"] / (F.col("h") * F.col("w")), 6).alias("share"), edge.alias("touches")
    )


def object_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gid, a, b, same_color, same_area, overlap_r, overlap_c, inside, distance): pairs of a grid's sixteen largest objects."""
    nodes = object_graph_nodes(spark, sf_dir)
    listed = nodes.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("node", "color", "area", "r0", "r1", "c0", "c1", "centre_r", "centre_c"))).alias("nodes"))  # at most sixteen
    pairs = listed.select("gid", F.explode("nodes").alias("a"), "nodes").select("gid", "a", F.explode(F.filter("nodes", lambda b: b["node"] > F.col("a.node"))).alias("b"))
    a, b = F.col("a"), F.col("b")
    overlap = lambda lo, hi: F.greatest(F.lit(0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]) + 1)
    within = lambda x, y: (x["r0"] >= y["r0"]) & (x["r1"] <= y["r1"]) & (x["c0"] >= y["c0"]) & (x["c1"] <= y["c1"])
    return pairs.select(
        "gid", a["node"].alias("a"), b["node"].alias("b"), (a["color"] == b["color"]).alias("same_color"), (a["area"] == b["area"]).alias("same_area"), overlap("r0", "r1").alias("overlap_r"), overlap("c0", "c1").alias("overlap_c"),
        (within(a, b) | within(b, a)).alias("inside"), F.round(F.abs(a["centre_r"] - b["centre_r"]) + F.abs(a["centre_c"] - b["centre_c"]), 4).alias("distance"),
    )


_STEPS = [("keep_color", {"color": 3}), ("flip", {"axis": 1})]


def valid_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four grids in a row are a task for a program of two steps; those that teach something."""
    stages = programs.trace(from_lineitem(spark, sf_dir), _STEPS)
    return analytics.valid_tasks(stages.select(F.floor(F.col("gid") / 4).alias("task_id"), F.col("gid").alias("idx"), "step", "g"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, prompt, completion): grids of four in a row, flipped, as a task's three demonstrations (as many as fit) and its test."""
    flipped = programs.run(from_lineitem(spark, sf_dir).withColumn("input", F.col("g")), [("flip", {"axis": 1})])
    rows = flipped.groupBy(F.floor(F.col("gid") / 4).alias("id")).agg(F.array_sort(F.collect_list(F.struct("gid", "input", "g"))).alias("all"))
    pair = lambda x: F.struct(x["input"].alias("input"), x["g"].alias("output"))
    n = F.size("all")
    made = rows.where(n > 1).select("id", F.transform(F.slice("all", F.lit(1), n - 1), pair).alias("train"), F.transform(F.slice("all", n, F.lit(1)), pair).alias("test"))
    return tasks.prompts(made, most=800)


def compared_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gid, text): every grid beside itself flipped."""
    flipped = programs.run(from_lineitem(spark, sf_dir).withColumn("input", F.col("g")), [("flip", {"axis": 0})])
    return tasks.side_by_side(flipped.select(F.col("gid").alias("task_id"), F.lit(0).alias("idx"), F.col("input").alias("g"), F.col("g").alias("wanted"))).select(F.col("task_id").alias("gid"), "text")


def record_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of counts over all records, maps as text."""
    shown = lambda name: F.array_join(F.transform(F.map_entries(name), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string"))), ",").alias(name)
    known = _known(spark, sf_dir).select("op").union(spark.range(1).select(F.lit("XX").alias("op")))
    return tasks.stats(_records(spark, sf_dir), known).select("tasks", shown("program_lengths"), shown("op_counts"), F.array_join("unused_ops", ",").alias("unused_ops"))


QUERIES = {
    f.__name__: f
    for f in (
        record_categories, operator_pool, unused_operators, coverage, coverage_top, skeletons, evaluation_means, category_scores, prior_of_types, selection_benchmark, cheapest_first, every_third_of_a_shard, critic_calibration, layer_roles,
        object_graph_nodes, object_graph_edges, valid_tasks, prompts, compared_side_by_side, record_stats,
    )
}

_RESULTS = _RECORDS + ", res AS (SELECT id, CASE WHEN len(ops) <= 4 THEN ops[1] END AS op FROM rec)"
_OBJECTS = f"WITH RECURSIVE {_BASE}, {_labels(False)}, mid AS (SELECT gid, k, avg(r) AS cr, avg(c) AS cc FROM own GROUP BY gid, k), nodes AS (SELECT o.*, cr, cc, row_number() OVER (PARTITION BY o.gid ORDER BY size DESC, o.k) - 1 AS node FROM o JOIN mid ON mid.gid = o.gid AND mid.k = o.k QUALIFY node < 16)"


def _text(value: str) -> str:
    """Rows of a grid of digits as lines, from cells with gid, r, c."""
    return f"(SELECT gid, string_agg(line, chr(10) ORDER BY r) AS text FROM (SELECT gid, r, string_agg({value}, '' ORDER BY c) AS line FROM cells GROUP BY gid, r) GROUP BY gid)"


_FLIPPED = "(SELECT gid, string_agg(line, chr(10) ORDER BY r) AS text FROM (SELECT gid, r, string_agg(v::VARCHAR, '' ORDER BY c DESC) AS line FROM cells GROUP BY gid, r) GROUP BY gid)"
_BENCH = "SELECT '{}' AS algorithm, count(*)::BIGINT AS right, round(coalesce(sum(part), 0), 6)::DOUBLE AS credit, (SELECT count(DISTINCT puzzle) FROM truth)::BIGINT AS puzzles FROM truth t WHERE EXISTS (SELECT 1 FROM ({}) b WHERE b.rank <= 1 AND b.base_key = t.base_key AND b.solution = t.solution)"

ORACLE_SQL = {
    "record_categories": _RECORDS + " SELECT id, string_agg(DISTINCT c, ',' ORDER BY c) AS categories FROM (SELECT id, unnest(ops)[1] AS c FROM rec) GROUP BY id",
    "operator_pool": "SELECT DISTINCT l_returnflag || l_linestatus AS op, l_returnflag AS category FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_returnflag || l_linestatus <> 'AF'",
    "unused_operators": "SELECT DISTINCT a.l_returnflag || b.l_linestatus AS op FROM (SELECT DISTINCT l_returnflag FROM lineitem UNION ALL SELECT 'X') a, (SELECT DISTINCT l_linestatus FROM lineitem) b WHERE a.l_returnflag || b.l_linestatus NOT IN (SELECT l_returnflag || l_linestatus FROM lineitem)",
    "coverage": _RESULTS + " SELECT count(*)::BIGINT AS tasks, count(op)::BIGINT AS covered, round(100.0 * count(op) / count(*), 6)::DOUBLE AS pct FROM res",
    "coverage_top": _RESULTS + " SELECT op, count(*)::BIGINT AS n, row_number() OVER (ORDER BY count(*) DESC, op)::INT AS rank FROM res WHERE op IS NOT NULL GROUP BY op QUALIFY rank <= 25",
    "skeletons": _RECORDS + " SELECT lower(array_to_string(ops, '|')) AS skeleton, count(*)::BIGINT AS n, row_number() OVER (ORDER BY count(*) DESC, min(id))::INT AS rank FROM rec WHERE len(ops) <= 4 GROUP BY ops QUALIFY rank <= 12",
    "evaluation_means": "SELECT count(*) FILTER (event_type <> 'click')::BIGINT AS evaluated, count(*) FILTER (event_type = 'click')::BIGINT AS skipped, round(avg((value > 50)::INT) FILTER (event_type <> 'click'), 6) AS verified, round(avg(value) FILTER (event_type <> 'click'), 6) AS valid FROM events",
    "category_scores": "SELECT event_type AS category, count(*)::BIGINT AS n, round(avg((value > 20)::INT), 6) AS accuracy, round(avg(value), 6) AS loss FROM events GROUP BY ALL",
    "prior_of_types": "SELECT sum(n)::BIGINT AS n, round(-sum(n / t * ln(n / t)), 6) AS entropy, round(max(n) / max(t), 6) AS mode_share FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS t FROM events GROUP BY event_type)",
    "selection_benchmark": "WITH truth AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY puzzle) AS part FROM (SELECT user_id AS base_key, user_id % 50 AS puzzle, min_by(event_type, event_id) AS solution FROM events GROUP BY ALL)) "
    + _BENCH.format("agreement", _choice("count(*) - avg((value + value / 2) / 2)"))
    + " UNION ALL "
    + _BENCH.format("product", _choice("sum(3.0 - value) + avg((3.0 - value) + (3.0 - value / 2))")),
    "cheapest_first": "SELECT l_orderkey AS id, sum(l_quantity)::BIGINT AS cost, (row_number() OVER (ORDER BY sum(l_quantity)::BIGINT, l_orderkey) - 1)::BIGINT AS place FROM lineitem GROUP BY l_orderkey",
    "every_third_of_a_shard": "SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 11 AS n FROM customer) WHERE n >= 0 AND n % 3 = 0 AND (n // 3) % 2 = 1 AND n // 6 < 100",
    "critic_calibration": """SELECT task_id, used, required, passed, round(mm, 6) AS median_margin, round(mp, 6) AS median_positive, coalesce(used >= required AND passed >= required AND mm >= 1 AND mp >= 25, false) AS reliable FROM (
      SELECT user_id AS task_id, count(*) FILTER (event_type <> 'purchase')::BIGINT AS used, greatest(1, ceil(0.6 * count(*)))::BIGINT AS required, count(*) FILTER (event_type <> 'purchase' AND value - 20 >= 1)::BIGINT AS passed,
        median(value - 20) FILTER (event_type <> 'purchase') AS mm, median(value) FILTER (event_type <> 'purchase') AS mp FROM events GROUP BY user_id)""",
    "object_graph_nodes": _OBJECTS + " SELECT gid::BIGINT AS gid, node::INT AS node, v::INT AS color, size::INT AS area, r0::INT AS r0, r1::INT AS r1, c0::INT AS c0, c1::INT AS c1, round(cr, 6) AS centre_r, round(cc, 6) AS centre_c, round(size / 144, 6) AS share, (r0 = 0 OR c0 = 0 OR r1 = 11 OR c1 = 11) AS touches FROM nodes",
    "object_graph_edges": _OBJECTS
    + """ SELECT a.gid::BIGINT AS gid, a.node::INT AS a, b.node::INT AS b, a.v = b.v AS same_color, a.size = b.size AS same_area, greatest(0, least(a.r1, b.r1) - greatest(a.r0, b.r0) + 1)::INT AS overlap_r, greatest(0, least(a.c1, b.c1) - greatest(a.c0, b.c0) + 1)::INT AS overlap_c,
      (a.r0 >= b.r0 AND a.r1 <= b.r1 AND a.c0 >= b.c0 AND a.c1 <= b.c1) OR (b.r0 >= a.r0 AND b.r1 <= a.r1 AND b.c0 >= a.c0 AND b.c1 <= a.c1) AS inside, round(abs(round(a.cr, 6) - round(b.cr, 6)) + abs(round(a.cc, 6) - round(b.cc, 6)), 4) AS distance FROM nodes a JOIN nodes b ON a.gid = b.gid AND a.node < b.node""",
    "valid_tasks": f"""WITH {_BASE}, s AS (SELECT gid, list(v ORDER BY r, c) AS a, list(CASE WHEN v = 3 THEN 3 ELSE 0 END ORDER BY r, c) AS b, list(CASE WHEN v = 3 THEN 3 ELSE 0 END ORDER BY r, c DESC) AS d FROM cells GROUP BY gid)
      SELECT (gid // 4)::BIGINT AS task_id FROM s GROUP BY gid // 4 HAVING count(DISTINCT a) = count(*) AND count(DISTINCT d) >= 2 AND bool_and(a <> d AND list_max(a) > 0 AND list_max(d) > 0) AND 2 * count(*) FILTER (a <> b) >= count(*) AND 2 * count(*) FILTER (b <> d) >= count(*)""",
    "prompts": f"""WITH {_BASE}, p AS (SELECT gid, gid // 4 AS id, 'INPUT' || chr(10) || a.text || chr(10) || 'OUTPUT' || chr(10) AS asked, b.text AS done, row_number() OVER (PARTITION BY gid // 4 ORDER BY gid) AS k, count(*) OVER (PARTITION BY gid // 4) AS n FROM {_text("v::VARCHAR")} a JOIN {_FLIPPED} b USING (gid)),
      d AS (SELECT *, sum(length(asked || done) + 1) OVER (PARTITION BY id ORDER BY k) AS upto FROM p WHERE k < n)
      SELECT p.id::BIGINT AS id, coalesce((SELECT string_agg(d.asked || d.done || chr(10), '' ORDER BY d.k) FROM d WHERE d.id = p.id AND d.upto + length(p.asked) <= 800), '') || p.asked AS prompt, p.done AS completion FROM p WHERE k = n AND n > 1""",
    "compared_side_by_side": f"WITH {_BASE}, l AS (SELECT gid, r, string_agg(CASE WHEN v = 0 THEN '.' ELSE v::VARCHAR END, '' ORDER BY c) AS t FROM cells GROUP BY gid, r) SELECT a.gid::BIGINT AS gid, string_agg(a.t || ' | ' || b.t, chr(10) ORDER BY a.r) AS text FROM l a JOIN l b ON b.gid = a.gid AND b.r = 11 - a.r GROUP BY a.gid",
    "record_stats": _RECORDS
    + """ SELECT count(*)::BIGINT AS tasks, (SELECT string_agg(l || '=' || n, ',' ORDER BY l) FROM (SELECT len(ops) AS l, count(*) AS n FROM rec GROUP BY len(ops))) AS program_lengths,
      (SELECT string_agg(op || '=' || n, ',' ORDER BY op) FROM (SELECT op, count(*) AS n FROM (SELECT unnest(ops) AS op FROM rec) GROUP BY op)) AS op_counts, 'XX' AS unused_ops FROM rec""",
}
