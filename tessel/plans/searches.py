"""Queries for selectors, samplers, search, datasets, encoding, layer features and kept results, with DuckDB SQL for most."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions.grids import Frame, make
from tessel.functions.selectors import BY_COLOR, BY_HOLES, BY_SIZE, HOLES, MOST_SIZE, SELECTORS, WEIGHTS, Objects
from tessel.plans import datasets, encoding, layers, programs, samplers, search
from tessel.plans.more import _draw
from tessel.plans.queries import _BASE, _labels
from tessel.plans.store import Results, shared_dir, written
from tessel.plans.tables import _read
from tessel.sources.generators import PRIME, draw
from tessel.sources.grids import from_lineitem


def selectors_enumerated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gid, place, by, value, n): of each grid's objects (c8), one selector for each set that any picks, in the order in which they are tried."""
    f = Frame(from_lineitem(spark, sf_dir))
    found = Objects(f, "c8").enumerated()
    rows = f.df.select("gid", F.posexplode(found).alias("place", "x"))
    return rows.select("gid", "place", "x.by", "x.value", F.size("x.picks").alias("n"))


def sampled_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gid, seg, held, new, shift, length): one draw of each kind for every grid."""
    grids = from_lineitem(spark, sf_dir)
    held, seed = samplers.present(F.col("g")), F.col("gid")
    return grids.select(
        "gid", samplers.weighted(list(samplers.SEGMENTS), list(samplers.SEGMENTS.values()), draw(seed, 51)).alias("seg"), samplers.drawn_number("present", held, draw(seed, 52)).alias("held"),
        samplers.drawn_number("new", held, draw(seed, 53)).alias("new"), samplers.drawn_number("shift", held, draw(seed, 54)).alias("shift"), datasets.program_length(seed, 2, 4).alias("length"),
    )


def sampled_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(length, n): how often each program length is drawn for the orders."""
    return _read(spark, sf_dir, "orders").select(datasets.program_length(F.col("o_orderkey")).alias("length")).groupBy("length").agg(F.count(F.lit(1)).alias("n"))


def _pairs(spark: SparkSession, sf_dir: str, rules: list) -> DataFrame:
    """Grids of four in a row are a task with one of the hidden rules."""
    grids = written(from_lineitem(spark, sf_dir), "grids").withColumn("task_id", F.floor(F.col("gid") / 4))
    wanted = [programs.run(grids.where(F.col("task_id") % len(rules) == k), rule).select("gid", F.col("g").alias("wanted")) for k, rule in enumerate(rules)]
    return grids.join(reduce(DataFrame.unionByName, wanted), "gid").select("task_id", F.col("gid").alias("idx"), "g", "wanted")


def one_step_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task_id, program): every single step that explains a whole task."""
    rules = [[("recolor", {"src": 1, "dst": 2})], [("flip", {"axis": 1})], [("keep_color", {"color": 3})]]
    return search.one_step(_pairs(spark, sf_dir, rules), samplers.pool(["recolor", "keep_color", "remove_color", "flip", "rot90", "transpose"]))


def searched_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task_id, solved, level, error, program): a search of two levels for hidden rules of two steps."""
    rules = [[("recolor", {"src": 1, "dst": 2}), ("flip", {"axis": 1})], [("rot90", {"k": 1}), ("keep_color", {"color": 3})], [("remove_color", {"color": 2}), ("transpose", {})]]
    pool = samplers.pool(["recolor", "keep_color", "remove_color", "rot90", "flip", "transpose"])
    return search.search(_pairs(spark, sf_dir, rules), pool, depth=2, beam=8, top=32)


def _indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("index"))


def sampled_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seed, gen, length, program): a program of one or two steps for each supplier whose every step could be drawn at the first attempt."""
    seeds = _indices(spark, sf_dir).select(F.col("index").alias("seed"), datasets.program_length(F.col("index"), 1, 2).alias("length"))
    made = datasets.sampled_programs(seeds, samplers.pool(["recolor", "translate", "scale_down", "keep_objects"], ("c8",)), most=2)
    return made.select("seed", "gen", F.size("steps").alias("length"), "program")


def sampled_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(index, id, gen, program, n_train, n_test): a task for every supplier."""
    path = f"{shared_dir(spark)}/tasks-{uuid.uuid4().hex}"
    pool = samplers.pool(["recolor", "keep_color", "recolor_all", "rot90", "flip", "mirror_concat", "draw_border"])
    made = datasets.generate(spark, _indices(spark, sf_dir), path, pool, most=3)
    return made.select("index", "id", "gen", "program", F.size("train").alias("n_train"), F.size("test").alias("n_test"))


def encoded_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task_id, pos, id, row, col, seg): of three grids in a row the first two are a demonstration, the third the query."""
    grids = from_lineitem(spark, sf_dir).select(F.floor(F.col("gid") / 3).alias("task_id"), "gid", "g")
    tasks = grids.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("gid", "g"))).alias("x")).where("size(x) = 3")  # three at most
    g = lambda k: F.get("x", F.lit(k))["g"]
    tasks = tasks.select("task_id", F.array(F.struct(g(0).alias("input"), g(1).alias("output"))).alias("demos"), g(2).alias("query"))
    return encoding.encoded(tasks).select("task_id", F.posexplode("tokens").alias("pos", "x")).select("task_id", "pos", "x.*")


def resampled_demos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task_id, order, k, length): an order's lines as pairs of blank grids, shown to at most 400 tokens."""
    lines = _read(spark, sf_dir, "lineitem")
    blank = lambda h, w: make(h, w, lambda r, c: F.lit(0))
    h, w = 1 + F.col("l_partkey") % 9, 1 + F.col("l_suppkey") % 9
    pairs = lines.select(F.col("l_orderkey").alias("task_id"), "l_linenumber", "l_partkey", "l_suppkey", blank(h, w).alias("input"), blank(w, h + 1).alias("output"))
    tasks = pairs.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "input", "output"))).alias("pairs"))  # an order has few lines
    out = encoding.resampled(tasks, 400, F.col("task_id"), F.lit(12))
    return out.select("task_id", F.array_join(F.col("order").cast("array<string>"), ",").alias("order"), "k", "length")


def layer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layers.edges(from_lineitem(spark, sf_dir))
    return found.select(*[F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in found.dtypes])


def kept_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, event_id, event_type): events kept as results of their users in three batches, one of them put twice, two merged; the latest counts."""
    events = _read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    store = Results(spark, f"{shared_dir(spark)}/results-{uuid.uuid4().hex}", "user_id", "event_id")
    for k in (0, 1, 1):
        store.put(events.where(F.col("event_id") % 3 == k), f"part-{k}")
    store.compact("merged-1")
    store.put(events.where("event_id % 3 = 2"), "part-2")
    return store.latest()


QUERIES = {f.__name__: f for f in (selectors_enumerated, sampled_numbers, sampled_lengths, one_step_programs, encoded_examples, resampled_demos, layer_edges, kept_results)}
#: Those of many jobs, which come last.
LONG = {f.__name__: f for f in (searched_programs, sampled_programs, sampled_tasks)}

# --- the same in SQL -------------------------------------------------------------------

#: Objects with all that selectors ask for, from the tables ``own`` and ``o`` of a labelling.
_FEATURES = """col AS (SELECT gid, k, v AS color FROM (SELECT gid, k, v, count(*) AS n FROM own GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY gid, k ORDER BY n DESC, v) = 1),
  win AS (SELECT gid, k, count(*) AS n, min(r) <> max(r) AND min(c) <> max(c) AS across FROM own, (VALUES (0), (1)) a(dr), (VALUES (0), (1)) b(dc) GROUP BY gid, k, r + dr, c + dc),
  hol AS (SELECT gid, k, 1 - (count(*) FILTER (n = 1) - count(*) FILTER (n = 3) - 2 * count(*) FILTER (n = 2 AND across)) // 4 AS holes FROM win GROUP BY gid, k),
  shp AS (SELECT gid, k, string_agg(((r - r0) * 32 + c - c0)::VARCHAR, ',' ORDER BY r, c) AS shape, count(DISTINCT own.v) AS nv FROM own JOIN o USING (gid, k) GROUP BY gid, k),
  sym AS (SELECT a.gid, a.k, bool_and(x.gid IS NOT NULL) OR bool_and(y.gid IS NOT NULL) AS sym FROM own a JOIN o USING (gid, k) LEFT JOIN own x ON x.gid = a.gid AND x.k = a.k AND x.r = a.r AND x.c = c0 + c1 - a.c LEFT JOIN own y ON y.gid = a.gid AND y.k = a.k AND y.c = a.c AND y.r = r0 + r1 - a.r GROUP BY a.gid, a.k),
  tch AS (SELECT DISTINCT a.gid, a.k, b.v FROM own a JOIN own b ON a.gid = b.gid AND a.k <> b.k AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1),
  ob AS (SELECT o.gid, o.k, size, r0, r1, c0, c1, r1 - r0 + 1 AS h, c1 - c0 + 1 AS w, color, holes, shape, nv, sym, count(*) OVER (PARTITION BY o.gid, color) AS nc, count(*) OVER (PARTITION BY o.gid, shape) AS ns FROM o JOIN col USING (gid, k) JOIN hol USING (gid, k) JOIN shp USING (gid, k) JOIN sym USING (gid, k))"""
_MOST = "{0} = max({0}) OVER (PARTITION BY gid)"
_LEAST = "{0} = min({0}) OVER (PARTITION BY gid)"
#: Whether an object of ``ob`` passes; ``val`` is the value.
_PASSES = {
    "all": "true", "largest": _MOST.format("size"), "smallest": _LEAST.format("size"), "tallest": _MOST.format("h"), "widest": _MOST.format("w"), "leftmost": _LEAST.format("c0"), "topmost": _LEAST.format("r0"), "rightmost": _MOST.format("c1"), "bottommost": _MOST.format("r1"),
    "common_color": _MOST.format("nc"), "rare_color": _LEAST.format("nc"), "common_shape": _MOST.format("ns"), "dup_shape": "ns > 1", "unique_shape": "ns = 1", "touching": "EXISTS (SELECT 1 FROM tch WHERE tch.gid = ob.gid AND tch.k = ob.k AND tch.v = val)",
    "holes_eq": "holes = val", "has_hole": "holes > 0", "no_hole": "holes = 0", "square": "size = h * w AND h = w", "symmetric": "sym", "color": "color = val", "not_color": "color <> val", "size_eq": "size = val", "size_gt": "size > val", "size_lt": "size < val",
    "touches_border": "(r0 = 0 OR c0 = 0 OR r1 = 11 OR c1 = 11)", "inner": "NOT (r0 = 0 OR c0 = 0 OR r1 = 11 OR c1 = 11)", "rect": "size = h * w", "not_rect": "size <> h * w", "multicolor": "nv > 1",
}
assert set(_PASSES) == set(SELECTORS)
_FLAGS = ", ".join(f"({_PASSES[s].replace(' val', ' 2')}) AS is_{s}" for s in SELECTORS)
_COUNTED = " UNION ALL ".join(f"SELECT gid, '{s}' AS selector, count(*) FILTER (is_{s}) AS n FROM flags GROUP BY gid" for s in SELECTORS)
SELECTED_SQL = f"WITH RECURSIVE {_BASE}, {_labels(False, 'v > 0', 'true')}, {_FEATURES}, flags AS (SELECT gid, {_FLAGS} FROM ob) SELECT gid::BIGINT AS gid, selector, n::INT AS n FROM ({_COUNTED})"

_VALUED = BY_COLOR + BY_SIZE + BY_HOLES
_ORDERED = [*[(by, None) for by in WEIGHTS if by not in _VALUED], *[(by, "colors") for by in BY_COLOR], *[(by, "sizes") for by in BY_SIZE], *[(by, "few") for by in BY_HOLES]]


def _candidate(place: int, by: str, values: str | None) -> str:
    if values is None:
        return f'''SELECT gid, {place} AS g, '{by}' AS "by", NULL::INT AS val, k, ({_PASSES[by]}) AS good FROM ob'''
    return f"SELECT ob.gid, {place}, '{by}', val, k, ({_PASSES[by]}) FROM ob JOIN {values} v ON v.gid = ob.gid"


_ENUMERATED = f"""WITH RECURSIVE {_BASE}, {_labels(True)}, {_FEATURES}, colors AS (SELECT DISTINCT gid, color AS val FROM ob), sizes AS (SELECT DISTINCT gid, size AS val FROM ob WHERE size <= {MOST_SIZE}), few AS (SELECT gid, x AS val FROM ids, (VALUES {", ".join(f"({n})" for n in HOLES)}) t(x)),
  cand AS ({" UNION ALL ".join(_candidate(n, *x) for n, x in enumerate(_ORDERED))}),
  picked AS (SELECT gid, g, "by", val, count(*) AS n, list(k ORDER BY k) AS picks FROM cand WHERE good GROUP BY gid, g, "by", val),
  firsts AS (SELECT *, row_number() OVER (PARTITION BY gid, picks ORDER BY g, val) AS first FROM picked)
  SELECT gid::BIGINT AS gid, (row_number() OVER (PARTITION BY gid ORDER BY g, val) - 1)::INT AS place, "by", val::INT AS value, n::INT AS n FROM firsts WHERE first = 1 OR "by" = 'all'"""


def _weighted(options: dict, salt: int, seed: str = "gid") -> str:
    total, so_far, cases = sum(options.values()), 0.0, []
    for name, weight in list(options.items())[:-1]:
        so_far += weight
        cases.append(f"WHEN {_draw(salt).replace('gid', seed)} < {int(so_far / total * PRIME)} THEN {name!r}")
    return f"CASE {' '.join(cases)} ELSE {list(options)[-1]!r} END"


_LENGTHS = {n: p for n, p in datasets.LENGTHS.items() if n >= 2}
_NUMBERS = f"""WITH {_BASE}, held AS (SELECT gid, list(DISTINCT v ORDER BY v) AS held FROM cells WHERE v > 0 GROUP BY gid), free AS (SELECT gid, held, list_filter(range(1, 10), lambda v: NOT list_contains(held, v::INT)) AS free FROM held)
  SELECT gid::BIGINT AS gid, {_weighted(samplers.SEGMENTS, 51)} AS seg, held[1 + {_draw(52)} % len(held)]::INT AS held, free[1 + {_draw(53)} % len(free)]::INT AS new, (1 + {_draw(54)} % 8)::INT AS shift, ({_weighted(_LENGTHS, 201)})::INT AS length FROM free"""

_ONE_STEP = f"""WITH {_BASE}, g AS (SELECT gid // 4 AS task, gid, r, c, v FROM cells),
  want AS (SELECT task, gid, r, c, CASE WHEN v = 1 THEN 2 ELSE v END AS v FROM g WHERE task % 3 = 0 UNION ALL SELECT task, gid, r, 11 - c, v FROM g WHERE task % 3 = 1 UNION ALL SELECT task, gid, r, c, CASE WHEN v = 3 THEN 3 ELSE 0 END FROM g WHERE task % 3 = 2),
  ins AS (SELECT DISTINCT task, v FROM g WHERE v > 0 AND gid IN (SELECT min(gid) FROM g GROUP BY task)), outs AS (SELECT DISTINCT task, v FROM want WHERE v > 0),
  tried AS (SELECT g.task, 'recolor(src=' || i.v || ', dst=' || o.v || ')' AS program, gid, r, c, CASE WHEN g.v = i.v THEN o.v ELSE g.v END AS v FROM g JOIN ins i USING (task) JOIN outs o ON o.task = g.task AND o.v <> i.v
    UNION ALL SELECT g.task, 'keep_color(color=' || i.v || ')', gid, r, c, CASE WHEN g.v = i.v THEN g.v ELSE 0 END FROM g JOIN ins i USING (task) UNION ALL SELECT g.task, 'remove_color(color=' || i.v || ')', gid, r, c, CASE WHEN g.v = i.v THEN 0 ELSE g.v END FROM g JOIN ins i USING (task)
    UNION ALL SELECT task, 'flip(axis=0)', gid, 11 - r, c, v FROM g UNION ALL SELECT task, 'flip(axis=1)', gid, r, 11 - c, v FROM g UNION ALL SELECT task, 'rot90(k=1)', gid, 11 - c, r, v FROM g UNION ALL SELECT task, 'rot90(k=2)', gid, 11 - r, 11 - c, v FROM g UNION ALL SELECT task, 'rot90(k=3)', gid, c, 11 - r, v FROM g UNION ALL SELECT task, 'transpose()', gid, c, r, v FROM g)
  SELECT t.task::BIGINT AS task_id, program FROM tried t JOIN want w USING (gid, r, c) GROUP BY t.task, program HAVING bool_and(t.v = w.v)"""

_ID = {name: n for n, name in enumerate(encoding.TOKENS)}


def _shown(part: int, k: int, seg: int) -> str:
    """Tokens of the k-th grid of a task, ordered within their part."""
    return f"""SELECT task, {part} AS part, r * 13 + c AS place, {_ID["c0"]} + v AS id, r + 1 AS "row", c AS col, {seg} AS seg FROM g WHERE k = {k} UNION ALL SELECT task, {part}, r * 13 + 12, {_ID["<nl>"]}, r + 1, 12, {seg} FROM g WHERE k = {k} AND c = 0"""


def _marks(part: int, *names: str) -> str:
    return " UNION ALL ".join(f"SELECT task, {part}, {n}, {_ID[name]}, 0, 0, 0 FROM whole" for n, name in enumerate(names))


#: Rows gid, role, v of the one layer that has the most or least of something, or alone has a property.
_ALONE = [("rarest", "area = min(area) OVER g"), ("most_frequent", "area = max(area) OVER g"), ("fewest_components", "components = min(components) OVER g"), ("most_components", "components = max(components) OVER g"), ("smallest_object_layer", "smallest = min(smallest) OVER g"), ("largest_object_layer", "largest = max(largest) OVER g"),
    ("only_foreground", "count(*) OVER g = 1"), ("has_hole", "holes > 0"), ("border_touching", "touches"), ("interior_only", "NOT touches"), ("second_largest_layer", "count(*) OVER g >= 3 AND dense_rank() OVER (PARTITION BY gid ORDER BY area DESC) = 2")]
ROLES_SQL = f"""WITH RECURSIVE {_BASE}, {_labels(False)}, {_FEATURES}, lay AS (SELECT gid, color AS v, sum(size) AS area, count(*) AS components, min(size) AS smallest, max(size) AS largest, sum(holes) AS holes, bool_or(r0 = 0 OR c0 = 0 OR r1 = 11 OR c1 = 11) AS touches FROM ob GROUP BY gid, color),
  has AS ({" UNION ALL ".join(f"SELECT gid, v, '{role}' AS role, ({test}) AS good FROM lay WINDOW g AS (PARTITION BY gid)" for role, test in _ALONE)})
  SELECT gid::BIGINT AS gid, role, min(v)::INT AS v FROM has WHERE good GROUP BY gid, role HAVING count(*) = 1 UNION ALL SELECT gid::BIGINT, 'background', 0 FROM ids"""

_ENCODED = f"""WITH {_BASE}, g AS (SELECT gid // 3 AS task, gid % 3 AS k, r, c, v FROM cells), whole AS (SELECT task FROM g GROUP BY task HAVING count(DISTINCT k) = 3),
  t AS ({_shown(2, 0, 1)} UNION ALL {_shown(4, 1, 2)} UNION ALL {_shown(6, 2, 3)} UNION ALL {_marks(1, "<bos>", "<train>", "<in>")} UNION ALL {_marks(3, "</in>", "<out>")} UNION ALL {_marks(5, "</out>", "<test>", "<in>")} UNION ALL {_marks(7, "</in>", "<prog>")})
  SELECT task::BIGINT AS task_id, (row_number() OVER (PARTITION BY task ORDER BY part, place) - 1)::INT AS pos, id::INT AS id, "row"::INT AS "row", col::INT AS col, seg::INT AS seg FROM t WHERE task IN (SELECT task FROM whole)"""

_RESAMPLED = f"""WITH p AS (SELECT l_orderkey AS task, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i, (1 + l_partkey % 9) AS h, (1 + l_suppkey % 9) AS w FROM lineitem),
  q AS (SELECT task, i, h * (w + 1) AS a, w * (h + 2) AS b, {_draw(301, "i").replace("gid", "task")} AS u FROM p),
  s AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY u, i) - 1 AS place, count(*) OVER (PARTITION BY task) AS n, coalesce(sum(4 + a + b) OVER (PARTITION BY task ORDER BY u, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q),
  f AS (SELECT task, place AS k, 2 + before + 4 + a + 13 AS length FROM s WHERE place BETWEEN 2 AND least(n - 1, 2 + {_draw(302).replace("gid", "task")} % 3)),
  best AS (SELECT task, max(k) AS k, max_by(length, k) AS length FROM f WHERE length <= 400 GROUP BY task), o AS (SELECT task, string_agg(i::VARCHAR, ',' ORDER BY place) AS "order" FROM s GROUP BY task)
  SELECT task AS task_id, "order", k::INT AS k, length::INT AS length FROM o LEFT JOIN best USING (task)"""

_EDGES = f"""WITH RECURSIVE {_BASE}, {_labels(False, "true")}, pieces AS (SELECT gid, v, count(*) AS pieces FROM o GROUP BY gid, v),
  turns AS (SELECT gid, v, t, string_agg((CASE WHEN t % 2 = 1 THEN y * 32 + x ELSE x * 32 + y END)::VARCHAR, ',' ORDER BY CASE WHEN t % 2 = 1 THEN y * 32 + x ELSE x * 32 + y END) AS s FROM (
    SELECT c.gid, c.v, t, CASE WHEN t // 2 % 2 = 0 THEN c.r - r0 ELSE r1 - c.r END AS x, CASE WHEN t // 4 = 0 THEN c.c - c0 ELSE c1 - c.c END AS y FROM cells c JOIN (SELECT gid, v, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM cells GROUP BY gid, v) USING (gid, v), range(8) z(t)) GROUP BY gid, v, t),
  n AS (SELECT gid, v, count(*) AS area, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1, avg(r) AS r, avg(c) AS c FROM cells GROUP BY gid, v),
  node AS (SELECT n.*, pieces, s AS shape FROM n JOIN pieces USING (gid, v) JOIN (SELECT gid, v, min(s) AS s FROM turns GROUP BY gid, v) USING (gid, v)),
  far AS (SELECT a.gid, a.v AS a, b.v AS b, min(abs(a.r - b.r) + abs(a.c - b.c)) AS d, bool_or(abs(a.r - b.r) + abs(a.c - b.c) = 1) AS side FROM cells a JOIN cells b USING (gid) GROUP BY ALL),
  e AS (SELECT a.gid, a.v AS av, b.v AS bv, greatest(0, least(a.r1, b.r1) - greatest(a.r0, b.r0) + 1) AS ih, greatest(0, least(a.c1, b.c1) - greatest(a.c0, b.c0) + 1) AS iw, (a.r1 - a.r0 + 1) * (a.c1 - a.c0 + 1) + (b.r1 - b.r0 + 1) * (b.c1 - b.c0 + 1) AS boxes, d, side,
    b.r0 <= a.r0 AND a.r1 <= b.r1 AND b.c0 <= a.c0 AND a.c1 <= b.c1 AS a_in_b, a.r0 <= b.r0 AND b.r1 <= a.r1 AND a.c0 <= b.c0 AND b.c1 <= a.c1 AS b_in_a, a.shape = b.shape AS same_shape, a.area = b.area AS same_area, greatest(a.r1, b.r1) - least(a.r0, b.r0) + 1 AS uh, greatest(a.c1, b.c1) - least(a.c0, b.c0) + 1 AS uw,
    abs(a.r - b.r) < 0.5 AS same_row, abs(a.c - b.c) < 0.5 AS same_column, a.r1 < b.r0 AS above, a.r0 > b.r1 AS below, a.c1 < b.c0 AS "left", a.c0 > b.c1 AS "right", least(a.area, b.area) / greatest(a.area, b.area) AS area_ratio, least(a.pieces, b.pieces) / greatest(1, a.pieces, b.pieces) AS pieces_ratio
    FROM node a JOIN node b USING (gid) JOIN far ON far.gid = a.gid AND far.a = a.v AND far.b = b.v)
  SELECT gid::BIGINT AS gid, av::INT AS a, bv::INT AS b, round(ih * iw / (boxes - ih * iw), 9) AS iou, side AS touching, round(1 / (1 + d), 9) AS nearness, a_in_b, b_in_a, same_shape, same_area, round(ih / uh, 9) AS overlap_r, round(iw / uw, 9) AS overlap_c, same_row, same_column, above, below, "left", "right", round(area_ratio, 9) AS area_ratio, round(pieces_ratio, 9) AS pieces_ratio FROM e"""

ORACLE_SQL = {
    "selectors_enumerated": _ENUMERATED,
    "sampled_numbers": _NUMBERS,
    "sampled_lengths": f"SELECT ({_weighted(datasets.LENGTHS, 201, 'o_orderkey')})::INT AS length, count(*)::BIGINT AS n FROM orders GROUP BY 1",
    "one_step_programs": _ONE_STEP,
    "encoded_examples": _ENCODED,
    "resampled_demos": _RESAMPLED,
    "layer_edges": _EDGES,
    "kept_results": "SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id",
}
