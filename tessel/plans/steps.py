"""Queries for object steps, layer operations, search steps and panel programs over grids from ``lineitem``, with DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions.grids import make
from tessel.operators import OPERATORS
from tessel.operators.panels import fitted
from tessel.operators.steps import LAYER_STEPS, OBJECT_STEPS, SEARCH_STEPS
from tessel.plans.queries import LINES, _labels, _sql
from tessel.plans.store import written
from tessel.sources.grids import FEW_ORDERS, ORDERS, SIDE, framed, from_lineitem, to_cells

#: Marks plans over the grids of fewer lines, so that things have room to move.
SMALL: list[tuple[str, dict]] = [("remove_color", {"color": 2})]
THREES = [("keep_color", {"color": 3})]
PLANS: dict[str, tuple[dict, list[tuple[str, dict]], dict]] = {
    "step_keep_selected": (OBJECT_STEPS, [], {"selector": "largest"}),
    "step_delete_selected": (OBJECT_STEPS, [], {"selector": "border"}),
    "step_recolor_selected": (OBJECT_STEPS, [], {"selector": "repeated_area", "target": 7}),
    "step_crop_selected": (OBJECT_STEPS, [], {"selector": "largest", "source": 3}),
    "step_fill_selected_bbox": (OBJECT_STEPS, [], {"selector": "largest"}),
    "step_outline_selected_bbox": (OBJECT_STEPS, [], {"selector": "unique_area"}),
    "step_transform_selected": (OBJECT_STEPS, SMALL, {"selector": "unique_area", "transform": 1}),
    "step_gravity_selected": (OBJECT_STEPS, [], {"selector": "largest", "direction": "down"}),
    "layer_gravity_objects": (LAYER_STEPS, [], {"direction": "left"}),
    "layer_conditional_line_gravity": (LAYER_STEPS, [], {"source": 3, "marker": 1, "direction": "down"}),
    "layer_connect_layer": (LAYER_STEPS, [], {"source": 3, "axis": "both"}),
    "layer_extend_rays": (LAYER_STEPS, [], {"source": 3, "direction": "right"}),
    "layer_complete_symmetry": (LAYER_STEPS, THREES, {"source": 3, "axis": "both", "frame": "bbox"}),
    "layer_repeat_objects": (LAYER_STEPS, [*SMALL, *THREES, ("tile", {"ny": 1, "nx": 2})], {"source": 3, "axis": "horizontal", "scope": "both"}),
    "layer_stamp_markers": (LAYER_STEPS, SMALL, {"source": 3, "marker": 1}),
    "layer_panel_boolean": (LAYER_STEPS, [], {"axis": 1, "mode": "a_minus_b", "target": 8, "gap": 0}),
    "layer_fill_enclosures": (LAYER_STEPS, [], {"target": 7}),
    "layer_crop_foreground": (LAYER_STEPS, SMALL, {}),
    "search_rotate_grid": (SEARCH_STEPS, [], {"turns": 3}),
    "search_reflect_grid": (SEARCH_STEPS, [], {"axis": "columns"}),
    "search_translate_layer": (SEARCH_STEPS, SMALL, {"source": 3, "dr": 1, "dc": 0}),
    "search_copy_layer": (SEARCH_STEPS, SMALL, {"source": 3, "dr": -1, "dc": 1}),
    "search_align_layers": (SEARCH_STEPS, SMALL, {"source": 3, "target": 1, "axis": 1, "anchor": "center"}),
    "search_move_layer_until_touch": (SEARCH_STEPS, SMALL, {"source": 3, "target": 1, "direction": "down"}),
    "search_recolor_layer": (SEARCH_STEPS, [], {"source": 3, "target": 8}),
    "search_swap_layers": (SEARCH_STEPS, [], {"source": 3, "target": 1}),
    "search_fill_layer_holes": (SEARCH_STEPS, [], {"source": 3}),
    "search_keep_objects": (SEARCH_STEPS, [], {"selector": "interior"}),
    "search_crop_objects": (SEARCH_STEPS, SMALL, {"selector": "largest"}),
    "search_delete_objects": (SEARCH_STEPS, [], {"selector": "smallest"}),
    "search_recolor_objects": (SEARCH_STEPS, [], {"selector": "topmost", "target": 9}),
    "search_fill_object_boxes": (SEARCH_STEPS, SMALL, {"selector": "largest"}),
    "search_outline_object_boxes": (SEARCH_STEPS, SMALL, {"selector": "all"}),
    "search_scale_pixels": (SEARCH_STEPS, [], {"rows": 2, "columns": 1}),
    "search_reduce_blocks": (SEARCH_STEPS, [("scale_up", {"k": 2})], {"rows": 2, "columns": 1}),
    "search_tile_grid": (SEARCH_STEPS, [], {"rows": 1, "columns": 2}),
    "search_mirror_tile": (SEARCH_STEPS, [], {"rows": 2, "columns": 2}),
    "search_trim_uniform_border": (SEARCH_STEPS, [("draw_border", {"color": 7})], {}),
    "search_select_panel": (SEARCH_STEPS, [LINES], {"partition": {"split": "separator", "axis": 0, "count": 3, "color": 5}, "index": 1}),
    "search_panel_logic": (SEARCH_STEPS, [], {"partition": {"split": "equal", "axis": 1, "count": 3}, "mode": "xor", "backgrounds": [0, 0, 0], "paint": 8, "output_bg": 0}),
    "search_panel_overlay": (SEARCH_STEPS, [], {"partition": {"split": "equal", "axis": 0, "count": 2}, "order": [1, 0], "backgrounds": [0, 0], "output_bg": 0}),
}


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    bank, before, given = PLANS[name]
    step = name.split("_", 1)[1]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        grids = from_lineitem(spark, sf_dir, FEW_ORDERS if before[:1] == SMALL else ORDERS)
        for earlier, parameters in before:
            grids = OPERATORS[earlier](grids, **parameters)
        return to_cells(bank[step](grids, **given))

    return run


def panel_programs_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids of four in a row are a task whose hidden rule compares or overlays halves; the programs that make all its pairs."""
    grids = written(from_lineitem(spark, sf_dir).withColumns({"task_id": F.floor(F.col("gid") / 4), "shown": F.col("g")}), "grids")
    halves = {"partition": {"split": "equal", "axis": 1, "count": 2}, "backgrounds": [0, 0], "output_bg": 0}
    rules = [("panel_logic", halves | {"mode": "and", "paint": 8}), ("panel_logic", halves | {"mode": "nor", "paint": 5}), ("panel_overlay", halves | {"order": [1, 0]})]
    pairs = [SEARCH_STEPS[name](grids.where(F.col("task_id") % 3 == k), **given).select("task_id", F.col("shown").alias("g"), F.col("g").alias("wanted")) for k, (name, given) in enumerate(rules)]
    return fitted(reduce(DataFrame.unionByName, pairs)).select("task_id", "split", "axis", "count", "op", "mode", "background", "paint", "output_bg", F.array_join("priority", ",").alias("priority"))


def layer_follow_marker_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids with an arrow that points right, whose markers are lines of four neighbouring orders: odd ones ahead of it, even ones
    over or under the last of them; every third grid has both, so its arrow can't choose and the grid is refused."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("gid", F.floor(F.col("l_orderkey") / FEW_ORDERS))
    ahead = (5 + F.col("l_quantity").cast("int") % 6).cast("int")
    up, down = 1 + F.col("l_partkey") % 3, 7 + F.col("l_partkey") % 4
    side = F.when(F.col("gid") % 3 == 0, F.array(up, down)).when(F.col("gid") % 3 == 1, F.array(up)).otherwise(F.array(down))
    odd = F.col("l_linenumber") % 2 == 1
    shown = lines.groupBy("gid").agg(F.array_sort(F.collect_set(F.when(odd, ahead))).alias("ahead"), F.flatten(F.collect_set(F.when(~odd, side))).cast("array<int>").alias("aside"))
    arrow = lambda r, c: ((c == 2) & r.between(4, 6)) | ((c == 3) & (r == 5))
    marked = lambda r, c: ((r == 5) & F.array_contains("ahead", c)) | ((c == F.array_max("ahead")) & F.array_contains("aside", r))
    grid = make(F.lit(SIDE), F.lit(SIDE), lambda r, c: F.when(arrow(r, c) | marked(r, c), 2).otherwise(0))
    return to_cells(LAYER_STEPS["follow_marker_path"](framed(shown.select("gid", grid.alias("g")))))


QUERIES = {name: _query(name) for name in PLANS} | {"layer_follow_marker_path": layer_follow_marker_path, "panel_programs_fitted": panel_programs_fitted}

_SMALL = "sm AS (SELECT gid, r, c, CASE WHEN v = 2 THEN 0 ELSE v END AS v FROM cells)"
_THREES = "k3 AS (SELECT gid, r, c, CASE WHEN v = 3 THEN 3 ELSE 0 END AS v FROM cells)"


def _ground(table: str = "cells", last: int = 11, by_place: bool = True) -> str:
    """CTE fg: the cells of a table with their grid's background."""
    order = "count(*) DESC, min(r * 12 + c)" if by_place else "v"
    return f"""bgs AS (SELECT gid, v AS bg FROM (SELECT gid, v, row_number() OVER (PARTITION BY gid ORDER BY sum((r IN (0, {last}))::INT + (c IN (0, {last}))::INT) DESC, {order}) AS k FROM {table} GROUP BY gid, v) WHERE k = 1),
  fg AS (SELECT t.gid, t.r, t.c, t.v, bgs.bg FROM {table} t JOIN bgs USING (gid))"""


def _parts(start: str = "v <> bg", same: str = "s.v = t.v") -> str:
    return _labels(False, start, same).replace("FROM cells", "FROM fg")


def _picked(value: str, choice: str, *before: str, by_place: bool = False, table: str = "cells", last: int = 11, start: str = "v <> bg", rows: str = "") -> str:
    """A value for each cell k, where o is its component if that is among the chosen (``choice`` follows FROM o)."""
    body = rows or f"SELECT k.gid, k.r, k.c, {value} AS v FROM fg k LEFT JOIN own USING (gid, r, c) LEFT JOIN sel o ON o.gid = k.gid AND o.k = own.k"
    return _sql(body, *before, _ground(table, last, by_place), _parts(start), f"sel AS (SELECT * FROM o {choice})", refused="SELECT gid FROM ids WHERE gid NOT IN (SELECT gid FROM sel)")


_LARGEST = "QUALIFY size = max(size) OVER (PARTITION BY gid)"
_IN = "k.r BETWEEN s.r0 AND s.r1 AND k.c BETWEEN s.c0 AND s.c1"
_RING = f"({_IN} AND (k.r IN (s.r0, s.r1) OR k.c IN (s.c0, s.c1)))"
_TOP = "s.v * 1000 + s.k"
_CROP = "SELECT k.gid, k.r - b.r0 AS r, k.c - b.c0 AS c, CASE WHEN s.k IS NULL THEN bg ELSE k.v END AS v FROM fg k JOIN (SELECT gid, min(r0) AS r0, max(r1) AS r1, min(c0) AS c0, max(c1) AS c1 FROM sel GROUP BY gid) b USING (gid) LEFT JOIN own USING (gid, r, c) LEFT JOIN sel s ON s.gid = k.gid AND s.k = own.k WHERE k.r BETWEEN b.r0 AND b.r1 AND k.c BETWEEN b.c0 AND b.c1"


def _seen(way: str) -> str:
    """The first value other than the background, seen from a cell."""
    by, order = ("c", "r") if way in ("up", "down") else ("r", "c")
    desc = " DESC" if way in ("down", "right") else ""
    return f"last_value(CASE WHEN v <> bg THEN v END IGNORE NULLS) OVER (PARTITION BY gid, {by} ORDER BY {order}{desc} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _moved(dr: str, dc: str, erase: bool, *more: str, refused: str = "") -> str:
    """The layer of threes of small grids moved; ``more`` CTEs give m (gid, dr, dc) where the steps aren't fixed."""
    to = "m AS (SELECT gid, {} AS dr, {} AS dc FROM ids)".format(dr, dc)
    ctes = [*(more or (to,)), "src AS (SELECT gid, r, c FROM fg WHERE v = 3 AND bg <> 3)", "dst AS (SELECT gid, r + dr AS r, c + dc AS c FROM src JOIN m USING (gid))"]
    wrong = "SELECT gid FROM ids WHERE gid NOT IN (SELECT gid FROM dst) OR gid IN (SELECT d.gid FROM dst d LEFT JOIN fg USING (gid, r, c) WHERE fg.v IS NULL OR fg.v NOT IN (fg.bg, 3))" + refused
    return _sql(
        f"SELECT k.gid, k.r, k.c, CASE WHEN d.gid IS NOT NULL THEN 3 WHEN k.v = 3 AND {erase} THEN k.bg ELSE k.v END AS v FROM fg k LEFT JOIN dst d USING (gid, r, c)", _SMALL, _ground("sm"), *ctes, refused=wrong
    )


_OUTSIDE = "(r0 = 0 OR c0 = 0 OR r1 = 11 OR c1 = 11)"

ORACLE_SQL = {
    "step_keep_selected": _picked("CASE WHEN o.k IS NULL THEN bg ELSE k.v END", _LARGEST),
    "step_delete_selected": _picked("CASE WHEN o.k IS NULL THEN k.v ELSE bg END", f"WHERE {_OUTSIDE}"),
    "step_recolor_selected": _picked("CASE WHEN o.k IS NULL THEN k.v ELSE 7 END", "QUALIFY count(*) OVER (PARTITION BY gid, size) > 1"),
    "step_crop_selected": _picked("", _LARGEST, start="v <> bg AND v = 3", rows=_CROP),
    "step_fill_selected_bbox": _picked("", _LARGEST, rows=f"SELECT k.gid, k.r, k.c, coalesce((SELECT arg_max(s.v, {_TOP}) FROM sel s WHERE s.gid = k.gid AND {_IN}), k.v) AS v FROM fg k"),
    "step_outline_selected_bbox": _picked(
        "",
        "QUALIFY count(*) OVER (PARTITION BY gid, size) = 1",
        rows=f"SELECT x.gid, x.r, x.c, coalesce((SELECT arg_max(CASE WHEN {_RING} THEN s.v ELSE x.bg END, {_TOP}) FROM sel s WHERE s.gid = x.gid AND ({_RING} OR s.k = x.own_k)), x.v) AS v FROM (SELECT fg.*, own.k AS own_k FROM fg LEFT JOIN own USING (gid, r, c)) x".replace("k.r ", "x.r ").replace("k.c ", "x.c "),
    ),
    "step_gravity_selected": _sql(
        "SELECT k.gid, k.r, k.c, CASE WHEN a.v IS NOT NULL THEN a.v WHEN b.v IS NOT NULL THEN k.bg ELSE k.v END AS v FROM fg k JOIN n USING (gid) LEFT JOIN moving a ON a.gid = k.gid AND a.c = k.c AND a.r + n.n = k.r LEFT JOIN moving b ON b.gid = k.gid AND b.c = k.c AND b.r = k.r",
        _ground(by_place=False),
        _parts(),
        f"sel AS (SELECT * FROM o {_LARGEST}), moving AS (SELECT own.gid, own.r, own.c, own.v FROM own JOIN sel USING (gid, k)), walls AS (SELECT gid, r, c FROM fg WHERE v <> bg AND (gid, r, c) NOT IN (SELECT gid, r, c FROM moving) UNION ALL SELECT gid, 12, c FROM fg WHERE r = 0)",
        "n AS (SELECT m.gid, min(w.r - m.r) - 1 AS n FROM moving m JOIN walls w ON w.gid = m.gid AND w.c = m.c AND w.r > m.r GROUP BY m.gid)",
        refused="SELECT gid FROM ids WHERE gid NOT IN (SELECT gid FROM sel)",
    ),
    "layer_connect_layer": _sql(
        f"SELECT gid, r, c, CASE WHEN v = bg AND (a = 3 AND b = 3 OR d = 3 AND e = 3) THEN 3 ELSE v END AS v FROM (SELECT *, {_seen('left')} AS a, {_seen('right')} AS b, {_seen('up')} AS d, {_seen('down')} AS e FROM fg)", _ground(), refused="SELECT gid FROM bgs WHERE bg = 3"
    ),
    "layer_extend_rays": _sql(f"SELECT gid, r, c, CASE WHEN v = bg AND {_seen('left')} = 3 THEN 3 ELSE v END AS v FROM fg", _ground(), refused="SELECT gid FROM bgs WHERE bg = 3"),
    "layer_complete_symmetry": _sql(
        "SELECT k.gid, k.r, k.c, CASE WHEN EXISTS (SELECT 1 FROM fg s JOIN box b USING (gid) WHERE s.gid = k.gid AND s.v = 3 AND s.r IN (k.r, b.r0 + b.r1 - k.r) AND s.c IN (k.c, b.c0 + b.c1 - k.c)) THEN 3 ELSE k.v END AS v FROM fg k",
        _THREES,
        _ground("k3"),
        "box AS (SELECT gid, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM fg WHERE v = 3 AND bg <> 3 GROUP BY gid)",
        refused="SELECT gid FROM ids WHERE gid NOT IN (SELECT gid FROM box)",
    ),
    "layer_stamp_markers": _sql(
        "SELECT k.gid, k.r, k.c, CASE WHEN EXISTS (SELECT 1 FROM spots s WHERE s.gid = k.gid AND s.r = k.r AND s.c = k.c) THEN 3 WHEN k.v = 1 THEN k.bg ELSE k.v END AS v FROM fg k",
        _SMALL,
        _ground("sm"),
        _parts(),
        "t AS (SELECT * FROM o WHERE v = 3 QUALIFY count(*) OVER (PARTITION BY gid) = 1), m AS (SELECT * FROM o WHERE v = 1 QUALIFY max(size) OVER (PARTITION BY gid) = 1)",
        "spots AS (SELECT t.gid, m.r0 + own.r - t.r0 AS r, m.c0 + own.c - t.c0 AS c FROM t JOIN m USING (gid) JOIN own ON own.gid = t.gid AND own.k = t.k)",
        refused="SELECT gid FROM ids WHERE gid NOT IN (SELECT gid FROM spots) OR gid IN (SELECT s.gid FROM spots s LEFT JOIN fg USING (gid, r, c) WHERE fg.v IS NULL OR fg.v NOT IN (fg.bg, 1, 3))",
    ),
    "layer_panel_boolean": _sql("SELECT a.gid, a.r, a.c, CASE WHEN a.v <> a.bg AND b.v = b.bg THEN 8 ELSE a.bg END AS v FROM fg a JOIN fg b ON b.gid = a.gid AND b.r = a.r AND b.c = a.c + 6", _ground()),
    "layer_fill_enclosures": _sql(f"SELECT k.gid, k.r, k.c, CASE WHEN k.v = k.bg AND NOT {_OUTSIDE} THEN 7 ELSE k.v END AS v FROM fg k LEFT JOIN own USING (gid, r, c) LEFT JOIN o ON o.gid = k.gid AND o.k = own.k", _ground(), _parts("v = bg")),
    "layer_crop_foreground": _sql(
        "SELECT k.gid, k.r - r0 AS r, k.c - c0 AS c, k.v FROM fg k JOIN box USING (gid) WHERE k.r BETWEEN r0 AND r1 AND k.c BETWEEN c0 AND c1",
        _SMALL,
        _ground("sm"),
        "box AS (SELECT gid, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM fg WHERE v <> bg GROUP BY gid)",
        refused="SELECT gid FROM ids WHERE gid NOT IN (SELECT gid FROM box)",
    ),
    "layer_follow_marker_path": f"""WITH l AS (SELECT l_orderkey // {FEW_ORDERS} AS gid, 5 + CAST(floor(l_quantity) AS INT) % 6 AS ahead, 1 + l_partkey % 3 AS up, 7 + l_partkey % 4 AS down, l_linenumber % 2 AS odd FROM lineitem),
  e AS (SELECT gid, max(ahead) FILTER (odd = 1) AS c, min(up) FILTER (odd = 0) AS up, max(down) FILTER (odd = 0) AS down FROM l GROUP BY gid),
  t AS (SELECT gid, c, CASE WHEN up IS NULL THEN 5 WHEN gid % 3 = 1 THEN up ELSE down END AS r, CASE WHEN up IS NULL THEN 'right' WHEN gid % 3 = 1 THEN 'up' ELSE 'down' END AS way FROM e WHERE c IS NOT NULL AND (up IS NULL OR gid % 3 <> 0))
  SELECT t.gid, CAST(y.i AS INT) AS r, CAST(x.i AS INT) AS c, CASE WHEN y.i = t.r AND x.i = t.c OR way = 'right' AND x.i = t.c - 1 AND abs(y.i - t.r) <= 1 OR way <> 'right' AND y.i = t.r + (CASE way WHEN 'up' THEN 1 ELSE -1 END) AND abs(x.i - t.c) <= 1 THEN 2 ELSE 0 END AS v
  FROM t, range({SIDE}) y(i), range({SIDE}) x(i) UNION ALL SELECT gid, -1, -1, -1 FROM e WHERE c IS NULL OR up IS NOT NULL AND gid % 3 = 0""",
    "search_rotate_grid": _sql("SELECT gid, c AS r, 11 - r AS c, v FROM cells"),
    "search_reflect_grid": _sql("SELECT gid, r, 11 - c AS c, v FROM cells"),
    "search_translate_layer": _moved("1", "0", True),
    "search_copy_layer": _moved("-1", "1", False),
    "search_align_layers": _moved(
        "",
        "",
        True,
        "ends AS (SELECT gid, min(c) FILTER (v = 1) + max(c) FILTER (v = 1) - min(c) FILTER (v = 3) - max(c) FILTER (v = 3) AS d FROM fg GROUP BY gid)",
        "m AS (SELECT gid, 0 AS dr, d // 2 AS dc FROM ends WHERE d IS NOT NULL AND d % 2 = 0)",
    ),
    "search_move_layer_until_touch": _moved(
        "",
        "",
        True,
        "s AS (SELECT gid, r, c FROM fg WHERE v = 3 AND bg <> 3), tries AS (SELECT s.gid, n.i AS n, bool_and(coalesce(f.v IN (f.bg, 3), false)) AS free, coalesce(bool_or(t.gid IS NOT NULL), false) AS touch FROM s CROSS JOIN range(13) n(i) LEFT JOIN fg f ON f.gid = s.gid AND f.r = s.r + n.i AND f.c = s.c LEFT JOIN fg t ON t.gid = s.gid AND t.v = 1 AND abs(t.r - s.r - n.i) + abs(t.c - s.c) = 1 GROUP BY s.gid, n.i)",
        "m AS (SELECT gid, n AS dr, 0 AS dc FROM (SELECT * FROM tries WHERE NOT free OR touch QUALIFY row_number() OVER (PARTITION BY gid ORDER BY n) = 1) WHERE free AND touch)",
    ),
    "search_recolor_layer": _sql("SELECT gid, r, c, CASE WHEN v = 3 THEN 8 ELSE v END AS v FROM fg", _ground(), refused="SELECT gid FROM bgs WHERE bg = 3"),
    "search_swap_layers": _sql("SELECT gid, r, c, CASE v WHEN 3 THEN 1 WHEN 1 THEN 3 ELSE v END AS v FROM fg", _ground(), refused="SELECT gid FROM bgs WHERE bg = 3 OR gid NOT IN (SELECT gid FROM cells WHERE v = 1)"),
    "search_fill_layer_holes": _sql(
        f"SELECT k.gid, k.r, k.c, CASE WHEN k.v = k.bg AND NOT {_OUTSIDE} THEN 3 ELSE k.v END AS v FROM fg k LEFT JOIN own USING (gid, r, c) LEFT JOIN o ON o.gid = k.gid AND o.k = own.k", _ground(), _parts("v <> 3", "true"), refused="SELECT gid FROM bgs WHERE bg = 3"
    ),
    "search_keep_objects": _picked("CASE WHEN o.k IS NULL THEN bg ELSE k.v END", f"WHERE NOT {_OUTSIDE}", by_place=True),
    "search_crop_objects": _picked("", _LARGEST, _SMALL, by_place=True, table="sm", rows=_CROP),
    "search_delete_objects": _picked("CASE WHEN o.k IS NULL THEN k.v ELSE bg END", "QUALIFY size = min(size) OVER (PARTITION BY gid)", by_place=True),
    "search_recolor_objects": _picked("CASE WHEN o.k IS NULL THEN k.v ELSE 9 END", "QUALIFY r0 = min(r0) OVER (PARTITION BY gid)", by_place=True),
    "search_fill_object_boxes": _sql(
        f"SELECT k.gid, k.r, k.c, coalesce((SELECT max(s.v) FROM sel s WHERE s.gid = k.gid AND {_IN}), k.v) AS v FROM fg k",
        _SMALL,
        _ground("sm"),
        _parts(),
        f"sel AS (SELECT * FROM o {_LARGEST})",
        refused=f"SELECT gid FROM ids WHERE gid NOT IN (SELECT gid FROM sel) OR gid IN (SELECT k.gid FROM fg k JOIN sel s ON s.gid = k.gid AND {_IN} WHERE k.v NOT IN (k.bg, s.v)) OR gid IN (SELECT a.gid FROM sel a JOIN sel b ON a.gid = b.gid AND a.v <> b.v AND a.r0 <= b.r1 AND b.r0 <= a.r1 AND a.c0 <= b.c1 AND b.c0 <= a.c1)",
    ),
    "search_scale_pixels": _sql("SELECT gid, r * 2 + y.i AS r, c, v FROM cells, range(2) y(i)"),
    "search_reduce_blocks": _sql("SELECT gid, r, c * 2 + x.i AS c, v FROM cells, range(2) x(i)"),
    "search_tile_grid": _sql("SELECT gid, r, c + 12 * x.i AS c, v FROM cells, range(2) x(i)"),
    "search_mirror_tile": _sql("SELECT gid, CASE y.i WHEN 0 THEN r ELSE 23 - r END AS r, CASE x.i WHEN 0 THEN c ELSE 23 - c END AS c, v FROM cells, range(2) y(i), range(2) x(i)"),
    "search_trim_uniform_border": _sql("SELECT gid, r - 1 AS r, c - 1 AS c, v FROM cells WHERE r BETWEEN 1 AND 10 AND c BETWEEN 1 AND 10"),
    "search_select_panel": _sql("SELECT gid, r - 4 AS r, c, CASE WHEN c % 4 = 3 THEN 5 ELSE v END AS v FROM cells WHERE r BETWEEN 4 AND 6"),
    "search_panel_logic": _sql("SELECT gid, r, c % 4 AS c, CASE WHEN count(*) FILTER (v <> 0) % 2 = 1 THEN 8 ELSE 0 END AS v FROM cells GROUP BY gid, r, c % 4"),
    "search_panel_overlay": _sql("SELECT a.gid, a.r, a.c, CASE WHEN a.v <> 0 THEN a.v ELSE b.v END AS v FROM cells a JOIN cells b ON b.gid = a.gid AND b.c = a.c AND b.r = a.r + 6"),
}
ORACLE_SQL = {name: sql.replace(f"// {ORDERS}", f"// {FEW_ORDERS}") if name in PLANS and PLANS[name][1][:1] == SMALL else sql for name, sql in ORACLE_SQL.items()}
