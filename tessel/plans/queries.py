"""A query for every operator over grids made from ``lineitem``, and DuckDB SQL for the same cells, written relationally."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessel.operators import OPERATORS
from tessel.sources.grids import from_lineitem, to_cells

ALL8 = {"sel": {"by": "all"}, "seg": "c8"}


def _sel(by: str, value: int | None = None, seg: str = "c8") -> dict:
    return {"sel": {"by": by} | ({} if value is None else {"value": value}), "seg": seg}


LINES = ("draw_grid_lines", {"period": 4, "color": 5})
#: Steps before the operator, and its parameters.
PLANS: dict[str, tuple[list[tuple[str, dict]], dict]] = {
    "rot90": ([], {"k": 1}),
    "flip": ([], {"axis": 0}),
    "transpose": ([], {}),
    "anti_transpose": ([], {}),
    "translate": ([], {"dy": 2, "dx": -1, "wrap": False}),
    "crop_to_content": ([("recolor", {"src": 1, "dst": 0}), ("recolor", {"src": 2, "dst": 0})], {}),
    "pad": ([], {"n": 2, "color": 4}),
    "scale_up": ([], {"k": 2}),
    "scale_down": ([("scale_up", {"k": 2})], {"k": 2}),
    "tile": ([], {"ny": 2, "nx": 1}),
    "mirror_concat": ([], {"mode": "both"}),
    "symmetrize": ([], {"mode": "h"}),
    "half": ([], {"which": "right"}),
    "half_logic": ([], {"axis": 1, "mode": "or", "color": 5}),
    "fractal": ([("pool", {"k": 3, "mode": "major"})], {}),
    "draw_border": ([], {"color": 7}),
    "remove_border": ([], {}),
    "draw_grid_lines": ([], {"period": 3, "color": 6}),
    "pool": ([], {"k": 3, "mode": "major"}),
    "dedupe_adjacent": ([("scale_up", {"k": 2})], {"axis": 2}),
    "tile_flip": ([], {"ny": 2, "nx": 2}),
    "rot_quad": ([], {"cw": False}),
    "shear": ([], {"step": 1, "axis": 1}),
    "scale_by_colors": ([("recolor", {"src": 3, "dst": 1})], {}),
    "pad_replicate": ([], {"n": 1, "corners": True}),
    "symmetrize_bbox": ([("keep_color", {"color": 3})], {"mode": "v"}),
    "crop_to_color": ([], {"color": 3, "inner": False}),
    "crop_fixed": ([], {"corner": "br", "h": 5, "w": 4}),
    "extract_period": ([("tile", {"ny": 2, "nx": 2})], {}),
    "take_part": ([], {"ny": 2, "nx": 2, "idx": 2}),
    "overlay_parts": ([], {"ny": 2, "nx": 2, "order": []}),
    "keep_center_line": ([("keep_color", {"color": 3}), ("crop_to_content", {})], {"axis": 1}),
    "concat_with": ([], {"axis": 0, "tf": "rot180", "swap": True}),
    "self_logic": ([], {"tf": "transpose", "mode": "xor", "color": 8}),
    "recolor": ([], {"src": 2, "dst": 9}),
    "swap_colors": ([], {"a": 1, "b": 3}),
    "keep_color": ([], {"color": 2}),
    "remove_color": ([], {"color": 2}),
    "recolor_all": ([], {"color": 4}),
    "shift_colors": ([], {"s": 7}),
    "invert_binary": ([], {"color": 6}),
    "fill_bg": ([], {"color": 8}),
    "majority_fill": ([], {}),
    "dominant_color_cell": ([], {}),
    "colors_by_frequency": ([], {}),
    "recolor_by_frequency_rank": ([], {"colors": [7, 8]}),
    "swap_extreme_colors": ([], {}),
    "recolor_objects": ([], {**_sel("largest"), "color": 7}),
    "recolor_by_size_rank": ([], {"colors": [7, 8], "seg": "c4"}),
    "recolor_by_holes": ([], {"colors": [4, 5, 6], "seg": "c8"}),
    "delete_objects": ([], _sel("size_eq", 1, "c4")),
    "keep_objects": ([], _sel("color", 2)),
    "move_objects": ([], {**_sel("inner"), "dy": 1, "dx": 0}),
    "copy_objects": ([], {**_sel("size_gt", 2), "dy": 1, "dx": 1}),
    "slide_objects": ([], {**_sel("smallest"), "dir": "down"}),
    "flip_objects": ([], {**_sel("largest", seg="m4"), "axis": 1}),
    "fill_holes": ([], {"color": 4}),
    "outline_objects": ([], {**_sel("color", 3), "color": 4}),
    "bbox_fill": ([], {**_sel("color", 3), "color": 4}),
    "frame_objects": ([], {**_sel("size_gt", 3), "color": 9}),
    "hollow_objects": ([("fill_bg", {"color": 1})], ALL8),
    "dilate": ([], {"conn": 4}),
    "erode": ([("recolor_all", {"color": 1}), ("fill_bg", {"color": 2}), ("draw_border", {"color": 0})], {"conn": 4}),
    "crop_to_object": ([], _sel("largest")),
    "count_objects_bar": ([], {**_sel("color", 3), "color": 3}),
    "gravity_cells": ([], {"dir": "down"}),
    "sort_columns_by_height": ([], {"order": "desc"}),
    "object_color_cell": ([], _sel("largest")),
    "swap_object_colors": ([], {"seg": "m4"}),
    "rotate_objects": ([], {**_sel("square"), "k": 1}),
    "paint_interior": ([("fill_bg", {"color": 1})], {**ALL8, "color": 9}),
    "recolor_split": ([], {**_sel("touches_border"), "yes": 5, "no": 6}),
    "slide_cells": ([], {"src": 2, "dir": "right"}),
    "count_bar_fixed": ([], {**_sel("size_gt", 3), "color": 2, "width": 9}),
    "crop_object_only": ([], _sel("largest")),
    "bbox_frame_all": ([("remove_color", {"color": 1}), ("remove_color", {"color": 2})], {"color": 7, "pad": 1}),
    "majority_filter": ([], {"conn": 8}),
    "mark_centers": ([], {**_sel("size_gt", 2), "color": 9}),
    "shoot_rays": ([("keep_color", {"color": 3})], {"src": 3, "dir": "right"}),
    "connect_pairs": ([("keep_color", {"color": 3})], {"src": 3, "line": 8, "axis": 0}),
    "fill_lines": ([("keep_color", {"color": 3})], {"src": 3, "axis": 0, "color": 6}),
    "stamp_shape": ([], {"src": 3, "shape": "plus", "color": 4}),
    "full_lines": ([("keep_color", {"color": 3})], {"src": 3, "dir": "h"}),
    "connect_diag": ([], {"src": 3, "line": 5}),
    "select_cell": ([LINES], {"mode": "most"}),
    "overlay_cells": ([LINES], {"order": "fwd"}),
    "cells_to_pixels": ([LINES], {}),
    "recolor_from_marker": ([], {"erase": True}),
    "recolor_contained": ([("draw_border", {"color": 4})], {"mode": "inherit"}),
    "stamp_template": ([("keep_color", {"color": 3})], {"marker": -1, "recolor": False}),
    "slide_toward": ([], {"mover": 1, "target": 3}),
    "connect_to_target": ([], {"mover": 1, "target": 3}),
    "repair_tiling": ([("pool", {"k": 3, "mode": "major"}), ("tile", {"ny": 2, "nx": 2}), ("draw_border", {"color": 9})], {"mask": 9, "crop": False}),
    "repair_symmetry": ([("symmetrize", {"mode": "h"})], {"mask": 3, "mode": "v", "crop": False}),
    "extend_periodic": ([], {"axis": 1}),
    "fill_holes_by_area": ([], {"colors": [7, 8, 9]}),
    "flood_from_seed": ([], {"seed": 3, "color": 7}),
    "draw_rect_between": ([("pool", {"k": 3, "mode": "major"})], {"fill": True, "color": 7}),
    "fill_largest_empty_rect": ([], {"color": 7}),
    "object_histogram": ([], {"seg": "c8"}),
    "unify_multicolor": ([], {"mode": "major", "seg": "m4"}),
    "mirror_over_line": ([("overlay_parts", {"ny": 1, "nx": 2, "order": []}), ("draw_grid_lines", {"period": 7, "color": 5})], {"line": 5}),
    "fill_cells": ([LINES], {"mode": "nonempty", "color": -1}),
    "step_toward": ([], {"mover": 1, "target": 3, "steps": 1}),
    "recolor_by_shape_match": ([], {"src": 1}),
    "color_histogram": ([], {"vertical": False}),
    "react_touching": ([], {"a": 1, "b": 2, "color": 8}),
    "recolor_mirrored": ([], {"axis": 1, "color": 8}),
}


def _query(name: str, before: list[tuple[str, dict]], parameters: dict) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        grids = from_lineitem(spark, sf_dir)
        for step, given in [*before, (name, parameters)]:
            grids = OPERATORS[step](grids, **given)
        return to_cells(grids)

    return run


QUERIES = {f"grid_{name}": _query(name, *plan) for name, plan in PLANS.items()}

# --- the same in SQL -------------------------------------------------------------------

_BASE = """raw AS (
  SELECT l_orderkey // 16 AS gid, (l_partkey % 12)::INT AS r, (l_quantity::INT % 12)::INT AS c, max(1 + l_linenumber % 3)::INT AS v FROM lineitem GROUP BY ALL
), ids AS (SELECT DISTINCT gid FROM raw), axis AS (SELECT i::INT AS i FROM range(12) t(i)), cells AS (
  SELECT ids.gid, y.i AS r, x.i AS c, coalesce(raw.v, 0) AS v FROM ids CROSS JOIN axis y CROSS JOIN axis x LEFT JOIN raw ON raw.gid = ids.gid AND raw.r = y.i AND raw.c = x.i
)"""


def _sql(body: str, *ctes: str, refused: str = "") -> str:
    """``body`` selects gid, r, c, v; ``refused`` selects the gids that the operator refuses."""
    out = f"SELECT gid::BIGINT AS gid, r::INT AS r, c::INT AS c, v::INT AS v FROM ({body})"
    if refused:
        out = f"SELECT * FROM ({out}) WHERE gid NOT IN (SELECT gid FROM ({refused})) UNION ALL SELECT gid::BIGINT, -1, -1, -1 FROM ({refused})"
    return "WITH RECURSIVE " + ", ".join([_BASE, *ctes]) + " " + out


def _push(r: str, c: str, where: str = "true") -> str:
    return f"SELECT gid, {r} AS r, {c} AS c, v FROM cells WHERE {where}"


def _case(cases: str) -> str:
    return f"SELECT gid, r, c, {cases} AS v FROM cells k"


def _grid(h: object, w: object, value: str) -> str:
    """A grid of h x w cells k, each with a value."""
    return f"SELECT k.gid, k.r, k.c, {value} AS v FROM (SELECT gid, y.i AS r, x.i AS c FROM ids, range({h}) y(i), range({w}) x(i)) k"


def _get(r: str, c: str, source: str = "cells") -> str:
    return f"(SELECT s.v FROM {source} s WHERE s.gid = k.gid AND s.r = {r} AND s.c = {c})"


_COUNTS = "n AS (SELECT gid, v, count(*) AS n FROM cells WHERE v > 0 GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY n DESC, v) AS k, count(*) OVER (PARTITION BY gid) AS m, count(*) OVER (PARTITION BY gid, n) AS same FROM n)"
_TIE = "SELECT gid FROM rk GROUP BY gid HAVING count(*) < 2 OR count(DISTINCT n) < count(*)"


def _labels(diagonal: bool, start: str = "v > 0", same: str = "s.v = t.v") -> str:
    near = "abs(s.r - t.r) <= 1 AND abs(s.c - t.c) <= 1" if diagonal else "abs(s.r - t.r) + abs(s.c - t.c) = 1"
    return f"""lab(gid, r, c, v, p) AS (
  SELECT gid, r, c, v, r * 12 + c FROM cells WHERE {start}
  UNION SELECT s.gid, s.r, s.c, s.v, t.p FROM lab t JOIN (SELECT * FROM cells WHERE {start}) s ON s.gid = t.gid AND {near} AND {same}
), own AS (SELECT gid, r, c, v, min(p) AS k FROM lab GROUP BY ALL),
o AS (SELECT gid, k, min(v) AS v, count(*) AS size, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM own GROUP BY gid, k)"""


def _objects(cases: str) -> str:
    """Cells k with their object o."""
    return f"SELECT k.gid, k.r, k.c, {cases} AS v FROM cells k LEFT JOIN own USING (gid, r, c) LEFT JOIN o ON o.gid = k.gid AND o.k = own.k"


_POOLED = "a AS (SELECT gid, r // 3 AS r, c // 3 AS c, v, count(*) AS n FROM cells GROUP BY ALL), part AS (SELECT gid, r, c, v FROM a QUALIFY row_number() OVER (PARTITION BY gid, r, c ORDER BY n DESC, v) = 1)"
_LARGEST = "o.size = max(o.size) OVER (PARTITION BY k.gid)"
_PANELS = "kept AS (SELECT gid, r // 4 AS i, c // 4 AS j, r % 4 AS y, c % 4 AS x, v FROM cells WHERE r % 4 < 3 AND c % 4 < 3)"
_STACK = "row_number() OVER (PARTITION BY gid, c ORDER BY r DESC)"

ORACLE_SQL = {
    "grid_rot90": _sql(_push("11 - c", "r")),
    "grid_flip": _sql(_push("11 - r", "c")),
    "grid_transpose": _sql(_push("c", "r")),
    "grid_anti_transpose": _sql(_push("11 - c", "11 - r")),
    "grid_translate": _sql(_case(f"coalesce({_get('k.r - 2', 'k.c + 1')}, 0)")),
    "grid_crop_to_content": _sql(
        "SELECT k.gid, r - r0 AS r, c - c0 AS c, CASE WHEN v = 3 THEN 3 ELSE 0 END AS v FROM cells k JOIN box USING (gid) WHERE r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1",
        "box AS (SELECT gid, min(r) r0, max(r) r1, min(c) c0, max(c) c1 FROM cells WHERE v = 3 GROUP BY gid)",
        refused="SELECT gid FROM ids WHERE gid NOT IN (SELECT gid FROM box)",
    ),
    "grid_pad": _sql(_grid(16, 16, f"coalesce({_get('k.r - 2', 'k.c - 2')}, 4)")),
    "grid_scale_up": _sql("SELECT gid, r * 2 + y.i AS r, c * 2 + x.i AS c, v FROM cells, range(2) y(i), range(2) x(i)"),
    "grid_scale_down": _sql("SELECT * FROM cells"),
    "grid_tile": _sql("SELECT gid, r + 12 * y.i AS r, c, v FROM cells, range(2) y(i)"),
    "grid_mirror_concat": _sql("SELECT gid, CASE y.i WHEN 0 THEN r ELSE 23 - r END AS r, CASE x.i WHEN 0 THEN c ELSE 23 - c END AS c, v FROM cells, range(2) y(i), range(2) x(i)"),
    "grid_symmetrize": _sql(_case(f"CASE WHEN v > 0 THEN v ELSE {_get('k.r', '11 - k.c')} END")),
    "grid_half": _sql(_push("r", "c - 6", "c >= 6")),
    "grid_half_logic": _sql("SELECT gid, a.r, a.c, CASE WHEN a.v > 0 OR b.v > 0 THEN 5 ELSE 0 END AS v FROM cells a JOIN (SELECT gid, r, c - 6 AS c, v FROM cells WHERE c >= 6) b USING (gid, r, c)"),
    "grid_fractal": _sql("SELECT a.gid, a.r * 4 + b.r AS r, a.c * 4 + b.c AS c, CASE WHEN a.v > 0 THEN b.v ELSE 0 END AS v FROM part a JOIN part b USING (gid)", _POOLED),
    "grid_extract_period": _sql("SELECT * FROM cells"),
    "grid_repair_tiling": _sql("SELECT gid, r + 4 * y.i AS r, c + 4 * x.i AS c, v FROM part, range(2) y(i), range(2) x(i)", _POOLED),
    "grid_slide_cells": _sql(
        "SELECT gid, r, c, CASE WHEN wall THEN v WHEN row_number() OVER (PARTITION BY gid, r, seg, wall ORDER BY c DESC) <= sum((v = 2)::INT) OVER (PARTITION BY gid, r, seg, wall) THEN 2 ELSE 0 END AS v FROM (SELECT *, sum(wall::INT) OVER (PARTITION BY gid, r ORDER BY c) AS seg FROM (SELECT *, v NOT IN (0, 2) AS wall FROM cells))"
    ),
    "grid_swap_object_colors": _sql(
        "SELECT k.gid, k.r, k.c, CASE WHEN n.m = 2 THEN n.lo + n.hi - k.v ELSE k.v END AS v FROM cells k LEFT JOIN own USING (gid, r, c) LEFT JOIN n ON n.gid = k.gid AND n.k = own.k",
        _labels(False, "v > 0", "true"),
        "n AS (SELECT gid, k, count(DISTINCT v) AS m, min(v) AS lo, max(v) AS hi FROM own GROUP BY gid, k)",
    ),
    "grid_unify_multicolor": _sql(
        "SELECT k.gid, k.r, k.c, coalesce(n.v, k.v) AS v FROM cells k LEFT JOIN own USING (gid, r, c) LEFT JOIN n ON n.gid = k.gid AND n.k = own.k AND n.place = 1",
        _labels(False, "v > 0", "true"),
        "n AS (SELECT gid, k, v, count(*) AS n, row_number() OVER (PARTITION BY gid, k ORDER BY count(*) DESC, v) AS place FROM own GROUP BY gid, k, v)",
        refused="SELECT a.gid FROM n a JOIN n b ON a.gid = b.gid AND a.k = b.k AND a.place = 1 AND b.place = 2 AND a.n = b.n GROUP BY a.gid",
    ),
    "grid_recolor_from_marker": _sql(
        "SELECT q.gid, q.r, q.c, CASE WHEN t.v IS NOT NULL THEN t.v WHEN own.k IN (SELECT x.marker FROM near x JOIN taken y ON y.gid = x.gid AND y.k = x.k WHERE x.gid = q.gid) THEN 0 ELSE q.v END AS v FROM cells q LEFT JOIN own USING (gid, r, c) LEFT JOIN taken t ON t.gid = q.gid AND t.k = own.k",
        _labels(True),
        "near AS (SELECT DISTINCT b.gid, b.k, m.k AS marker, m.v FROM own b JOIN o ON o.gid = b.gid AND o.k = b.k AND o.size > 1 JOIN o m ON m.gid = b.gid AND m.size = 1 AND abs(m.r0 - b.r) <= 1 AND abs(m.c0 - b.c) <= 1)",
        "taken AS (SELECT gid, k, min(v) AS v FROM near GROUP BY gid, k HAVING count(DISTINCT v) = 1)",
    ),
    "grid_fill_largest_empty_rect": _sql(
        "SELECT k.gid, k.r, k.c, CASE WHEN k.r BETWEEN r0 AND r1 AND k.c BETWEEN c0 AND c1 THEN 7 ELSE k.v END AS v FROM cells k JOIN best USING (gid)",
        "sums AS (SELECT gid, r, c, sum((v > 0)::INT) OVER (PARTITION BY gid, c ORDER BY r) AS n FROM cells)",
        "cols AS (SELECT b.gid, y.i AS r0, b.r AS r1, b.c, b.n - coalesce(a.n, 0) = 0 AS free FROM sums b JOIN range(12) y(i) ON y.i <= b.r LEFT JOIN sums a ON a.gid = b.gid AND a.c = b.c AND a.r = y.i - 1)",
        "runs AS (SELECT gid, r0, r1, min(c) AS c0, max(c) AS c1 FROM (SELECT *, c - row_number() OVER (PARTITION BY gid, r0, r1 ORDER BY c) AS run FROM cols WHERE free) GROUP BY gid, r0, r1, run)",
        "big AS (SELECT *, (r1 - r0 + 1) * (c1 - c0 + 1) AS area FROM runs), best AS (SELECT * FROM big WHERE area > 1 QUALIFY area = max(area) OVER (PARTITION BY gid) AND count(*) OVER (PARTITION BY gid, area) = 1)",
        refused="SELECT gid FROM ids WHERE gid NOT IN (SELECT gid FROM best)",
    ),
    "grid_draw_border": _sql(_case("CASE WHEN r IN (0, 11) OR c IN (0, 11) THEN 7 ELSE v END")),
    "grid_remove_border": _sql(_push("r - 1", "c - 1", "r BETWEEN 1 AND 10 AND c BETWEEN 1 AND 10")),
    "grid_draw_grid_lines": _sql(_case("CASE WHEN r % 3 = 2 OR c % 3 = 2 THEN 6 ELSE v END")),
    "grid_pool": _sql("SELECT gid, r, c, v FROM b WHERE k = 1", "a AS (SELECT gid, r // 3 AS r, c // 3 AS c, v, count(*) AS n FROM cells GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY gid, r, c ORDER BY n DESC, v) AS k FROM a)"),
    "grid_dedupe_adjacent": _sql(
        "SELECT k.gid, y.n AS r, x.n AS c, k.v FROM cells k JOIN ry y ON y.gid = k.gid AND y.r = k.r JOIN cx x ON x.gid = k.gid AND x.c = k.c",
        "rows AS (SELECT gid, r, list(v ORDER BY c) AS l FROM cells GROUP BY gid, r), ry AS (SELECT gid, r, row_number() OVER (PARTITION BY gid ORDER BY r) - 1 AS n FROM (SELECT *, lag(l) OVER (PARTITION BY gid ORDER BY r) AS b FROM rows) WHERE b IS NULL OR b <> l), "
        "cols AS (SELECT gid, c, list(v ORDER BY r) AS l FROM cells JOIN ry USING (gid, r) GROUP BY gid, c), cx AS (SELECT gid, c, row_number() OVER (PARTITION BY gid ORDER BY c) - 1 AS n FROM (SELECT *, lag(l) OVER (PARTITION BY gid ORDER BY c) AS b FROM cols) WHERE b IS NULL OR b <> l)",
    ),
    "grid_tile_flip": _sql("SELECT gid, CASE y.i WHEN 0 THEN r ELSE 23 - r END AS r, CASE x.i WHEN 0 THEN c ELSE 23 - c END AS c, v FROM cells, range(2) y(i), range(2) x(i)"),
    "grid_rot_quad": _sql(" UNION ALL ".join([_push("r", "c"), _push("11 - c", "r + 12"), _push("c + 12", "11 - r"), _push("23 - r", "23 - c")])),
    "grid_shear": _sql(_push("r", "(c + r) % 12")),
    "grid_scale_by_colors": _sql(
        "SELECT gid, r * m + y.i AS r, c * m + x.i AS c, CASE WHEN v = 3 THEN 1 ELSE v END AS v FROM cells JOIN m USING (gid), range(2) y(i), range(2) x(i)",
        "m AS (SELECT gid, count(DISTINCT CASE WHEN v = 3 THEN 1 ELSE v END) AS m FROM cells WHERE v > 0 GROUP BY gid)",
        refused="SELECT gid FROM m WHERE m < 2",
    ),
    "grid_pad_replicate": _sql(_grid(14, 14, f"CASE WHEN k.r IN (0, 13) AND k.c IN (0, 13) THEN 0 ELSE {_get('least(greatest(k.r - 1, 0), 11)', 'least(greatest(k.c - 1, 0), 11)')} END")),
    "grid_symmetrize_bbox": _sql(
        "SELECT k.gid, k.r, k.c, CASE WHEN k.v = 3 OR (r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1 AND (SELECT s.v FROM cells s WHERE s.gid = k.gid AND s.r = r0 + r1 - k.r AND s.c = k.c) = 3) THEN 3 ELSE 0 END AS v FROM cells k JOIN box USING (gid)",
        "box AS (SELECT gid, min(r) r0, max(r) r1, min(c) c0, max(c) c1 FROM cells WHERE v = 3 GROUP BY gid)",
        refused="SELECT gid FROM ids WHERE gid NOT IN (SELECT gid FROM box)",
    ),
    "grid_crop_to_color": _sql(
        "SELECT k.gid, r - r0 AS r, c - c0 AS c, v FROM cells k JOIN box USING (gid) WHERE r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1",
        "box AS (SELECT gid, min(r) r0, max(r) r1, min(c) c0, max(c) c1 FROM cells WHERE v = 3 GROUP BY gid)",
        refused="SELECT gid FROM ids WHERE gid NOT IN (SELECT gid FROM box)",
    ),
    "grid_crop_fixed": _sql(_push("r - 7", "c - 8", "r >= 7 AND c >= 8")),
    "grid_take_part": _sql(_push("r - 6", "c", "r >= 6 AND c < 6")),
    "grid_overlay_parts": _sql(_grid(6, 6, "coalesce(" + ", ".join(f"nullif({_get(f'k.r + {y}', f'k.c + {x}')}, 0)" for y in (0, 6) for x in (0, 6)) + ", 0)")),
    "grid_keep_center_line": _sql(
        "SELECT gid, r - r0 AS r, c - c0 AS c, CASE WHEN v = 3 AND 2 * c = c0 + c1 THEN 3 ELSE 0 END AS v FROM cells JOIN box USING (gid) WHERE r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1",
        "box AS (SELECT gid, min(r) r0, max(r) r1, min(c) c0, max(c) c1 FROM cells WHERE v = 3 GROUP BY gid)",
        refused="SELECT gid FROM ids WHERE gid NOT IN (SELECT gid FROM box WHERE (c1 - c0) % 2 = 0)",
    ),
    "grid_concat_with": _sql(_push("11 - r", "11 - c") + " UNION ALL " + _push("r + 12", "c")),
    "grid_self_logic": _sql(_case(f"CASE WHEN (v > 0) <> ({_get('k.c', 'k.r')} > 0) THEN 8 ELSE 0 END")),
    "grid_recolor": _sql(_case("CASE WHEN v = 2 THEN 9 ELSE v END")),
    "grid_swap_colors": _sql(_case("CASE v WHEN 1 THEN 3 WHEN 3 THEN 1 ELSE v END")),
    "grid_keep_color": _sql(_case("CASE WHEN v = 2 THEN 2 ELSE 0 END")),
    "grid_remove_color": _sql(_case("CASE WHEN v = 2 THEN 0 ELSE v END")),
    "grid_recolor_all": _sql(_case("CASE WHEN v > 0 THEN 4 ELSE 0 END")),
    "grid_shift_colors": _sql(_case("CASE WHEN v > 0 THEN (v + 6) % 9 + 1 ELSE 0 END")),
    "grid_invert_binary": _sql(_case("CASE WHEN v > 0 THEN 0 ELSE 6 END")),
    "grid_fill_bg": _sql(_case("CASE WHEN v > 0 THEN v ELSE 8 END")),
    "grid_majority_fill": _sql("SELECT c.gid, c.r, c.c, rk.v FROM cells c JOIN rk ON rk.gid = c.gid AND k = 1", _COUNTS),
    "grid_dominant_color_cell": _sql("SELECT gid, 0 AS r, 0 AS c, v FROM rk WHERE k = 1", _COUNTS, refused="SELECT gid FROM rk WHERE k = 1 AND same > 1"),
    "grid_colors_by_frequency": _sql("SELECT gid, k - 1 AS r, 0 AS c, v FROM rk", _COUNTS, refused="SELECT gid FROM rk GROUP BY gid HAVING count(DISTINCT n) < count(*)"),
    "grid_recolor_by_frequency_rank": _sql("SELECT c.gid, c.r, c.c, CASE rk.k WHEN 1 THEN 7 WHEN 2 THEN 8 ELSE c.v END AS v FROM cells c LEFT JOIN rk ON rk.gid = c.gid AND rk.v = c.v", _COUNTS, refused=_TIE),
    "grid_swap_extreme_colors": _sql(
        "SELECT c.gid, c.r, c.c, CASE WHEN c.v = a.v THEN z.v WHEN c.v = z.v THEN a.v ELSE c.v END AS v FROM cells c JOIN rk a ON a.gid = c.gid AND a.k = 1 JOIN rk z ON z.gid = c.gid AND z.k = z.m",
        _COUNTS,
        refused="SELECT gid FROM rk WHERE m < 2 OR ((k = 1 OR k = m) AND same > 1)",
    ),
    "grid_recolor_objects": _sql(_objects(f"CASE WHEN {_LARGEST} THEN 7 ELSE k.v END"), _labels(True)),
    "grid_recolor_by_size_rank": _sql(
        "SELECT k.gid, k.r, k.c, CASE d.k WHEN 1 THEN 7 WHEN 2 THEN 8 ELSE k.v END AS v FROM cells k LEFT JOIN own USING (gid, r, c) LEFT JOIN o ON o.gid = k.gid AND o.k = own.k LEFT JOIN d ON d.gid = o.gid AND d.size = o.size",
        _labels(False),
        "d AS (SELECT DISTINCT gid, size, dense_rank() OVER (PARTITION BY gid ORDER BY size DESC) AS k FROM o)",
    ),
    "grid_delete_objects": _sql(_objects("CASE WHEN o.size = 1 THEN 0 ELSE k.v END"), _labels(False)),
    "grid_keep_objects": _sql(_objects("CASE WHEN o.v = 2 THEN k.v ELSE 0 END"), _labels(True)),
    "grid_outline_objects": _sql(_case("CASE WHEN v = 0 AND EXISTS (SELECT 1 FROM cells s WHERE s.gid = k.gid AND s.v = 3 AND abs(s.r - k.r) <= 1 AND abs(s.c - k.c) <= 1) THEN 4 ELSE v END")),
    "grid_bbox_fill": _sql(_case("CASE WHEN v = 0 AND EXISTS (SELECT 1 FROM o WHERE o.gid = k.gid AND o.v = 3 AND k.r BETWEEN r0 AND r1 AND k.c BETWEEN c0 AND c1) THEN 4 ELSE v END"), _labels(True)),
    "grid_frame_objects": _sql(
        _case("CASE WHEN v = 0 AND EXISTS (SELECT 1 FROM o WHERE o.gid = k.gid AND o.size > 3 AND k.r BETWEEN r0 - 1 AND r1 + 1 AND k.c BETWEEN c0 - 1 AND c1 + 1 AND (k.r IN (r0 - 1, r1 + 1) OR k.c IN (c0 - 1, c1 + 1))) THEN 9 ELSE v END"), _labels(True)
    ),
    "grid_move_objects": _sql(
        "SELECT k.gid, k.r, k.c, CASE WHEN a.v IS NOT NULL THEN a.v WHEN b.v IS NOT NULL THEN 0 ELSE k.v END AS v FROM cells k LEFT JOIN moved a ON a.gid = k.gid AND a.r + 1 = k.r AND a.c = k.c LEFT JOIN moved b ON b.gid = k.gid AND b.r = k.r AND b.c = k.c",
        _labels(True),
        "moved AS (SELECT own.* FROM own JOIN o USING (gid, k) WHERE r0 > 0 AND c0 > 0 AND r1 < 11 AND c1 < 11)",
    ),
    "grid_copy_objects": _sql("SELECT k.gid, k.r, k.c, coalesce(a.v, k.v) AS v FROM cells k LEFT JOIN moved a ON a.gid = k.gid AND a.r + 1 = k.r AND a.c + 1 = k.c", _labels(True), "moved AS (SELECT own.* FROM own JOIN o USING (gid, k) WHERE size > 2)"),
    "grid_fill_holes": _sql(_objects("CASE WHEN k.v = 0 AND r0 > 0 AND c0 > 0 AND r1 < 11 AND c1 < 11 THEN 4 ELSE k.v END"), _labels(False, "v = 0")),
    "grid_fill_holes_by_area": _sql(_objects("CASE WHEN k.v = 0 AND r0 > 0 AND c0 > 0 AND r1 < 11 AND c1 < 11 THEN CASE WHEN o.size = 1 THEN 7 WHEN o.size <= 4 THEN 8 ELSE 9 END ELSE k.v END"), _labels(False, "v = 0")),
    "grid_flood_from_seed": _sql(
        "SELECT k.gid, k.r, k.c, CASE WHEN k.v = 0 AND own.k IN (SELECT s.k FROM own s WHERE s.gid = k.gid AND s.v = 3) THEN 7 ELSE k.v END AS v FROM cells k LEFT JOIN own USING (gid, r, c)",
        _labels(False, "v IN (0, 3)", "true"),
        refused="SELECT gid FROM ids WHERE gid NOT IN (SELECT gid FROM cells WHERE v = 3)",
    ),
    "grid_dilate": _sql(_case("CASE WHEN v > 0 THEN v ELSE coalesce(" + ", ".join(f"nullif({_get(y, x)}, 0)" for y, x in (("k.r + 1", "k.c"), ("k.r - 1", "k.c"), ("k.r", "k.c + 1"), ("k.r", "k.c - 1"))) + ", 0) END")),
    "grid_crop_to_object": _sql(
        "SELECT k.gid, r - r0 AS r, c - c0 AS c, k.v FROM cells k JOIN big o USING (gid) WHERE r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1",
        _labels(True),
        "big AS (SELECT * FROM o QUALIFY size = max(size) OVER (PARTITION BY gid))",
        refused="SELECT gid FROM big GROUP BY gid HAVING count(*) > 1",
    ),
    "grid_crop_object_only": _sql(
        "SELECT k.gid, r - r0 AS r, c - c0 AS c, CASE WHEN own.k = o.k THEN k.v ELSE 0 END AS v FROM cells k LEFT JOIN own USING (gid, r, c) JOIN big o ON o.gid = k.gid WHERE r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1",
        _labels(True),
        "big AS (SELECT * FROM o QUALIFY size = max(size) OVER (PARTITION BY gid))",
        refused="SELECT gid FROM big GROUP BY gid HAVING count(*) > 1",
    ),
    "grid_count_objects_bar": _sql(
        "SELECT gid, 0 AS r, unnest(range(n)) AS c, 3 AS v FROM n", _labels(True), "n AS (SELECT gid, count(*) FILTER (v = 3) AS n FROM o GROUP BY gid)", refused="SELECT gid FROM n WHERE n = 0 OR n > 30"
    ),
    "grid_count_bar_fixed": _sql(
        "SELECT gid, 0 AS r, x.i AS c, CASE WHEN x.i < n THEN 2 ELSE 0 END AS v FROM n, range(9) x(i)", _labels(True), "n AS (SELECT gid, count(*) FILTER (size > 3) AS n FROM o GROUP BY gid)", refused="SELECT gid FROM n WHERE n = 0 OR n > 9"
    ),
    "grid_object_color_cell": _sql(
        "SELECT gid, 0 AS r, 0 AS c, min(v) AS v FROM big GROUP BY gid", _labels(True), "big AS (SELECT * FROM o QUALIFY size = max(size) OVER (PARTITION BY gid))", refused="SELECT gid FROM big GROUP BY gid HAVING count(DISTINCT v) > 1"
    ),
    "grid_recolor_split": _sql(_objects("CASE WHEN r0 = 0 OR c0 = 0 OR r1 = 11 OR c1 = 11 THEN 5 WHEN o.k IS NOT NULL THEN 6 ELSE 0 END"), _labels(True)),
    "grid_mark_centers": _sql(
        _case("CASE WHEN EXISTS (SELECT 1 FROM o WHERE o.gid = k.gid AND o.size > 2 AND (r1 - r0) % 2 = 0 AND (c1 - c0) % 2 = 0 AND 2 * k.r = r0 + r1 AND 2 * k.c = c0 + c1) THEN 9 ELSE v END"), _labels(True)
    ),
    "grid_object_histogram": _sql(
        "SELECT gid, k - 1 AS r, c, CASE WHEN c < n THEN v ELSE 0 END AS v FROM rk, LATERAL (SELECT unnest(range(most)) AS c)",
        _labels(True),
        "rk AS (SELECT gid, v, count(*) AS n, row_number() OVER (PARTITION BY gid ORDER BY count(*) DESC) AS k, max(count(*)) OVER (PARTITION BY gid) AS most FROM o GROUP BY gid, v)",
        refused="SELECT gid FROM rk GROUP BY gid HAVING count(*) < 2 OR count(DISTINCT n) < count(*) OR max(n) > 30",
    ),
    "grid_gravity_cells": _sql(
        "SELECT k.gid, k.r, k.c, coalesce(s.v, 0) AS v FROM cells k LEFT JOIN s USING (gid, r, c)", f"s AS (SELECT gid, (12 - {_STACK})::INT AS r, c, v FROM cells WHERE v > 0)"
    ),
    "grid_sort_columns_by_height": _sql(
        "SELECT k.gid, k.r, p.n AS c, coalesce(s.v, 0) AS v FROM cells k LEFT JOIN s USING (gid, r, c) JOIN p ON p.gid = k.gid AND p.c = k.c",
        f"s AS (SELECT gid, (12 - {_STACK})::INT AS r, c, v FROM cells WHERE v > 0)",
        "p AS (SELECT gid, c, row_number() OVER (PARTITION BY gid ORDER BY count(*) FILTER (v > 0) DESC, c) - 1 AS n FROM cells GROUP BY gid, c)",
    ),
    "grid_bbox_frame_all": _sql(
        "SELECT k.gid, r, c, CASE WHEN v = 3 THEN 3 WHEN r BETWEEN r0 - 1 AND r1 + 1 AND c BETWEEN c0 - 1 AND c1 + 1 AND (r IN (r0 - 1, r1 + 1) OR c IN (c0 - 1, c1 + 1)) THEN 7 ELSE 0 END AS v FROM cells k JOIN box USING (gid)",
        "box AS (SELECT gid, min(r) r0, max(r) r1, min(c) c0, max(c) c1 FROM cells WHERE v = 3 GROUP BY gid)",
        refused="SELECT gid FROM ids WHERE gid NOT IN (SELECT gid FROM box)",
    ),
    "grid_majority_filter": _sql(
        "SELECT k.gid, k.r, k.c, coalesce(b.w, k.v) AS v FROM cells k LEFT JOIN b USING (gid, r, c)",
        "a AS (SELECT k.gid, k.r, k.c, s.v AS w, count(*) AS n FROM cells k JOIN cells s ON s.gid = k.gid AND abs(s.r - k.r) <= 1 AND abs(s.c - k.c) <= 1 GROUP BY ALL), "
        "b AS (SELECT gid, r, c, w FROM a QUALIFY n = max(n) OVER (PARTITION BY gid, r, c) AND count(*) OVER (PARTITION BY gid, r, c, n) = 1)",
    ),
    "grid_fill_lines": _sql(_case("CASE WHEN v = 3 THEN 3 WHEN max(v) OVER (PARTITION BY gid, r) = 3 THEN 6 ELSE 0 END")),
    "grid_full_lines": _sql(_case("CASE WHEN max(v) OVER (PARTITION BY gid, r) = 3 THEN 3 ELSE 0 END")),
    "grid_shoot_rays": _sql(_case("CASE WHEN max(v) OVER (PARTITION BY gid, r ORDER BY c) = 3 THEN 3 ELSE 0 END")),
    "grid_connect_pairs": _sql(
        _case("CASE WHEN v = 3 THEN 3 WHEN max(v) OVER (PARTITION BY gid, r ORDER BY c) = 3 AND max(v) OVER (PARTITION BY gid, r ORDER BY c DESC) = 3 THEN 8 ELSE 0 END")
    ),
    "grid_stamp_shape": _sql(_case("CASE WHEN v = 0 AND EXISTS (SELECT 1 FROM cells s WHERE s.gid = k.gid AND s.v = 3 AND abs(s.r - k.r) + abs(s.c - k.c) = 1) THEN 4 ELSE v END")),
    "grid_select_cell": _sql(
        "SELECT gid, y AS r, x AS c, v FROM kept JOIN best USING (gid, i, j)",
        _PANELS,
        "best AS (SELECT gid, i, j, count(*) FILTER (v > 0) AS n FROM kept GROUP BY gid, i, j QUALIFY n = max(n) OVER (PARTITION BY gid))",
        refused="SELECT gid FROM best GROUP BY gid HAVING count(*) > 1",
    ),
    "grid_overlay_cells": _sql("SELECT gid, y AS r, x AS c, coalesce(min_by(v, i * 3 + j) FILTER (v > 0), 0) AS v FROM kept GROUP BY ALL", _PANELS),
    "grid_cells_to_pixels": _sql(
        "SELECT p.gid, p.i AS r, p.j AS c, coalesce(m.v, 0) AS v FROM (SELECT DISTINCT gid, i, j FROM kept) p LEFT JOIN m USING (gid, i, j)",
        _PANELS,
        "m AS (SELECT gid, i, j, v FROM kept WHERE v > 0 GROUP BY gid, i, j, v QUALIFY row_number() OVER (PARTITION BY gid, i, j ORDER BY count(*) DESC, v) = 1)",
    ),
    "grid_fill_cells": _sql(
        "SELECT k.gid, k.r, k.c, CASE WHEN k.r % 4 = 3 OR k.c % 4 = 3 THEN 5 ELSE coalesce(m.v, 0) END AS v FROM cells k LEFT JOIN m ON m.gid = k.gid AND m.i = k.r // 4 AND m.j = k.c // 4",
        _PANELS,
        "m AS (SELECT gid, i, j, v FROM kept WHERE v > 0 GROUP BY gid, i, j, v QUALIFY row_number() OVER (PARTITION BY gid, i, j ORDER BY count(*) DESC, v) = 1)",
    ),
    "grid_color_histogram": _sql(
        "SELECT rk.gid, k - 1 AS r, x.i AS c, CASE WHEN x.i < n THEN v ELSE 0 END AS v FROM rk JOIN top USING (gid), range(31) x(i) WHERE x.i < top.m",
        _COUNTS,
        "top AS (SELECT gid, max(n) AS m FROM n GROUP BY gid)",
        refused=_TIE + " OR max(n) > 30",
    ),
    "grid_react_touching": _sql(
        _case(
            "CASE WHEN v = 1 AND EXISTS (SELECT 1 FROM cells s WHERE s.gid = k.gid AND s.v = 2 AND abs(s.r - k.r) <= 1 AND abs(s.c - k.c) <= 1) THEN 8 WHEN v = 2 AND EXISTS (SELECT 1 FROM cells s WHERE s.gid = k.gid AND s.v = 1 AND abs(s.r - k.r) <= 1 AND abs(s.c - k.c) <= 1) THEN 0 ELSE v END"
        ),
        refused="SELECT gid FROM ids WHERE gid NOT IN (SELECT k.gid FROM cells k JOIN cells s ON s.gid = k.gid AND k.v = 1 AND s.v = 2 AND abs(s.r - k.r) <= 1 AND abs(s.c - k.c) <= 1)",
    ),
    "grid_recolor_mirrored": _sql(_case(f"CASE WHEN v > 0 AND v = {_get('k.r', '11 - k.c')} THEN 8 ELSE v END")),
    "grid_hollow_objects": _sql(
        "SELECT k.gid, k.r, k.c, CASE WHEN (SELECT count(*) FROM f s WHERE s.gid = k.gid AND s.v = k.v AND abs(s.r - k.r) + abs(s.c - k.c) = 1) = 4 THEN 0 ELSE k.v END AS v FROM f k", "f AS (SELECT gid, r, c, CASE WHEN v = 0 THEN 1 ELSE v END AS v FROM cells)"
    ),
    "grid_paint_interior": _sql(
        "SELECT k.gid, k.r, k.c, CASE WHEN (SELECT count(*) FROM f s WHERE s.gid = k.gid AND s.v = k.v AND abs(s.r - k.r) <= 1 AND abs(s.c - k.c) <= 1) = 9 THEN 9 ELSE k.v END AS v FROM f k", "f AS (SELECT gid, r, c, CASE WHEN v = 0 THEN 1 ELSE v END AS v FROM cells)"
    ),
    "grid_erode": _sql(_case("CASE WHEN r BETWEEN 2 AND 9 AND c BETWEEN 2 AND 9 THEN CASE WHEN v > 0 THEN 1 ELSE 2 END ELSE 0 END")),
}
