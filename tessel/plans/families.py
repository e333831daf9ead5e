"""Named programs of two or three steps, run over lineitem's grids or grids generated from its orders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.plans import more
from tessel.plans.programs import Program, run
from tessel.plans.queries import _labels, _objects, _sql
from tessel.sources.generators import generate
from tessel.sources.grids import ORDERS, from_lineitem, to_cells


def _on(by: str, value: int | None = None, seg: str = "c8") -> dict:
    return {"sel": {"by": by} | ({} if value is None else {"value": value}), "seg": seg}


#: Each family's steps, with one choice of parameters, and the generator of its grids ("": lineitem's grids).
FAMILIES: dict[str, tuple[str, Program]] = {
    "highlight_extract": ("", [("recolor_objects", {**_on("largest"), "color": 7}), ("crop_object_only", _on("color", 7))]),
    "odd_shape_out": ("", [("recolor_objects", {**_on("unique_shape"), "color": 7}), ("keep_objects", _on("color", 7))]),
    "big_small_split": ("", [("recolor_split", {**_on("size_gt", 2), "yes": 5, "no": 6}), ("keep_objects", _on("color", 5))]),
    "rank_and_fall": ("few", [("slide_objects", {**_on("all"), "dir": "down"}), ("recolor_by_size_rank", {"colors": [7, 8, 9], "seg": "c8"})]),
    "layer_slide_repaint": ("", [("keep_color", {"color": 3}), ("slide_objects", {**_on("all"), "dir": "left"}), ("recolor_all", {"color": 8})]),
    "centres_only": ("", [("mark_centers", {**_on("rect"), "color": 9}), ("keep_objects", _on("color", 9))]),
    "isolate_crop_frame": ("", [("keep_color", {"color": 3}), ("crop_to_content", {}), ("pad", {"n": 1, "color": 4})]),
    "denoise_then_fill": ("", [("delete_objects", _on("size_lt", 2)), ("fill_holes", {"color": 4})]),
    "clean_dots_halo": ("few", [("unify_multicolor", {"mode": "minor", "seg": "m8"}), ("outline_objects", {**_on("all"), "color": 4})]),
    "majority_clean_shrink": ("blocky_noise", [("majority_filter", {"conn": 8}), ("pool", {"k": 2, "mode": "any"})]),
    "marker_paint_halo": ("few", [("recolor_from_marker", {"erase": True}), ("outline_objects", {**_on("all"), "color": 4})]),
    "container_border": ("", [("recolor_contained", {"mode": "inherit"}), ("draw_border", {"color": 4})]),
    "fly_to_wall_glow": ("few", [("slide_toward", {"mover": 1, "target": 2}), ("outline_objects", {**_on("color", 1), "color": 4})]),
    "wire_to_wall": ("few", [("connect_to_target", {"mover": 1, "target": 2}), ("recolor", {"src": 1, "dst": 4})]),
    "stamp_and_crop": ("few", [("stamp_template", {"marker": 3, "recolor": True}), ("crop_to_content", {})]),
    "flood_rooms_keep": ("", [("flood_from_seed", {"seed": 3, "color": 7}), ("keep_color", {"color": 7})]),
    "box_then_flood": ("few", [("draw_rect_between", {"fill": False, "color": -1}), ("fill_holes", {"color": 4})]),
    "crossing_lines": ("few", [("full_lines", {"src": 1, "dir": "h"}), ("full_lines", {"src": 2, "dir": "v"})]),
    "wires_with_halo": ("few", [("connect_pairs", {"src": -1, "line": 4, "axis": 2}), ("outline_objects", {**_on("color", 4), "color": 5})]),
    "symmetry_frame": ("sparse", [("symmetrize", {"mode": "both"}), ("draw_border", {"color": 4})]),
    "patch_zoom": ("sparse", [("symmetrize", {"mode": "h"}), ("repair_symmetry", {"mask": 3, "mode": "v", "crop": True}), ("scale_up", {"k": 2})]),
    "carpet_motif": ("periodic", [("repair_tiling", {"mask": 3, "crop": False}), ("extract_period", {})]),
    "motif_zoom": ("periodic", [("extract_period", {}), ("scale_up", {"k": 2})]),
    "squeeze_turn": ("stretched", [("dedupe_adjacent", {"axis": 2}), ("rot90", {"k": 1})]),
    "mirror_repaint": ("small", [("mirror_concat", {"mode": "both"}), ("recolor", {"src": 1, "dst": 7})]),
    "flip_tiling_repaint": ("small", [("tile_flip", {"ny": 2, "nx": 2}), ("recolor", {"src": 2, "dst": 7})]),
    "kaleidoscope_frame": ("small", [("rot_quad", {"cw": True}), ("draw_border", {"color": 4})]),
    "panel_logic_zoom": ("halves", [("half_logic", {"axis": 1, "mode": "xor", "color": 4}), ("scale_up", {"k": 2})]),
    "pick_cell_zoom": ("gridded", [("select_cell", {"mode": "most"}), ("scale_up", {"k": 2})]),
    "panels_to_pixels": ("gridded", [("cells_to_pixels", {}), ("scale_up", {"k": 2})]),
    "stack_panels_paint": ("gridded", [("overlay_cells", {"order": "rev"}), ("recolor_all", {"color": 4})]),
    "count_to_bar": ("", [("count_objects_bar", {**_on("color", 3), "color": 7}), ("rot90", {"k": 1})]),
    "sorted_bars_repaint": ("bars", [("sort_columns_by_height", {"order": "asc"}), ("recolor_all", {"color": 4})]),
}


def grids(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    if not kind:
        return from_lineitem(spark, sf_dir)
    orders = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.floor(F.col("l_orderkey") / ORDERS).alias("gid")).distinct()
    return generate(orders, kind)


def _query(kind: str, program: Program) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: to_cells(run(grids(spark, sf_dir, kind), program))


QUERIES = {f"family_{name}": _query(*plan) for name, plan in FAMILIES.items()}

_BOX = "box AS (SELECT gid, min(r) r0, max(r) r1, min(c) c0, max(c) c1 FROM cells WHERE v = 3 GROUP BY gid)"
_FRAME = "r = 0 OR c = 0 OR r = max(r) OVER (PARTITION BY gid) OR c = max(c) OVER (PARTITION BY gid)"


def _on_made(generator: str, body: str) -> str:
    """``body`` over the cells g of generated grids, with their sizes."""
    return f"WITH g0 AS ({more.ORACLE_SQL['generate_' + generator]}), g AS (SELECT *, max(r) OVER (PARTITION BY gid) + 1 AS h, max(c) OVER (PARTITION BY gid) + 1 AS w FROM g0) SELECT gid::BIGINT AS gid, r::INT AS r, c::INT AS c, v::INT AS v FROM ({body})"


ORACLE_SQL = {
    "family_big_small_split": _sql(_objects("CASE WHEN o.size > 2 THEN 5 ELSE 0 END"), _labels(True)),
    "family_centres_only": _sql(
        "SELECT k.gid, k.r, k.c, CASE WHEN EXISTS (SELECT 1 FROM o WHERE o.gid = k.gid AND size = (r1 - r0 + 1) * (c1 - c0 + 1) AND (r1 - r0) % 2 = 0 AND (c1 - c0) % 2 = 0 AND 2 * k.r = r0 + r1 AND 2 * k.c = c0 + c1) THEN 9 ELSE 0 END AS v FROM cells k", _labels(True)
    ),
    "family_isolate_crop_frame": _sql(
        "SELECT b.gid, y.i AS r, x.i AS c, CASE WHEN y.i = 0 OR x.i = 0 OR y.i = r1 - r0 + 2 OR x.i = c1 - c0 + 2 THEN 4 WHEN k.v = 3 THEN 3 ELSE 0 END AS v FROM box b JOIN range(14) y(i) ON y.i <= r1 - r0 + 2 JOIN range(14) x(i) ON x.i <= c1 - c0 + 2 LEFT JOIN cells k ON k.gid = b.gid AND k.r = r0 + y.i - 1 AND k.c = c0 + x.i - 1",
        _BOX,
        refused="SELECT gid FROM ids WHERE gid NOT IN (SELECT gid FROM box)",
    ),
    "family_denoise_then_fill": _sql(
        "SELECT k.gid, k.r, k.c, CASE WHEN k.v = 0 AND p.r0 > 0 AND p.c0 > 0 AND p.r1 < 11 AND p.c1 < 11 THEN 4 ELSE k.v END AS v FROM den k LEFT JOIN own2 USING (gid, r, c) LEFT JOIN o2 p ON p.gid = k.gid AND p.k = own2.k",
        _labels(True),
        "den AS (SELECT k.gid, k.r, k.c, CASE WHEN o.size < 2 THEN 0 ELSE k.v END AS v FROM cells k LEFT JOIN own USING (gid, r, c) LEFT JOIN o ON o.gid = k.gid AND o.k = own.k)",
        _labels(False, "v = 0").replace("cells", "den").replace("lab", "lab2").replace("own", "own2").replace("\no AS", "\no2 AS"),
    ),
    "family_flood_rooms_keep": _sql(
        "SELECT k.gid, k.r, k.c, CASE WHEN k.v = 0 AND own.k IN (SELECT s.k FROM own s WHERE s.gid = k.gid AND s.v = 3) THEN 7 ELSE 0 END AS v FROM cells k LEFT JOIN own USING (gid, r, c)",
        _labels(False, "v IN (0, 3)", "true"),
        refused="SELECT gid FROM ids WHERE gid NOT IN (SELECT gid FROM cells WHERE v = 3)",
    ),
    "family_count_to_bar": _sql("SELECT gid, unnest(range(n)) AS r, 0 AS c, 7 AS v FROM n", _labels(True), "n AS (SELECT gid, count(*) FILTER (v = 3) AS n FROM o GROUP BY gid)", refused="SELECT gid FROM n WHERE n = 0 OR n > 30"),
    "family_symmetry_frame": _on_made(
        "sparse",
        f"SELECT gid, r, c, CASE WHEN {_FRAME} THEN 4 ELSE coalesce(" + ", ".join(f"nullif((SELECT s.v FROM g0 s WHERE s.gid = g.gid AND s.r = {r} AND s.c = {c}), 0)" for r in ("g.r", "g.h - 1 - g.r") for c in ("g.c", "g.w - 1 - g.c")) + ", 0) END AS v FROM g",
    ),
    "family_mirror_repaint": _on_made("small", "SELECT gid, CASE y.i WHEN 0 THEN r ELSE 2 * h - 1 - r END AS r, CASE x.i WHEN 0 THEN c ELSE 2 * w - 1 - c END AS c, CASE WHEN v = 1 THEN 7 ELSE v END AS v FROM g, range(2) y(i), range(2) x(i)"),
    "family_flip_tiling_repaint": _on_made("small", "SELECT gid, CASE y.i WHEN 0 THEN r ELSE 2 * h - 1 - r END AS r, CASE x.i WHEN 0 THEN c ELSE 2 * w - 1 - c END AS c, CASE WHEN v = 2 THEN 7 ELSE v END AS v FROM g, range(2) y(i), range(2) x(i)"),
    "family_kaleidoscope_frame": _on_made(
        "small",
        "SELECT gid, r, c, CASE WHEN r IN (0, 2 * h - 1) OR c IN (0, 2 * h - 1) THEN 4 ELSE v END AS v FROM (SELECT gid, h, r, c, v FROM g WHERE h = w UNION ALL SELECT gid, h, c, 2 * h - 1 - r, v FROM g WHERE h = w UNION ALL SELECT gid, h, 2 * h - 1 - c, r, v FROM g WHERE h = w UNION ALL SELECT gid, h, 2 * h - 1 - r, 2 * h - 1 - c, v FROM g WHERE h = w) UNION ALL SELECT DISTINCT gid, -1, -1, -1 FROM g WHERE h <> w",
    ),
    "family_panel_logic_zoom": _on_made("halves", "SELECT a.gid, a.r * 2 + y.i AS r, a.c * 2 + x.i AS c, CASE WHEN (a.v > 0) <> (b.v > 0) THEN 4 ELSE 0 END AS v FROM g a JOIN g b ON b.gid = a.gid AND b.r = a.r AND b.c = a.c + a.w // 2 + 1, range(2) y(i), range(2) x(i)"),
    "family_squeeze_turn": _on_made(
        "stretched",
        """SELECT gid, (max(c) OVER (PARTITION BY gid) - c) AS r, r AS c, v FROM (SELECT k.gid, y.n AS r, x.n AS c, k.v FROM g k
          JOIN (SELECT gid, r, row_number() OVER (PARTITION BY gid ORDER BY r) - 1 AS n FROM (SELECT *, lag(l) OVER (PARTITION BY gid ORDER BY r) AS b FROM (SELECT gid, r, list(v ORDER BY c) AS l FROM g GROUP BY gid, r)) WHERE b IS NULL OR b <> l) y ON y.gid = k.gid AND y.r = k.r
          JOIN (SELECT gid, c, row_number() OVER (PARTITION BY gid ORDER BY c) - 1 AS n FROM (SELECT *, lag(l) OVER (PARTITION BY gid ORDER BY c) AS b FROM (SELECT gid, c, list(v ORDER BY r) AS l FROM g GROUP BY gid, c)) WHERE b IS NULL OR b <> l) x ON x.gid = k.gid AND x.c = k.c)""",
    ),
    "family_sorted_bars_repaint": _on_made("bars", "SELECT g.gid, g.r, p.n AS c, CASE WHEN g.v > 0 THEN 4 ELSE 0 END AS v FROM g JOIN (SELECT gid, c, row_number() OVER (PARTITION BY gid ORDER BY count(*) FILTER (v > 0), c) - 1 AS n FROM g GROUP BY gid, c) p ON p.gid = g.gid AND p.c = g.c"),
    "family_crossing_lines": _on_made(
        "few",
        "SELECT gid, r, c, CASE WHEN a = 0 AND bool_or(a = 2) OVER (PARTITION BY gid, c) THEN 2 ELSE a END AS v FROM (SELECT *, CASE WHEN v = 0 AND bool_or(v = 1) OVER (PARTITION BY gid, r) THEN 1 ELSE v END AS a FROM g)",
    ),
}
