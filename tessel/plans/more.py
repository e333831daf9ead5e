"""Queries for the relation dialect and the generators, over grids and seeds from ``lineitem``, with DuckDB SQL for most."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.operators import OPERATORS
from tessel.operators.dialect import RELATIONS
from tessel.plans.queries import _BASE
from tessel.sources import placements  # noqa: F401  (adds its kinds to GENERATORS)
from tessel.sources.generators import COLORS, GENERATORS, PRIME, generate
from tessel.sources.grids import FEW_ORDERS, ORDERS, from_lineitem, to_cells


def _relation(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        grids = OPERATORS["remove_color"](from_lineitem(spark, sf_dir, FEW_ORDERS), color=2)
        return to_cells(RELATIONS[name](grids, source=3, target=1))

    return run


def _generated(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.floor(F.col("l_orderkey") / ORDERS).alias("gid")).distinct()
        return to_cells(generate(orders, name))

    return run


QUERIES = {f"relation_{n}": _relation(n) for n in RELATIONS} | {f"generate_{n}": _generated(n) for n in GENERATORS}

FEW_BASE = _BASE.replace(f"// {ORDERS}", f"// {FEW_ORDERS}")
_SMALL = f"""WITH RECURSIVE {FEW_BASE}, g0 AS (SELECT gid, r, c, CASE WHEN v = 2 THEN 0 ELSE v END AS v FROM cells),
  bgs AS (SELECT gid, v AS bg FROM (SELECT gid, v, row_number() OVER (PARTITION BY gid ORDER BY sum((r IN (0, 11))::INT + (c IN (0, 11))::INT) DESC, v) AS k FROM g0 GROUP BY gid, v) WHERE k = 1),
  g AS (SELECT g0.*, bg FROM g0 JOIN bgs USING (gid)),
  box AS (SELECT gid, min(r) r0, max(r) r1, min(c) c0, max(c) c1 FROM g WHERE v = 3 GROUP BY gid), ctx AS (SELECT DISTINCT gid FROM g WHERE v = 1),
  fine AS (SELECT gid FROM box), both_in AS (SELECT gid FROM box JOIN ctx USING (gid))"""


def _sql(value: str, good: str) -> str:
    """Every cell's value from its own (v) and its grid's source box; grids outside ``good`` are refused."""
    out = f"SELECT g.gid, g.r, g.c, {value} AS v FROM g JOIN box USING (gid) WHERE gid IN (SELECT gid FROM {good})"
    return f"{_SMALL} SELECT gid::BIGINT AS gid, r::INT AS r, c::INT AS c, v::INT AS v FROM ({out} UNION ALL SELECT gid, -1, -1, -1 FROM ids WHERE gid NOT IN (SELECT gid FROM {good}))"


_INSIDE = "r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1"


def _placed(ctes: str, erase: bool = True) -> str:
    """The source's cells put where dst (gid, r, c) says; grids where something else is, or nothing, are refused."""
    return f"""{_SMALL}, {ctes}, bad AS (SELECT gid FROM ids WHERE gid NOT IN (SELECT gid FROM dst) UNION SELECT d.gid FROM dst d LEFT JOIN g USING (gid, r, c) WHERE g.v IS NULL OR g.v NOT IN (g.bg, 3))
      SELECT g.gid::BIGINT AS gid, g.r::INT AS r, g.c::INT AS c, (CASE WHEN d.gid IS NOT NULL THEN 3 WHEN g.v = 3 AND {erase} THEN g.bg ELSE g.v END)::INT AS v FROM g LEFT JOIN dst d USING (gid, r, c) WHERE g.gid NOT IN (SELECT gid FROM bad)
      UNION ALL SELECT gid, -1, -1, -1 FROM bad"""


def _by(step: str, erase: bool = True) -> str:
    return _placed(f"{step}, dst AS (SELECT g.gid, g.r + m.dr AS r, g.c + m.dc AS c FROM g JOIN m USING (gid) WHERE g.v = 3)", erase)


def _toward(sign: int) -> str:
    return f"""far AS (SELECT gid, avg(r) FILTER (v = 1) - avg(r) FILTER (v = 3) AS dy, avg(c) FILTER (v = 1) - avg(c) FILTER (v = 3) AS dx FROM g GROUP BY gid),
  way AS (SELECT gid, CASE WHEN abs(dy) >= abs(dx) THEN CASE WHEN dy > 0 THEN {sign} ELSE {-sign} END ELSE 0 END AS dr, CASE WHEN abs(dy) >= abs(dx) THEN 0 WHEN dx > 0 THEN {sign} ELSE {-sign} END AS dc FROM far WHERE dy IS NOT NULL)"""


def _until(sign: int, touch: str) -> str:
    return f"""{_toward(sign)}, tries AS (SELECT s.gid, n.i AS n, bool_or(f.v IS NULL OR f.v = 1) OR {touch} AS stop FROM g s JOIN way USING (gid) CROSS JOIN range(25) n(i)
    LEFT JOIN g f ON f.gid = s.gid AND f.r = s.r + (n.i + 1) * way.dr AND f.c = s.c + (n.i + 1) * way.dc
    LEFT JOIN g t ON t.gid = s.gid AND t.v = 1 AND abs(t.r - s.r - n.i * way.dr) + abs(t.c - s.c - n.i * way.dc) = 1 WHERE s.v = 3 GROUP BY s.gid, n.i),
  m AS (SELECT gid, dr * coalesce(n, 24) AS dr, dc * coalesce(n, 24) AS dc FROM way LEFT JOIN (SELECT gid, min(n) AS n FROM tries WHERE stop GROUP BY gid) USING (gid))"""


def _round(r: str, c: str) -> str:
    """The source turned in its box: from its place y, z in a box of h x w."""
    return _placed(f"dst AS (SELECT gid, r0 + {r} AS r, c0 + {c} AS c FROM (SELECT gid, r0, c0, r - r0 AS y, c - c0 AS z, r1 - r0 + 1 AS h, c1 - c0 + 1 AS w FROM g JOIN box USING (gid) WHERE v = 3))")


def _draw(salt: int, r: str = "0", c: str = "0") -> str:
    x = f"((gid * 7919 + ({r}) * 104729 + ({c}) * 1299709 + {salt * 15_485_863}) % {PRIME})"
    for add in (12_345, 67_891):
        x = f"(({x} * {x} + {x} * 31 + {add}) % {PRIME})"
    return x


def _chance(p: float, salt: int, r: str = "0", c: str = "0") -> str:
    return f"({_draw(salt, r, c)} < {int(p * PRIME)})"


def _pick(low: int, high: int, salt: int, r: str = "0", c: str = "0") -> str:
    return f"({low} + {_draw(salt, r, c)} % {high - low + 1})"


def _color(salt: int, r: str = "0", c: str = "0") -> str:
    return _pick(1, COLORS, salt, r, c)


def _made(h: str, w: str, value: str, names: str = "") -> str:
    """Cells of generated grids; ``names``: further columns of each seed."""
    seeds = f"SELECT *, {h} AS h, {w} AS w FROM (SELECT gid{names} FROM (SELECT DISTINCT l_orderkey // {ORDERS} AS gid FROM lineitem))"
    return f"SELECT gid::BIGINT AS gid, r::INT AS r, c::INT AS c, ({value})::INT AS v FROM (SELECT *, unnest(range(w)) AS c FROM (SELECT *, unnest(range(h)) AS r FROM ({seeds})))"


def _noisy(p: float) -> str:
    return f"CASE WHEN {_chance(p, 10, 'r', 'c')} THEN {_color(11, 'r', 'c')} ELSE 0 END"


ORACLE_SQL = {
    "relation_identity": f"{_SMALL} SELECT gid::BIGINT AS gid, r, c, v::INT AS v FROM g",
    "relation_move_toward": _by(f"{_toward(1)}, m AS (SELECT * FROM way)"),
    "relation_move_away": _by(f"{_toward(-1)}, m AS (SELECT * FROM way)"),
    "relation_copy_toward": _by(f"{_toward(1)}, m AS (SELECT * FROM way)", False),
    "relation_align_row": _by("m AS (SELECT gid, min(r) FILTER (v = 1) - min(r) FILTER (v = 3) AS dr, 0 AS dc FROM g GROUP BY gid HAVING dr IS NOT NULL)"),
    "relation_align_column": _by("m AS (SELECT gid, 0 AS dr, min(c) FILTER (v = 1) - min(c) FILTER (v = 3) AS dc FROM g GROUP BY gid HAVING dc IS NOT NULL)"),
    "relation_move_until_touch": _by(_until(1, "bool_or(t.gid IS NOT NULL)")),
    "relation_move_away_until_border": _by(_until(-1, "false")),
    "relation_rotate90": _round("w - 1 - z", "y"),
    "relation_rotate180": _round("h - 1 - y", "w - 1 - z"),
    "relation_reflect_left_right": _round("y", "w - 1 - z"),
    "relation_reflect_up_down": _round("h - 1 - y", "z"),
    "relation_fill_holes": f"""{_SMALL}, room AS (SELECT g.*, r IN (r0, r1) OR c IN (c0, c1) AS edge FROM g JOIN box USING (gid) WHERE {_INSIDE} AND v <> 3),
      open(gid, r, c) AS (SELECT gid, r, c FROM room WHERE edge UNION SELECT n.gid, n.r, n.c FROM open o JOIN room n ON n.gid = o.gid AND abs(n.r - o.r) + abs(n.c - o.c) = 1)
      SELECT gid::BIGINT AS gid, r::INT AS r, c::INT AS c, (CASE WHEN (gid, r, c) IN (SELECT gid, r, c FROM room) AND (gid, r, c) NOT IN (SELECT gid, r, c FROM open) THEN 3 ELSE v END)::INT AS v FROM g WHERE gid IN (SELECT gid FROM fine)
      UNION ALL SELECT gid, -1, -1, -1 FROM ids WHERE gid NOT IN (SELECT gid FROM fine)""",
    "relation_connect_source_to_context": f"""{_SMALL}, p AS (SELECT a.gid, a.r, a.c, b.r AS tr, b.c AS tc FROM g a JOIN g b ON b.gid = a.gid AND a.v = 3 AND b.v = 1 QUALIFY row_number() OVER (PARTITION BY a.gid ORDER BY abs(a.r - b.r) + abs(a.c - b.c), a.r, a.c, b.r, b.c) = 1)
      SELECT g.gid::BIGINT AS gid, g.r::INT AS r, g.c::INT AS c, (CASE WHEN (g.r, g.c) NOT IN ((p.r, p.c), (p.tr, p.tc)) AND (g.c = p.c AND g.r BETWEEN least(p.r, p.tr) AND greatest(p.r, p.tr) OR g.r = p.tr AND g.c BETWEEN least(p.c, p.tc) AND greatest(p.c, p.tc)) THEN 3 ELSE g.v END)::INT AS v
      FROM g JOIN p USING (gid) UNION ALL SELECT gid, -1, -1, -1 FROM ids WHERE gid NOT IN (SELECT gid FROM p)""",
    "relation_recolor_as_context": _sql("CASE WHEN v = 3 THEN 1 ELSE v END", "both_in"),
    "relation_swap_source_context_colors": _sql("CASE v WHEN 3 THEN 1 WHEN 1 THEN 3 ELSE v END", "both_in"),
    "relation_delete_source": _sql("CASE WHEN v = 3 THEN bg ELSE v END", "fine"),
    "relation_fill_bbox": _sql(f"CASE WHEN {_INSIDE} THEN 3 ELSE v END", "fine"),
    "relation_outline_bbox": _sql(f"CASE WHEN {_INSIDE} AND (r IN (r0, r1) OR c IN (c0, c1)) THEN 3 WHEN v = 3 THEN bg ELSE v END", "fine"),
    "generate_sparse": _made(_pick(5, 12, 1), _pick(5, 12, 2), _noisy(0.13)),
    "generate_noise": _made(_pick(5, 12, 1), _pick(5, 12, 2), _noisy(0.5)),
    "generate_odd": _made(f"2 * {_pick(2, 6, 1)} + 1", f"2 * {_pick(2, 6, 2)} + 1", _noisy(0.35)),
    "generate_blocky": _made(f"2 * {_pick(2, 6, 1)}", f"2 * {_pick(2, 6, 2)}", f"CASE WHEN {_chance(0.5, 10, 'r // 2', 'c // 2')} THEN {_color(11, 'r // 2', 'c // 2')} ELSE 0 END"),
    "generate_bars": _made(_pick(5, 12, 1), _pick(5, 12, 2), f"CASE WHEN r >= h - {_draw(10, '0', 'c')} % (h + 1) THEN CASE WHEN {_chance(0.8, 11, '0', 'c')} THEN {_color(12)} ELSE {_color(13, '0', 'c')} END ELSE 0 END"),
    "generate_small": f"SELECT gid, r, c, CASE WHEN r = 0 AND c = 0 AND max(v) OVER (PARTITION BY gid) = 0 THEN ({_color(3)})::INT ELSE v END AS v FROM ({_made(_pick(2, 5, 1), _pick(2, 5, 2), _noisy(0.55))})",
    "generate_blocky_noise": _made(f"2 * {_pick(2, 6, 1)}", f"2 * {_pick(2, 6, 2)}", f"CASE WHEN {_chance(0.1, 20, 'r', 'c')} THEN {_color(21, 'r', 'c')} WHEN {_chance(0.5, 10, 'r // 2', 'c // 2')} THEN {_color(11, 'r // 2', 'c // 2')} ELSE 0 END"),
    "generate_few": f"""WITH dots AS (SELECT gid, r, c, arg_max(v, k) AS v FROM (SELECT gid, k, {_draw(4, 'k')} % h AS r, {_draw(5, 'k')} % w AS c, {_color(6, 'k')} AS v FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM (SELECT gid, {_pick(5, 12, 1)} AS h, {_pick(5, 12, 2)} AS w, {_pick(2, 6, 3)} AS n FROM (SELECT DISTINCT l_orderkey // {ORDERS} AS gid FROM lineitem)))) GROUP BY ALL)
      SELECT g.gid, g.r, g.c, coalesce(d.v, 0)::INT AS v FROM ({_made(_pick(5, 12, 1), _pick(5, 12, 2), "0")}) g LEFT JOIN dots d ON d.gid = g.gid AND d.r = g.r AND d.c = g.c""",
    "generate_gridded": _made(
        f"{_pick(1, 3, 4)} * (ch + 1) - 1", f"{_pick(2, 3, 5)} * (cw + 1) - 1", f"CASE WHEN r % (ch + 1) = ch OR c % (cw + 1) = cw THEN {_color(1)} WHEN {_chance(0.4, 10, 'r', 'c')} THEN ({_color(1)} - 1 + {_pick(1, COLORS - 1, 11, 'r', 'c')}) % {COLORS} + 1 ELSE 0 END", f", {_pick(2, 4, 2)} AS ch, {_pick(2, 4, 3)} AS cw"
    ),
    "generate_stretched": f"""WITH s AS (SELECT gid, unnest(range(n)) AS i, salt FROM (SELECT gid, {_pick(2, 5, 1)} AS n, 3 AS salt FROM (SELECT DISTINCT l_orderkey // {ORDERS} AS gid FROM lineitem) UNION ALL SELECT gid, {_pick(2, 5, 2)}, 4 FROM (SELECT DISTINCT l_orderkey // {ORDERS} AS gid FROM lineitem))),
      e AS (SELECT gid, salt, i, row_number() OVER (PARTITION BY gid, salt ORDER BY i) - 1 AS at FROM (SELECT gid, salt, i, unnest(range(CASE salt WHEN 3 THEN {_pick(1, 3, 3, 'i')} ELSE {_pick(1, 3, 4, 'i')} END)) FROM s))
      SELECT a.gid::BIGINT AS gid, a.at::INT AS r, b.at::INT AS c, (SELECT CASE WHEN {_chance(0.7, 10, 'r', 'c')} THEN {_color(11, 'r', 'c')} ELSE 0 END FROM (SELECT a.gid AS gid, a.i AS r, b.i AS c))::INT AS v FROM e a JOIN e b ON a.gid = b.gid AND a.salt = 3 AND b.salt = 4""",
    "generate_halves": _made(_pick(3, 8, 2), f"2 * {_pick(3, 7, 1)} + 1", f"CASE WHEN c = w // 2 THEN {_color(5)} WHEN {_chance(0.5, 10, 'r', 'c')} THEN CASE WHEN c < w // 2 THEN {_color(3)} ELSE {_color(4)} END ELSE 0 END"),
    "generate_parts": _made(f"2 * {_pick(2, 6, 1)}", f"2 * {_pick(2, 6, 2)}", f"CASE WHEN {_chance(0.4, 10, 'r', 'c')} THEN ({_color(3)} - 1 + CASE WHEN r >= h // 2 THEN 2 ELSE 0 END + CASE WHEN c >= w // 2 THEN 1 ELSE 0 END) % {COLORS} + 1 ELSE 0 END"),
    "generate_periodic": _made(f"y * {_pick(2, 4, 3)}", f"x * {_pick(2, 4, 4)}", f"CASE WHEN (r % y = 0 AND c % x = 0) OR {_chance(0.8, 10, 'r % y', 'c % x')} THEN {_color(11, 'r % y', 'c % x')} ELSE 0 END", f", {_pick(1, 4, 1)} AS y, {_pick(1, 4, 2)} AS x"),
}
