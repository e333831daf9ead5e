"""Object steps, layer operations, search steps and panel programs on small grids whose results were worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tessel.operators import panels
from tessel.operators.steps import LAYER_STEPS, OBJECT_STEPS, SEARCH_STEPS

BANKS = {"object": OBJECT_STEPS, "layer": LAYER_STEPS, "search": SEARCH_STEPS}
EQUAL = {"split": "equal", "axis": 1, "count": 2}
CUT = {"split": "separator", "axis": 0, "count": 2, "color": 5}

#: Bank, step, parameters, grid, result (None: refused).
CASES = [
    ("object", "keep_selected", {"selector": "largest"}, "0000 0110 0002", "0000 0110 0000"),
    ("object", "delete_selected", {"selector": "interior"}, "3333 3103 3003 3233", "3333 3333 3333 3233"),
    ("object", "keep_selected", {"selector": "unique_shape"}, "00000 01100 00000 01010 00010", "00000 00000 00000 01000 00000"),
    ("object", "keep_selected", {"selector": "repeated_shape"}, "00000 01100 00000 01010 00010", "00000 01100 00000 00010 00010"),
    ("object", "recolor_selected", {"selector": "has_hole", "target": 6}, "00000 01110 01010 01110 00000", "00000 06660 06060 06660 00000"),
    ("object", "crop_selected", {"selector": "rightmost"}, "0000 0110 0020 0000", "11 02"),
    ("object", "fill_selected_bbox", {"selector": "all"}, "0000 0100 0110 0000", "0000 0110 0110 0000"),
    ("object", "outline_selected_bbox", {"selector": "all"}, "00000 01110 01110 00110 00000", "00000 01110 01010 01110 00000"),
    ("object", "transform_selected", {"transform": 1}, "00000 01110 01000 00000 00000", "00000 01000 01000 01100 00000"),
    ("object", "transform_selected", {"transform": 1}, "00000 01110 00000 02000 00000", "00000 01000 01000 02000 00000"),
    ("object", "transform_selected", {"transform": 1, "source": 1}, "00000 01110 00000 02000 00000", None),
    ("object", "transform_selected", {"transform": 4, "source": 1}, "0000 0110 0100 0000", "0000 0110 0010 0000"),
    ("object", "gravity_selected", {"direction": "down", "source": 1}, "0000 0101 0000 0002", "0000 0000 0101 0002"),
    ("object", "keep_selected", {"source": 7}, "000 010 000", None),
    ("layer", "gravity_objects", {"direction": "down"}, "0000 0110 0200 0000 0000", "0000 0000 0000 0110 0200"),
    ("layer", "gravity_objects", {"direction": "left"}, "00000 00120 00000", "00000 12000 00000"),
    ("layer", "gravity_objects", {"direction": "up", "source": 2}, "00000 01000 02000 00200 00000", "00200 01000 02000 00000 00000"),
    ("layer", "conditional_line_gravity", {"source": 3, "marker": 1, "direction": "down"}, "00000 03030 00010 00000 02020 00000", "00000 00000 00030 00010 02020 03000"),
    ("layer", "connect_layer", {"source": 3, "axis": "rows"}, "000000 030030 032030 000000", "000000 033330 032030 000000"),
    ("layer", "extend_rays", {"source": 3, "direction": "right"}, "00000 03000 03020 00000", "00000 03333 03320 00000"),
    ("layer", "complete_symmetry", {"source": 3, "axis": "left_right"}, "0000 3000 0300 0000", "0000 3003 0330 0000"),
    ("layer", "complete_symmetry", {"source": 3, "axis": "up_down"}, "0000 3000 0000 2000 0000", None),
    ("layer", "complete_symmetry", {"source": 3, "axis": "diagonal", "frame": "bbox"}, "00000 03330 00000 00030 00000", "00000 03330 03000 03030 00000"),
    ("layer", "repeat_objects", {"source": 3, "axis": "horizontal", "scope": "forward"}, "0000000 0303000 0000000", "0000000 0303030 0000000"),
    ("layer", "repeat_objects", {"source": 3, "axis": "horizontal", "scope": "both"}, "0000000 0003030 0000000", "0000000 0303030 0000000"),
    ("layer", "repeat_objects", {"source": 3, "axis": "horizontal"}, "0000000 0303020 0000000", None),
    ("layer", "stamp_markers", {"source": 3, "marker": 1}, "000000 033000 030010 000000", "000000 033000 030033 000030"),
    ("layer", "stamp_markers", {"source": 3, "marker": 1, "anchor": "center", "paint": "marker", "keep_template": False}, "00000 33300 00000 00010 00000", "00000 00000 00000 00111 00000"),
    ("layer", "panel_boolean", {"axis": 1, "mode": "xor", "target": 8}, "01500 00510", "08 80"),
    ("layer", "panel_boolean", {"axis": 1, "mode": "xor", "target": 8}, "01500 00310", None),
    ("layer", "follow_marker_path", {}, "00000000 01000000 01100010 01000000 00000000 00000010 00000000", "00000000 00000000 00000000 00000000 00000111 00000010 00000000"),
    ("layer", "follow_marker_path", {}, "00000000 01000000 01101000 01000000 00000000", "00000000 00010000 00011000 00010000 00000000"),
    ("layer", "follow_marker_path", {}, "00000000 00000010 01000000 01100010 01000000 00000010 00000000", None),  # markers on both sides
    ("layer", "follow_marker_path", {}, "00000000 21000000 01101000 01000000 00000000", None),  # a third colour
    ("layer", "follow_marker_path", {}, "0000000 0100000 0110100 0100000 5555555 0000000 0100000 0110100 0100000", "0000000 0001000 0001100 0001000"),  # two panels alike
    ("layer", "follow_marker_path", {}, "0000000 0100000 0110100 0100000 5555555 0000000 0100000 0110010 0100000", None),
    ("layer", "fill_enclosures", {"target": 4}, "00000 02110 01010 01110 00000", "00000 02110 01410 01110 00000"),
    ("layer", "crop_foreground", {}, "3333 3013 3333", "01"),
    ("search", "rotate_grid", {"turns": 1}, "123 456", "36 25 14"),
    ("search", "reflect_grid", {"axis": "rows"}, "123 456", "456 123"),
    ("search", "translate_layer", {"source": 1, "dr": 0, "dc": 1}, "0000 0110 0000", "0000 0011 0000"),
    ("search", "translate_layer", {"source": 1, "dr": 0, "dc": 2}, "0000 0110 0000", None),
    ("search", "copy_layer", {"source": 1, "dr": 1, "dc": 0}, "0000 0110 0000", "0000 0110 0110"),
    ("search", "align_layers", {"source": 1, "target": 2, "axis": 0, "anchor": "min"}, "000000 010000 010020 000020", "000000 000000 010020 010020"),
    ("search", "align_layers", {"source": 1, "target": 2, "axis": 0, "anchor": "center"}, "00000 01000 01020 00000 00000", None),
    ("search", "move_layer_until_touch", {"source": 1, "target": 2, "direction": "right"}, "000000 010020 000000", "000000 000120 000000"),
    ("search", "move_layer_until_touch", {"source": 1, "target": 2, "direction": "left"}, "000000 010020 000000", None),
    ("search", "swap_layers", {"source": 1, "target": 2}, "0000 0120 0000", "0000 0210 0000"),
    ("search", "recolor_layer", {"source": 0, "target": 2}, "0000 0120 0000", None),
    ("search", "fill_layer_holes", {"source": 1}, "00000 01110 01010 01010 01110 00000", "00000 01110 01110 01110 01110 00000"),
    ("search", "keep_objects", {"selector": "unique_shape"}, "000000 011010 000010 000000", "000000 011010 000010 000000"),
    ("search", "crop_objects", {"selector": "smallest"}, "0000 0110 0002", "2"),
    ("search", "fill_object_boxes", {"selector": "largest"}, "0000 0120 0110 0000", None),
    ("search", "fill_object_boxes", {"selector": "largest"}, "0000 0100 0110 0000", "0000 0110 0110 0000"),
    ("search", "outline_object_boxes", {}, "000000 011100 012100 011100 000000", "000000 011100 012100 011100 000000"),
    ("search", "outline_object_boxes", {"source": 1}, "000000 011100 012100 011100 000000", "000000 011100 012100 011100 000000"),
    ("search", "scale_pixels", {"rows": 1, "columns": 3}, "12", "111222"),
    ("search", "reduce_blocks", {"rows": 1, "columns": 3}, "111222", "12"),
    ("search", "reduce_blocks", {"rows": 1, "columns": 2}, "111222", None),
    ("search", "tile_grid", {"rows": 2, "columns": 1}, "12", "12 12"),
    ("search", "mirror_tile", {"rows": 1, "columns": 3}, "12", "122112"),
    ("search", "trim_uniform_border", {}, "44444 44444 44124 44344 44444", "444 412 434"),
    ("search", "select_panel", {"partition": CUT, "index": 1}, "12 55 34", "34"),
    ("search", "select_panel", {"partition": CUT, "index": 1}, "12 55 34 34", None),
    ("search", "panel_logic", {"partition": EQUAL, "mode": "nor", "backgrounds": [0, 0], "paint": 7, "output_bg": 0}, "1002 0000", "00 77"),
    ("search", "panel_overlay", {"partition": EQUAL, "order": [0, 1], "backgrounds": [0, 0], "output_bg": 9}, "1012 0020", "12 29"),
]


def grid(text):
    return [[int(v) for v in row] for row in text.split()]


@pytest.fixture(scope="module")
def results(spark):
    """All cases of one step and its parameters in one query."""
    out = {}
    for i, (bank, step, given, given_grid, _) in enumerate(CASES):
        g = grid(given_grid)
        frame = spark.createDataFrame([(i, g, len(g), len(g[0]), None)], "gid long, g array<array<int>>, h int, w int, err string")
        rows = BANKS[bank][step](frame, **given).select("gid", "g", "err")
        out[i] = rows
    merged = None
    for rows in out.values():
        merged = rows if merged is None else merged.union(rows)
    return {r["gid"]: (r["g"], r["err"]) for r in merged.collect()}


@pytest.mark.parametrize("i", range(len(CASES)), ids=[f"{i}-{c[1]}" for i, c in enumerate(CASES)])
def test_case(results, i):
    wanted = CASES[i][4]
    got, err = results[i]
    assert got == (None if wanted is None else grid(wanted)) and (err is None) == (wanted is not None)


def test_panel_programs_are_fitted(spark):
    halves = ["0110", "1010", "0011"]  # two panels beside each other
    pairs = [(1, [grid(t)[0]], [[int(a != "0" and b != "0") * 8 for a, b in zip(t[:2], t[2:])]]) for t in halves]
    pairs += [(2, grid("12 55 30"), grid("32")), (2, grid("01 55 20"), grid("21"))]
    pairs += [(3, grid("10"), grid("1")), (3, grid("10"), grid("0"))]
    frame = spark.createDataFrame(pairs, "task_id long, g array<array<int>>, wanted array<array<int>>")
    found = panels.fitted(frame).collect()
    first = [r for r in found if r["task_id"] == 1 and r["split"] == "equal" and r["axis"] == 1 and r["count"] == 2]
    assert {(r["op"], r["mode"], r["paint"], r["output_bg"]) for r in first if r["background"] == 0} == {("panel_boolean", "and", 8, 0), ("panel_boolean", "nand", 0, 8)}
    second = [r for r in found if r["task_id"] == 2 and r["split"] == "separator" and r["color"] == 5]
    assert [(r["op"], r["priority"]) for r in second if r["background"] == 0] == [("panel_priority_overlay", [0, 1])]
    assert not [r for r in found if r["task_id"] == 3]
    assert panels.fitted(frame.where(F.lit(False))).count() == 0
