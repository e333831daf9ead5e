"""The relation dialect on small grids, and the rules that generated grids must keep."""

import pytest

from tessel.operators.dialect import RELATIONS
from tessel.sources.generators import GENERATORS, generate
from tessel.sources.grids import from_text
from tests.test_operators import shown

CASES = [
    ("identity", "12", "12"),
    ("recolor_as_context", "0000 0102 0000", "0000 0202 0000"),
    ("swap_source_context_colors", "0000 0102 0000", "0000 0201 0000"),
    ("delete_source", "0000 0102 0000", "0000 0002 0000"),
    ("fill_bbox", "00000 01010 00000 01010 00000", "00000 01110 01110 01110 00000"),
    ("outline_bbox", "00000 01010 00100 01010 00000", "00000 01110 01010 01110 00000"),
    ("fill_holes", "00000 01110 01010 01110 00002", "00000 01110 01110 01110 00002"),
    ("rotate90", "0000 0110 0000 0002", "0000 0100 0100 0002"),
    ("rotate90", "0000 0000 0002 0110", None),
    ("rotate180", "00000 01100 01000 00000 00002", "00000 00100 01100 00000 00002"),
    ("reflect_left_right", "00000 01100 01000 00000 00002", "00000 01100 00100 00000 00002"),
    ("reflect_up_down", "00000 01100 01000 00000 00002", "00000 01000 01100 00000 00002"),
    ("move_toward", "00000 01002 00000", "00000 00102 00000"),
    ("move_away", "00000 01002 00000", "00000 10002 00000"),
    ("move_away", "00000 10020 00000", None),
    ("copy_toward", "00000 01002 00000", "00000 01102 00000"),
    ("move_until_touch", "000000 010020 000000", "000000 000120 000000"),
    ("move_away_until_border", "000000 001020 000000", "000000 100020 000000"),
    ("align_row", "0000 0100 0000 0002", "0000 0000 0000 0102"),
    ("align_column", "0000 0100 0000 0002", "0000 0001 0000 0002"),
    ("connect_source_to_context", "0000 0100 0000 0002", "0000 0100 0100 0112"),
]


@pytest.mark.parametrize("name", sorted(RELATIONS))
def test_relations(spark, name):
    own = [(given, wanted) for n, given, wanted in CASES if n == name]
    assert own
    rows = RELATIONS[name](from_text(spark, [(i, given) for i, (given, _) in enumerate(own)]), source=1, target=2).collect()
    assert {r["gid"]: shown(r["g"]) for r in rows} == {i: wanted for i, (_, wanted) in enumerate(own)}


@pytest.mark.parametrize("name", sorted(GENERATORS))
def test_generators(spark, name):
    seeds = spark.range(60).withColumnRenamed("id", "gid")
    grids = {r["gid"]: r["g"] for r in generate(seeds, name).collect()}
    assert grids == {r["gid"]: r["g"] for r in generate(seeds.repartition(3), name).collect()}
    assert len({str(g) for g in grids.values()}) > 40
    for g in grids.values():
        assert 1 <= len(g) <= 30 and len({len(row) for row in g}) == 1 and 1 <= len(g[0]) <= 30
        assert all(0 <= v <= 3 for row in g for v in row)
        if name == "odd":
            assert len(g) % 2 and len(g[0]) % 2
        if name == "small":
            assert any(v for row in g for v in row)
