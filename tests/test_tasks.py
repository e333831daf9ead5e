"""Task files, programs, the stream, and the queries against DuckDB."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessel.plans import families, more, programs, queries, tables
from tessel.sources import tasks
from tessel.sources.grids import from_text, to_cells
from tessel.streaming import programs as stream

PAIR = {"input": [[1, 2], [0, 3]], "output": [[2, 1], [3, 0]]}
TASK = {"train": [PAIR, {"input": [[4]], "output": [[4]]}], "test": [{"input": [[5, 6]]}]}


def test_challenges_solutions_and_exports(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"a": TASK, "b": TASK}))
    (tmp_path / "s.json").write_text(json.dumps({"a": [[[6, 5]]]}))
    read = tasks.with_solutions(spark, tasks.read_challenges(spark, str(tmp_path / "c.json")), str(tmp_path / "s.json"))
    rows = {r["id"]: r for r in read.collect()}
    assert rows["a"]["test"][0]["output"] == [[6, 5]] and rows["b"]["test"][0]["output"] is None
    prompt = {r["id"]: r for r in tasks.prompts(read).collect()}["a"]
    assert prompt["completion"] == "65" and prompt["prompt"] == "INPUT\n12\n03\nOUTPUT\n21\n30\nINPUT\n4\nOUTPUT\n4\nINPUT\n56\nOUTPUT\n"
    explained = programs.explaining(tasks.grids(read), [[("flip", {"axis": 1})], [("flip", {"axis": 0})]])
    assert sorted((r["task_id"], r["program"]) for r in explained.collect()) == [("a", "flip(axis=1)"), ("b", "flip(axis=1)")]
    wrong = tasks.grids(read).select("idx", programs.error().alias("e")).collect()
    assert {r["idx"]: r["e"] for r in wrong} == {0: 4, 1: 0}


def test_records_are_read_tolerantly(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text(json.dumps({"id": "x", "ops": ["flip"], **TASK}) + '\n{"id": "half\n')
    assert [r["id"] for r in tasks.read_records(spark, str(tmp_path / "d.jsonl"), tolerant=True).collect()] == ["x"]


def test_parts_and_appending(spark, tmp_path):
    numbers = spark.range(20).withColumnRenamed("id", "n")
    assert [r["n"] for r in tasks.part(numbers, "n", offset=2, limit=3).orderBy("n").collect()] == [2, 3, 4]
    assert [r["n"] for r in tasks.part(numbers, "n", stride=3, shards=2, shard=1).orderBy("n").collect()] == [3, 9, 15]
    path = str(tmp_path / "out")
    tasks.append_new(numbers.where("n < 5"), path, "n")
    tasks.append_new(numbers.where("n < 8"), path, "n")
    assert sorted(r["n"] for r in spark.read.parquet(path).collect()) == list(range(8))


def test_programs(spark):
    grids = from_text(spark, [(0, "100 000"), (1, "00")])
    steps = [("crop_to_content", {}), ("scale_up", {"k": 2})]
    got = {r["gid"]: (r["g"], r["err"]) for r in programs.run(grids, steps).collect()}
    assert got[0] == ([[1, 1], [1, 1]], None) and got[1][0] is None and got[1][1]
    assert programs.trace(grids, steps).count() == 6
    assert programs.text([("recolor_objects", {"sel": {"by": "color", "value": 2}, "seg": "c8", "color": 7}), ("tile", {"ny": 1, "nx": 2})]) == "recolor_objects(sel=color(2), seg=c8, color=7) | tile(ny=1, nx=2)"


def test_stream(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(2):
        from_text(spark, [(k, "12 34")]).coalesce(1).write.mode("append").parquet(source)
        stream.start(spark, source, sink, str(tmp_path / "state"), [("flip", {"axis": 0})]).awaitTermination()
    wanted = to_cells(from_text(spark, [(0, "34 12"), (1, "34 12")]))
    assert sorted(spark.read.parquet(sink).drop("batch").collect()) == sorted(wanted.collect())


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for file in os.listdir("/root/testdata/sf0.001"):
        connection.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '/root/testdata/sf0.001/{file}'")
    return connection


@pytest.mark.parametrize("name", ["grid_half_logic", "grid_rot90", "grid_crop_to_object", "grid_fill_holes", "grid_select_cell", "grid_majority_filter", "relation_fill_bbox", "generate_bars", "generate_periodic", *tables.ORACLE_SQL])
def test_against_duckdb(spark, database, name):
    got = entry.queries()[name](spark, "/root/testdata/sf0.001")
    columns = sorted(got.columns)
    wanted = database.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, wanted))


def test_every_operator_has_a_query():
    from tessel.operators import OPERATORS

    assert {f"grid_{name}" for name in OPERATORS} == set(queries.QUERIES)


def test_flagship(spark):
    assert entry.entry(spark).where(F.col("v") > 0).count() > 0


def test_families(spark):
    assert len(families.FAMILIES) == 33 and len(more.QUERIES) == 52
    for name in ("isolate_crop_frame", "panels_to_pixels", "motif_zoom", "rank_and_fall"):
        rows = families.QUERIES[f"family_{name}"](spark, "/root/testdata/sf0.001")
        assert rows.where("v > 0").count() > 0
