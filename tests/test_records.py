"""Augmentation keys, writers, side-by-side texts, and roles of layers against plain versions."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.plans import analytics, augment, programs, records
from tessel.plans.tables import _read
from tessel.sources import tasks
from tessel.sources.grids import from_lineitem, from_text
from tests.test_labels import plain

SF = "/root/testdata/sf0.001"


def changed(grid, key):
    """By numpy."""
    g = np.array(grid)
    for step in key.split(".")[1:]:
        if step == "rot90":
            g = np.rot90(g)
        elif step == "transpose":
            g = g.T
        elif step.startswith("permute"):
            g = np.array([int(c) for c in step[7:]])[g]
    return g.tolist()


def test_long_keys_stay_one_pass(spark):
    """Each turn used to name the grid twice, once of them for every column: the work grew with a power of the turns."""
    turns = ["rot90", "transpose", "rot90", "permute1203456789", "rot90"] * 5
    key, want = ".".join(["base", *turns]), np.arange(6).reshape(2, 3)
    for step in turns:
        want = {"r": lambda g: np.rot90(g), "t": lambda g: g.T, "p": lambda g: np.array([1, 2, 0, 3, 4, 5])[g]}[step[0]](want)
    made = from_text(spark, [(0, "012 345")]).select("g", augment.forward(F.col("g"), key).alias("there"))
    row = made.withColumn("back", augment.inverse(F.col("there"), key)).first()
    assert row.there == want.tolist() and row.back == row.g


@pytest.mark.parametrize("key", [*augment.TURNS, "a.permute9876543210", "a.rot90.permute1203456789.transpose.rot90.copy2", "a"])
def test_augmentation_and_back(spark, key):
    grids = from_text(spark, [(0, "123 456"), (1, "90"), (2, "1 2 3")])
    rows = grids.select("g", augment.forward(F.col("g"), key).alias("there")).withColumn("back", augment.inverse(F.col("there"), key)).collect()
    for r in rows:
        assert r["there"] == changed(r["g"], key) and r["back"] == r["g"]


def test_order_of_examples(spark):
    frame = spark.createDataFrame([(["a", "b", "c"],)], "train array<string>")
    assert frame.select(augment.ordered(F.col("train"), "x.rot90.ex201")).first()[0] == ["c", "a", "b"]
    assert frame.select(augment.ordered(F.col("train"), "x.ex1-12")).first()[0] == ["b"]
    with pytest.raises(ValueError):
        augment.forward(F.col("g"), "x.permute0123")
    with pytest.raises(ValueError):
        augment.forward(F.col("g"), "x.shake")


def test_layer_roles(spark):
    wanted = set()
    for row in from_lineitem(spark, SF).collect():
        labels, holes = plain(row["g"], "c4")
        layers = {}
        for k in range(1, max(map(max, labels)) + 1):
            cells = [(r, c) for r, line in enumerate(labels) for c, n in enumerate(line) if n == k]
            layers.setdefault(row["g"][cells[0][0]][cells[0][1]], []).append((len(cells), holes[k - 1], any(r in (0, 11) or c in (0, 11) for r, c in cells)))
        facts = {v: {"area": sum(x[0] for x in o), "components": len(o), "smallest": min(x[0] for x in o), "largest": max(x[0] for x in o), "holes": sum(x[1] for x in o), "touches": any(x[2] for x in o)} for v, o in layers.items()}
        for role, (field, way) in analytics.ROLES.items():
            best = (min if way == "min" else max)(f[field] for f in facts.values())
            own = [v for v, f in facts.items() if f[field] == best]
            wanted |= {(row["gid"], role, own[0])} if len(own) == 1 else set()
        areas = sorted({f["area"] for f in facts.values()}, reverse=True)
        wanted.add((row["gid"], "background", 0))
        tests = {"second_largest_layer": lambda f: len(facts) >= 3 and len(areas) > 1 and f["area"] == areas[1], "only_foreground": lambda f: len(facts) == 1, "has_hole": lambda f: f["holes"] > 0, "border_touching": lambda f: f["touches"], "interior_only": lambda f: not f["touches"]}
        for role, test in tests.items():
            own = [v for v, f in facts.items() if test(f)]
            wanted |= {(row["gid"], role, own[0])} if len(own) == 1 else set()
    assert {tuple(r) for r in records.layer_roles(spark, SF).collect()} == wanted


def test_writers(spark, tmp_path):
    pair = {"input": [[1]], "output": [[2]]}
    lines = [{"id": i, "train": [pair], "test": [pair], "ops": ["flip"] * n} for i, n in (("x", 1), ("y", 2))]
    (tmp_path / "in.jsonl").write_text("\n".join(map(json.dumps, lines)))
    read = tasks.read_records(spark, str(tmp_path / "in.jsonl"))
    tasks.write_records(read, str(tmp_path / "records"))
    assert sorted(r["id"] for r in tasks.read_records(spark, str(tmp_path / "records")).collect()) == ["x", "y"]
    tasks.write_tasks(read, str(tmp_path / "tasks"))
    text = "".join(p.read_text() for p in (tmp_path / "tasks" / "id=x").glob("*.txt"))
    assert json.loads(text) == {"train": [pair], "test": [pair]}
    row = tasks.stats(read, spark.createDataFrame([("flip",), ("tile",)], "op string"), 7).first()
    assert (row["tasks"], row["seed"], row["program_lengths"], row["op_counts"], row["unused_ops"]) == (2, 7, {1: 1, 2: 1}, {"flip": 3}, ["tile"])
    tried = spark.createDataFrame([("x", 1, [[3]], [[4]]), ("x", 0, [[1]], [[2]])], "id string, test int, attempt_1 array<array<int>>, attempt_2 array<array<int>>")
    tasks.write_submission(tried, str(tmp_path / "submission"))
    (line,) = [json.loads(t) for p in (tmp_path / "submission").glob("*.json") for t in p.read_text().splitlines()]
    assert line == {"id": "x", "attempts": [{"attempt_1": [[1]], "attempt_2": [[2]]}, {"attempt_1": [[3]], "attempt_2": [[4]]}]}


def test_side_by_side(spark):
    pairs = spark.createDataFrame([(1, 0, [[1, 0], [0, 2]], [[3]]), (2, 0, [[5]], None)], "task_id int, idx int, g array<array<int>>, wanted array<array<int>>")
    assert [r["text"] for r in tasks.side_by_side(pairs).orderBy("task_id").collect()][0] == "1. | 3\n.2 |  "


def test_places_need_no_single_task(spark):
    frame = spark.range(1000).select((F.col("id") * 7 % 100).alias("k"), F.col("id").alias("n"))
    for given in (frame, frame.withColumn("k", F.when(F.col("k") > 50, F.col("k"))), frame.withColumn("k", F.concat(F.lit("t"), F.col("k").cast("string"))), frame.limit(0)):
        rows = tasks.placed(given, "k").collect()
        assert sorted(r["place"] for r in rows) == list(range(len(rows)))
        inside = sorted(rows, key=lambda r: r["place"])
        key = lambda r: (r["k"] is not None, r["k"] if r["k"] is not None else 0)
        assert [key(r) for r in inside] == sorted(map(key, rows))


def test_skeletons_of_texts(spark):
    texts = ["flip(axis=1)", "flip(axis=1) | tile(ny=1, nx=2)", "flip(axis=1) | shake(x=1)", "", " | ".join(["flip(axis=0)"] * 5), "flip"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in frame.select(analytics.skeleton(F.col("t"), ["flip", "tile"])).collect()] == ["flip", "flip|tile", None, None, None, None]


def test_candidates_in_one_scan(spark):
    pairs = from_text(spark, [(0, "12 34"), (1, "56")]).select(F.col("gid").alias("task_id"), "g", "h", "w", "err", F.col("g").alias("wanted"))
    found = programs.explaining(pairs, [[("flip", {"axis": 1}), ("flip", {"axis": 1})], [("transpose", {})], [("rot90", {"k": 2}), ("rot90", {"k": 2})]])
    assert sorted((r["task_id"], r["program"]) for r in found.collect()) == sorted((t, p) for t in (0, 1) for p in ("flip(axis=1) | flip(axis=1)", "rot90(k=2) | rot90(k=2)"))
    assert _read(spark, SF, "region").count() == 5
