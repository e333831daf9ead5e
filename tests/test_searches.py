"""Search, samplers, datasets, token arrays, layer pairs and kept results against plain versions."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessel.functions.grids import Frame
from tessel.functions.labels import flood
from tessel.functions.selectors import Objects
from tessel.plans import datasets, encoding, layers, programs, samplers, search
from tessel.plans.store import Results
from tessel.sources.generators import PRIME, draw
from tessel.sources.grids import from_text

BLANK = [(0, "1020 0000 3300 0001"), (1, "0100 0200 3000 1110"), (2, "2003 2000 0010 0110"), (3, "0001 0220 0000 3000")]


def pairs_of(spark, rule, numbers=(0, 1, 2), task=0):
    grids = from_text(spark, [BLANK[k] for k in numbers])
    wanted = programs.run(grids, rule).select("gid", F.col("g").alias("wanted"))
    return grids.join(wanted, "gid").select(F.lit(task).alias("task_id"), F.col("gid").alias("idx"), "g", "wanted")


def test_a_rule_of_two_steps_is_found_from_three_pairs(spark):
    pool = samplers.pool(["recolor", "flip", "transpose"])
    both = pairs_of(spark, [("recolor", {"src": 1, "dst": 7}), ("transpose", {})]).unionByName(pairs_of(spark, [("flip", {"axis": 1})], (0, 1, 2, 3), 1)).unionByName(pairs_of(spark, [], (1, 2), 2)).unionByName(pairs_of(spark, [("draw_border", {"color": 9}), ("scale_up", {"k": 2})], (0, 1), 3))
    found = {r.task_id: r for r in search.search(both, pool, depth=2, beam=4, top=12).collect()}
    assert len(found) == 4 and not found[3].solved and found[3].error > 0
    assert (found[0].solved, found[0].level, found[0].error) == (True, 2, 0) and set(found[0].program.split(" | ")) == {"recolor(src=1, dst=7)", "transpose()"}
    assert (found[1].level, found[1].program, found[2].level, found[2].program) == (1, "flip(axis=1)", 0, "")
    assert {(r.task_id, r.program) for r in search.one_step(both, pool).collect()} == {(1, "flip(axis=1)")}


def test_steps_with_a_selector_of_their_own(spark):
    known = samplers.branches(samplers.pool(["keep_objects"], ("c8",)))
    rows = from_text(spark, [BLANK[0]] * 3).withColumn("n", F.monotonically_increasing_id()).withColumn("n", F.row_number().over(__import__("pyspark").sql.Window.orderBy("n")))
    rows = rows.withColumns({"branch": F.lit(0), "a": F.lit(None).cast("int"), "b": F.lit(None).cast("int"), "by": F.element_at(F.array(F.lit("largest"), F.lit("color"), F.lit("size_gt")), F.col("n")), "value": F.element_at(F.array(F.lit(None).cast("int"), F.lit(1), F.lit(9)), F.col("n"))})
    out = samplers.applied(rows, known).withColumn("text", samplers.step_text(known))
    got = {r.text: "".join(map(str, sum(r.g, []))) for r in out.collect()}
    assert got == {"keep_objects(sel=largest, seg=c8)": "0000000033000000", "keep_objects(sel=color(1), seg=c8)": "1000000000000001", "keep_objects(sel=size_gt(9), seg=c8)": "0" * 16}


def test_one_selector_for_each_set(spark):
    f = Frame(from_text(spark, [BLANK[0], (9, "0000 0000")]))
    found = Objects(f, "c8").enumerated()
    rows = {r.gid: [(x.by, x.value, tuple(x.picks)) for x in r.x] for r in f.df.select("gid", found.alias("x")).collect()}
    assert rows[9] == []
    sets = [picks for by, _, picks in rows[0] if by != "all"]
    assert len(sets) == len(set(sets)) and ("all", None) in [x[:2] for x in rows[0]] and rows[0][0][:2] == ("largest", None)


def test_weights_hold(spark):
    rows = spark.range(20_000).select(samplers.weighted(["a", "b", "c"], [1, 5, 4], draw(F.col("id"), 3)).alias("x"), datasets.program_length(F.col("id")).alias("n"))
    counts = {r.x: r["count"] / 20_000 for r in rows.groupBy("x").count().collect()}
    assert abs(counts["a"] - 0.1) < 0.01 and abs(counts["b"] - 0.5) < 0.02 and abs(counts["c"] - 0.4) < 0.02
    lengths = {r.n: r["count"] / 20_000 for r in rows.groupBy("n").count().collect()}
    assert all(abs(lengths[n] - p) < 0.02 for n, p in datasets.LENGTHS.items())
    edge = spark.range(1).select(samplers.weighted([1, 2], [1, 1], F.lit(PRIME - 1)).alias("hi"), samplers.weighted([1, 2], [1, 1], F.lit(0)).alias("lo")).head()
    assert (edge.lo, edge.hi) == (1, 2)


POOL = ["recolor", "flip"]


def test_tasks_for_all_indices_and_again(spark, tmp_path):
    """Every index has a task that its own program makes; a second call adds nothing; the partitioning doesn't matter."""
    choices = samplers.pool(POOL)
    indices = spark.range(6).select(F.col("id").alias("index"))
    made = datasets.generate(spark, indices, str(tmp_path / "a"), choices, most=2).collect()
    again = datasets.generate(spark, indices.repartition(3), str(tmp_path / "a"), choices, most=2).collect()
    assert sorted(map(str, made)) == sorted(map(str, again)) and sorted(r["index"] for r in made) == list(range(6)) and len({r.id for r in made}) == 6
    part = datasets.generate(spark, indices.where("index < 3").repartition(2), str(tmp_path / "b"), choices, most=2).collect()
    assert {r["index"]: r.id for r in part} == {r["index"]: r.id for r in made if r["index"] < 3}
    for r in made:
        steps = [programs_of(text) for text in r.program.split(" | ")]
        assert r.ops == [name for name, _ in steps] and all(a != b for a, b in zip(r.ops, r.ops[1:]))
        assert 2 <= len(r.train) <= 5 and 1 <= len(r.test) <= 2
        for p in [*r.train, *r.test]:
            g = np.array(p.input)
            for name, given in steps:
                g = plain_step(g, name, given)
            assert g.tolist() == p.output != p.input and g.any()


def test_later_tries_change_nothing_for_seeds_that_have_a_good_one(spark, monkeypatch):
    """Programs are the same whether all tries are made at once or later ones for the seeds without a good one alone."""
    choices = samplers.pool(POOL)
    seeds = spark.range(40).select(F.col("id").alias("seed"), F.lit(1).alias("length"))
    found = []
    for early in (datasets.EARLY, 1, 4):
        monkeypatch.setattr(datasets, "EARLY", early)
        found.append(sorted(tuple(r) for r in datasets.sampled_programs(seeds, choices, tries=4, most=1).select("seed", "gen", "program").collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) > 30


def programs_of(text):
    name, rest = text[:-1].split("(")
    return name, {k: int(v) for k, v in (x.split("=") for x in rest.split(", "))}


def plain_step(g, name, given):
    return np.flip(g, given["axis"]) if name == "flip" else np.where(g == given["src"], given["dst"], g)


def test_a_store_keeps_one_row_a_key(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "key long, version long, value string")
    store = Results(spark, str(tmp_path / "s"), "key", "version")
    assert store.latest() is None and store.missing(rows((1, 1, "a"))).count() == 1
    store.compact("none")
    store.put(rows((1, 1, "a"), (2, 1, "b")), "one")
    for _ in range(2):  # a retry replaces its batch
        store.put(rows((2, 2, "c"), (3, 1, "d")), "two")
    kept = lambda: sorted(tuple(r) for r in store.latest().collect())
    want = [(1, 1, "a"), (2, 2, "c"), (3, 1, "d")]
    assert kept() == want
    for _ in range(2):  # and so does a compaction
        store.compact("merged")
        assert kept() == want
    store.put(rows((3, 2, "e")), "three")
    assert kept() == [*want[:2], (3, 2, "e")] and store.missing(rows((3, 0, ""), (4, 0, ""))).collect()[0].key == 4


def test_tokens_of_a_small_task(spark):
    df = spark.createDataFrame([([([[1, 0]], [[2]])], [[3], [4]])], "demos array<struct<input: array<array<int>>, output: array<array<int>>>>, query array<array<int>>")
    got = [tuple(t) for t in encoding.encoded(df).head().tokens]
    t = encoding.TOKENS
    mark = lambda *names: [(t.index(n), 0, 0, 0) for n in names]
    c0, nl = t.index("c0"), t.index("<nl>")
    want = mark("<bos>", "<train>", "<in>") + [(c0 + 1, 1, 0, 1), (c0, 1, 1, 1), (nl, 1, 2, 1)] + mark("</in>", "<out>") + [(c0 + 2, 1, 0, 2), (nl, 1, 1, 2)] + mark("</out>", "<test>", "<in>") + [(c0 + 3, 1, 0, 3), (nl, 1, 1, 3), (c0 + 4, 2, 0, 3), (nl, 2, 1, 3)] + mark("</in>", "<prog>")
    assert got == want


@pytest.mark.parametrize("most", [40, 70, 1000])
def test_drawn_examples_fit(spark, most):
    sizes = [(1, 2), (3, 3), (2, 5), (4, 1), (2, 2)]
    pairs = [([[0] * w] * h, [[1] * h] * w) for h, w in sizes]
    df = spark.createDataFrame([(i, pairs) for i in range(20)], "id long, pairs array<struct<input: array<array<int>>, output: array<array<int>>>>")
    out = encoding.resampled(df, most, F.col("id"), F.lit(5))
    rows = out.collect()
    assert all(sorted(r.order) == list(range(5)) for r in rows) and len({tuple(r.order) for r in rows}) > 5
    shown = {r.id: len(r.tokens) for r in encoding.encoded(encoding.drawn_example(out)).collect()}
    for r in rows:
        if r.k is None:
            assert r.id not in shown
            continue
        assert shown[r.id] + 5 + 1 == r.length <= most and 2 <= r.k <= 4
    assert most < 1000 or {r.k for r in rows} == {2, 3, 4}


def test_distances_and_pieces_of_layers():
    rng = np.random.default_rng(5)
    grids = [rng.integers(0, 4, (int(h), int(w))) for h, w in rng.integers(1, 9, (30, 2))]
    column = pa.array([g.tolist() for g in grids], pa.list_(pa.list_(pa.int32())))
    far, pieces = layers.distances(column), layers.components(column)
    for k, g in enumerate(grids):
        for a in range(10):
            own = np.argwhere(g == a)
            assert pieces[k, a] == (len(flood(np.where(g == a, 1, -1).tolist(), False)[1]) if len(own) else 0)
            for b in range(10):
                other = np.argwhere(g == b)
                want = min((int(np.abs(other - p).sum(1).min()) for p in own), default=999) if len(other) else 999
                assert far[k, a, b] == want
