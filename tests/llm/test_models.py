"""Classifiers by their held-out accuracy, and the pipeline against a brute-force version of its stages."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tessel.llm import quality, text, toxicity
from tests.llm.test_exact import components


def held_out(spark, rows, column, name):
    labels = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{name}/labels.parquet").collect()}
    return [(r["predicted"], labels[r["doc_id"]], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in labels]


def test_quality_on_held_out_labels(spark):
    name = "/root/testdata/sf0.01"
    rows = quality.op10_quality(spark, name).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    pairs = held_out(spark, rows, "quality", name)
    assert np.mean([p == y for p, y, _ in pairs]) > 0.9


def test_toxicity_on_held_out_labels(spark):
    name = "/root/testdata/sf0.1"
    rows = toxicity.op5_toxicity(spark, name).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    pairs = held_out(spark, rows, "toxic", name)
    assert np.mean([p == y for p, y, _ in pairs]) > 0.9


def test_misspellings_share_ngrams():
    rng = np.random.default_rng(0)
    clean = [" ".join(f"{a}{b}" for a, b in zip(rng.choice(["wa", "ri", "lo", "mu"], 40), rng.choice(["ten", "sol", "gar", "pim"], 40))) for _ in range(200)]
    rude = [c + " gruntlepox" + " " + c for c in clean[:100]]
    texts = [*clean, *rude]
    doc, windows, target = [], [], []
    for i, t in enumerate(texts):
        w = t.split()
        for at in range(0, len(w), toxicity.WINDOW):
            doc.append(i)
            windows.append(" ".join(w[at : at + toxicity.WINDOW]))
            target.append(int(i >= 200))
    model = toxicity.fit(np.array(doc), np.array(target), pa.array(windows))
    chunk = next(text.chunks(pa.array([clean[0] + " gruntlep0x", clean[1]])))
    scores = model.scores(chunk)
    assert scores[0] > 0.5 > scores[1]


def test_toxicity_learns_from_whole_texts(spark):
    # The rude words of a toxic text are all in windows that 400 evenly spaced ones of its 1000 leave out.
    rng = np.random.default_rng(1)
    prose = lambda n: [f"{a}{b}" for a, b in zip(rng.choice(["wa", "ri", "lo", "mu"], n), rng.choice(["ten", "sol", "gar", "pim"], n))]
    texts = [prose(4000) for _ in range(80)]
    left_out = np.setdiff1d(np.arange(1000), np.linspace(0, 999, 400).astype(int))
    for words in texts[40:]:
        for at in left_out[::3]:
            words[4 * at + 1] = "gruntlepox"
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 40)) for i in range(80)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    long, short = prose(20_000), prose(20)
    held = pa.array([" ".join(w) for w in (long, short, [*long[:15_001], "gruntlepox", *long[15_001:]], [*short, "gruntlepox"])])
    scores = np.concatenate([model.scores(chunk) for chunk in text.chunks(held)])
    assert scores[:2].max() < 0.5 < scores[2:].min()


def test_scores_of_odd_rows(spark, odd_docs, odd_rows):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(8)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for module, target in ((toxicity, "toxic"), (quality, "quality")):
        for given in (labels, labels.limit(0)):
            model = module.train(odd_docs, given, target)
            rows = module.score(odd_docs, model).collect()
            assert len(rows) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in rows)
            assert module.kept(odd_docs, model).columns == odd_docs.columns
        assert module.score(odd_docs.limit(0), model).count() == 0


def test_field_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    logit, table = rng.normal(size=5), rng.normal(size=(2, 2))
    total, good = 0.0, np.zeros(5)
    for k in range(32):
        y = [(k >> i) & 1 for i in range(5)]
        w = np.exp(sum(logit[i] * y[i] for i in range(5)) + sum(table[y[i - 1], y[i]] for i in range(1, 5)))
        total += w
        good += w * np.array(y)
    found, _ = quality.marginals(np.r_[logit, logit[:2]], np.array([0] * 5 + [1] * 2), table)
    assert np.allclose(found[:5], good / total)


def test_slopes_of_documents_by_difference():
    rng = np.random.default_rng(2)
    doc = np.array([0, 0, 0, 1, 1, 2])
    logit, table, pull = rng.normal(size=6), rng.normal(size=(2, 2)), rng.normal(size=6)
    by_logit, by_table = quality.document_slopes(logit, doc, table, pull)
    value = lambda z, t: (pull * quality.marginals(z, doc, t)[0]).sum()
    for k in range(6):
        step = np.eye(6)[k] * 1e-5
        assert abs((value(logit + step, table) - value(logit - step, table)) / 2e-5 - by_logit[k]) < 1e-4
    for k in range(4):
        step = np.eye(4)[k].reshape(2, 2) * 1e-5
        assert abs((value(logit, table + step) - value(logit, table - step)) / 2e-5 - by_table.ravel()[k]) < 1e-4


def test_quality_finds_the_bad_lines():
    # Bad documents are good prose with a few junk lines; only documents are labelled.
    rng = np.random.default_rng(3)
    prose = lambda: " ".join(rng.choice(["the", "river", "was", "calm", "over", "green", "hills"], 9)).capitalize() + "."
    junk = lambda: "".join(rng.choice(list("#*$%&|<>0123456789"), 40))
    texts = ["\n".join(junk() if k % 2 and 3 <= i % 8 <= 6 else prose() for i in range(24)) for k in range(120)]
    field = quality.fit(pa.array(texts), np.array([1 - k % 2 for k in range(120)]))
    features, doc, _ = quality.line_features(next(text.chunks(pa.array(texts[:2]))))
    good = quality.marginals(features @ field.weights, doc, field.table)[0]
    bad = np.r_[np.zeros(24, bool), [3 <= i % 8 <= 6 for i in range(24)]]
    assert good[bad].max() < 0.5 < good[~bad].mean()
    assert field.table[0, 0] + field.table[1, 1] > field.table[0, 1] + field.table[1, 0]


def test_pipeline(spark):
    name = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{name}/documents.parquet")
    first = corpus_pipeline.clean(spark, docs, name)
    model = toxicity.train(docs, spark.read.parquet(f"{name}/labels.parquet"), "toxic", corpus_pipeline.remainder("doc_id", 3) != 1)
    passing = {r["doc_id"] for r in toxicity.score(docs, model).where(F.col("score") < toxicity.THRESHOLD).collect()}
    assert {r["doc_id"] for r in first.collect()} == passing and first.columns == docs.columns
    some = docs.where("length(text) < 1500").limit(250).cache()
    kept = corpus_pipeline.unique(spark, some, name)
    rows = sorted(some.select("doc_id", "text").collect())
    wanted = {rows[i]["doc_id"] for i, (_, root) in enumerate(components([r["text"] for r in rows])) if root == i}
    assert {r["doc_id"] for r in kept.collect()} == wanted and kept.columns == docs.columns
    packed = corpus_pipeline.packed(spark, some, name)
    assert packed.select("doc_id").distinct().count() == some.count()
    kept = corpus_pipeline.unique(spark, docs.limit(0), name)
    assert kept.count() == 0 and kept.columns == docs.columns


def test_duplicates_of_odd_rows(spark, odd_docs, odd_rows):
    text, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(4, text), (5, text), (None, text), (None, text), (5, other), (None, ""), (None, ""), (None, None), (7, "")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, row int")
    kept = sorted(str((r["doc_id"], r["text"])) for r in corpus_pipeline.unique(spark, docs, "").collect())
    assert kept == sorted(map(str, [(4, text), (5, other), (None, ""), (None, ""), (None, None), (7, "")]))
    kept = corpus_pipeline.unique(spark, odd_docs, "")
    texts = [r["text"] for r in kept.collect()]
    same = [t for t in texts if t and t.lower().split() == "the cat sat on the mat".split()]
    assert kept.columns == odd_docs.columns and len(same) == 1
    assert sum(not (t or "").split() for t in texts) == sum(not (r[1] or "").split() for r in odd_rows)
