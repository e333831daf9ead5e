"""Operators with one right result, against brute-force versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessel.llm import bpe, chat, maxent, neardup, neighbours, packing, perplexity
from tessel.llm.components import components as component_steps


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_tokenizer())


def test_bpe_is_the_library(spark, odd_docs, odd_rows):
    library = tokenizer()
    wanted = sorted(repr((r[0], (ids := library.encode(r[1] or "", add_special_tokens=False).ids), library.decode(ids, skip_special_tokens=False))) for r in odd_rows)
    got = sorted(repr((r["doc_id"], r["ids"], r["decoded"])) for r in bpe.encode(odd_docs, decode=True).collect())
    assert got == wanted
    assert bpe.encode(odd_docs.limit(0)).count() == 0


def test_trie_walk_is_plain_merging():
    import json

    vocabulary = bpe.Vocabulary(json.load(open(bpe.default_tokenizer())))
    some = ["unbelievable", "unbelief", "u", "un", "tionthing", "aaaaaaaaab", "a" * 300, "été", "x9"]
    found = vocabulary.encode(some)
    for word in some:
        symbols = [*vocabulary.lettered(word)]
        symbols[-1] += vocabulary.end
        assert found[word][1].split() == vocabulary.merged(symbols)


def test_very_long_words_take_linear_memory():
    import json
    import tracemalloc

    vocabulary = bpe.Vocabulary(json.load(open(bpe.default_tokenizer())))
    word = "".join(np.random.default_rng(0).choice(list("abcdefgh"), 1_000_000))
    tracemalloc.start()
    found = vocabulary.encode([word, word[:5000]])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 400e6
    assert found[word][1].replace(" ", "").removesuffix(vocabulary.end) == word
    symbols = [*word[:2000]]
    symbols[-1] += vocabulary.end
    assert vocabulary.encode([word[:2000]])[word[:2000]][1].split() == vocabulary.merged(symbols)


def test_few_remembered_pairs(monkeypatch):
    import json

    vocabulary = bpe.Vocabulary(json.load(open(bpe.default_tokenizer())))
    some = ["unbelievable", "unbelief", "tionthing", "aaaaaaaaab", "xyzzyplugh"]
    whole = vocabulary.encode(some)
    monkeypatch.setattr(bpe, "PAIRS", 3)
    assert bpe.Vocabulary(json.load(open(bpe.default_tokenizer()))).encode(some) == whole


def test_op7(spark, sf_dir):
    library = tokenizer()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in bpe.op7_bpe_encoding(spark, sf_dir).collect():
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_packing(spark, odd_docs, odd_rows):
    capacity = 64
    rows = packing.pack(packing.pieces(odd_docs, capacity), capacity, block=50).collect()
    library = tokenizer()
    ids = [[*library.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in odd_rows]
    wanted = sorted(repr((odd_rows[k][0], n, n * capacity, x[n * capacity : (n + 1) * capacity])) for k, x in enumerate(ids) for n in range(-(-len(x) // capacity)))
    assert sorted(repr((r["doc_id"], r["piece"], r["start"], np.frombuffer(bytes(r["ids"]), "<u4").tolist())) for r in rows) == wanted
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in held.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= capacity
    total = sum(map(len, ids))
    assert -(-total // capacity) <= len(held) <= -(-total // capacity) + 2
    assert packing.pack(packing.pieces(odd_docs.limit(0))).count() == 0


def test_blocks_cost_no_sequences(spark):
    # Two pieces fit a sequence, three don't: with an odd number in every block, half-filled bins have to meet those of other blocks.
    rng = np.random.default_rng(4)
    for low, high in ((35, 50), (20, 33), (1, 64)):
        sizes = rng.integers(low, high, 997).tolist()
        rows = packing.pack(spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "doc_id long, length long"), 100, block=61).collect()
        held = {}
        for r in rows:
            held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert len(rows) == 997 and all(sum(n for _, n in spans) <= 100 for spans in held.values())
        least = -(-997 // 2) if low == 35 else -(-sum(sizes) // 100)
        assert len(held) <= least * (1.0 if low == 35 else 1.03) + 1, (low, high, len(held), least)


def test_genetic_algorithm_packs_fewer_than_best_fit():
    rng = np.random.default_rng(11)
    better = 0
    for seed in range(8):
        sizes = rng.integers(200, 700, 120).tolist()
        first = len(packing.best_fit(sizes, sorted(range(120), key=lambda i: -sizes[i]), [], 1000))
        better += len(packing.evolve(sizes, [], 1000, seed, generations=150)[0]) < first
    assert better >= 1


def test_genetic_algorithm_packs_all_and_no_worse():
    rng = np.random.default_rng(1)
    sizes = rng.integers(200, 1200, 300).tolist()
    first = packing.best_fit(sizes, sorted(range(300), key=lambda i: -sizes[i]), [], 2048)
    for bins in packing.evolve(sizes, [], 2048, 3):
        assert sorted(i for b in bins for i in b) == list(range(300))
        assert all(sum(sizes[i] for i in b) <= 2048 for b in bins)
    assert len(packing.evolve(sizes, [], 2048, 3)[0]) <= len(first)


def components(texts):
    """(set size, smallest index reachable) of each text."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return [(len(s), r) for s, r in zip(sets, root)]


def test_near_duplicates(spark):
    rng = np.random.default_rng(5)
    base = [" ".join(f"w{k}" for k in rng.integers(0, 500, 60)) for _ in range(12)]
    texts = []
    for b in base:
        for edits in (0, 0, 1, 2, 3, 4, 6, 9):
            w = b.split()
            for p in rng.integers(0, 60, edits):
                w[p] = f"v{rng.integers(0, 500)}"
            texts.append(" ".join(w))
    texts += [None, "", "one two", "One  two", "three"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("node", F.lit("x")).withColumn("root", F.lit(1))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect()}
    assert got == {i: (n, root, root == i) for i, (n, root) in enumerate(components(texts))}


def test_near_duplicates_of_odd_rows(spark, odd_docs, odd_rows):
    rows = neardup.near_duplicates(odd_docs).collect()
    assert len(rows) == len(odd_rows)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[5][0]["component_id"] == 4 and by[6][0]["component_id"] == 4 and by[9][0]["component_id"] == 8
    assert sorted((r["component_id"], r["kept"]) for r in by[None] if r["n_shingles"]) == [(4, False)]
    assert all(r["kept"] for r in rows if not r["n_shingles"])
    assert neardup.near_duplicates(odd_docs.limit(0)).count() == 0


def test_all_pairs_within_the_distance_meet():
    rng = np.random.default_rng(7)
    for _ in range(300):
        one = rng.integers(0, 1 << 16, neardup.VALUES).astype("<u2")
        other = one.copy()
        other[rng.choice(neardup.VALUES, neardup.MOST_DIFFERENT, replace=False)] ^= 1
        rows = pa.table({"node": [1, 2], "size": pa.array([9, 9], pa.int32()), "signature": [one.tobytes(), other.tobytes()]})
        keys = pa.Table.from_batches(neardup._keys(iter(rows.to_batches())))
        by = {n: set(keys.filter(pa.compute.equal(keys["node"], n))["key"].to_pylist()) for n in (1, 2)}
        assert by[1] & by[2]


def test_links_of_a_cluster_are_confirmed_on_sets_alone():
    sets = [np.arange(at, at + 28, dtype=np.uint64).tobytes() for at in (0, 4, 8)]
    rows = pa.table({"root": [1] * 3, "p": [0] * 3, "q": [0] * 3, "own": [0] * 3, "from": [1, 2, 3], "node": [1, 2, 3], "size": [28] * 3, "shingles": sets})
    found = pa.Table.from_batches(neardup._joining(iter(rows.to_batches())))
    assert list(zip(found["a"].to_pylist(), found["b"].to_pylist())) == [(2, 1), (3, 2)]


def test_near_duplicates_in_many_slices(spark, monkeypatch):
    # Buckets and clusters of far more rows than a slice: a chain (rows are apart after the hub's pass) and a star.
    monkeypatch.setattr(neardup, "SLICE", 3)
    monkeypatch.setattr(neardup, "CLUSTER_SLICE", 3)
    texts = [" ".join(f"c{j}" for j in range(at, at + 64)) for at in range(0, 60, 4)]
    base = [f"s{j}" for j in range(90)]
    texts += [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(0, 90, 5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs).collect()}
    assert got == dict(enumerate(components(texts)))


def test_near_duplicates_without_ids(spark):
    near = [" ".join(f"w{j}" for j in range(at, at + 60)) for at in (0, 2, 500)]
    rows = [(None, near[0]), (None, near[1]), (None, near[1].upper()), (None, near[2]), (7, near[2])] + [(None, "")] * 2
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str((r["doc_id"], r["component_id"], r["kept"])) for r in found if r["n_shingles"]) == sorted(map(str, [(None, None, True)] * 3 + [(None, 7, False), (7, 7, True)]))


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(i + 1, i) for i in range(40)]
    hub = [(1000 + i, 999) for i in range(200)] + [(1050, 500)]
    found = {r["node"]: r["root"] for r in component_steps(spark.createDataFrame(chain + hub, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {1000 + i: 500 for i in range(200)} | {999: 500}


def test_statistics_of_quality_rules(spark, odd_docs, odd_rows):
    rows = perplexity.quality_rules(odd_docs).collect()
    wanted = []
    for r in odd_rows:
        t = r[1] or ""
        w, seen, dup = words(t), set(), 0
        for line in t.split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        often, covered = Counter(zip(w, w[1:], w[2:])), set()
        for i, g in enumerate(zip(w, w[1:], w[2:])):
            if often[g] > 1:
                covered |= {i, i + 1, i + 2}
        wanted.append((len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    assert sorted((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows) == sorted(wanted)
    assert not any(r["kept"] for r in rows if r["base_failed"])
    assert perplexity.quality_rules(odd_docs.limit(0)).count() == 0


def plain_kneser_ney(texts):
    """Costs of texts (one language) by the textbook: counts in dictionaries."""
    def symbols(text):
        line, out = [0], []
        for word in words(text):
            line += [32, *(48 if 48 <= ord(c) <= 57 else ord(c) for c in word)]
        line.append(32)
        return [tuple(line[i : i + 3]) for i in range(len(line) - 2)]

    tri = Counter(g for t in texts for g in symbols(t))
    bi = Counter(g[1:] for g in tri)
    uni = Counter(g[1:] for g in bi)

    def discounts(counts):
        of = Counter(counts.values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] else None
        out = {}
        for k in (1, 2, 3):
            d = k - (k + 1) * y * of[k + 1] / of[k] if y is not None and of[k] else 0
            out[k] = d if 0 < d < k else 0.75
        return out

    orders = []
    for counts in (uni, bi, tri):
        d = discounts(counts)
        total, rest = Counter(), Counter()
        for g, n in counts.items():
            total[g[:-1]] += n
            rest[g[:-1]] += d[min(n, 3)]
        orders.append((counts, d, total, rest))

    def p(order, gram):
        if order < 0:
            return 1 / perplexity.SYMBOLS
        counts, d, total, rest = orders[order]
        context = gram[:-1]
        if not total[context]:
            return p(order - 1, gram[1:])
        n = counts[gram]
        return (n - d[min(n, 3)] if n else 0) / total[context] + rest[context] / total[context] * p(order - 1, gram[1:])

    return [(-np.mean([math.log10(p(2, g)) for g in symbols(t)]) if words(t) else None) for t in texts]


def test_costs_are_those_of_plain_kneser_ney(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join("".join(rng.choice(list("abcdeé中9"), rng.integers(1, 6))) for _ in range(rng.integers(1, 30))) for _ in range(60)] + [None, "", "new\nwörter \U0001f600"]
    rows = [(i, t, "aa") for i, t in enumerate(texts)] + [(100 + i, f"zz {i} qq", "bb") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["cost"] for r in perplexity.quality_rules(docs).collect()}
    for i, cost in enumerate(plain_kneser_ney(texts)):
        assert (found[i] is None and cost is None) or abs(found[i] - cost) < 1e-5


def test_a_smaller_model_backs_off(spark):
    docs = spark.createDataFrame([(i, "the cat sat on the mat " * 20, "en") for i in range(4)], "doc_id long, text string, lang string")
    counts = perplexity.trigram_counts(docs)
    whole, small = perplexity.Model.fit(counts), perplexity.Model.fit(counts, most=20)
    assert 0 < len(small.keys) < len(whole.keys)
    costs = [r["cost"] for r in perplexity.measure(docs, small).collect()]
    assert all(c is not None and 0 < c < 6 for c in costs)


def test_a_part_of_the_model_gives_the_same_result(spark, odd_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").union(odd_docs.select("doc_id", "text", "lang"))
    docs = docs.union(docs.limit(5))
    key = lambda r: tuple((v is not None, v) for v in (r["doc_id"], r["n_words"], r["word_chars"]))
    whole = sorted(perplexity.quality_rules(docs).collect(), key=key)
    for most in (1, 500):
        part = sorted(perplexity.quality_rules(docs, most=most).collect(), key=key)
        assert len(part) == len(whole) > 100
        for a, b in zip(part, whole):
            assert a[:7] == b[:7] and a["kept"] == b["kept"]
            assert (a["cost"] is None and b["cost"] is None) or abs(a["cost"] - b["cost"]) < 1e-9


def test_bands_reject_junk_of_each_language(spark):
    rng = np.random.default_rng(5)
    letters = {"en": "abcdefgh", "ro": "ijklmnop", "ru": "абвгдежз", None: "qrstuvwx"}  # en and ro: of one crc32 remainder by 64
    lexicon = {lang: ["".join(rng.choice(list(own), 5)) for _ in range(60)] for lang, own in letters.items()}
    rows = []
    for lang, known in lexicon.items():
        rows += [(len(rows) + i, " ".join(rng.choice(known, 80)), lang) for i in range(60)]
    junk = len(rows)
    rows.append((junk, " ".join("".join(rng.choice(list("ийклмноп"), 5)) for _ in range(80)), "ru"))  # letters of the script, not of the language
    rows.append((junk + 1, " ".join("".join(rng.choice(list("ijklmnop"), 5)) for _ in range(80)), "en"))  # letters of another language
    rows.append((junk + 2, " ".join(lexicon["en"][:49]), "en"))
    found = {r["doc_id"]: r for r in perplexity.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not any(found[junk + k]["kept"] for k in range(3)) and found[junk + 2]["base_failed"]
    good = [found[i] for i in range(junk) if not found[i]["base_failed"]]
    assert all(r["kept"] for r in good)


def test_lm_base_scores(spark, odd_docs, odd_rows):
    trains = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2
    tokens = [[*(r[1] or "").encode().lower().split(), None] for r in odd_rows]
    counts = Counter(w for r, t in zip(odd_rows, tokens) if trains(r[0]) for w in t)
    total = sum(counts.values())
    wanted = sorted((len(t), sum(w in counts for w in t), round(sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in t), 5)) for t in tokens)
    rows = maxent.score_texts(odd_docs, maxent.remainder("doc_id", 7) != 2).collect()
    assert sorted((r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in rows) == wanted
    assert {r["train_tokens"] for r in rows} == {total} and all(r["score"] < 0 for r in rows)
    assert maxent.score_texts(odd_docs.limit(0), F.lit(True)).count() == 0


def test_lm_beats_its_base_on_held_out_texts(spark):
    rows = maxent.op8_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_probabilities_of_the_language_model_sum_to_one():
    rng = np.random.default_rng(6)
    words = maxent.Vocabulary(np.arange(3000, dtype=np.uint64), rng.integers(1, 50, 3000), np.where(np.arange(3000) < maxent.HEADS, np.arange(3000), -1), 100_000, 5000)
    model = maxent.Model.start(words)
    model.classes[:-1] = rng.normal(0, 1, model.classes[:-1].shape)
    model.words[:] = rng.normal(0, 1, model.words.shape)
    # One history before every head, and before one tail word, whose class stands for all of the tail.
    stream = object.__new__(maxent.Stream)
    n = maxent.HEADS + 1
    stream.tokens, stream.lengths = np.tile(np.array([7, 9, 0], np.uint64), n), np.full(n, 3)
    heads = np.tile(np.array([7, 9, 0]), n)
    heads[2::3] = np.r_[np.arange(maxent.HEADS), -1]
    assert abs((10 ** maxent.log10(model, maxent.History(stream, heads))[2::3]).sum() - 1) < 1e-4


def test_one_step_is_that_of_plain_gradients():
    rng = np.random.default_rng(8)
    table, rows, slope = np.zeros((6, 3), np.float32), rng.integers(0, 6, (2, 9)), rng.normal(size=(9, 3))
    sizes, seen = np.zeros(6, np.float32), np.zeros(6, np.float32)
    maxent._add(table, sizes, seen, rows, slope)
    for row in range(6):
        total = sum((slope[i] for k in range(2) for i in range(9) if rows[k, i] == row), np.zeros(3))
        assert seen[row] == (rows == row).sum()
        assert np.allclose(table[row], -maxent.RATE / np.sqrt((total**2).mean() + 1) * total, atol=1e-5)


def test_rare_words_go_through_the_join(spark, odd_docs, monkeypatch):
    whole = sorted((r["n_known"], round(r["base_score"], 6)) for r in maxent.score_texts(odd_docs, F.lit(True)).collect())
    monkeypatch.setattr(maxent, "BROADCAST", 20)
    assert sorted((r["n_known"], round(r["base_score"], 6)) for r in maxent.score_texts(odd_docs, F.lit(True)).collect()) == whole


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 0.0, 1.0]) for i in range(90)] + [(100 + i, rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(150)]
    rows += [(300, None), (320, [0.0] * 4), (340, [float("nan"), 1.0, 1.0, 1.0]), (360, [None, 1.0, 1.0, 1.0]), (380, [1.0]), (400, []), (None, [1.0, 1.0, 1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("cell", F.lit(1))
    valid = [(i, np.array(v)) for i, v in rows if i is not None and v is not None and len(v) == 4 and None not in v and np.isfinite(v).all() and any(v)]
    vectors, got, hits = dict(valid), {}, []
    for r in neighbours.search(frame, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in vectors if i % 20 == 0}
    for i, found in got.items():
        found = sorted(found)
        assert [r for r, _, _ in found] == list(range(1, 21)) and len({j for _, j, _ in found} - {i}) == 20
        assert all(s == float((vectors[i] * vectors[j]).sum()) for _, j, s in found)
        assert [(-s, j) for _, j, s in found] == sorted((-s, j) for _, j, s in found)
        wanted = {j for _, j in sorted((-float((vectors[i] * w).sum()), j) for j, w in valid if j != i)[:20]}
        hits.append(len(wanted & {j for _, j, _ in found}) / 20)
    assert np.mean(hits) >= 0.9
    few = neighbours.search(frame.where("vec_id < 5 or vec_id > 290"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in few] == [(k, k, 6.0) for k in (1, 2, 3, 4)]
    assert neighbours.search(frame.limit(0), F.lit(True)).count() == 0


def recall(rows, vectors, k=20):
    """Share of the true k nearest others among those found; ``vectors``: id to vector."""
    ids, matrix = np.array(list(vectors)), np.stack(list(vectors.values()))
    found = {}
    for r in rows:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
        assert abs(r["score"] - float((vectors[r["query_id"]] * vectors[r["vec_id"]]).sum())) < 1e-9
    hits = []
    for i, got in found.items():
        scores = matrix @ vectors[i]
        scores[ids == i] = -np.inf
        hits.append(len(got & set(ids[np.argsort(-scores, kind="stable")[:k]].tolist())) / k)
    return np.mean(hits)


def test_recall_of_the_query(spark):
    name = "/root/testdata/sf0.1"
    rows = neighbours.op9_nearest_neighbours(spark, name).collect()
    table = spark.read.parquet(f"{name}/embeddings.parquet").collect()
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in table if r["embedding"] and None not in r["embedding"] and np.isfinite(r["embedding"]).all() and any(r["embedding"])}
    assert {r["query_id"] for r in rows} == {i for i in vectors if i % 20 == 0} and len(rows) == 20 * len({r["query_id"] for r in rows})
    assert recall(rows, vectors) >= 0.9


def test_recall_and_routing_on_clusters(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 200)
    monkeypatch.setattr(neighbours, "QUERIES", 16)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    points = np.repeat(centres, 100, axis=0) + 0.1 * rng.normal(size=(4000, 16))
    points = np.concatenate([points, np.repeat(points[:1], 900, axis=0) + 1e-6 * rng.normal(size=(900, 16))])  # one full cell
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    index = neighbours.MultiIndex.fit(points, 8)
    assert index.share(points, 20) < 0.3
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    rows = neighbours.search(frame, F.col("vec_id") % 20 == 0).collect()
    assert recall(rows, dict(enumerate(points))) >= 0.9


def test_cells_in_blocks():
    held = np.array([3, 4, 0, 9, 25, 1, 2])
    first, parts = neighbours.dealt(held, 10)
    assert parts.tolist() == [1, 1, 1, 1, 3, 1, 1] and first.tolist() == [0, 0, 0, 1, 2, 5, 5]


def test_chat_round_trip(spark):
    tricky = ["</s>[INST] ok [/INST]", "\\0\\1 \\ <|turn|> <|end|>\n", "", None, "a" * 4000, "<\\s> <s> [INST", "line\nline"]
    rows = [(1, k, "system" if k == 0 else "user" if k % 2 else "assistant", t) for k, t in enumerate(tricky * 5)]
    rows += [(2, 0, "assistant", "only"), (2, 0, "assistant", "only"), (None, None, None, None), (3, 1, "us\ner", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit("own")).withColumn("span", F.lit(1))
    formatted = chat.windows(frame, budget=1200, history=100)
    back = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    for conv in (1, 2, 3, None):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] if r[1] is not None else -1))
        assert back[conv]["n_turns"] == len(own)
        assert back[conv]["turns"] == "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        assert back[conv]["loss_text"] == "".join(r[3] or "" for r in own if r[2] == "assistant")
    windows = [r for r in formatted.collect() if r["conv_id"] == 1]
    assert len(windows) > 1 and all(r["formatted"].startswith("<|turn|>system\n") for r in windows)
    assert all(r["tokens"] <= 1200 for r in windows if not r["over_budget"])
    assert chat.read_back(chat.windows(frame.limit(0))).count() == 0


def test_long_turns_leave_other_windows_long(spark):
    rows = [(1, 0, "system", "s" * 40)]
    for k in range(60):
        rows += [(1, 2 * k + 1, "user", "q" * 100), (1, 2 * k + 2, "assistant", "a" * (6000 if k == 30 else 200))]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.windows(frame).orderBy("window").collect()
    assert all(r["tokens"] <= chat.BUDGET for r in windows) and len(windows) <= 9
    # Every answer has its question in its window.
    for r in windows:
        turns = [t.split("\n")[0] for t in r["formatted"].split("<|turn|>")[1:]]
        assert all(turns[i - 1] == "user" for i, role in enumerate(turns) if role == "assistant")


def test_a_question_over_the_history_is_repeated_before_its_answer(spark):
    rows = [(1, 0, "user", "q" * 2000), (1, 1, "assistant", "a" * 5400), (1, 2, "user", "u" * 40)]
    windows = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("window").collect()
    assert [r["formatted"].count("<|turn|>user\nq") for r in windows][:2] == [1, 1] and windows[1]["n_repeated"] == 1
    assert all(r["tokens"] <= chat.BUDGET for r in windows)
