import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessel.llm import spelling
from tessel.llm.shared import table


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(known):
    near = {w: [o for o in known if one_apart(w, o)] for w in known}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-known[o], o), default=None)
        form[w] = best if best is not None and known[best] >= 5 * known[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), known[w], len(near[w]), None if form[w] is None else known[form[w]]) for w in known}


def as_found(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "own", 1) for i, t in rows], "doc_id long, text string, word string, n int")


def of(docs):
    return spelling.grouped(spelling.occurrences(docs, F.col("doc_id"), F.col("text")))


def test_query_against_every_pair(spark, sf_dir):
    known = plain_words([tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()])
    assert as_found(spelling.op13_spelling_variants(spark, sf_dir)) == plain(known) and len(known) > 300


def test_neighbourhoods_are_whole_and_without_repeats():
    number = {}  # a letter for each symbol
    for c in map(chr, range(97, 123)):
        number.setdefault(int(spelling.symbols(np.array([ord(c)]))[0]), c)
    letters = list(number.values())
    assert len(letters) == spelling.SYMBOLS
    for word in ("", letters[0], letters[0] * 4, "".join(letters[:3]) + letters[2], "".join(letters)):
        around = {word} | {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i + k :] for i in range(len(word) + 1) for k in (0, 1) for c in letters if i + k <= len(word)}
        hashes = np.concatenate(list(spelling.neighbourhood(word)))
        assert len(hashes) == len(set(hashes.tolist())) == len(around)
        assert set(hashes.tolist()) == set(spelling.reduced(sorted(around)).tolist())


def test_stretches_of_long_words(monkeypatch):
    word = "ab" * 40 + "c" * 33
    whole = np.sort(np.concatenate(list(spelling.neighbourhood(word))))
    monkeypatch.setattr(spelling, "CHUNK", 7)
    assert (np.sort(np.concatenate(list(spelling.neighbourhood(word)))) == whole).all()


def test_chains_ties_and_borders(spark):
    words = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "abbbbb": 24, "cccccc": 6, "ccccccd": 30, "bcccccc": 30, "zzzzzz": 4, "éééééé": 5, "ééééé": 900, "ÉÉÉÉÉÉÉ": 5}
    docs = docs_of(spark, [(k, " ".join([w] * n)) for k, (w, n) in enumerate(words.items())])
    got, want = as_found(of(docs)), plain(plain_words([(k, " ".join([w] * n)) for k, (w, n) in enumerate(words.items())]))
    assert got == want
    chains = spelling.grouped(spark.createDataFrame([(w,) for w, n in words.items() for _ in range(n)], "word string"))
    found = as_found(chains)
    assert found["aaaaaa"][:2] == ("aaaaab", "aabbbb") and found["aabbbb"][:2] == (None, "aabbbb") and found["cccccc"][0] == "bcccccc"


def test_planted_slips(spark):
    rows = [(k, "Repeated réponse repeated") for k in range(3000)]
    got = as_found(of(docs_of(spark, rows)))
    assert got == plain(plain_words(rows)) and len(got) > 2


def test_odd_rows(spark, odd_docs, odd_rows):
    rows = [(r[0], r[1]) for r in odd_rows] * 5
    assert as_found(of(docs_of(spark, rows))) == plain(plain_words(rows))
    assert of(docs_of(spark, [])).count() == 0 and of(docs_of(spark, [(1, None), (None, ""), (2, "a b c")])).count() == 0
    long = "q" * 100_000
    near = as_found(of(docs_of(spark, [(k, f"{long} {long[1:]}") for k in range(6)])))
    assert {len(w): v[3] for w, v in near.items()} == {100_000: 1, 99_999: 1}


def test_pairs_of_random_words(spark):
    rng = np.random.default_rng(1)
    words = {"".join("abxyé"[k] for k in rng.integers(0, 5, int(n))) for n in rng.integers(6, 9, 600)}
    known = spark.createDataFrame([(i, w, 5) for i, w in enumerate(sorted(words))], "id long, word string, n long")
    got = {(r.word, r.near) for r in spelling.near_pairs(known).collect()}
    assert got == {p for a, b in itertools.combinations(words, 2) if one_apart(a, b) for p in ((a, b), (b, a))}


def test_one_edit_on_any_pairs():
    rng = np.random.default_rng(2)
    words = ["".join("abé"[k] for k in rng.integers(0, 3, int(n))) for n in rng.integers(1, 6, 400)]
    pairs = [(a, b) for a in words[:60] for b in words if a != b and abs(len(a) - len(b)) <= 1]
    got = spelling.one_edit(pa.array([a for a, _ in pairs]), pa.array([b for _, b in pairs]))
    assert got.tolist() == [one_apart(a, b) for a, b in pairs]
