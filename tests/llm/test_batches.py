"""Batches of texts encoded at once, against the tokenizers library."""

import json
import random
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessel.llm import batches, bpe

END = np.array([0], "<u4").tobytes()


@pytest.fixture(scope="module")
def spec():
    with open(bpe.default_tokenizer(), encoding="utf-8") as file:
        return file.read()


def library(spec):
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(spec)
    made.no_truncation()
    made.no_padding()
    return made


def encoded(encoder, texts):
    out = []
    for at, bounds, ids in encoder.parts(pa.array(texts, pa.string()), END):
        assert at == len(out)
        out += [np.frombuffer(ids, "<u4")[a // 4 : b // 4].tolist() for a, b in zip(bounds, bounds[1:])]
    return out


def wanted(spec, texts):
    made = library(spec)
    return [[*made.encode(text or "", add_special_tokens=False).ids, 0] for text in texts]


def odd_texts(seed, n):
    """Words, capitals, sharp s, contractions, special tokens, composing marks, spaces of all kinds and any code points, often unspaced."""
    draw = random.Random(seed)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "'s", "'S", "'re", "'LL", "''", "İ", "Σ", "ς", "H̱", "ẘ", "é", "ß", "ẞ", "K", "Å", "É", "×", "÷", "\x1c", "\x85", "\xa0", " ", "“", "’", "½", "ª", "µ", "中文", "\U0001f600", "1́", "≮"]
    signs = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789"
    makers = [
        lambda: "".join(draw.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ", k=draw.choice([1, 3, 8, 47, 48, 49, 300]))),
        lambda: "".join(draw.choices("thereandingation", k=draw.randint(1, 20))),
        lambda: "".join(map(chr, draw.choices(range(0x250), k=draw.randint(1, 8)))),
        lambda: draw.choice(bits),
        lambda: "".join(draw.choices(signs, k=draw.randint(1, 5))),
        lambda: chr(draw.choice([draw.randrange(1, 0xD800), draw.randrange(0xE000, 0x110000)])),
    ]
    return [None, "", " \n", *("".join(draw.choice(makers)() + draw.choice(["", "", " ", "\n", "  "]) for _ in range(draw.randint(0, 40))) for _ in range(n)), "", None]


def test_batches_are_the_library(spec, monkeypatch):
    encoder = batches.BatchEncoder(spec)
    assert encoder.usual
    for seed, (remembered, size) in enumerate([(400_000, 8 << 20), (400_000, 3000), (700, 9000), (0, 1)]):
        monkeypatch.setattr(batches, "REMEMBERED", remembered)
        monkeypatch.setattr(batches, "_BATCH_BYTES", size)
        texts = odd_texts(seed, 400)
        assert encoded(encoder, texts) == wanted(spec, texts)
        assert len(encoder.known) == len(encoder.coded) <= remembered
    assert encoded(encoder, []) == [] and encoded(encoder, [None, ""]) == [[0], [0]]


def test_other_rules_go_to_the_library(spec):
    rules = json.loads(spec)
    rules["normalizer"]["normalizers"] = rules["normalizer"]["normalizers"][:2]  # capitals stay
    other = json.dumps(rules)
    encoder = batches.BatchEncoder(other)
    assert not encoder.usual
    texts = ["The CAT sat on the Mat. It's ÉTÉ", None, *odd_texts(9, 60)]
    assert encoded(encoder, texts) == wanted(other, texts) != wanted(spec, texts)


def test_pairs_are_those_of_a_dictionary():
    rng = np.random.default_rng(3)
    keys = rng.choice(1 << 31, 20_000, replace=False).astype(np.uint64)
    pairs = batches.Pairs(keys[:15_000], np.arange(15_000, dtype=np.int32))
    assert pairs(keys).tolist() == [*range(15_000), *[pairs.NONE] * 5000]


def test_a_batch_takes_a_quarter_of_the_time_of_the_library(spec):
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).combine_chunks()
    texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
    encoder, made, ours, theirs = batches.BatchEncoder(spec), library(spec), [], []
    for _ in range(3):
        encoder.forget()
        began = time.thread_time()
        for _ in encoder.parts(texts, END):
            pass
        ours.append(time.thread_time() - began)
        began = time.thread_time()
        for text in texts.to_pylist():
            made.encode(text or "", add_special_tokens=False)
        theirs.append(time.thread_time() - began)
    assert min(ours) < min(theirs) / 4, (ours, theirs)
