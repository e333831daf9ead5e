"""BPE encoding and decoding by prefix-sharing trie traversal.

The texts are never all seen by one task: each task walks its own batches.  The
distinct words that a batch brings anew go into a trie.  A depth-first walk keeps,
for the prefix at every depth, the *last token* of that prefix's encoding: token t
ends the encoding of a prefix when t is its suffix and t may follow the last token
of the rest (merging the two alone gives the two back).  Exactly one t does, so a
prefix that many words share is encoded once.  Beside the last token stands the depth
where it starts, so a word's ids are read off by going back from its end, and memory
grows with the longest word, not with its square.

Vocabulary files are read by the driver (2 MB) and broadcast.  Results per word
are remembered, at most ``REMEMBERED`` of them in a task's process, and at most ``PAIRS``
pairs of tokens.

Edge cases: null text is encoded as empty text: no ids, decoded "".  Strings of
special tokens inside a text become those tokens.  Rows are kept one for one,
null ids and repeated rows included; columns other than id and text are left out.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.shared import table

#: Words, and as many runs, that a process remembers, and pairs of tokens that it knows to follow each other or not.
REMEMBERED, PAIRS = 400_000, 1_000_000
_LAST_MARK = re.compile(r"(?<=[^\W_])([.,])(?!\S)")
_BATCH_BYTES = 8 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_alphabet() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable ones stand for themselves, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Vocabulary:
    """Ids, merge ranks and text rules of a tokenizer file with word ends (NFC, lower case, white space dropped)."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # Of each token: its packed id, and which tokens it may follow, as far as known.
        self.entries: dict[str, tuple[bytes, dict[str, bool]]] = {t: (i.to_bytes(4, "little"), {}) for t, i in self.ids.items()}
        self.n_pairs = 0
        self.special_coded = {i: (i.to_bytes(4, "little"), f" {t}") for t, i in self.special.items()}
        self.longest = max(len(t.removesuffix(self.end)) for t in self.ids)
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(pattern).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.bytes = {chr(b): c for b, c in _byte_alphabet().items()}
        self.bytes_table = str.maketrans(self.bytes)

    def runs(self, text: str) -> list[bytes]:
        """Stretches of a text whose encodings add up: between white space and, where that is safe, before a last . or ,."""
        if "<|" not in text and "Σ" not in text and (text.isascii() or unicodedata.is_normalized("NFC", text)):
            text = _LAST_MARK.sub(r" \1", text.lower())
        return text.encode("utf-8").split()

    def pieces(self, raw: bytes) -> list[str | int]:
        """A run without ASCII white space as lower-case words, special tokens as ids."""
        text, out = raw.decode("utf-8"), []
        for part in self.cut(text) if "<|" in text else (text,):
            if part in self.special:
                out.append(self.special[part])
                continue
            if not part.isascii():  # each character is lowered by itself: a final sigma gets no other form
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            part = part.lower()
            if part.isalpha():
                out.append(part)
            elif part[:-1].isalpha() and part[-1] in ".,":
                out += (part[:-1], part[-1])
            else:
                out += self.find(part)
        return out

    def lettered(self, word: str) -> str:
        """A word in the byte alphabet."""
        return (word if word.isascii() else word.encode("utf-8").decode("latin-1")).translate(self.bytes_table)

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE: merge the neighbours of lowest rank, from the left, until none is left."""
        while len(symbols) > 1:
            pairs = [(self.ranks.get(p, 1 << 30), i) for i, p in enumerate(zip(symbols, symbols[1:]))]
            rank, at = min(pairs)
            if rank == 1 << 30:
                break
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    def _symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and token != self.end:
            token = token.removesuffix(self.end)
            return [*token[:-1], token[-1] + self.end]
        return [*token]

    def follows(self, before: str, token: str) -> bool:
        """May ``token`` come right after ``before`` ("": the start) in an encoding?"""
        known = self.entries[token][1]
        if before not in known:
            self.n_pairs += 1
            if self.n_pairs > PAIRS:
                self.n_pairs = 1
                for _, pairs in self.entries.values():
                    pairs.clear()
            known[before] = self.merged(self._symbols(before) + self._symbols(token)) == ([before, token] if before else [token])
        return known[before]

    def encode(self, words: Iterable[str]) -> dict[str, tuple[bytes, str]]:
        """Packed ids and spaced token strings of each word, by a depth-first walk of their trie in the byte alphabet.

        The trie is path-compressed: in sorted order each word branches off its predecessor's path at the
        letters they share, and that order is the trie's depth-first one.  States above the branch stay.
        """
        out: dict[str, tuple[bytes, str]] = {}
        entry, follows, longest, end = self.entries.get, self.follows, self.longest, self.end
        # Of the prefix at each depth of the path: its last token (None: not needed yet), and the depth where that starts.
        last: list[str | None] = [""]
        back = [0]
        above = ""

        def state(depth: int, suffix: str) -> tuple[str, int]:
            """Last token of the path's first letters, with ``suffix`` as its end, and where it starts."""
            for start in range(max(0, depth - longest), depth):
                token = word[start:depth] + suffix
                if (of := entry(token)) is not None:
                    if (before := last[start]) is None:
                        before, back[start] = state(start, "")
                        last[start] = before
                    fits = of[1].get(before)
                    if fits or fits is None and follows(before, token):
                        return token, start
            raise ValueError(f"no token ends {word[:depth]!r}")

        for word, name in sorted((self.lettered(w), w) for w in words):
            n, shared = len(word), 0
            for one, other in zip(above, word):
                if one != other:
                    break
                shared += 1
            last[shared + 1 :] = [None] * (n - shared)
            back[shared + 1 :] = [0] * (n - shared)
            for depth in range(1, n) if n > 256 else ():  # so that a very long word's states don't wait for each other
                if last[depth] is None:
                    last[depth], back[depth] = state(depth, "")
            token, at = state(n, end)
            tokens = [token]
            while at:
                tokens.append(last[at])
                at = back[at]
            tokens.reverse()
            out[name] = b"".join([entry(t)[0] for t in tokens]), " " + " ".join(tokens)
            above = word
        return out


class Encoder:
    """Encodes batches of texts, remembering at most ``REMEMBERED`` words and as many runs."""

    _made: dict[tuple[type, int], Encoder] = {}

    def __init__(self, spec: str):
        self.vocabulary = Vocabulary(json.loads(spec))
        self.words: dict[str, tuple[bytes, str]] = {}
        self.runs: dict[bytes, tuple[bytes, str]] = {}

    @classmethod
    def of(cls, spec: str) -> Encoder:
        """One for each vocabulary in a worker process."""
        if (cls, hash(spec)) not in cls._made:
            cls._made[cls, hash(spec)] = cls(spec)
        return cls._made[cls, hash(spec)]

    def coded(self, words: set[str]) -> dict[str, tuple[bytes, str]]:
        return self.vocabulary.encode(words)

    def learn(self, runs: set[bytes]) -> None:
        pieces = {run: self.vocabulary.pieces(run) for run in runs}
        new = {w for p in pieces.values() for w in p if isinstance(w, str)} - self.words.keys()
        found = self.coded(new)
        if len(self.words) + len(new) > REMEMBERED:
            found = {w: self.words.get(w) or found[w] for p in pieces.values() for w in p if isinstance(w, str)}
            self.words = {}
        self.words.update(found)
        words, special = self.words, self.vocabulary.special_coded
        for run, parts in pieces.items():
            if len(parts) == 1 and isinstance(parts[0], str):
                self.runs[run] = words[parts[0]]
            else:
                coded = [words[p] if isinstance(p, str) else special[p] for p in parts]
                self.runs[run] = b"".join([c[0] for c in coded]), "".join([c[1] for c in coded])

    def texts(self, column: pa.Array) -> Iterator[list[tuple[bytes, str]]]:
        """For each text, the packed ids and the token strings, a space before each, of its runs in order."""
        batch: list[list[bytes]] = []
        size = 0
        for value in column:
            text = value.as_py() or ""
            batch.append(self.vocabulary.runs(text))
            size += len(text)
            if size >= _BATCH_BYTES:
                yield from self._flush(batch)
                batch, size = [], 0
        yield from self._flush(batch)

    def _flush(self, batch: list[list[bytes]]) -> Iterator[list[tuple[bytes, str]]]:
        runs = set().union(*batch)
        new = {run for run in runs if run not in self.runs}
        if len(self.runs) + len(new) > REMEMBERED:
            self.runs.clear()
            new = runs
        self.learn(new)
        known = self.runs.__getitem__
        for texts in batch:
            yield list(map(known, texts))


def read_spec(spark: SparkSession, tokenizer: str | None) -> object:
    """The vocabulary file's text, broadcast (its size is that of the file)."""
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, tokenizer: str | None = None, id_column: str = "doc_id", text_column: str = "text", decode: bool = False) -> DataFrame:
    """(id, ids array<int>[, decoded string]) of each row of ``docs``, by the vocabulary file ``tokenizer``.

    ``decoded`` is what the ids say: their token strings, joined by a space where the file names no decoder.
    """
    spec = read_spec(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(spec.value)
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 1000):
                part = batch.slice(at, 1000)
                packed, decoded = [], []
                for runs in encoder.texts(part.column(1)):
                    packed.append(b"".join([r[0] for r in runs]))
                    if decode:
                        decoded.append("".join([r[1] for r in runs])[1:])
                ids = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed], dtype=np.int64)]), pa.int32()),
                    pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32), pa.int32()),
                )
                columns = [part.column(0), ids] + ([pa.array(decoded, pa.string())] if decode else [])
                yield pa.RecordBatch.from_arrays(columns, names=["id", "ids", "decoded"][: len(columns)])

    kind = docs.schema[id_column].dataType.simpleString()
    out = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>" + ", decoded string" * decode)
    return out.withColumnRenamed("id", id_column)


def op7_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again; the digests are taken from the ids and the decoded text."""
    coded = encode(table(spark, sf_dir, "documents"), decode=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
