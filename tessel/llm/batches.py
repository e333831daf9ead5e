"""Token ids of whole batches of texts at once, with numpy and Arrow, equal to those of the tokenizers library.

A batch's bytes are cut into stretches whose encodings add up: at ASCII white space,
and between letters, digits and marks where both neighbours are ASCII or Latin-1
letters.  Each distinct stretch is encoded once and remembered; a dictionary of the
stretches then gives the ids of all texts by one ``take``.

A stretch of ASCII and Latin-1 letters, a digit or some marks is one word for byte
pair encoding.  All new words of a length are merged side by side: in each round
every word merges its neighbours of lowest rank, the left ones if two are equal.
Stretches with any other character (apostrophes and bars too, as they begin
contractions and special tokens), and those of more than ``LONGEST`` bytes, are
encoded by the library itself, as all are where a file has other rules than these.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessel.llm.bpe import _BATCH_BYTES, REMEMBERED, _byte_alphabet

LONGEST = 48  # bytes; positions in a word take six bits
_TOGETHER = 4096  # stretches in one call of the library
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# --- stretches ----------------------------------------------------------------------

SPACE, LETTER, DIGIT, MARK, OTHER = range(5)
_KINDS = np.full(256, OTHER, np.uint8)
_KINDS[33:127] = MARK
_KINDS[[ord("'"), ord("|")]] = OTHER
_KINDS[[*b" \t\n\r\x0b\x0c"]] = SPACE
_KINDS[[*b"0123456789"]] = DIGIT
_KINDS[[c for c in range(128) if chr(c).isalpha()]] = LETTER
_SPACES_ONLY = np.where(_KINDS == SPACE, SPACE, OTHER).astype(np.uint8)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Is there a cut between two bytes, by 8 * kind of the first + kind of the second?
_CUT = np.array([SPACE in (a, b) and a != b or OTHER not in (a, b) and (a != b or a == DIGIT) for a in range(8) for b in range(8)])


def kinds(data: np.ndarray, usual: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The kind of each byte, and where letters of two bytes (Latin-1) start."""
    if not usual:
        return _SPACES_ONLY[data], np.empty(0, np.int64)
    kind = _KINDS[data]
    two = np.flatnonzero(data[:-1] == 0xC3)
    second = data[two + 1]
    two = two[(second >= 0x80) & (second < 0xC0) & (second != 0x97) & (second != 0xB7)]
    kind[two] = kind[two + 1] = LETTER
    return kind, two


def _parts(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 (one more than values) and bytes of a large binary array without nulls."""
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    return at - at[0], np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]


def _binary(ends: np.ndarray, data: np.ndarray) -> pa.Array:
    """A large binary array of values that end at these bytes."""
    offsets = np.concatenate([np.zeros(1, np.int64), ends])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def stretches(texts: pa.Array, usual: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All stretches of the texts in order, as large binary, and how many there are up to each text's end.

    ASCII and Latin-1 letters are lower-cased, but not beside other characters, with which they may combine.
    """
    offsets, data = _parts(texts)
    if not len(data):
        return pa.array([], pa.large_binary()), np.zeros(len(texts), np.int64)
    kind, two = kinds(data, usual)
    cut = np.ones(len(data), bool)
    cut[1:] = _CUT[(kind[:-1] << 3) | kind[1:]]
    cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    start = np.flatnonzero(cut)
    length = np.diff(start, append=len(data))
    full = kind[start] != SPACE
    start, length = start[full], length[full]
    ends = np.cumsum(length)
    low = _LOWER[data] if usual else data.copy()
    low[two[data[two + 1] < 0x9F] + 1] |= 0x20  # not in sharp s
    inside = kind != SPACE
    low = low[inside]
    others = np.flatnonzero(kind[inside] == OTHER)
    if usual and len(others):
        odd = np.zeros(len(start), bool)
        odd[np.searchsorted(ends, others, "right")] = True
        odd = np.repeat(odd, length)
        low[odd] = data[inside][odd]
    return _binary(ends, low), np.searchsorted(start, offsets[1:])


# --- byte pair encoding ---------------------------------------------------------------


class Pairs:
    """Ranks of pairs of tokens in hash tables: pairs that share a slot with another of one table stand in the next."""

    NONE = 1 << 24

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        rng = np.random.default_rng(0)
        bits = max(8, (8 * len(keys)).bit_length())
        self.shift, self.tables = np.uint64(64 - bits), []
        left = np.arange(len(keys))
        while len(left):
            best = None
            for _ in range(300 if len(left) < 5000 else 1):
                by = rng.integers(0, 1 << 64, dtype=np.uint64) | np.uint64(1)
                slot = (keys[left] * by) >> self.shift
                first = np.unique(slot, return_index=True)[1]
                if best is None or len(first) > len(best[2]):
                    best = by, slot, first
                if len(first) == len(left):
                    break
            by, slot, first = best
            held, of = np.full(1 << bits, ~np.uint64(0)), np.full(1 << bits, self.NONE, np.int32)
            held[slot[first]], of[slot[first]] = keys[left[first]], ranks[left[first]]
            self.tables.append((by, held, of))
            left = np.delete(left, first)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Ranks, ``NONE`` for pairs that don't merge."""
        rank = np.full(keys.shape, self.NONE, np.int32)
        for by, held, of in self.tables:
            slot = (keys * by) >> self.shift
            rank = np.where(held[slot] == keys, of[slot], rank)
        return rank


class BatchEncoder:
    """Encodes batches of texts, remembering at most ``REMEMBERED`` stretches."""

    _made: dict[int, BatchEncoder] = {}

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        rules = json.loads(spec)
        model = rules["model"]
        ids, self.usual = model.get("vocab", {}), False
        if (
            rules["normalizer"] == {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
            and rules["pre_tokenizer"]
            == {
                "type": "Sequence",
                "pretokenizers": [
                    {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True},
                    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
                ],
            }
            and all(re.fullmatch(r"<\|[a-z]+\|>", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in rules["added_tokens"])
            and model["type"] == "BPE"
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges"))
        ):
            letters, end = _byte_alphabet(), model["end_of_word_suffix"] or ""
            self.usual = all(letters[b] in ids and letters[b] + end in ids for b in range(256))
        if self.usual:
            self.inner, self.final = (np.array([ids[letters[b] + suffix] for b in range(256)], np.uint64) for suffix in ("", end))
            merges = {tuple(m.split(" ") if isinstance(m, str) else m): rank for rank, m in enumerate(model["merges"])}
            self.nothing = np.uint64(max(ids.values()) + 1)  # beside a word's last token
            self.pairs = Pairs(self._keys(*np.array([(ids[a], ids[b]) for a, b in merges], np.uint64).reshape(-1, 2).T), np.array([*merges.values()], np.int32))
            self.made = np.array([ids[a + b] for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])], np.uint64)
        self.forget()

    @classmethod
    def of(cls, spec: str) -> BatchEncoder:
        """One for each vocabulary in a worker process."""
        if hash(spec) not in cls._made:
            cls._made[hash(spec)] = cls(spec)
        return cls._made[hash(spec)]

    def forget(self) -> None:
        self.known, self.coded = pa.array([], pa.large_binary()), pa.array([], pa.large_binary())

    def _keys(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left * (self.nothing + np.uint64(1)) + right

    def merged(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of one length, word after word, and each word's number of them; ``letters``: bytes, a column for a word.

        The tokens stay at the place of their first byte, with the places of their neighbours.  Row ``n`` stands for no token.
        """
        n, words = letters.shape
        token = np.full((n + 1, words), self.nothing)
        token[: n - 1], token[n - 1] = self.inner[letters[:-1]], self.final[letters[-1]]
        place = np.arange(n + 1)[:, None]
        after, before = np.repeat(place + 1, words, 1), np.repeat(place - 1, words, 1)
        before[0] = n
        there = np.ones((n, words), bool)
        rank = np.full((n + 1, words), Pairs.NONE << 6, np.int32)  # of a token and the next, with its place in the lowest bits
        rank[:n] = self.pairs(self._keys(token[:-1], token[1:])) << 6 | place[:n]
        flat, flat_after, flat_before, flat_there, flat_rank = (x.reshape(-1) for x in (token, after, before, there, rank))
        while True:
            least = rank.min(0)
            word = np.flatnonzero(least < Pairs.NONE << 6)
            if not len(word):
                break
            least = least[word]
            here = least & 63
            at = here * words + word
            gone = flat_after[at] * words + word
            flat[at] = self.made[least >> 6]
            flat_there[gone] = False
            flat_rank[gone] = Pairs.NONE << 6
            next_place, last_place = flat_after[gone], flat_before[at]
            next_at, last_at = next_place * words + word, last_place * words + word
            flat_after[at], flat_before[next_at] = next_place, here
            both = self.pairs(self._keys(np.concatenate([flat[at], flat[last_at]]), np.concatenate([flat[next_at], flat[at]]))) << 6
            flat_rank[at], flat_rank[last_at] = both[: len(word)] | here, both[len(word) :] | last_place
        return token[:n].T[there.T].astype("<u4"), there.sum(0)

    def _by_library(self, runs: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Many stretches are one text for the library; its word numbers say which ids are whose."""
        ids, counts = [], []
        for at in range(0, len(runs), _TOGETHER):
            part = runs[at : at + _TOGETHER]
            coded = self.library.encode([run.decode("utf-8") for run in part], is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(coded.ids, "<u4"))
            counts.append(np.bincount(np.array(coded.word_ids, np.int64), minlength=len(part)))
        return ids, counts

    def learned(self, runs: pa.Array) -> pa.Array:
        """Packed ids of distinct stretches."""
        if not len(runs):
            return pa.array([], pa.large_binary())
        offsets, data = _parts(runs)
        length = np.minimum(np.diff(offsets), LONGEST + 1)
        length[np.searchsorted(offsets, np.flatnonzero(kinds(data, self.usual)[0] == OTHER), "right") - 1] = LONGEST + 1
        order = np.argsort(length, kind="stable")
        first = np.searchsorted(length[order], np.arange(1, LONGEST + 2))
        ids, counts = [], []
        for n, (begin, end) in enumerate(zip(first, first[1:]), 1):
            if begin < end:
                made, count = self.merged(data[offsets[order[begin:end]] + np.arange(n)[:, None]])
                ids.append(made)
                counts.append(count)
        more_ids, more_counts = self._by_library(runs.take(pa.array(order[first[-1] :])).to_pylist())
        coded = _binary(4 * np.cumsum(np.concatenate(counts + more_counts)), np.concatenate(ids + more_ids))
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return coded.take(pa.array(back))

    def parts(self, column: pa.Array, end: bytes) -> Iterator[tuple[int, np.ndarray, pa.Buffer]]:
        """The column's texts, some megabytes at a time: the first one's number, where each one's ids begin and end, and the ids."""
        texts = pc.fill_null(column.cast(pa.large_binary()), b"")
        offsets, at = _parts(texts)[0], 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _BATCH_BYTES, "right")) - 1)
            yield at, *self.encode(texts.slice(at, stop - at), end)
            at = stop

    def encode(self, texts: pa.Array, end: bytes) -> tuple[np.ndarray, pa.Buffer]:
        """The bytes where each text's ids begin and end, and the packed ids of all, ``end`` after each."""
        runs, upto = stretches(texts, self.usual)
        found = runs.dictionary_encode()
        distinct = found.dictionary
        place = pc.index_in(distinct, value_set=self.known)
        new = distinct.filter(pc.is_null(place))
        place = place.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        place[place < 0] = len(self.known) + np.arange(len(new))
        coded = pa.concat_arrays([self.coded, self.learned(new)])
        if len(coded) <= REMEMBERED:
            self.known, self.coded = pa.concat_arrays([self.known, new]), coded
        elif len(distinct) <= REMEMBERED:
            self.known, self.coded = distinct, coded.take(pa.array(place))
        else:
            self.forget()
        entries = np.insert(place[found.indices.to_numpy()], upto, len(coded))
        ids = pa.concat_arrays([coded, pa.array([end], pa.large_binary())]).take(pa.array(entries))
        at, data = _parts(ids)
        return at[np.concatenate([np.zeros(1, np.int64), upto + np.arange(1, len(upto) + 1)])], pa.py_buffer(data)
