"""BPE encoding and decoding: speculate and verify.

Greedy longest match proposes the tokens of each distinct word. A sequence is what BPE gives if, and only if, each
token is what BPE gives for its own bytes and each two neighbours are what it gives for theirs; the neighbours of all
words are tested at once, by undoing merges step by step in numpy. Only words with a failing pair are merged exactly.
The vocabulary is read from a public tokenizer's file on each executor and never trained.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm import common

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: How byte-level BPE cuts text into words; its merges never cross them.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose tokens a worker remembers, and the characters of a longer word, which it never does.
MEMO_WORDS, MEMO_CHARS = 1 << 18, 64
#: Characters of text that are cut into words at a time.
STRETCH = 1 << 20
_FAR = 1 << 30
_NEVER = (_FAR, -1)

ENCODED = "struct<ids: array<int>, n_tokens: int, round_trip: boolean>"


def _byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in vocabulary files of byte-level BPE."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bpe:
    """A byte-level vocabulary with its merges in order."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        signs = _byte_signs()
        special = {t for t in model["vocab"] if any(c not in signs for c in t)}
        made = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        self.size = max(model["vocab"].values()) + 1
        self.bytes: list[bytes] = [b""] * self.size
        for t, i in model["vocab"].items():
            if t not in special:
                self.bytes[i] = bytes(signs[c] for c in t)
        self.rank = np.full(self.size, -1, np.int64)
        self.left, self.right = np.arange(self.size), np.arange(self.size)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for (a, b), r in made.items():
            ia, ib, it = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            self.rank[it], self.left[it], self.right[it] = r, ia, ib
            self.merges[ia, ib] = r, it
        pairs = sorted((a * self.size + b, r) for (a, b), (r, _) in self.merges.items())
        self._pair_key, self._pair_rank = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        # an end-of-text token is not made by merges, so that no text matches it
        reached = np.array([len(t) == 1 for t in self.bytes]) | (self.rank >= 0)
        self.ids = {t: i for i, t in enumerate(self.bytes) if t and reached[i]}
        self._prefixes = {t[:n] for t in self.ids for n in range(1, len(t) + 1)}
        self._byte_id = [self.ids[bytes([b])] for b in range(256)]
        self._stable = np.full(self.size, -1, np.int8)
        self._split = regex.compile(PATTERN)
        self._flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self._ends = np.cumsum([len(t) for t in self.bytes])
        self._memo: dict[str, int] = {}
        self._table, self._table_at, self.failed = np.zeros(0, np.int32), np.zeros(1, np.int64), 0

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, end = [], 0, len(word)
        while at < end:
            n = best = 1
            while at + n <= end and (part := word[at : at + n]) in self._prefixes:
                if part in self.ids:
                    best = n
                n += 1
            out.append(self.ids[word[at : at + best]])
            at += best
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE: the first of the lowest-ranked pairs is merged until none is left."""
        ids = [self._byte_id[b] for b in word]
        n, get = len(ids), self.merges.get
        if n <= 32:  # looking at every pair again is quicker than a heap
            found = [get(p, _NEVER) for p in zip(ids, ids[1:])]
            while found and (best := min(found)) is not _NEVER:
                i = found.index(best)
                ids[i : i + 2] = [best[1]]
                del found[i]
                if i < len(found):
                    found[i] = get((ids[i], ids[i + 1]), _NEVER)
                if i:
                    found[i - 1] = get((ids[i - 1], ids[i]), _NEVER)
            return ids
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.merges[a, b][1], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if m := self.merges.get((ids[i], ids[k])):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (m := self.merges.get((ids[h], ids[i]))):
                heapq.heappush(heap, (m[0], h, ids[h], ids[i]))
        return [t for t in ids if t >= 0]

    def stable(self, tokens: np.ndarray) -> np.ndarray:
        """Whether each token is what BPE gives for its bytes."""
        for t in np.unique(tokens[self._stable[tokens] < 0]):
            self._stable[t] = self.merge(self.bytes[t]) == [t]
        return self._stable[tokens] == 1

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves each two tokens apart: no merge across their border comes before one that made them."""
        ok, at = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), _FAR)
        while len(at):
            key = a * self.size + b
            i = np.minimum(np.searchsorted(self._pair_key, key), len(self._pair_key) - 1)
            broken = (self._pair_key[i] == key) & (self._pair_rank[i] < limit)
            ok[at[broken]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~broken & ((ra >= 0) | (rb >= 0))
            a, b, ra, rb, at = a[go], b[go], ra[go], rb[go], at[go]
            first = ra > rb
            # of two merges of one rank the left one comes first, hence the 1
            limit = np.where(first, ra, rb + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return ok

    def words(self, words: list[str]) -> list[list[int]]:
        """The tokens of each word."""
        raw = [w.encode() for w in words]
        out = [self.propose(w) for w in raw]
        n = np.array([len(x) for x in out])
        flat = np.array([t for x in out for t in x], np.int64)
        owner = np.repeat(np.arange(len(out)), n)
        wrong = owner[~self.stable(flat)]
        inner = owner[1:] == owner[:-1]
        pairs, back = np.unique(np.stack([flat[:-1][inner], flat[1:][inner]]), axis=1, return_inverse=True)
        wrong = np.concatenate([wrong, owner[1:][inner][~self.compatible(*pairs)[back.ravel()]]])
        for i in np.unique(wrong):
            out[i] = self.merge(raw[i])
        self.failed += len(np.unique(wrong))
        return out

    def cut(self, text: str) -> Iterator[list[str]]:
        """The words of ``text``, a stretch at a time; stretches end before a single blank between two signs."""
        at = 0
        while at < len(text):
            end = at + STRETCH
            while end < len(text) and not (text[end] == " " and not text[end - 1].isspace() and end + 1 < len(text) and not text[end + 1].isspace()):
                end += 1
            yield self._split.findall(text, at, end) if end >= len(text) else self._split.findall(text[at:end])
            at = end

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The tokens of each text."""
        if len(self._memo) > MEMO_WORDS:
            self._memo, self._table, self._table_at = {}, np.zeros(0, np.int32), np.zeros(1, np.int64)
        out: list[list[np.ndarray]] = [[] for _ in texts]
        waiting, size = [], 0
        for i, text in enumerate(texts):
            for words in self.cut(text):
                waiting.append((i, words))
                size += len(words)
                if size > STRETCH // 4:
                    self._flush(waiting, out)
                    waiting, size = [], 0
        self._flush(waiting, out)
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.zeros(0, np.int32) for x in out]

    def _flush(self, waiting: list[tuple[int, list[str]]], out: list[list[np.ndarray]]) -> None:
        words = [w for _, ws in waiting for w in ws]
        new = [w for w in set(words) if w not in self._memo]
        long = [w for w in new if len(w) > MEMO_CHARS]
        if new:
            found = self.words(new)
            base = len(self._table_at) - 1
            self._memo |= {w: base + i for i, w in enumerate(new)}
            self._table = np.concatenate([self._table, np.array([t for x in found for t in x], np.int32)])
            self._table_at = np.concatenate([self._table_at, self._table_at[-1] + np.cumsum([len(x) for x in found])])
        at = np.fromiter(map(self._memo.__getitem__, words), np.int64, len(words))
        ids, n = common.gather(self._table, self._table_at[at], self._table_at[at + 1])
        end = np.concatenate([[0], np.cumsum(n)])
        place = 0
        for i, ws in waiting:
            out[i].append(ids[end[place] : end[place + len(ws)]])
            place += len(ws)
        for w in long:
            del self._memo[w]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence; an id that is not in the vocabulary is an IndexError."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise IndexError("token id outside the vocabulary")
        return common.gather(self._flat, np.concatenate([[0], self._ends])[ids], self._ends[ids])[0].tobytes()


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """The vocabulary, once for each worker."""
    return Bpe(path)


def encode(text: Column, path: str = VOCABULARY) -> Column:
    """ids, n_tokens and round_trip, as a struct, for each text.

    A null text has nulls, the empty text no tokens. ``round_trip`` says that decoding gives the text's bytes again.
    Texts of any length are encoded whole; strings that look like special tokens are ordinary text.
    """

    @F.arrow_udf(ENCODED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = load(path)
        for texts in batches:
            null = np.asarray(texts.is_null())
            raw = ["" if t is None else t for t in texts.to_pylist()]
            found = bpe.encode(raw)
            n = np.array([len(x) for x in found], np.int32)
            same = [bpe.decode(x) == t.encode() for x, t in zip(found, raw, strict=True)]
            at = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), mask=np.append(null, False)) if null.any() else pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            ids = pa.ListArray.from_arrays(at, pa.array(np.concatenate([np.zeros(0, np.int32), *found])))
            yield pa.StructArray.from_arrays([ids, pa.array(n, mask=null), pa.array(same, mask=null)], ["ids", "n_tokens", "round_trip"])

    return run(text)


def decode(ids: Column, path: str = VOCABULARY) -> Column:
    """The text of each sequence of ids; null for null, bytes that are no UTF-8 become U+FFFD."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = load(path)
        for lists in batches:
            yield pa.array([None if x is None else bpe.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in lists.to_pylist()], pa.string())

    return run(ids)


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """doc_id, ids, n_tokens and round_trip, a row for every row of ``df``; see ``encode``. Other columns are ignored."""
    common.bound_batches(df.sparkSession)
    rows = common.pick(df, doc_id=id_col, text=text_col)
    return rows.select("doc_id", encode(F.col("text"), path).alias("r")).select("doc_id", "r.*")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` as tokens, decoded again."""
    return encode_documents(common.table(spark, sf_dir, "documents"))
