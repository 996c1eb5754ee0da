"""Language ID: a byte convolutional network, trained in numpy on labelled text.

Filters of several widths slide over the bytes of fixed-length windows; each filter keeps its largest response in the
window, and a softmax over those names the language. A filter over one-hot bytes is a table of 256 weights for each
of its places, so a convolution is a few table look-ups and sums, with no matrix product. Every window of every text
is classified; a document's probabilities are its windows', weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestore.llm import common

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
#: The bound of training: at most so many distinct windows of labelled texts, as many of each label by lowest hash.
TRAIN_WINDOWS = 8000
EPOCHS, BATCH, RATE = 6, 64, 0.01
#: A document whose best language has less probability is rejected, if it has at least MIN_BYTES to judge it by.
MIN_CONFIDENCE, MIN_BYTES = 0.5, 32
#: The class of bytes that are no language: digits, symbols, encoded data, unassigned scripts.
NONE = "und"
_CHUNK = 64

RESULT = "struct<language: string, confidence: double, accepted: boolean>"


def windows(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts ``raw[start:end]``, zero-padded, with each one's text and its number of real bytes."""
    n = -(-(end - start) // WINDOW)
    doc = np.repeat(np.arange(len(n)), n)
    first = start[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
    real = np.minimum(WINDOW, end[doc] - first)
    at = np.arange(WINDOW)
    x = raw[np.minimum(first[:, None] + at, max(0, len(raw) - 1))] if len(doc) else np.zeros((0, WINDOW), np.uint8)
    x[at >= real[:, None]] = 0
    return x, doc, real


class Network:
    """The weights; ``tables[w]`` is (width, 256, FILTERS)."""

    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = rng.normal(0, 0.3, (FILTERS * len(WIDTHS), len(classes))).astype(np.float32)
        self.out_bias = np.zeros(len(classes), np.float32)
        self._pairs: list | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_pairs": None}

    def _look_up(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """The filters' responses (windows, places, FILTERS), for each width; two places at a time share a table."""
        if self._pairs is None:
            self._pairs = [[(t[j][:, None] + t[j + 1][None]).reshape(65536, FILTERS) if j + 1 < w else t[j] for j in range(0, w, 2)] for w, t in zip(WIDTHS, self.tables, strict=True)]
        two = (x[:, :-1].astype(np.uint16) << 8) | x[:, 1:]
        for w, tables in zip(WIDTHS, self._pairs, strict=True):
            n, sums = WINDOW - w + 1, None
            for j, table in zip(range(0, w, 2), tables, strict=True):
                part = np.take(table, (two if len(table) > 256 else x)[:, j : j + n], axis=0)
                sums = part if sums is None else np.add(sums, part, out=sums)
            yield sums

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(windows, classes) of softmax over max-pooled filters."""
        probs = np.empty((len(x), len(self.classes)), np.float32)
        for i in range(0, len(x), _CHUNK):
            top = []
            for s in self._look_up(x[i : i + _CHUNK]):
                n = s.shape[1]
                while n > 1:  # halves compare as long contiguous runs
                    np.maximum(s[:, : n // 2], s[:, n - n // 2 : n], out=s[:, : n // 2])
                    n -= n // 2
                top.append(s[:, 0])
            z = np.maximum(np.concatenate(top, 1) + self.bias, 0) @ self.out + self.out_bias
            e = np.exp(z - z.max(1, keepdims=True))
            probs[i : i + _CHUNK] = e / e.sum(1, keepdims=True)
        return probs

    def gradients(self, b: np.ndarray, t: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The mean cross entropy of windows ``b`` with classes ``t``, and its gradient by each parameter.

        Max pooling sends a filter's gradient to the bytes at its largest place only.
        """
        f = np.arange(FILTERS)
        tops, places = [], []
        for w, table in zip(WIDTHS, self.tables, strict=True):
            s = sum(table[j][b[:, j : j + WINDOW - w + 1]] for j in range(w))
            places.append(s.argmax(1))
            tops.append(np.take_along_axis(s, places[-1][:, None], 1)[:, 0])
        pre = np.concatenate(tops, 1) + self.bias
        h = np.maximum(pre, 0)
        z = h @ self.out + self.out_bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        own = np.arange(len(t)), t
        loss = float(-np.log(np.maximum(p[own], 1e-30)).mean())
        p[own] -= 1
        p /= len(t)
        dh = (p @ self.out.T) * (pre > 0)
        grads = []
        for k, (w, place) in enumerate(zip(WIDTHS, places, strict=True)):
            g = np.zeros_like(self.tables[k])
            for j in range(w):
                np.add.at(g[j], (np.take_along_axis(b, place + j, 1), f[None]), dh[:, k * FILTERS : (k + 1) * FILTERS])
            grads.append(g)
        return loss, [*grads, dh.sum(0), h.T @ p, p.sum(0)]

    def parameters(self) -> list[np.ndarray]:
        return [*self.tables, self.bias, self.out, self.out_bias]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
        """Adam on the cross entropy."""
        rng = np.random.default_rng(seed)
        params = self.parameters()
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(order), BATCH):
                _, grads = self.gradients(x[order[i : i + BATCH]], y[order[i : i + BATCH]])
                step += 1
                for q, g, mm, vv in zip(params, grads, m, v, strict=True):
                    mm += 0.1 * (g - mm)
                    vv += 0.001 * (g * g - vv)
                    q -= RATE * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
        self._pairs = None
        return self


def _no_language(n: int, rng: np.random.Generator) -> list[bytes]:
    """Stretches that are no language."""
    kinds = [b"0123456789abcdef", b"0123456789 .,:-\n", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", b"!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~ ", bytes(range(1, 256))]
    out = []
    for i in range(n):
        size = int(rng.integers(WINDOW // 4, WINDOW + 1))
        if (k := i % (len(kinds) + 1)) < len(kinds):
            out.append(bytes(rng.choice(np.frombuffer(kinds[k], np.uint8), size)))
        else:
            low = int(rng.choice([0x370, 0x400, 0x590, 0x600, 0x900, 0xE00, 0x3040, 0x4E00, 0xAC00]))
            out.append("".join(map(chr, rng.integers(low, low + 100, size // 2))).encode()[:WINDOW])
    return out


#: Hashes of windows are below it.
_HASHES = 1 << 62
_SAMPLE = "label string, h long, real int, piece binary"


def _window_hashes(x: np.ndarray, label: int) -> np.ndarray:
    """A hash of each row of ``x`` and of the label."""
    h = np.full(len(x), label, np.uint64)
    for word in x.view(np.uint64).T:
        h = common.mix(h ^ word)
    return (h % np.uint64(_HASHES)).astype(np.int64)


def _lowest(each: int, cuts: dict[str, int]):
    """Of each label, a task's ``each`` distinct windows with the lowest hashes under its cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, tuple[np.ndarray, ...]] = {}
        for b in batches:
            labels, marks = b.column(0).to_pylist(), np.array(b.column(1).to_pylist(), np.uint64)
            raw, start, end = common.utf8_buffer(b.column(2))
            for i, label in enumerate(labels):
                if label not in cuts:
                    continue
                x, _, real = windows(raw, start[i : i + 1], end[i : i + 1])
                h = _window_hashes(x, marks[i])
                under = h < (kept[label][0][-1] if label in kept and len(kept[label][0]) == each else cuts[label])
                if under.any():
                    new = h[under], real[under], x[under]
                    h, real, x = (np.concatenate(p) for p in zip(kept[label], new, strict=True)) if label in kept else new
                    h, first = np.unique(h, return_index=True)
                    kept[label] = h[:each], real[first][:each], x[first][:each]
        for label, (h, real, x) in kept.items():
            yield pa.record_batch([pa.array([label] * len(h)), pa.array(h), pa.array(real, pa.int32()), pa.array([w.tobytes() for w in x], pa.binary())], names=["label", "h", "real", "piece"])

    return run


def sample(df: DataFrame, text_col: str = "text", label_col: str = "lang", rows: int = TRAIN_WINDOWS) -> list[tuple[str, int, bytes]]:
    """(label, bytes, window) of at most ``rows`` distinct windows of labelled texts, as many of each label by lowest hash.

    All windows of all labelled texts are looked at. What comes to the driver is what is asked for and, since labels
    are cut by an estimate of their windows, about twice that.
    """
    common.bound_batches(df.sparkSession)
    named = common.pick(df, label=label_col, text=text_col).filter("text <> '' and label is not null").select(F.col("label").cast("string").alias("label"), F.xxhash64(F.col("label").cast("string")).bitwiseAND(_HASHES - 1).alias("mark"), "text")
    windowed = F.sum(F.ceil(F.octet_length("text") / WINDOW))
    # a row for each label
    counts = named.groupBy("label").agg((windowed * F.approx_count_distinct(F.xxhash64("text")) / F.count(F.lit(1))).alias("n")).collect()
    if not counts:
        return []
    each = max(1, rows // len(counts))
    share = {r.label: (2 * each + 50) / max(1, r.n) for r in counts}
    found: dict[str, dict[int, tuple[int, bytes]]] = {}
    while share:
        cuts = {label: int(min(1, s) * _HASHES) for label, s in share.items()}
        lowest = named.filter(F.col("label").isin(*cuts)) if len(cuts) < 100 else named
        got: dict[str, dict[int, tuple[int, bytes]]] = {label: {} for label in cuts}
        place = F.row_number().over(Window.partitionBy("label").orderBy("h"))
        for r in lowest.mapInArrow(_lowest(each, cuts), _SAMPLE).dropDuplicates(["label", "h"]).withColumn("place", place).filter(F.col("place") <= each).collect():
            got[r.label][r.h] = r.real, bytes(r.piece)
        # with fewer than asked for under its cut, a label is looked at again under a higher one
        found |= {label: got[label] for label, s in share.items() if s >= 1 or len(got[label]) == each}
        share = {label: 8 * s for label, s in share.items() if label not in found}
    return sorted((label, *own[h]) for label, own in found.items() for h in own)


def train(df: DataFrame, text_col: str = "text", label_col: str = "lang", rows: int = TRAIN_WINDOWS, epochs: int = EPOCHS) -> Network | None:
    """A network fitted on ``sample``: at most ``rows`` distinct windows of WINDOW bytes of the labelled texts of ``df``.

    Each label has a class, also a rare one, and copies count once; if there are more labels than ``rows``, each has one
    window. Rows without text or label are not used; where no row is labelled there is no network. The same rows give
    the same network, however they are partitioned.
    """
    pieces = sample(df, text_col, label_col, rows)
    if not pieces:
        return None
    rng = np.random.default_rng(3)
    classes = sorted({label for label, *_ in pieces} | {NONE})
    x = np.stack([np.frombuffer(p, np.uint8) for *_, p in pieces])
    real = np.array([n for _, n, _ in pieces])
    y = np.array([classes.index(label) for label, *_ in pieces])
    # some windows are cut short, as a document's last one is
    short = x[::3].copy()
    short[np.arange(WINDOW) >= np.minimum(real[::3], rng.integers(24, WINDOW, len(short)))[:, None]] = 0
    none = np.stack([np.frombuffer(p.ljust(WINDOW, b"\0"), np.uint8) for p in _no_language(max(32, len(x) // 8), rng)])
    return Network(classes).fit(np.concatenate([x, short, none]), np.concatenate([y, y[::3], np.full(len(none), classes.index(NONE))]), epochs)


def classify(network: Network | None, texts: pa.Array, min_confidence: float = MIN_CONFIDENCE) -> pa.Array:
    """What ``language`` gives, for one batch of texts."""
    n = len(texts)
    raw, start, end = common.utf8_buffer(texts)
    null = np.asarray(texts.is_null())
    if network is None:
        return pa.StructArray.from_arrays([pa.nulls(n, pa.string()), pa.array(np.zeros(n)), pa.array(~null)], ["language", "confidence", "accepted"])
    total = np.zeros((n, len(network.classes)))
    step = 4096 * WINDOW
    # a group of texts has about `step` bytes; a longer text is a group of its own and is cut into stretches
    cuts, size = [0], 0
    for i, length in enumerate(end - start):
        if size and size + length > step:
            cuts.append(i)
            size = 0
        size += length
    for a, b in zip(cuts, [*cuts[1:], n], strict=True):
        stretches = range(0, max(1, int((end - start)[a:b].max(initial=0))), step) if b - a == 1 else [0]
        for off in stretches:
            x, doc, real = windows(raw, start[a:b] + off, np.minimum(end[a:b], start[a:b] + off + step))
            np.add.at(total, a + doc, network.probabilities(x) * real[:, None])
    total /= np.maximum(end - start, 1)[:, None]
    best = total.argmax(1)
    sure = total.max(1)
    names = np.array(network.classes, object)[best]
    names[(end == start)] = NONE
    short = (end - start < MIN_BYTES) & (end > start)
    ok = (short | (names != NONE) & (sure >= min_confidence)) & ~null
    return pa.StructArray.from_arrays([pa.array(names, pa.string(), mask=null), pa.array(sure), pa.array(ok)], ["language", "confidence", "accepted"])


def language(network: Network | None, text: Column, min_confidence: float = MIN_CONFIDENCE) -> Column:
    """language, confidence and accepted, as a struct, for each text.

    A text is accepted if its language is known and has at least ``min_confidence``, or if it is shorter than
    MIN_BYTES, too little to reject it for. A null text has no language, no confidence and is rejected; the empty text
    and bytes that are no language are ``und`` and rejected. Without a network, no language can be told and every text
    but null is accepted. Equal texts have equal results.
    """

    @F.arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield classify(network, texts, min_confidence)

    return run(text)


def identify(df: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text", min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """doc_id, language, confidence and accepted, a row for every row of ``df``; see ``language``."""
    common.bound_batches(df.sparkSession)
    rows = common.pick(df, doc_id=id_col, text=text_col)
    return rows.select("doc_id", language(network, F.col("text"), min_confidence).alias("r")).select("doc_id", "r.*")


def drop_rejected(df: DataFrame, network: Network | None, text_col: str = "text", min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """The rows of ``df`` whose text ``language`` accepts, with all their columns."""
    common.bound_batches(df.sparkSession)
    told = df.withColumn("__language", language(network, F.col(f"`{text_col}`"), min_confidence))
    return told.filter(F.col("__language.accepted")).drop("__language")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document of ``documents``, by a network trained on its labels."""
    docs = common.table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
