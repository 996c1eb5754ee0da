"""Quality rules: tokeniser fertility.

Public vocabularies measure each text: characters per token and the entropy of its tokens under a byte-level BPE, and
the share of pieces that fall back to bytes under a piece vocabulary. Ordinary texts of a language lie close together
in all three; bands around the middle of each language, or of each script where no language is named, reject the rest.
A band is the median of all documents of the group, plus and minus so many deviations, which are taken from the
quartiles, so that a minority of junk moves it little. Quartiles come from counts of values in narrow steps, so they are
the same however documents are partitioned.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestore.llm import common

TOKENS, PIECES = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken", "/opt/tokenizers/piece_bpe_32k.model"
#: Half the width of a band, in deviations of the group: of characters per token, byte-fallback share and token entropy.
WIDTHS = {"chars_per_token": 4.5, "byte_share": 8.0, "entropy": 4.5}
#: The least deviation of each measure, for groups whose texts are all alike.
LEAST = {"chars_per_token": 0.25, "byte_share": 0.01, "entropy": 0.01}
#: A mean over n tokens strays by 1 / sqrt(n), but texts of any length differ by as much as those of so many tokens.
SETTLED = 1600
#: Steps in which values are counted for medians and quartiles.
STEPS = {"chars_per_token": 0.001, "byte_share": 0.00001, "entropy": 0.00001}
#: Texts with fewer tokens are too short to reject.
MIN_TOKENS = 32
#: Words that a worker remembers, and characters of a longer one, which it never does.
MEMO_WORDS, MEMO_CHARS = 1 << 18, 64
_GROUP = 1 << 20

MEASURES = "struct<n_tokens: long, chars_per_token: double, byte_share: double, entropy: double, script: string>"

#: First and last code point of scripts, and code points in them that are no letters; what is in none counts as ``Zyyy``.
SCRIPTS = [("Latn", 0x41, 0x24F), ("Grek", 0x370, 0x3FF), ("Cyrl", 0x400, 0x52F), ("Armn", 0x530, 0x58F), ("Hebr", 0x590, 0x5FF), ("Arab", 0x600, 0x77F), ("Deva", 0x900, 0x97F), ("Thai", 0xE00, 0xE7F), ("Hang", 0xAC00, 0xD7AF), ("Kana", 0x3040, 0x30FF), ("Hani", 0x4E00, 0x9FFF)]
#: Where each script's letters are counted: 0 for what is no letter, else the place in SCRIPTS and one.
_SCRIPT = np.zeros(0x10000, np.int8)
for _i, (_, _a, _z) in enumerate(SCRIPTS):
    _SCRIPT[[c for c in range(_a, _z + 1) if unicodedata.category(chr(c))[0] in "LM"]] = _i + 1


class Meter:
    """Counts tokens and pieces of words; each distinct word is encoded once."""

    def __init__(self, tokens: str, pieces: str):
        import sentencepiece
        import tiktoken

        from lodestore.llm.bpe import PATTERN

        with open(tokens, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("fertility", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        self._clear()

    def _clear(self) -> None:
        self.memo: dict[str, int] = {}
        self.flat, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.n_pieces, self.n_bytes, self.chars = (np.zeros(0, np.int64) for _ in range(3))

    def _learn(self, words: list[str]) -> None:
        found = [self.bpe.encode_ordinary(" " + w) for w in words]
        cut = self.pieces.encode(words, num_threads=1)
        n = np.array([len(x) for x in cut])
        fall = self.is_byte[np.array([i for x in cut for i in x], np.int64)]
        ends = np.concatenate([[0], np.cumsum(n)])
        sums = np.concatenate([[0], np.cumsum(fall)])
        base = len(self.at) - 1
        self.memo |= {w: base + i for i, w in enumerate(words)}
        self.flat = np.concatenate([self.flat, np.array([t for x in found for t in x], np.int32)])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum([len(x) for x in found])])
        self.n_pieces = np.concatenate([self.n_pieces, n])
        self.n_bytes = np.concatenate([self.n_bytes, sums[ends[1:]] - sums[ends[:-1]]])
        self.chars = np.concatenate([self.chars, [len(w) + 1 for w in words]])

    def measure(self, texts: list[str]) -> np.ndarray:
        """(texts, 4): tokens, characters per token, byte share and entropy in bits relative to the most there can be."""
        if len(self.memo) > MEMO_WORDS:
            self._clear()
        out = np.zeros((len(texts), 4))
        group: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            group.append(i)
            size += len(t)
            if size > _GROUP or i + 1 == len(texts):
                self._group(texts, group, out)
                group, size = [], 0
        return out

    def _group(self, texts: list[str], group: list[int], out: np.ndarray) -> None:
        each = [texts[i].split() for i in group]
        words = [w for ws in each for w in ws]
        new = [w for w in dict.fromkeys(words) if w not in self.memo]
        if new:
            self._learn(new)
        at = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        for w in new:
            if len(w) > MEMO_CHARS:
                del self.memo[w]
        n = np.array([len(ws) for ws in each])
        end = np.cumsum(n)
        start = end - n
        add = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[at])])[np.concatenate([[0], end])]) if len(end) else np.zeros(0)
        chars, pieces, fall = add(self.chars), add(self.n_pieces), add(self.n_bytes)
        ids, per = common.gather(self.flat, self.at[at], self.at[at + 1])
        places = np.concatenate([[0], np.cumsum(per)])
        for k, i in enumerate(group):
            own = ids[places[start[k]] : places[end[k]]]
            if not len(own):
                continue
            c = np.unique(own, return_counts=True)[1]
            total = len(own)
            bits = np.log2(total) - (c * np.log2(c)).sum() / total
            out[i] = total, chars[k] / total, fall[k] / max(1, pieces[k]), bits / np.log2(total) if total > 1 else 0


@lru_cache(maxsize=2)
def meter(tokens: str, pieces: str) -> Meter:
    return Meter(tokens, pieces)


def script(text: str) -> str:
    """The script of most letters of ``text``, of several the first; ``Zyyy`` for no letters of any in SCRIPTS."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    counts = np.bincount(_SCRIPT[points[points < len(_SCRIPT)]], minlength=len(SCRIPTS) + 1)[1:]
    return SCRIPTS[counts.argmax()][0] if counts.any() else "Zyyy"


def measures(text: Column, tokens: str = TOKENS, pieces: str = PIECES, scripts: Column | None = None) -> Column:
    """n_tokens, chars_per_token, byte_share, entropy and script, as a struct.

    A null text has nulls. A text without words has no tokens and noughts. Blanks other than one before each word
    don't count. ``scripts`` says where the script is needed; elsewhere it is null.
    """

    @F.arrow_udf(MEASURES)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        m = meter(tokens, pieces)
        for texts, asked in batches:
            null = np.asarray(texts.is_null())
            raw = ["" if t is None else t for t in texts.to_pylist()]
            x = m.measure(raw)
            names = [script(t) if a else None for t, a in zip(raw, asked.to_pylist(), strict=True)]
            yield pa.StructArray.from_arrays([pa.array(x[:, 0].astype(np.int64), mask=null), *(pa.array(x[:, k], mask=null) for k in (1, 2, 3)), pa.array(names, pa.string())], ["n_tokens", "chars_per_token", "byte_share", "entropy", "script"])

    return run(text, F.lit(True) if scripts is None else scripts)


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **vocabularies: str) -> DataFrame:
    """doc_id, lang, the row's keys k1 and k2, band (the language, else the script) and the measures of every row."""
    common.bound_batches(df.sparkSession)
    rows = common.pick(df, doc_id=id_col, text=text_col, lang=lang_col).withColumn("lang", F.col("lang").cast("string"))
    k1, k2 = common.row_keys("doc_id", "text")
    rows = rows.select("doc_id", "lang", k1.alias("k1"), k2.alias("k2"), measures(F.col("text"), scripts=F.col("lang").isNull(), **vocabularies).alias("m"))
    return rows.select("doc_id", "lang", "k1", "k2", F.coalesce("lang", "m.script").alias("band"), "m.n_tokens", "m.chars_per_token", "m.byte_share", "m.entropy")


def quantiles(rows: DataFrame, names: list[str], at: dict[str, float]) -> DataFrame:
    """band and, for each measure and quantile, its value: the least with so large a share of the documents up to it.

    Values are rounded to STEPS and counted, which no order of documents changes.
    """
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.rint(F.col(k) / STEPS[k]).cast("long").alias("v")) for k in names)))
    counts = rows.select("band", each.alias("e")).groupBy("band", "e.k", "e.v").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("band", "k")
    so_far = F.sum("n").over(own.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.select("band", "k", "v", so_far.alias("c"), F.sum("n").over(own).alias("total"))
    pick = [F.min(F.when((F.col("k") == k) & (F.col("c") >= q * F.col("total")), F.col("v") * STEPS[k])).alias(f"{q_name}_{k}") for k in names for q_name, q in at.items()]
    return placed.groupBy("band").agg(*pick)


def bands(rows: DataFrame, widths: dict[str, float] | None = None, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """A row for each band: the middle of characters per token, the slope of entropy, and lo_ and hi_ of each measure.

    Taken from all documents of the group with ``min_tokens`` tokens, however few. Characters per token are judged by
    their distance from the middle, relative to what texts of that length stray by, and entropy by its distance from the
    group's line over the logarithm of the length; ``strays`` has both.
    """
    widths = WIDTHS | (widths or {})
    long = rows.filter(F.col("n_tokens") >= min_tokens)
    slopes = long.groupBy("band").agg(F.round(F.coalesce(F.regr_slope("entropy", F.log2("n_tokens")), F.lit(0.0)), 6).alias("slope"))
    first = quantiles(long, ["chars_per_token"], {"middle": 0.5}).withColumnRenamed("middle_chars_per_token", "middle").join(slopes, "band")
    # a row for each band
    first = common.stash(first, "middles")
    found = quantiles(strays(long.join(first, "band")), list(widths), {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    edges = []
    for k, w in widths.items():
        # 1.349 deviations lie between the quartiles of a normal distribution
        reach = F.greatest((F.col(f"q3_{k}") - F.col(f"q1_{k}")) / 1.349, F.lit(LEAST[k])) * w
        edges += [(F.col(f"q2_{k}") - reach).alias(f"lo_{k}"), (F.col(f"q2_{k}") + reach).alias(f"hi_{k}")]
    return first.join(found, "band").select("band", "middle", "slope", *edges)


def strays(rows: DataFrame) -> DataFrame:
    """``rows``, with ``middle`` and ``slope`` of their band, with their measures as the bands judge them."""
    scale = F.sqrt(1 / F.greatest("n_tokens", F.lit(1)) + 1 / SETTLED)
    return rows.withColumns({"chars_per_token": (F.col("chars_per_token") - F.col("middle")) / scale, "entropy": F.col("entropy") - F.col("slope") * F.log2(F.greatest("n_tokens", F.lit(1)))})


def judged(rows: DataFrame, limits: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """``rows`` with ``reason``: the measures outside their band, ``empty`` for no words, else the empty string."""
    kept = rows.withColumns({f"own_{k}": F.col(k) for k in WIDTHS}).join(limits, "band", "left")
    outside = [F.when((F.col(k) < F.col(f"lo_{k}")) | (F.col(k) > F.col(f"hi_{k}")), F.lit(k)) for k in WIDTHS]
    reason = F.when(F.coalesce("n_tokens", F.lit(0)) == 0, "empty").when(F.col("n_tokens") < min_tokens, "").otherwise(F.concat_ws(",", *outside))
    return strays(kept).withColumn("reason", reason).drop(*WIDTHS).withColumnsRenamed({f"own_{k}": k for k in WIDTHS})


def fertility(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", widths: dict[str, float] | None = None, **vocabularies: str) -> DataFrame:
    """doc_id, band, the measures, reason and accepted, a row for every row of ``df``.

    A document is rejected if a measure lies outside the band of its language (of its script, where that is null).
    Texts of fewer than MIN_TOKENS tokens are accepted, which the README has figures of.
    Null texts (their measures are null) and texts without words are rejected as ``empty``. Repeated rows count as
    often as they come. Other columns are ignored. No rows give no rows.
    """
    rows = common.stash(measured(df, id_col, text_col, lang_col, **vocabularies), "measures")
    told = judged(rows, bands(rows, widths))
    return told.select("doc_id", "band", "n_tokens", "chars_per_token", "byte_share", "entropy", "reason", (F.col("reason") == "").alias("accepted"))


def drop_rejected(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how) -> DataFrame:
    """The rows of ``df`` that ``fertility`` accepts, with all their columns."""
    rows = common.stash(measured(df, id_col, text_col, lang_col), "measures")
    own = ["__fert_k1", "__fert_k2", "__fert_lang"]
    bad = judged(rows, bands(rows, **how)).filter("reason <> ''").select(*(F.col(c).alias(o) for c, o in zip(("k1", "k2", "lang"), own, strict=True))).distinct()
    k1, k2 = common.row_keys(id_col, text_col)
    keyed = df.withColumns({"__own_k1": k1, "__own_k2": k2})
    same = (F.col("__own_k1") == F.col(own[0])) & (F.col("__own_k2") == F.col(own[1])) & F.col(f"`{lang_col}`").cast("string").eqNullSafe(F.col(own[2]))
    return keyed.join(bad, same, "left_anti").drop("__own_k1", "__own_k2")


def op2_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` with its measures and verdict."""
    return fertility(common.table(spark, sf_dir, "documents"))
