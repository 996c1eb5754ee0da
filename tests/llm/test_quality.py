import math
from collections import Counter

import numpy as np
import pytest
from conftest_llm import ODD, SF, clash, rows
from pyspark.sql import functions as F

from lodestore.llm import quality


def by_hand(text):
    """The measures, one word at a time, straight from the libraries."""
    m = quality.meter(quality.TOKENS, quality.PIECES)
    words = text.split()
    tokens = [t for w in words for t in m.bpe.encode_ordinary(" " + w)]
    pieces = [p for w in words for p in m.pieces.encode(w)]
    n = len(tokens)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(tokens).values()) if n else 0
    return n, sum(len(w) + 1 for w in words) / max(1, n), sum(m.pieces.is_byte(p) for p in pieces) / max(1, len(pieces)), bits / math.log2(n) if n > 1 else 0


def test_measures(spark):
    texts = ["a b  c\n déjà vu " * 9, "日本語 ᚠᚢᚦ \U0001f9ff", "", " \n", "x" * 5000, "one"] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    got = quality.meter(quality.TOKENS, quality.PIECES).measure(texts)
    for g, t in zip(got, texts, strict=True):
        assert g == pytest.approx(by_hand(t), abs=1e-9)
    assert got[1][2] > 0.2


def test_script():
    assert [quality.script(t) for t in ("abc дa", "привет a", "123 !", "日本", "", "{}{}[]^_~§×÷ 1", "{}{}[]^_~ д", "\U0001f9ff\U00020000")] == ["Latn", "Cyrl", "Zyyy", "Hani", "Zyyy", "Zyyy", "Cyrl", "Zyyy"]


def test_bands_by_hand(spark):
    """Every verdict, from the measures, with numpy: no value may lie so near an edge that rounding decides."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    junk = spark.createDataFrame([(10_000 + i, "\u16a0\u16a2 ᚦᚨ " * 20 if i % 2 else "word " * 300, "en" if i < 6 else "xx", "s", 1) for i in range(9)], df.schema)
    docs = df.unionByName(junk)
    got = {r.doc_id: r for r in quality.fertility(docs).collect()}
    assert len(got) == docs.count()
    lower = lambda x, q: np.sort(x)[max(0, math.ceil(q * len(x)) - 1)]
    seen = set()
    for lang in ("en", "de", "fr", "es", "xx"):
        own = [r for r in got.values() if r.band == lang and r.n_tokens >= quality.MIN_TOKENS]
        n, c, s, e = (np.array([r[k] for r in own], float) for k in ("n_tokens", "chars_per_token", "byte_share", "entropy"))
        c = (c - lower(c, 0.5)) / np.sqrt(1 / n + 1 / quality.SETTLED)
        e = e - (np.polyfit(np.log2(n), e, 1)[0] if len({*n}) > 1 else 0) * np.log2(n)
        why = np.full((len(own), 3), "", object)
        for j, (x, k) in enumerate(((c, "chars_per_token"), (s, "byte_share"), (e, "entropy"))):
            q = [lower(x, p) for p in (0.25, 0.5, 0.75)]
            off = abs(x - q[1]) / (max(quality.LEAST[k], (q[2] - q[0]) / 1.349) * quality.WIDTHS[k])
            clear = abs(off - 1) > 0.01
            assert clear.mean() > 0.98
            why[off > 1, j] = k
            why[~clear, j] = "?"
        for r, w in zip(own, why, strict=True):
            if "?" not in w:
                assert r.reason == ",".join(x for x in w if x) and r.accepted == (r.reason == ""), (r, w)
                seen.add(r.reason)
    assert {"", "chars_per_token", "byte_share", "entropy"} <= {x for r in seen for x in (r, *r.split(","))}


def test_verdicts_do_not_depend_on_partitions(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert rows(quality.fertility(df.repartition(7))) == rows(quality.fertility(df.coalesce(1)))


def test_rejects_junk_and_keeps_clean(spark):
    d = "/root/testdata/sf0.1"
    got = quality.fertility(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").groupBy("quality").agg(F.avg(F.col("accepted").cast("int")).alias("kept"))
    kept = {r.quality: r.kept for r in got.collect()}
    assert kept[1] > 0.985 and kept[0] < 0.15


def test_odd(odd, none):
    got = quality.fertility(odd)
    assert got.count() == len(ODD)
    assert rows(quality.fertility(clash(odd).withColumn("band", F.lit("c")).withColumn("middle", F.lit(0)))) == rows(got)
    assert quality.fertility(none).collect() == [] and quality.drop_rejected(none).collect() == []
    by = {r.doc_id: r for r in got.collect()}
    assert by[3].reason == by[4].reason == by[5].reason == by[8].reason == "empty" and by[5].n_tokens is None
    assert by[1].accepted and by[9].accepted and by[4].band == "Zyyy"
    kept = quality.drop_rejected(clash(odd))
    assert kept.columns == clash(odd).columns and kept.count() == got.filter("accepted").count()
