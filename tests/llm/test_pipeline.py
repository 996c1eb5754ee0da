import hashlib
import itertools
import math
import re
from collections import defaultdict

import __spark_entry__
import numpy as np
import pytest
from conftest_llm import ODD, SF, clash, rows
from pyspark.sql import functions as F
from test_near_dedup import find, hashes
from test_quality import by_hand

import corpus_pipeline
from lodestore.llm import language_id, line_dedup, near_dedup, packing, quality


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What each stage returned, written and read."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_stages_are_the_operators(spark, kept):
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    columns = whole.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "line_dedup", "near_dedup", "packing"]
    assert all(sorted(b.columns) == sorted(columns) for _, b in kept[:-1])
    for (before, after), told in zip(kept[:2], (lambda d: language_id.identify(d, language_id.train(d)), quality.fertility), strict=True):
        want = {r.doc_id for r in told(before).filter("accepted").collect()}
        assert rows(after) == rows(before.filter(F.col("doc_id").isin(want)))
    before, after = kept[2]
    want = line_dedup.dedup_lines(before)
    assert rows(after.select("doc_id", "text")) == rows(want.select("doc_id", "text"))
    assert after.filter("n_chars <> length(text)").count() == 0
    before, after = kept[3]
    want = {r.doc_id for r in near_dedup.near_copies(before).filter("not is_duplicate").collect()}
    assert rows(after) == rows(before.filter(F.col("doc_id").isin(want))) and after.count() == len(want) < before.count()
    before, after = kept[4]
    assert rows(after) == rows(packing.pack(before))


def test_clean_documents_stay(spark, kept):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = kept[0][0].join(labels.filter("quality = 1"), "doc_id")
    left = kept[1][1].join(labels.filter("quality = 1"), "doc_id")
    assert left.count() >= 0.98 * good.count()
    bad = labels.filter("quality = 0")
    assert kept[1][1].join(bad, "doc_id").count() <= 0.2 * bad.count()


def test_run(spark, kept):
    assert rows(__spark_entry__.queries()["pipeline"](spark, SF)) == rows(kept[-1][1])


def test_odd(spark, odd, none):
    for docs, n in ((clash(odd), len(ODD)), (none, 0)):
        columns = docs.columns
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            assert i == 4 or out.columns == columns
            assert out.count() <= n or i == 4


def brute_languages(network, docs):
    """Windows one by one, filters as sums over one-hot bytes."""
    out = []
    for d in docs:
        raw = (d["text"] or "").encode()
        total = np.zeros(len(network.classes))
        for at in range(0, len(raw), 256):
            real = len(raw[at : at + 256])
            hot = np.eye(256)[list(raw[at : at + 256].ljust(256, b"\0"))]
            top = []
            for w, table in zip((2, 3, 4), network.tables):
                top.append(np.max(sum(hot[j : 256 - w + 1 + j] @ table[j] for j in range(w)), axis=0))
            z = np.maximum(np.concatenate(top) + network.bias, 0) @ network.out + network.out_bias
            total += real * np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        sure = total.max() / max(1, len(raw))
        assert abs(sure - 0.5) > 1e-4
        if d["text"] is not None and raw and (len(raw) < 32 or network.classes[total.argmax()] != "und" and sure >= 0.5):
            out.append(d)
    return out


def brute_rules(docs):
    lower = lambda x, q: sorted(x)[max(0, math.ceil(q * len(x)) - 1)]
    found = [(d, *by_hand(d["text"])) for d in docs]
    bad = {id(d) for d, n, *_ in found if not n}
    for lang in {d["lang"] for d in docs} - {None}:
        own = [x for x in found if x[0]["lang"] == lang and x[1] >= 32]
        step = lambda x, s: np.rint(np.asarray(x) / s) * s
        n = np.array([x[1] for x in own], float)
        slope = round(float(np.polyfit(np.log2(n), [x[4] for x in own], 1)[0]), 6)
        chars = np.array([x[2] for x in own])
        chars = (chars - lower(step(chars, 0.001), 0.5)) / np.sqrt(1 / n + 1 / 1600)
        for v, s, least, width in ((chars, 0.001, 0.25, 4.5), (np.array([x[3] for x in own]), 1e-5, 0.01, 8.0), (np.array([x[4] for x in own]) - slope * np.log2(n), 1e-5, 0.01, 4.5)):
            a, m, b = (lower(step(v, s), q) for q in (0.25, 0.5, 0.75))
            reach = max((b - a) / 1.349, least) * width
            bad |= {id(x[0]) for x, y in zip(own, v) if not m - reach <= y <= m + reach}
    return [d for d in docs if id(d) not in bad]


def brute_lines(docs):
    normal = lambda line: re.sub("[ \t\r]+", " ", line).strip(" ").lower()
    held = defaultdict(set)
    for d in docs:
        for line in d["text"].split("\n"):
            held[normal(line)].add(d["doc_id"])
    gone = {line: min(ids) for line, ids in held.items() if line and len(ids) > 20}
    out = []
    for d in docs:
        lines = d["text"].split("\n")
        left = [x for x in lines if gone.get(normal(x), d["doc_id"]) == d["doc_id"]]
        out.append(d if len(left) == len(lines) else d | {"text": "\n".join(left), "n_chars": len("\n".join(left))})
    return out


def brute_near(docs):
    """All pairs: near by both hashes, and within the radius or alike under some mask."""
    own = [(d, near_dedup.fingerprint(h)) for d in docs if len(h := hashes(d["text"]))]
    fp = np.array([p for _, p in own], np.int64).view(np.uint64)
    parent = list(range(len(own)))
    for i in range(len(own) - 1):
        d = np.bitwise_count(fp[i + 1 :] ^ fp[i]).astype(int)
        for j in np.flatnonzero((d[:, :2].sum(1) <= 22) & (d[:, 2:].sum(1) <= 34)):
            gap = fp[i] ^ fp[i + 1 + j]
            alike = any(not gap[half] & mask for half, mask in near_dedup.TABLES)
            assert alike or d[j, :2].sum() > 13
            if alike:
                parent[find(parent, i + 1 + int(j))] = find(parent, i)
    first = {}
    for i, (d, _) in enumerate(own):
        first[find(parent, i)] = min(first.get(find(parent, i), d["doc_id"]), d["doc_id"])
    gone = {d["doc_id"] for i, (d, _) in enumerate(own) if first[find(parent, i)] != d["doc_id"]}
    return [d for d in docs if d["doc_id"] not in gone]


def brute_packing(docs):
    pieces = []
    for d in docs:
        words = [w for w in re.split("[ \t\n\r]+", d["text"]) if w]
        at = 0
        for size in itertools.chain([4096] * (len(words) // 4096), (1 << b for b in reversed(range(12)) if len(words) >> b & 1)):
            pieces.append((d["doc_id"], at, size, " ".join(words[at : at + size])))
            at += size
        assert at == len(words)
    shards = {n: max(1, -(-sum(p[2] for p in pieces if p[2] == n) // (4 << 20))) for n in {p[2] for p in pieces}}
    buckets = defaultdict(list)
    for p in pieces:
        key = int(hashlib.md5(f"{p[0]}/{p[1]}/{p[3]}".encode()).hexdigest()[:15], 16)
        buckets[p[2], key % shards[p[2]]].append(p)
    return [(i, a, n, s, k // (16384 // n), k % (16384 // n), t) for (n, s), own in buckets.items() for k, (i, a, _, t) in enumerate(sorted(own))]


def test_run_against_brute_force(spark, tmp_path):
    """Stage by stage, and the whole, with nothing of the operators but the network's weights, masks and word hashes."""
    d = str(tmp_path)
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = np.random.default_rng(5)
    digits = ["".join(rng.choice(list("0123456789abcdef"), 700)) for _ in range(12)]
    planted = [(100_000 + i, t, None, "s", 1) for i, t in enumerate([*digits, None, "", " \n ", "日本語" * 90])]
    given.unionByName(spark.createDataFrame(planted, given.schema)).coalesce(3).write.parquet(f"{d}/documents.parquet")
    whole = spark.read.parquet(f"{d}/documents.parquet")
    docs = [r.asDict() for r in whole.collect()]
    network = language_id.train(whole)
    sizes = [len(docs)]
    for stage in (lambda x: brute_languages(network, x), brute_rules, brute_lines, brute_near):
        docs = stage(docs)
        sizes.append(len(docs))
    assert sizes[0] >= sizes[1] + len(planted) - 1 and sizes[1] > sizes[2] == sizes[3] > sizes[4] > 0.5 * sizes[0], sizes
    got = corpus_pipeline.run(spark, d).select("doc_id", "start", "length", "shard", "batch", "slot", "tokens").collect()
    assert sorted(map(tuple, got)) == sorted(brute_packing(docs))
