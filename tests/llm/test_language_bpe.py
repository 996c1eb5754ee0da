import random

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import ODD, SF, clash, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestore.llm import bpe, language_id


@pytest.fixture(scope="session")
def network(spark):
    return language_id.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_language_held_out(spark, network):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    # trained on even rows, tried on odd ones
    half = language_id.train(df.filter("doc_id % 2 = 0"))
    got = language_id.identify(df.filter("doc_id % 2 = 1"), half).join(df, "doc_id").toPandas()
    judged = got[got["n_chars"] >= 40]
    assert (judged["language"] == judged["lang"]).mean() > 0.97
    assert got["accepted"].mean() > 0.98


def test_language_training_does_not_depend_on_partitions(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    a, b = (language_id.train(df.repartition(n), epochs=1) for n in (1, 5))
    assert all((x == y).all() for x, y in zip(a.tables, b.tables, strict=True)) and (a.out == b.out).all()


def test_language_rejects_what_is_none(network):
    rng = random.Random(1)
    texts = ["".join(rng.choice("0123456789abcdef") for _ in range(900)), "".join(rng.choice("ABCDEFGHIJKLMNOPqrstuvwxyz0123456789+/") for _ in range(2000)), "".join(chr(rng.randint(0x4E00, 0x4E60)) for _ in range(400)), "", None]
    got = language_id.classify(network, pa.array(texts)).to_pylist()
    assert [r["accepted"] for r in got] == [False] * 5
    assert [r["language"] for r in got] == ["und"] * 4 + [None]


def test_language_windows_and_long_texts(network):
    raw = np.frombuffer(b"abc" * 200 + b"x", np.uint8)
    x, doc, real = language_id.windows(raw, np.array([0, 600, 601]), np.array([600, 601, 601]))
    assert list(doc) == [0, 0, 0, 1] and list(real) == [256, 256, 88, 1] and x[2, 88:].sum() == 0 and b"".join(bytes(r[:n]) for r, n in zip(x, real)) == raw.tobytes()
    # look-ups in tables of two bytes give what the convolution does
    for s, w, table in zip(network._look_up(x), language_id.WIDTHS, network.tables):
        want = sum(table[j][x[:, j : j + 256 - w + 1]] for j in range(w))
        assert np.allclose(s, want, atol=1e-4)
    # a text that is classified by stretches has the mean of its windows
    text = "the and of with " * 100_000
    got = language_id.classify(network, pa.array([text]))[0].as_py()
    x, _, real = language_id.windows(np.frombuffer(text.encode(), np.uint8), np.array([0]), np.array([len(text)]))
    assert abs((network.probabilities(x) * real[:, None]).sum(0).max() / len(text) - got["confidence"]) < 1e-4


def test_language_odd(odd, none, network):
    got = language_id.identify(odd, network)
    assert got.count() == len(ODD)
    assert rows(language_id.identify(clash(odd), network)) == rows(got)
    assert language_id.identify(none, network).collect() == []
    assert language_id.train(none) is None
    by = {r.doc_id: r for r in got.collect()}
    assert by[5].language is None and not by[5].accepted and by[3].language == "und" and not by[3].accepted
    assert {r.accepted for r in language_id.identify(odd, None).filter("doc_id in (1, 3)").collect()} == {True}


@pytest.fixture(scope="session")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.VOCABULARY)
    t.encode_special_tokens = True
    return t


def test_bpe_is_the_tokenizers(spark, tokenizer):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = bpe.encode_documents(df).join(df, "doc_id").collect()
    want = tokenizer.encode_batch([r.text for r in got], add_special_tokens=False)
    assert [r.ids for r in got] == [w.ids for w in want]
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="aehst ' \n1.é日", max_size=80)), max_size=8))
def test_bpe_any_text(tokenizer, texts):
    b = bpe.load(bpe.VOCABULARY)
    found = b.encode(texts)
    assert [list(x) for x in found] == [t.ids for t in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [b.decode(x).decode() for x in found] == texts


def test_bpe_pairs_are_checked_as_merging_does():
    b = bpe.load(bpe.VOCABULARY)
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 50256, (2, 3000))
    keep = b.stable(x) & b.stable(y)
    x, y = x[keep], y[keep]
    want = [b.merge(b.bytes[i] + b.bytes[j]) == [i, j] for i, j in zip(x, y)]
    assert list(b.compatible(x, y)) == want
    # the heap and the scan merge alike
    for w in [b"e" * 300, b"the" * 90, bytes(rng.integers(97, 123, 500).astype(np.uint8)), b" " * 77]:
        scan, n = [b._byte_id[c] for c in w], 1
        while n:
            n = min((b.merges.get(p, bpe._NEVER) for p in zip(scan, scan[1:])), default=bpe._NEVER)
            if n == bpe._NEVER:
                break
            i = next(i for i, p in enumerate(zip(scan, scan[1:])) if b.merges.get(p) == n)
            scan[i : i + 2] = [n[1]]
        assert b.merge(w) == scan


def test_bpe_stretches_cut_nothing(tokenizer, monkeypatch):
    text = "Ab c  d\n\n e'll 12 " * 60 + "x" * 300
    monkeypatch.setattr(bpe, "STRETCH", 50)
    assert list(bpe.load(bpe.VOCABULARY).encode([text])[0]) == tokenizer.encode(text, add_special_tokens=False).ids


def test_bpe_odd(odd, none):
    got = bpe.encode_documents(odd)
    assert got.count() == len(ODD)
    assert rows(bpe.encode_documents(clash(odd))) == rows(got)
    assert bpe.encode_documents(none).collect() == []
    by = {r.doc_id: r for r in got.collect()}
    assert by[5].ids is None and by[5].n_tokens is None and by[3].ids == [] and by[3].round_trip
    back = odd.withColumn("ids", bpe.encode(F.col("text"))["ids"]).withColumn("again", bpe.decode(F.col("ids")))
    assert back.filter("not (text <=> again)").count() == 0


def test_a_rare_label_is_trained_and_copies_count_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language_id.Network, "fit", lambda self, x, y, *a, **k: seen.append((self.classes, x, y)) or self)
    docs = [(f"the text number {i} of the frequent label", "en") for i in range(3000)] + [("one copy of many, again and again and again", "en")] * 30_000 + [("ein seltener Text von nur einer Zeile", "de"), ("x", "fr")]
    df = spark.createDataFrame(docs, "text string, lang string")
    for n in (1, 4):
        language_id.train(df.repartition(n), rows=100)
    assert (seen[0][1] == seen[1][1]).all() and (seen[0][2] == seen[1][2]).all() and seen[0][0] == ["de", "en", "fr", language_id.NONE]
    assert len(seen[0][1]) < 100 + 100 // 3 + 32 + 10


def test_the_sample_is_the_lowest_windows_and_bounded(spark):
    texts = [(f"{'long text ' * 200}{i} " + "end " * (i % 90), "en" if i % 3 else "de") for i in range(300)]
    df = spark.createDataFrame(texts + texts[:1] * 20_000, "text string, lang string")
    got = language_id.sample(df, rows=200)
    want = {}
    for text, label in texts:
        raw = np.frombuffer(text.encode(), np.uint8)
        for i in range(0, len(raw), language_id.WINDOW):
            w = raw[i : i + language_id.WINDOW]
            want.setdefault(label, {})[w.tobytes().ljust(language_id.WINDOW, b"\0")] = len(w)
    for label in ("de", "en"):
        own = {p: n for k, n, p in got if k == label}
        assert len(own) == min(100, len(want[label])) == sum(k == label for k, *_ in got) and all(want[label][p] == n for p, n in own.items())
        mark = df.select(F.xxhash64(F.lit(label)).bitwiseAND(language_id._HASHES - 1)).first()[0]
        every = sorted(want[label], key=lambda p: int(language_id._window_hashes(np.frombuffer(p, np.uint8)[None], np.uint64(mark))[0]))
        assert set(own) == set(every[:100])


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    net = language_id.Network(["a", "b", "c"], seed=3)
    for name in ("bias", "out", "out_bias"):
        setattr(net, name, rng.normal(0, 0.3, getattr(net, name).shape))
    net.tables = [t.astype(np.float64) for t in net.tables]
    x = rng.integers(0, 256, (5, language_id.WINDOW)).astype(np.uint8)
    y = np.array([0, 1, 2, 1, 0])
    loss, grads = net.gradients(x, y)
    assert abs(loss + np.log(net.probabilities(x)[np.arange(5), y]).mean()) < 1e-4
    tried = 0
    for p, g in zip(net.parameters(), grads, strict=True):
        assert p.shape == g.shape
        flat, own = p.reshape(-1), g.reshape(-1)
        for i in {*np.argsort(-abs(own))[:15].tolist(), *rng.integers(0, own.size, 5).tolist()}:
            was, step = flat[i], 1e-6
            flat[i] = was + step
            up = net.gradients(x, y)[0]
            flat[i] = was - step
            down = net.gradients(x, y)[0]
            flat[i] = was
            assert abs((up - down) / (2 * step) - own[i]) < 1e-5 + 1e-3 * abs(own[i])
            tried += own[i] != 0
    assert tried > 60
