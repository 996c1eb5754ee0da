import random
import time
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from conftest_llm import ODD, SCHEMA, SF, clash, duck, rows  # noqa: F401
from pyspark.sql import functions as F

from lodestore.llm import exact_dedup, line_dedup, packing, sharding

ODD_TABLE = pd.DataFrame(ODD, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64", "n_chars": "Int64"})


@pytest.mark.parametrize(
    ("query", "sql"),
    [(exact_dedup.op1_exact_dedup, exact_dedup.SQL), (line_dedup.op4_line_dedup, line_dedup.SQL), (packing.op8_packing, packing.SQL)],
)
def test_against_sql(spark, query, sql):
    assert rows(query(spark, SF)) == duck(sql)


@pytest.mark.parametrize("op", [exact_dedup.exact_owners, line_dedup.dedup_lines, packing.pack, lambda d: sharding.shard(d, F.col("text"))])
def test_empty_and_clashing(odd, none, op):
    assert op(none).collect() == []
    assert rows(op(clash(odd))) == rows(op(odd))


def test_exact_odd(odd):
    assert rows(exact_dedup.exact_owners(odd)) == duck(exact_dedup.SQL, documents=ODD_TABLE)


def owners_by_hand(texts):
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    return {i: first[t] for i, t in enumerate(texts)}


def test_exact_spills(spark, odd):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in range(3000)] + ["h" * 1500 + rng.choice("abc") + str(i % 300) for i in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    for spill, combine in ((2000, 1), (20_000, 5000)):
        got = exact_dedup.exact_owners(df, spill_bytes=spill, combine_bytes=combine)
        assert {r.doc_id: r.owner_id for r in got.collect()} == owners_by_hand(texts)
        assert got.filter("not is_duplicate").count() == len(set(texts))


def spilled(tmp_path, keys, budget):
    """What a trie holds of ``keys`` in the end, and the most bytes that it had on disk."""
    trie, most = exact_dedup.Trie(str(tmp_path / "run"), budget), 0
    used = lambda: sum(p.stat().st_size for p in tmp_path.iterdir())
    for i, k in enumerate(keys):
        trie.insert(k, (False, i, 0, 0))
    most = used()
    out = []
    for n, v in enumerate(trie.settle()):
        out.append(v[1])
        if n % 50 == 0:
            most = max(most, used())
    assert list(tmp_path.iterdir()) == []
    return sorted(out), most


@pytest.mark.parametrize("kind", ["short", "heads", "comb", "equal"])
def test_trie_spills_by_subtree(tmp_path, kind):
    rng = random.Random(2)
    heads = [bytes(rng.choice(b"xy") for _ in range(10_000)) for _ in range(3)]
    keys = {
        "short": lambda: [bytes(rng.choice(b"xyz") for _ in range(rng.randint(0, 12))) for _ in range(4000)],
        "heads": lambda: [rng.choice(heads)[: rng.choice([1200, 10_000])] + bytes([rng.randrange(256)]) * rng.randint(0, 900) for _ in range(600)],
        "comb": lambda: [b"x" * rng.randrange(3000) for _ in range(2000)],
        "equal": lambda: [b"x" * 5000] * 500,
    }[kind]()
    want = sorted(set(owners_by_hand(keys).values()))
    for budget in (4000, 100_000):
        out, most = spilled(tmp_path, keys, budget)
        assert out == want
        assert most <= 2 * sum(len(k) + 40 for k in keys)


def test_exact_ids_at_the_edge(spark):
    low = -(1 << 63)
    got = exact_dedup.exact_owners(spark.createDataFrame([(low, "a"), (1, "a"), (None, "a"), ((1 << 63) - 1, "b"), (None, "b"), (None, "c")], "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(low, low, False), (1, low, True), (None, low, True), ((1 << 63) - 1, (1 << 63) - 1, False), (None, (1 << 63) - 1, True), (None, None, False)], key=repr)


def test_lines_odd(odd):
    got = line_dedup.dedup_lines(odd, threshold=2)
    want = duck(line_dedup.SQL.replace(f"> {line_dedup.THRESHOLD}", "> 2"), documents=ODD_TABLE)
    assert rows(got) == want
    text = {r.doc_id: r.text for r in got.filter("doc_id is not null").collect()}
    assert text[1].split("\n")[1] == "same line" and text[7] == "é ü \U0001f600 \x00" and text[5] is None and text[8] == "   \n \n"


def test_packing_odd_and_whole(odd):
    got = packing.pack(odd, max_length=8, batch_tokens=16, shard_tokens=64).collect()
    by = defaultdict(list)
    for r in got:
        if r.doc_id not in (None, 2):
            by[r.doc_id].append((r.start, r.length, r.tokens.split(" ")))
    texts = {r[0]: r[1] for r in ODD if r[0] not in (None, 2) and r[1]}
    for i, t in texts.items():
        want = [w for w in __import__("re").split("[ \t\n\r]+", t) if w]
        assert [w for s, n, p in sorted(by[i]) for w in p] == want
        assert all(len(p) == n and n & (n - 1) == 0 and n <= 8 for _, n, p in by[i])
        assert len({n for _, n, _ in by[i] if n < 8}) == len([n for _, n, _ in by[i] if n < 8])
    batches = defaultdict(list)
    for r in got:
        batches[r.length, r.shard, r.batch].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) and len(s) * k[0] <= 16 for k, s in batches.items())


def test_differencing_is_karmarkar_karp():
    # the textbook case: 8 7 6 5 4 in two shards leaves a difference of 2
    sizes = np.zeros((5, 2), np.int64)
    sizes[:, 0] = [8, 7, 6, 5, 4]
    final, slots = sharding.differencing(sizes)
    assert final[0] - final[1] == 2
    loads = np.zeros(2, int)
    np.add.at(loads, slots[:, 0], sizes[:, 0])
    assert sorted(loads) == sorted(final)


def test_differencing_beats_greedy():
    rng = np.random.default_rng(3)
    for k in (2, 5, 16):
        x = rng.integers(1, 10**6, 400)
        sizes = np.zeros((400, k), np.int64)
        sizes[:, 0] = x
        final, slots = sharding.differencing(sizes)
        loads = np.bincount(slots[:, 0], weights=x, minlength=k)
        assert sorted(loads) == sorted(final) and loads.sum() == x.sum()
        greedy = np.zeros(k)
        for v in sorted(x, reverse=True):
            greedy[greedy.argmin()] += v
        assert np.ptp(loads) <= np.ptp(greedy)


def test_shards_keep_groups_whole_and_balance(spark, odd):
    for leaf, near in ((20, 0.1), (10**6, 0.01)):
        df = spark.read.parquet(f"{SF}/documents.parquet")
        got = sharding.shard(df, F.col("text"), shards=4, leaf_groups=leaf).join(df, "doc_id").toPandas()
        assert len(got) == df.count()
        assert (got.groupby("text")["shard"].nunique() == 1).all()
        assert (got["bytes"] == got["text"].str.encode("utf-8").str.len()).all()
        load = got.groupby("shard")["bytes"].sum()
        assert len(load) == 4 and load.max() - load.min() < near * load.mean()
    again = [sharding.shard(df.repartition(n), F.col("text"), shards=4, leaf_groups=20) for n in (1, 5)]
    assert rows(again[0]) == rows(again[1])
    got = sharding.shard(odd, F.col("source"), shards=2).collect()
    assert len(got) == len(ODD) and len({r.shard for r in got}) == 2


def test_hot_groups_over_several_leaves(spark):
    rng = random.Random(5)
    small = [("x" * rng.randint(50, 150) + str(i), 1) for i in range(240)]
    # one group of a shard's mean, two of half of it, each of many rows
    hot = [("h" * 79 + "0", 150), ("h" * 79 + "1", 75), ("h" * 79 + "2", 75)]
    texts = [t for t, n in small + hot for _ in range(n)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = []
    for leaf, fan in ((41, 64), (10, 4), (10**6, 64)):
        got = sharding.shard(df, F.col("text"), shards=4, leaf_groups=leaf, fan=fan).join(df, "doc_id").toPandas()
        assert len(got) == len(texts) and (got.groupby("text")["shard"].nunique() == 1).all()
        load = got.groupby("shard")["bytes"].sum()
        out.append(load.max() / load.mean())
    # a tree does as well as whole differencing
    assert max(out) < 1.02, out
    again = [sharding.shard(df.repartition(n), F.col("text"), shards=4, leaf_groups=10, fan=4) for n in (1, 5)]
    assert rows(again[0]) == rows(again[1])


def whole_differencing(sizes, k):
    """Karmarkar-Karp over lists of (sum, members), written out."""
    parts = [[(-x, [i])] + [(0, [])] * (k - 1) for i, x in enumerate(sizes)]
    parts = [sorted(p, key=lambda s: s[0]) for p in parts]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[0][0] - p[-1][0])
        a, b = parts[0], parts[1]
        parts = parts[2:] + [sorted(((x + y, m + o) for (x, m), (y, o) in zip(a, b[::-1])), key=lambda s: s[0])]
    return [-s for s, _ in parts[0]], [m for _, m in parts[0]]


def test_differencing_against_lists():
    rng = random.Random(8)
    for k, n in ((2, 30), (3, 50), (7, 40), (4, 3)):
        # sizes without ties of spreads
        x = sorted((rng.randrange(1, 10**12) for _ in range(n)), reverse=True)
        sizes = np.zeros((n, k), np.int64)
        sizes[:, 0] = x
        final, slots = sharding.differencing(sizes)
        sums, members = whole_differencing(x, k)
        assert list(final) == sums
        own = [sorted(i for i in range(n) if slots[i, 0] == s) for s in range(k)]
        assert sorted(own) == sorted(sorted(m) for m in members)


def test_a_tree_of_nodes_balances_like_plain_differencing(spark):
    rng = np.random.default_rng(9)
    sizes = np.minimum(rng.lognormal(7, 1.5, 30_000), 10**6).astype(int)
    sizes[:3] = sizes.sum() // 16, sizes.sum() // 20, sizes.sum() // 300
    df = spark.createDataFrame([(i, int(n)) for i, n in enumerate(sizes)], "doc_id long, n int").select("doc_id", F.repeat(F.lit("x"), F.col("n")).alias("text"))
    out = []
    for leaf, fan in ((10**6, 64), (500, 8)):
        load = sharding.shard(df, F.col("doc_id"), leaf_groups=leaf, fan=fan).groupBy("shard").agg(F.sum("bytes").alias("b")).toPandas()["b"]
        assert load.sum() == sizes.sum()
        out.append(load.max() / load.mean())
    print("max over mean, plain and by a tree:", out)
    assert out[1] < 1.002, out


def test_lines_take_time_by_their_number(spark):
    def took(n):
        text = "\n".join(f"line {i}" for i in range(n))
        df = spark.createDataFrame([(i, text + f"\nown {i}") for i in range(3)], "doc_id long, text string").coalesce(1)
        began = time.time()
        got = sorted(line_dedup.dedup_lines(df, threshold=2).collect())
        assert [(r.lines_dropped, r.text) for r in got] == [(0, text + "\nown 0"), (n, "own 1"), (n, "own 2")]
        return time.time() - began

    took(100)
    small, large = took(20_000), took(200_000)
    assert large < 20 * small + 10, (small, large)


def test_packing_ids_at_the_edge(spark):
    top, low = (1 << 63) - 1, -(1 << 63)
    df = spark.createDataFrame([(i, "a b c d e") for i in (top, low, None)] * 2 + [(None, f"x{i} y z") for i in range(200)], "doc_id long, text string")
    got = packing.pack(df, max_length=2, batch_tokens=4, shard_tokens=16).collect()
    assert sum(r.length for r in got) == 6 * 5 + 200 * 3 and {top, low, None} == {r.doc_id for r in got}
    assert len({r.shard for r in got if r.doc_id is None and r.length == 2}) > 10
