import itertools
import random
import re
import time

import numpy as np
import pandas as pd
from conftest_llm import ODD, SF, clash, rows

from lodestore.llm import near_dedup as nd


def hashes(text):
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    return nd.word_hashes(raw, np.array([0]), np.array([len(raw)]))[0]


def apart(a, b):
    return sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(a, b))


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_masks_cover_the_radius():
    masks = nd.masks()
    assert len(masks) == 126 and (np.bitwise_count(masks) == 32).all()
    rng = random.Random(1)
    for _ in range(3000):
        gap = sum(1 << i for i in rng.sample(range(64), rng.randint(0, 6)))
        assert (masks & np.uint64(gap) == 0).any()
    # one half of two has at most six of thirteen bits
    assert nd.RADIUS == 2 * 6 + 1


def test_words_in_any_cut(monkeypatch):
    texts = ["A b-c déjà  vu", "", "x", "...", "long" * 40 + " z", "a b", "日本 a"]
    raw = np.frombuffer("".join(t.lower() for t in texts).encode(), np.uint8)
    end = np.cumsum([len(t.lower().encode()) for t in texts])
    want, n = nd.word_hashes(raw, np.concatenate([[0], end[:-1]]), end)
    assert list(n) == [5, 0, 1, 0, 2, 2, 2] == [len(re.findall(r"[^\W_]+", t)) for t in texts]
    assert len({*want}) == len({w for t in texts for w in re.findall(r"\w+", t.lower())})
    for step in (3, 7):
        monkeypatch.setattr(nd, "_STRETCH", step)
        got, m = nd.word_hashes(raw, np.concatenate([[0], end[:-1]]), end)
        assert (got == want).all() and (m == n).all()


def test_links_hold_each_bucket_together():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, (30, 2)).astype(np.uint64)
    fp = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, base.shape).astype(np.uint64)) for _ in range(40)]), axis=0)
    half, mask = nd.TABLES[200]
    got = {tuple(x) for x in nd.linked(fp, half, mask, 6)}
    index = {tuple(x): i for i, x in enumerate(fp.view(np.int64).tolist())}
    true = [(i, j) for i, j in itertools.combinations(range(len(fp)), 2) if fp[i, half] & mask == fp[j, half] & mask and np.bitwise_count(fp[i] ^ fp[j]).sum() <= 6]
    links = {tuple(sorted((index[x[:2]], index[x[2:]]))) for x in got}
    assert links <= set(true)

    def joined(pairs):
        parent = list(range(len(fp)))
        for i, j in pairs:
            parent[find(parent, i)] = find(parent, j)
        return [find(parent, i) for i in range(len(fp))]

    a, b = joined(links), joined(true)
    assert len({*zip(a, b)}) == len({*a}) == len({*b})


def test_links_are_a_spanning_forest_under_both_radii():
    half, mask = nd.TABLES[200]
    # bits that the mask leaves open: the half itself stays equal under it
    free = [i for i in range(128) if i // 64 != half or not int(mask) >> (i % 64) & 1]
    flip = lambda bits: [sum(1 << (i % 64) for i in bits if i // 64 == h) for h in (0, 1)]
    at = [[], free[:10], free[5:10] + free[20:28], free[12:20]]
    far = 2**60 - 1
    for width in (2, 4):
        fp = np.array([flip(x) + [0, 0][: width - 2] for x in at], np.uint64)
        whole = {tuple(x) for x in nd.linked(fp, half, mask, 22)}
        assert len(whole) == len(fp) - 1
    # the nearest and the first are reordered texts, the third is the near copy
    fp = np.array([flip([]) + [0, 0], flip(free[:1]) + [far, far], flip(free[:2]) + [far, 0], flip(free[:3]) + [7, 0]], np.uint64)
    for order in itertools.permutations(range(4)):
        got = [{x[:4], x[4:]} for x in map(tuple, nd.linked(fp[list(order)], half, mask, 22).tolist())]
        assert got == [{tuple(fp[i].astype(np.int64).tolist()) for i in (0, 3)}]
    # any accepted pair joins its ends
    rng = np.random.default_rng(4)
    fp = np.unique(np.array([flip(rng.choice(free, rng.integers(0, 16), replace=False)) + flip(rng.choice(128, rng.integers(0, 30), replace=False)) for _ in range(300)], np.uint64), axis=0)
    index = {tuple(x): i for i, x in enumerate(fp.view(np.int64).tolist())}
    d = np.bitwise_count(fp[:, None] ^ fp[None]).astype(int)
    true = np.argwhere((d[..., :2].sum(2) <= 12) & (d[..., 2:].sum(2) <= 34))
    parent = list(range(len(fp)))
    links = [(index[tuple(x[:4])], index[tuple(x[4:])]) for x in nd.linked(fp, half, mask, 12).tolist()]
    assert {*links} <= {tuple(x) for x in true.tolist()}
    for i, j in links:
        assert find(parent, i) != find(parent, j)
        parent[find(parent, i)] = find(parent, j)
    assert all(find(parent, i) == find(parent, j) for i, j in true) and len(true) > 2 * len(fp)


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 400), rng.randint(100, 400)) for _ in range(150)] + [(500, 500)]
    got = {r.node.x: r.root.x for r in nd.components(spark.createDataFrame([((a, 0), (b, 0)) for a, b in pairs], "a struct<x: long, y: long>, b struct<x: long, y: long>")).collect()}
    parent = {x: x for p in pairs for x in p}
    for a, b in pairs:
        parent[max(find(parent, a), find(parent, b))] = min(find(parent, a), find(parent, b))
    assert got == {x: find(parent, x) for x in parent if x != 500}


def test_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = {r.doc_id: r.text for r in df.collect()}
    keeper = {r.doc_id: r.keeper_id for r in nd.near_copies(df).collect()}
    prints = {i: nd.fingerprint(h) for i, t in docs.items() if len(h := hashes(t))}
    near = {d: [0, 0] for d in ("radius", "reach")}
    for a, b in itertools.combinations(prints, 2):
        if apart(prints[a][2:], prints[b][2:]) <= nd.PAIR_RADIUS and (d := apart(prints[a][:2], prints[b][:2])) <= nd.REACH:
            same = keeper[a] == keeper[b]
            assert same or d > nd.RADIUS, "a pair within the radius was missed"
            near["reach"][same] += 1
    assert near["reach"][1] >= 0.9 * sum(near["reach"]) > 50
    for i, k in keeper.items():
        assert k <= i and keeper[k] == k
    # what is grouped is alike: a group's texts share most of their words with another of the group
    words = {i: {*re.findall(r"\w+", t.lower())} for i, t in docs.items()}
    for i, k in keeper.items():
        if i != k:
            assert max(len(words[i] & words[j]) / len(words[i] | words[j]) for j in keeper if j != i and keeper[j] == k) > 0.5


def test_planted_copies(spark):
    rng = random.Random(4)
    lexicon = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(4000)]
    docs, source = [], {}
    for i in range(150):
        words = [rng.choice(lexicon) for _ in range(rng.randint(60, 400))]
        docs.append((i, " ".join(words)))
        if i % 3 == 0:
            for j, share in enumerate((0, 0.02, 0.03)):
                copy = [rng.choice(lexicon) if rng.random() < share else w for w in words]
                docs.append((1000 + 10 * i + j, " ".join(copy).upper() if j == 1 else " ".join(copy)))
                source[1000 + 10 * i + j] = i
    got = {r.doc_id: r.keeper_id for r in nd.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[i] == i for i in range(150))
    assert sum(got[c] == s for c, s in source.items()) >= 0.95 * len(source)
    assert all(got[c] in (s, c) or source.get(got[c]) == s for c, s in source.items())


def test_near_copies_behind_a_reordered_text(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    texts = [rng.sample(words, len(words)), words, words[1:] + words[:1], words[150:] + words[:150]]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts, 1)]
    prints = [nd.fingerprint(hashes(t)) for _, t in docs]
    assert len({p[:2] for p in prints}) == 1 and len({p[2:] for p in prints}) == 4
    assert all(apart(prints[0][2:], p[2:]) > nd.PAIR_RADIUS >= apart(prints[1][2:], p[2:]) for p in prints[1:])
    got = {r.doc_id: r.keeper_id for r in nd.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 2}


def test_odd(spark, odd, none):
    got = nd.near_copies(odd)
    assert got.count() == len(ODD)
    assert rows(nd.near_copies(clash(odd))) == rows(got)
    assert nd.near_copies(none).collect() == [] and nd.drop_near_copies(none).collect() == []
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append((r.keeper_id, r.is_duplicate))
    assert by[1] == [(1, False)] and by[2] == [(1, True)] * 2 and by[3] == [(3, False)] and by[4] == [(4, False)] and by[5] == [(5, False)] and by[8] == [(8, False)]
    assert sorted(by[None], key=str) == [(1, True), (None, False), (None, False), (None, True)]
    kept = nd.drop_near_copies(clash(odd))
    assert kept.columns == clash(odd).columns
    flags = got.filter("not is_duplicate").count()
    assert kept.count() == flags
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    assert rows(nd.drop_near_copies(whole).select("doc_id")) == rows(nd.near_copies(whole).filter("not is_duplicate").select("doc_id"))


def accepted(fp, reach, pair_radius):
    d = np.bitwise_count(fp[:, None] ^ fp[None]).astype(int)
    return np.argwhere((d[..., :2].sum(2) <= reach) & (d[..., 2:].sum(2) <= pair_radius))


def joined(n, links):
    parent = list(range(n))
    for i, j in links:
        assert (a := find(parent, i)) != (b := find(parent, j)), "no forest"
        parent[a] = b
    return [find(parent, i) for i in range(n)]


def cluster(rng, n, centres, spread, words):
    base = rng.integers(0, 2**63, (centres, words)).astype(np.uint64)
    fp = base[rng.integers(0, centres, n)]
    for _ in range(spread):
        fp = fp ^ np.where(rng.random(fp.shape) < 0.7, np.uint64(1) << rng.integers(0, 64, fp.shape).astype(np.uint64), np.uint64(0))
    return np.unique(fp, axis=0)


def test_a_large_bucket_is_joined_by_all_its_near_pairs():
    rng = np.random.default_rng(7)
    kinds = [cluster(rng, 700, c, s, w) for c, s, w in ((1, 4, 4), (3, 9, 4), (30, 6, 4), (700, 0, 4), (2, 5, 2), (1, 12, 2))]
    # the same words in other orders: one fingerprint, word pairs in clusters
    same = cluster(rng, 500, 12, 8, 4)
    same[:, :2] = same[0, :2]
    for fp in [*kinds, same]:
        for first in (0, 1):
            links = nd._forest(fp, first, 22, 34)
            near = {tuple(x) for x in accepted(fp, 22, 34).tolist()}
            assert {tuple(x) for x in links.tolist()} <= near
            group = joined(len(fp), links)
            assert all(group[i] == group[j] for i, j in near)


def test_a_hot_key_takes_bounded_time():
    rng = np.random.default_rng(8)
    half, mask = nd.TABLES[100]
    took = []
    for n in (16_000, 300_000):
        fp = cluster(rng, n, 40, 4, 4)
        fp[:, half] &= ~mask
        began = time.time()
        links = nd.linked(fp, half, mask, 22)
        took.append(time.time() - began)
        assert len(links) >= len(np.unique(fp, axis=0)) - 40 - n // 100
    assert took[1] < 60, took
    fp = rng.integers(0, 2**63, (16_000, 4)).astype(np.uint64)
    fp[:, half] &= ~mask
    began = time.time()
    assert len(nd.linked(fp, half, mask, 22)) == 0 and time.time() - began < 10


def test_blocks_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 40)
    monkeypatch.setattr(nd, "PART_BYTES", 4000)
    rng = np.random.default_rng(9)
    fp = np.unique(np.concatenate([cluster(rng, 500, 1, 1, 4), cluster(rng, 200, 2, 4, 4), rng.integers(0, 2**63, (100, 4)).astype(np.uint64)]), axis=0)
    df = spark.createDataFrame(pd.DataFrame(fp.view(np.int64), columns=["x", "y", "v1", "v2"])).coalesce(1)
    assert nd._hot(df.select("x", "y"), 4, len(fp))
    index = {tuple(x): i for i, x in enumerate(fp.view(np.int64).tolist())}
    links = [(index[tuple(r.a)], index[tuple(r.b)]) for r in nd.near_links(df, 22, 34).collect()]
    parent = list(range(len(fp)))
    for i, j in links:
        parent[find(parent, i)] = find(parent, j)
    near = accepted(fp, 22, 34).tolist()
    for i, j in near:
        d = np.bitwise_count(fp[i, :2] ^ fp[j, :2]).sum()
        assert d > nd.RADIUS or find(parent, i) == find(parent, j)
    assert {(i, j) for i, j in links} <= {tuple(x) for x in near} and len(near) > 1000


def test_permuted_bags_of_words(spark):
    rng = random.Random(11)
    docs, n = [], 0
    for _ in range(6):
        words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(200)]
        for k in range(12):
            t = rng.sample(words, len(words)) if k % 3 == 0 else t[:]  # noqa: F821
            if k % 3:
                t[rng.randrange(len(t))] = "edit"
            docs.append((n := n + 1, " ".join(t)))
    keeper = {r.doc_id: r.keeper_id for r in nd.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    prints = {i: nd.fingerprint(hashes(t)) for i, t in docs}
    pairs = 0
    for a, b in itertools.combinations(prints, 2):
        if apart(prints[a][2:], prints[b][2:]) <= nd.PAIR_RADIUS and apart(prints[a][:2], prints[b][:2]) <= nd.RADIUS:
            assert keeper[a] == keeper[b]
            pairs += 1
    assert pairs > 30


def test_many_copies_of_a_word_weigh_by_their_number():
    words = np.repeat(np.array([1, 2, 3], np.uint64), [70_000, 700_000, 3])
    seen, n = np.unique(words, return_counts=True)
    assert nd.fingerprint(words)[0] == nd._bits(seen, np.round(64 * (1 + 2 * np.log(n))))


def test_repeated_rows_and_a_hot_group(spark):
    docs = [(i, f"the very same text number of words and more {'x' if i % 7 else 'y'}", i) for i in range(400)] * 3 + [(7, "alone in the world of words", 1), (7, "alone in the world of words", 2), (8, "!", 1), (8, "!", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, extra long")
    got = nd.near_copies(df)
    assert got.count() == len(docs)
    kept = sorted((r.doc_id, r.keeper_id) for r in got.filter("not is_duplicate").collect())
    assert kept[-3:] == [(7, 7), (8, 8), (8, 8)] and len(kept) in (4, 5)
    assert sorted(r.doc_id for r in nd.drop_near_copies(df).collect()) == [i for i, _ in kept]
