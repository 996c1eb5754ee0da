import random
import re
import time

import numpy as np
from conftest_llm import ODD, SF, clash, rows
from pyspark.sql import functions as F

from lodestore.llm import licenses


def numbers(index, text):
    at = {w: i for i, w in enumerate(index.words)}
    # words are cut as the engine cuts them: signs beyond ASCII are letters
    return np.array([at.get(w, -1) for w in re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", text.lower())], np.int64)


def brute(text, templates=licenses.TEMPLATES):
    """Every template at every place, by comparing words."""
    doc = re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", text.lower())
    found = []
    for t, (name, notice, phrases) in enumerate(templates):
        words, phrases = notice.split(), [p.split() for p in phrases]
        if any(w not in doc for p in phrases for w in p):
            continue
        head = next(i for i in range(len(words)) if words[i : i + len(phrases[0])] == phrases[0])
        for start in range(-len(words), len(doc)):
            if start + head < 0 or doc[start + head : start + head + len(phrases[0])] != phrases[0]:
                continue
            lo, hi = max(0, start - licenses.SLACK), max(0, start + len(words) + licenses.SLACK)
            if any(not any(doc[i : i + len(p)] == p for i in range(lo, min(hi, len(doc)) - len(p) + 1)) for p in phrases):
                continue
            hits = []
            for k, w in enumerate(words):
                near = [start + k + o for o in (0, -1, 1, -2, 2) if 0 <= start + k + o < len(doc) and doc[start + k + o] == w]
                hits += near[:1]
            if len(hits) >= licenses.MIN_SHARE * len(words):
                found.append((-len(hits), hits[0], max(hits) + 1, t))
    kept = []
    for n, a, z, t in sorted(set(found), key=lambda x: (x[0], x[1], x[3])):
        if all(a >= y or z <= x for x, y, *_ in kept):
            kept.append((a, z, t, -n))
    return [(templates[t][0], a, z - a, n / len(templates[t][1].split())) for a, z, t, n in sorted(kept)]


def test_against_brute_force(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(1)
    own = []
    for i in range(150):
        name, text, _ = rng.choice(licenses.TEMPLATES)
        words = text.split()
        for _ in range(rng.choice([0, 0, 1, 3])):
            k = rng.randrange(len(words))
            words[k : k + rng.randint(0, 1)] = rng.choice([[], ["zzz"], ["license"], [words[k].upper()]])
        own.append((10_000 + i, "Foo bar. " * rng.randint(0, 3) + ", ".join(words) + ".\nthe mit " * rng.randint(0, 2)))
    docs = df.select("doc_id", "text").unionByName(spark.createDataFrame(own, "doc_id long, text string"))
    got = {}
    for r in licenses.scan_licenses(docs).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.start, r.words, r.share))
    index = licenses.Index()
    lowered = docs.select("doc_id", F.lower("text").alias("text"))
    counts = licenses.document_counts(lowered, index)
    texts = docs.collect()
    want_counts = np.zeros(len(index.words), int)
    for r in texts:
        n = numbers(index, r.text)
        want_counts[np.unique(n[n >= 0])] += 1
    assert (counts == want_counts).all()
    want = {r.doc_id: f for r in texts if (f := brute(r.text))}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert len(got) > 80


def test_every_template_is_found_whole():
    index = licenses.Index().rank(np.zeros(999, int))
    for name, text, _ in licenses.TEMPLATES:
        assert (name, 2, len(text.split()), 1.0) in index.scan(numbers(index, f"A b {text}. And more"))
        assert index.scan(numbers(index, f"{text} {text}")) == brute(f"{text} {text}")
    for text in ("the license of the software", "apache license", "mit licence", "gnu general public license version 4"):
        assert index.scan(numbers(index, text)) == []
    two = index.scan(numbers(index, "Released under the MIT License. x y z. Licensed under the Apache License, Version 2.0."))
    assert [x[0] for x in two] == ["MIT", "Apache-2.0"]


def test_every_document_with_a_notice(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    has = {n: {r.doc_id for r in df.filter(F.col("text").contains(t)).collect()} for n, t in (("Apache-2.0", "Licensed under the Apache License, Version 2.0"), ("MIT", "Released under the MIT License"), ("GPL-3.0", "licensed under the GNU General Public License, version 3"), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."))}
    got = {}
    for r in licenses.scan_licenses(df).collect():
        got.setdefault(r.license, set()).add(r.doc_id)
    assert got == has


def test_every_notice_of_the_tables(spark):
    for sf in ("0.01", "0.1"):
        df = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
        has = {r.doc_id for r in df.filter(F.col("text").rlike("(?im)^.*(licensed|released) under .*$")).collect()}
        cc = {r.doc_id for r in df.filter(F.col("text").contains("Licensed under CC BY-NC 4.0.")).collect()}
        got = licenses.scan_licenses(df).collect()
        assert {r.doc_id for r in got} == has and cc < has
        assert {r.doc_id for r in got if r.license == "CC-BY-NC-4.0"} == cc != set()


def test_short_notices():
    index = licenses.Index().rank(np.zeros(999, int))
    for name, text in (
        ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-SA-4.0", "licensed under CC-BY-NC-SA-4.0"), ("BSD", "Released under the BSD license."),
        ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"), ("BSD-2-Clause", "# SPDX-License-Identifier: BSD-2-Clause"), ("GPL-2.0", "// SPDX-License-Identifier: GPL-2.0-only"), ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-or-later"),
        ("LGPL-2.1", "Released under the GNU Lesser General Public License, version 2.1."), ("LGPL-2.0", "Released under the GNU Lesser General Public License, version 2."), ("CC-BY-4.0", "SPDX-License-Identifier: CC-BY-4.0"),
    ):
        assert [x[0] for x in index.scan(numbers(index, f"a b c {text} d e"))] == [name], text
    assert index.scan(numbers(index, "released under the new mit license")) == [("MIT", 0, 6, 1.0)]
    assert index.scan(numbers(index, "x " + licenses._GNU.format("lesser ", "2 1"))) == [("LGPL-2.1", 1, len(licenses._GNU.format("lesser ", "2 1").split()), 1.0)]
    for text in ("the cc by 4 of them", "bsd", "a bsd license", "spdx license identifier", "nc 4 0"):
        assert index.scan(numbers(index, text)) == []


def test_odd(spark, odd, none):
    more = spark.createDataFrame([(1, "MIT license, released under the MIT License", "en", "s", 1), (None, "Released under the MIT License", "en", "s", 1), (2, "Released under the MIT License", None, None, None)] * 2 + [(3, "word " * 100_000 + "released under the MIT license", "en", "s", 1)], odd.schema)
    got = licenses.scan_licenses(odd.unionByName(more))
    assert rows(licenses.scan_licenses(clash(odd.unionByName(more)).withColumn("license", F.lit("c")))) == rows(got)
    found = sorted(((r.doc_id, r.license, r.start) for r in got.collect()), key=repr)
    assert found == sorted([(1, "MIT", 2), (None, "MIT", 0), (2, "MIT", 0)] * 2 + [(3, "MIT", 100_000)], key=repr)
    assert licenses.scan_licenses(none).collect() == [] and len(ODD) == odd.count()


def test_rarity_decides_nothing(spark):
    rng = np.random.default_rng(3)
    index = licenses.Index()
    words = sorted({w for _, t, _ in licenses.TEMPLATES[:6] for w in t.split()}) + ["mit license", "released under the mit license", "apache license version 2 0", "foo"]
    for _ in range(60):
        text = " ".join(rng.choice(words, 200))
        found = brute(text)
        for _ in range(3):
            assert index.rank(rng.integers(0, 9, len(index.words))).scan(numbers(index, text)) == found


def test_long_texts_of_licence_words_take_time_by_their_length():
    index = licenses.Index()
    took = []
    for n in (20_000, 200_000):
        doc = numbers(index, "released under the mit license " * n)
        began = time.time()
        assert len(index.scan(doc)) == n
        took.append(time.time() - began)
    assert took[1] < 25 * took[0] + 1, took
    assert index.scan(numbers(index, "mit " * 1_000_000 + "license " * 1_000_000)) == index.scan(numbers(index, "mit license"))
