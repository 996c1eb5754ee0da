import io
import random
import re

import numpy as np
import pytest
import stores
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestore import formats, reports
from lodestore.db import ObjectDB, find_store
from lodestore.operators import lookup


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    if not stores.HAS_GIT:
        pytest.skip("no git here")
    path = tmp_path_factory.mktemp("git") / "repo"
    stores.git_store(path)
    return path


@pytest.fixture(scope="module")
def db(spark, repo):
    return ObjectDB(spark, find_store(str(repo / "dir")))


@pytest.fixture(scope="module")
def whole(db):
    return {r.oid: r for r in db.objects().collect()}


def test_objects_are_gits(repo, db, whole):
    listed = [x.split() for x in stores.git(repo, "cat-file", "--batch-check", "--batch-all-objects").decode().splitlines()]
    assert {o: (t, int(n)) for o, t, n in listed} == {o: (r.type, r.size) for o, r in whole.items()}
    assert [r.oid for r in reports.list_ids(db).collect()] == sorted(whole)
    for o, r in whole.items():
        assert bytes(r.payload) == stores.git(repo, "cat-file", r.type, o)
    assert all(r.id_holds and r.crc_holds is not False for r in db.verify().collect())
    assert {r.store for r in whole.values()} == {"loose", "packed"}


def test_packs_are_gits(repo, db):
    packs = db.packs().collect()
    assert len(packs) == 2 and all(p.idx_version == 2 and p.pack_version == 2 for p in packs)
    for p in packs:
        own = [r.line for r in reports.show_index(db, p.pack_id).collect()]
        assert own == stores.git(repo, "show-index", data=open(p.idx_path, "rb").read()).decode().splitlines()
        want = [re.split(r"\s+", x.strip()) for x in stores.git(repo, "verify-pack", "-v", p.idx_path).decode().splitlines() if re.match("[0-9a-f]{40}", x)]
        got = [re.split(r"\s+", r.line.strip()) for r in reports.verify_pack(db, p.pack_id).collect()]
        assert sorted(got) == sorted(want) and [int(x[4]) for x in got] == sorted(int(x[4]) for x in got)
    assert max(r.depth for r in db.resolved().select("depth").collect()) >= 5


def test_log_cat_and_walk(repo, db):
    head = stores.git(repo, "rev-parse", "HEAD").decode().strip()
    want = stores.git(repo, "log", "--first-parent", "--no-abbrev-commit", "--format=%H %s", "HEAD").decode().splitlines()
    assert [r.line for r in reports.log_oneline(db, head).collect()] == want and len(want) == 14
    assert [r.line for r in reports.log_oneline(db, head[:12], 3).collect()] == want[:3]
    assert [r.line for r in reports.log_oneline(db, head, 1, 8).collect()] == [want[0][:8] + want[0][40:]]
    shown = reports.cat_file(db, head).first()
    assert shown.text.rstrip("\n") == stores.git(repo, "cat-file", "-p", head).decode().rstrip("\n")
    tree = stores.git(repo, "rev-parse", "HEAD^{tree}").decode().strip()
    assert reports.cat_file(db, tree).first().text == stores.git(repo, "-c", "core.quotePath=false", "ls-tree", tree).decode().rstrip("\n")
    files = dict(reversed(x.split("\t")) for x in (y.split(" ", 2)[2] for y in stores.git(repo, "-c", "core.quotePath=false", "ls-tree", "-r", head).decode().splitlines()))
    assert {r.path: r.oid for r in reports.walk(db, head).collect()} == files
    places = reports.which_pack(db, head).collect()
    assert places and all(r.oid == head for r in places)


def test_commits_and_tags(repo, db):
    for r in db.commits("subject_and_description").collect():
        tree, parents, name, subject, body = stores.git(repo, "show", "-s", "--format=%T%x01%P%x01%an <%ae> %at%x01%s%x01%b", r.oid).decode().split("\x01")
        assert (r.tree, r.parents, r.subject, r.description) == (tree, parents.split(), subject, body.strip("\n"))
        assert r.author.startswith(name) and r.author.endswith(" +0100")
    tag = db.tags().first()
    assert (tag.tag, tag.object_type, tag.message, tag.object) == ("v1", "commit", "a tag\n\nof some lines", stores.git(repo, "rev-parse", "HEAD").decode().strip())
    assert db.commit_parents().filter("pos = 1").count() == 1


def test_prefixes(db, whole):
    heads = {}
    for o in whole:
        heads.setdefault(o[:2], []).append(o)
    for p, own in list(heads.items())[:3]:
        assert [r.oid for r in reports.resolve_ambiguous(db, p.upper()).collect()] == sorted(own)
    many = next(p for p, own in heads.items() if len(own) > 1)
    with pytest.raises(lookup.Ambiguous) as e:
        db.get(many)
    assert e.value.candidates == sorted(heads[many])
    with pytest.raises(lookup.Missing):
        db.get("0" * 39)
    for bad in ("", "xyz", "a" * 41):
        with pytest.raises(ValueError):
            lookup.find(db.locations(), bad)
    asked = db.spark.createDataFrame([(many,), (many.upper(),), ("zz",), (None,), (sorted(whole)[0][:9],)], "prefix string")
    got = {(r.prefix, r.oid) for r in lookup.join_prefixes(db.ids().distinct(), asked).collect()}
    assert got == {(many, o) for o in heads[many]} | {(sorted(whole)[0][:9], sorted(whole)[0])}


def test_options_prune(spark, db):
    def read(**options):
        return spark.read.format("objectdb").options(path=db.path, **options).load()

    one = db.loose_ids().first().oid
    assert read(kind="ids", prefix=one[:4]).rdd.getNumPartitions() == 1 < read(kind="ids").rdd.getNumPartitions()
    every = {(r.pack_id, r.oid) for r in read(kind="entries", slice="5").collect()}
    parts = read(kind="entries", slice="5").rdd.getNumPartitions()
    assert len(every) == db.entries().count() and parts > 20
    late = read(kind="entries", slice="5", low="c8")
    assert late.rdd.getNumPartitions() < parts / 2
    assert {(r.pack_id, r.oid) for r in late.filter(F.col("oid") >= "c8").collect()} == {x for x in every if x[1] >= "c8"}
    # scans of one DataFrame don't change each other
    df = db.entries()
    assert df.filter(F.col("oid") >= "f0").count() + df.filter(F.col("oid") < "f0").count() == df.count() == len(every)
    pack = db.packs().first().pack_id
    assert db.entries(packs=[pack]).count() == sum(p == pack for p, _ in every) and db.entries(packs=[]).count() == 0


def test_mixed_chains_and_versions(spark, tmp_path):
    rng = random.Random(1)
    base = bytes(rng.randrange(256) for _ in range(70_000))
    items, texts = [(stores.oid("blob", base), "blob", base, None)], [base]
    for i in range(1, 51):  # fifty deep, ofs and ref in turn
        delta = stores.append_delta(texts[-1], bytes([i]) * 5)
        texts.append(texts[-1] + bytes([i]) * 5)
        items.append((stores.oid("blob", texts[-1]), "ofs", delta, i - 1) if i % 2 else (stores.oid("blob", texts[-1]), "ref", delta, items[-1][0]))
    early = stores.append_delta(base, b"early")  # its base comes after it
    items2 = [(stores.oid("blob", base + b"early"), "ref", early, items[0][0]), *items[:1], (stores.oid("blob", b""), "blob", b"", None)]
    for n, (own, version, idx, far) in enumerate([(items, 2, 2, False), (items, 3, 1, False), (items2, 2, 2, True), ([], 2, 2, False)]):
        root = tmp_path / str(n)
        stores.put_pack(root, own, version, idx, far)
        db = ObjectDB(spark, str(root))
        got = {r.oid: bytes(r.payload) for r in db.objects().collect()}
        assert set(got) == {x[0] for x in own} and all(stores.oid("blob", v) == k for k, v in got.items())
        assert db.packs().first().idx_version == idx and db.packs().first().pack_version == version
        assert {r.crc32 is None for r in db.entries().collect()} <= {idx == 1}
        assert sorted(r.depth for r in db.resolved().collect()) == (sorted(range(51)) if own is items else [0, 0, 1] if own else [])
        if own is items:
            last = db.fetch(spark.createDataFrame([(items[-1][0],), ("0" * 40,), (None,), ("x",)], "oid string")).collect()
            assert [bytes(r.payload) for r in last] == [texts[-1]]
            one = db.get(items[7][0][:20]).first()
            assert bytes(one.payload) == texts[7] and one.store == "packed"


def test_copies_and_damage(spark, tmp_path):
    name = stores.put_loose(tmp_path, "blob", b"twice")
    stores.put_pack(tmp_path, [(name, "blob", b"twice", None)])
    db = ObjectDB(spark, str(tmp_path))
    assert db.ids().count() == 2 and [r.store for r in db.objects().collect()] == ["loose"]
    (tmp_path / "ab").mkdir()
    (tmp_path / "ab" / ("c" * 38)).write_bytes(b"nonsense")
    (tmp_path / "pack" / f"pack-{'e' * 40}.idx").write_bytes(b"\xfftOc\0\0\0\3" + b"\0" * 1100)
    with pytest.raises(PySparkException):
        db.scan("loose").collect()
    with pytest.raises(PySparkException):
        db.entries().collect()
    lax = ObjectDB(spark, str(tmp_path), mode="PERMISSIVE")
    assert [r.oid for r in lax.scan("loose").collect()] == [name] and lax.entries().count() == 1 and lax.packs().count() == 1
    with pytest.raises(FileNotFoundError):
        ObjectDB(spark, str(tmp_path / "none"))
    empty = tmp_path / "empty"
    empty.mkdir()
    assert ObjectDB(spark, str(empty)).objects().count() == 0
    circle = tmp_path / "circle"
    a, b = "a" * 40, "b" * 40
    stores.put_pack(circle, [(a, "ref", b"\0\0", b), (b, "ref", b"\0\0", a)])
    with pytest.raises(Exception, match="ancestor|does not end"):
        ObjectDB(spark, str(circle)).resolved().collect()
    lost = tmp_path / "lost"
    stores.put_pack(lost, [(a, "ref", b"\0\0", b)])
    with pytest.raises(PySparkException, match="not in the pack"):
        ObjectDB(spark, str(lost)).resolved().collect()


def damage(root, pack, oids):
    """Spoils the streams of entries, not their headers."""
    index = formats.read_index(io.BytesIO((root / "pack" / f"pack-{pack}.idx").read_bytes()))
    path = root / "pack" / f"pack-{pack}.pack"
    raw = bytearray(path.read_bytes())
    for o in oids:
        at = int(index.offsets[index.ids.index(o)])
        e = formats.entry_header(bytes(raw[at : at + 32]), at)
        for i in range(at + e.length, at + e.length + 8):
            raw[i] ^= 0xFF
    path.write_bytes(raw)


def typed_store(root):
    """A commit, its trees and blobs, once loose and once packed, and the ids of the blobs."""
    names = {}
    for place in ("loose", "packed"):
        blob = place.encode() * 5000
        inner = b"100644 file\0" + bytes.fromhex(stores.oid("blob", blob))
        tree = b"40000 dir\0" + bytes.fromhex(stores.oid("tree", inner))
        commit = f"tree {stores.oid('tree', tree)}\nauthor a <a> 0 +0000\ncommitter a <a> 0 +0000\n\n{place}\n".encode()
        names[place] = [(stores.oid(k, d), k, d, None) for k, d in (("blob", blob), ("tree", inner), ("tree", tree), ("commit", commit))]
    for _, kind, data, _ in names["loose"]:
        stores.put_loose(root, kind, data)
    # a chain of blobs, too
    base = names["packed"][0]
    names["packed"].append((stores.oid("blob", base[2] + b"x"), "ref", stores.append_delta(base[2], b"x"), base[0]))
    stores.put_pack(root, names["packed"])
    pack = next(p.stem[5:] for p in (root / "pack").glob("*.idx"))
    return names, pack


def test_reads_of_a_type_inflate_no_other(spark, tmp_path):
    names, pack = typed_store(tmp_path)
    blobs = [n[0] for n in (names["packed"][0], names["packed"][4])]
    damage(tmp_path, pack, blobs)
    own = names["loose"][0][0]
    path = tmp_path / own[:2] / own[2:]
    raw = path.read_bytes()
    path.write_bytes(raw[:-6])  # its checksum is gone, its head is whole
    db = ObjectDB(spark, str(tmp_path))
    assert {r.message for r in db.commits("full").collect()} == {"loose", "packed"}
    assert {(r.kind, r.name) for r in db.tree_entries().collect()} == {("tree", "dir"), ("blob", "file")} and db.tree_entries().count() == 4
    assert db.kinds().count() == 9
    assert sorted(r.path for p in names for r in reports.walk(db, names[p][3][0]).collect()) == ["dir/file"] * 2
    assert len(reports.log_oneline(db, names["packed"][3][0][:12], 5).collect()) == 1
    with pytest.raises(PySparkException):
        db.blobs().collect()
    plan = db.commits()._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("FlatMapGroupsInArrow") :]
    assert "commit" in below.split("Exchange")[1] or "= commit" in below


def test_one_object_opens_one_chain(spark, tmp_path):
    names, pack = typed_store(tmp_path)
    tip, base = names["packed"][4][0], names["packed"][0]
    damage(tmp_path, pack, [n[0] for n in names["packed"][1:4]])
    db = ObjectDB(spark, str(tmp_path))
    assert bytes(db.get(tip[:10]).first().payload) == base[2] + b"x" and db.get(base[0]).first().offset == 12
    assert db.get(tip, ["commit"]).count() == 0
    with pytest.raises(PySparkException):
        db.get(names["packed"][3][0]).collect()
    lax = ObjectDB(spark, str(tmp_path), mode="PERMISSIVE")
    assert lax.get(names["packed"][3][0]).count() == 0


def test_bounds_in_an_index(tmp_path):
    rng = random.Random(4)
    for version in (1, 2):
        rows = sorted((stores.oid("blob", bytes([i % 256, i // 256])), 2**31 * (i % 3) * (version == 2) + i, i) for i in range(700))
        path = tmp_path / f"{version}.idx"
        path.write_bytes(formats.encode_index(rows, version=version))
        index, ids = formats.IndexMap(str(path)), [r[0] for r in rows]
        assert [index.find(o) for o in ids] == [r[1] for r in rows] and index.find("0" * 40) is None and index.find("f" * 40) is None
        for _ in range(200):
            low, high = sorted("".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([1, 2, 3, 8, 40]))) for _ in range(2))
            lo, hi = index.bounds(low, high)
            assert ids[lo:hi] == [o for o in ids if low.ljust(40, "0") <= o <= high.ljust(40, "f")]


def test_malformed_trees_and_commits_are_errors(spark, tmp_path):
    good = stores.put_loose(tmp_path, "tree", b"100644 a\0" + b"\1" * 20)
    stores.put_loose(tmp_path, "tree", b"100644 a\0" + b"\1" * 20 + b"100644 b\0short")
    stores.put_loose(tmp_path, "commit", b"tree " + b"a" * 40 + b"\nno author\n\nx")
    db, lax = ObjectDB(spark, str(tmp_path)), ObjectDB(spark, str(tmp_path), mode="PERMISSIVE")
    with pytest.raises(PySparkException, match="not entries to its end"):
        db.tree_entries().collect()
    with pytest.raises(PySparkException, match="no author"):
        db.commits().collect()
    assert [r.tree_oid for r in lax.tree_entries().collect()] == [good] and lax.commits().count() == 0


def test_an_ambiguous_prefix_lists_all(spark, tmp_path):
    names = sorted(stores.put_loose(tmp_path, "blob", bytes([i % 256, i // 256])) for i in range(700))
    many = [o for o in names if o[0] == "a"]
    with pytest.raises(lookup.Ambiguous) as e:
        ObjectDB(spark, str(tmp_path)).get("a")
    assert e.value.candidates == many[:20] and [r.oid for r in e.value.every.collect()] == many and len(many) > 20


def test_stream_of_a_file_that_is_older_than_what_was_seen(spark, tmp_path):
    import os
    import shutil
    import time

    from lodestore.session import configure
    from lodestore.streaming.loose import counts_by_type, new_objects

    configure(spark)
    elsewhere = tmp_path / "elsewhere"
    elsewhere.mkdir()
    old = stores.put_loose(elsewhere, "blob", b"written long ago")
    os.utime(elsewhere / old[:2] / old[2:], (1, 1))
    root = tmp_path / "objects"
    root.mkdir()
    want = {stores.put_loose(root, "blob", b"new")}
    assert set(counts_by_type(new_objects(spark, str(root))).columns) == {"window", "type", "objects", "bytes"}
    query = new_objects(spark, str(root)).writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "late")).start()
    try:
        for n in (1, 2):
            for _ in range(120):
                got = [r.oid for r in spark.table("late").collect()]
                if len(got) >= n:
                    break
                time.sleep(0.25)
            assert sorted(got) == sorted(want)
            (root / old[:2]).mkdir(exist_ok=True)
            if n == 1:
                shutil.move(elsewhere / old[:2] / old[2:], root / old[:2] / old[2:])
            want.add(old)
    finally:
        query.stop()


def test_stream_of_new_objects(spark, tmp_path):
    import time

    from lodestore.session import configure
    from lodestore.streaming.loose import new_objects

    configure(spark)
    want = {stores.put_loose(tmp_path, "blob", bytes([i]) * i) for i in range(20)}
    query = new_objects(spark, str(tmp_path)).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        for _ in range(2):
            for _ in range(80):
                got = [r.oid for r in spark.table("seen").collect()]
                if len(got) >= len(want):
                    break
                time.sleep(0.25)
            assert sorted(got) == sorted(want)
            want |= {stores.put_loose(tmp_path, "tree", b"") for _ in range(1)}
    finally:
        query.stop()


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=400), st.binary(max_size=400), st.integers(0, 2**62))
def test_codecs(a, b, n):
    assert formats.apply_delta(a, formats.make_delta(a, b)) == b
    assert formats.apply_delta(a + b, formats.make_delta(a + b, a + b"x" + b)) == a + b"x" + b
    assert formats.offset_varint(formats.encode_offset_varint(n)) == (n, len(formats.encode_offset_varint(n))) and formats.encode_offset_varint(n) == stores.back(n)
    assert formats.size_varint(formats.encode_size_varint(n))[0] == n
    for kind in ("commit", "tree", "blob", "tag", "ref_delta"):
        e = formats.entry_header(formats.encode_entry_header(kind, n) + b"\1" * 20, 12)
        assert (e.kind, e.size) == (kind, n)
    assert formats.decode_loose(formats.encode_loose("blob", a)) == ("blob", a)
    stream = formats.stored(a)
    assert formats.inflate_at(io.BytesIO(b"xx" + stream + b"trailer"), 2, len(a)) == (a, 2 + len(stream))
    sizes = np.array([n, n >> 3, n >> 40, 0, 15, 16, 2047, 2048])
    numbers = np.array([1, 2, 3, 4, 1, 2, 3, 4])
    raw, length = formats.encode_entry_headers(numbers, sizes)
    assert [bytes(r[:k]) for r, k in zip(raw, length)] == [formats.encode_entry_header(formats.TYPES[int(t)], int(x)) for t, x in zip(numbers, sizes)]
    assert all((x == y).all() for x, y in zip(formats.entry_headers(raw), (numbers, sizes, length)))
    raw, length = formats.encode_offset_varints(sizes)
    assert [bytes(r[10 - k :]) for r, k in zip(raw, length)] == [formats.encode_offset_varint(int(x)) for x in sizes] and (formats.offset_varints(raw, length) == sizes).all()


def test_codecs_of_whole_files():
    rng = random.Random(2)
    rows = [(stores.oid("blob", bytes([i, i])), rng.randrange(2**31), i) for i in range(200)]
    for version in (1, 2):
        raw = formats.encode_index(rows, version=version)
        got = formats.read_index(io.BytesIO(raw))
        assert list(zip(got.ids, got.offsets)) == [(o, n) for o, n, _ in sorted(rows)] and got.version == version
        part = formats.read_index(io.BytesIO(raw), 50, 70)
        assert part.ids == got.ids[50:70]
    far = [(o, n + (i % 3 == 0) * 2**33, c) for i, (o, n, c) in enumerate(rows)]
    assert list(formats.read_index(io.BytesIO(formats.encode_index(far))).offsets) == [n for _, n, _ in sorted(far)]
    for raw in (b"", b"\xfftOc\0\0\0\3", b"\1" * 1024 + b"\0" * 999):
        with pytest.raises(formats.Corrupt):
            formats.read_index(io.BytesIO(raw))
    for delta in (b"", b"\1\1\0", b"\0\5\5ab", b"\3\3\x90\3", b"\0\1\x90\1"):
        with pytest.raises(formats.Corrupt):
            formats.apply_delta(b"", delta)
