"""What keeps reads of a store linear: lookups by joins, chains by packs, copies settled before any is read, small batches."""

import inspect
import random

import pyarrow as pa
import pytest
import stores
from pyspark.sql import functions as F

from lodestore import formats, reports
from lodestore.db import FEW, ObjectDB
from lodestore.plans import binary, store
from lodestore.sources import reader


def commit(parent, text):
    data = f"tree {'a' * 40}\n{f'parent {parent}' + chr(10) if parent else ''}author a <a> 0 +0000\ncommitter a <a> 0 +0000\n\n{text}\n".encode()
    return stores.oid("commit", data), data


def scattered(root, chains=50, depth=7, packs=5):
    """Commits in chains that go from pack to pack and to loose objects; (heads, parent of each, payload of each)."""
    rng, inside, heads, above, every = random.Random(7), [[] for _ in range(packs)], [], {}, {}
    for c in range(chains):
        last = None
        for d in range(depth):
            name, data = commit(last, f"{c} {d}")
            above[name], every[name], last = last, data, name
            for place in rng.sample(range(packs + 1), 1 + (d == 3)):
                if place == packs:
                    stores.put_loose(root, "commit", data)
                else:
                    inside[place].append((name, "commit", data, None))
        heads.append(last)
    for items in inside:
        stores.put_pack(root, items)
    return heads, above, every


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_ids_are_joined_with_the_indexes(spark, tmp_path):
    _, _, every = scattered(tmp_path)
    db = ObjectDB(spark, str(tmp_path))
    first = {r.oid: (r.store, r.pack_id, r.offset) for r in db.objects().collect()}
    asked = spark.createDataFrame([(o,) for o in [*every, *every, "0" * 40, "x", None]], "oid string")
    found = db.fetch(asked)
    assert len(every) > FEW and "Join" in plan(found)
    rows = found.collect()
    assert len(rows) == len(every) and {r.oid: bytes(r.payload) for r in rows} == every
    assert {r.oid: (r.store, r.pack_id, r.offset) for r in rows} == first and {x[0] for x in first.values()} == {"loose", "packed"}
    assert db.fetch(asked, ["tree"]).count() == 0
    few = db.fetch(asked.filter(F.col("oid") < sorted(every)[5]))
    assert "Join" not in plan(few) and {r.oid: (r.store, r.pack_id, r.offset) for r in few.collect()} == {o: first[o] for o in sorted(every)[:5]}


def test_a_reader_keeps_few_files_open(tmp_path, monkeypatch):
    scattered(tmp_path)
    monkeypatch.setattr(reader, "OPEN", 2, raising=False)
    own = reader.StoreReader(str(tmp_path))
    for pack in own.ids:
        index = own.index(pack)
        assert own.chain(pack, index.offset(0))[0] == "commit"
    assert len(own.indexes) == 2 and len(own.packs) == 2
    own.close()


def test_histories_go_from_pack_to_pack(spark, tmp_path):
    heads, above, every = scattered(tmp_path)
    db = ObjectDB(spark, str(tmp_path))
    for limit in (1, 3, 20):
        want = []
        for h in [*heads, heads[0]]:
            at, d = h, 0
            while at and d < limit:
                want.append((h, d, at, every[at]))
                at, d = above[at], d + 1
        many = db.history(spark.createDataFrame([(h,) for h in [*heads, heads[0]]], "oid string"), limit)
        assert "Join" not in plan(many)
        assert sorted((r.head, r.depth, r.oid, bytes(r.payload)) for r in many.collect()) == sorted(want)
        alone = db.history(spark.createDataFrame([(heads[0],)], "oid string"), limit)
        assert sorted((r.head, r.depth, r.oid, bytes(r.payload)) for r in alone.collect()) == sorted({w for w in want if w[0] == heads[0]})


def test_walks_ask_for_all_trees_of_a_level_together(spark, tmp_path):
    roots = []
    for i in range(FEW + 8):
        blob = f"text {i}".encode()
        inner = b"100644 file\0" + bytes.fromhex(stores.oid("blob", blob))
        tree = b"40000 dir\0" + bytes.fromhex(stores.oid("tree", inner))
        stores.put_pack(tmp_path, [(stores.oid(k, d), k, d, None) for k, d in (("blob", blob), ("tree", inner), ("tree", tree))])
        roots.append((stores.oid("tree", tree), stores.oid("blob", blob)))
    db = ObjectDB(spark, str(tmp_path))
    asked = spark.createDataFrame([(r,) for r, _ in roots], "tree_oid string")
    assert "Join" in plan(db.tree_entries(asked))
    found = reports.graph.descend(db.tree_entries, asked.select(F.col("tree_oid").alias("root"))).collect()
    assert {(r.root, r.oid, r.path) for r in found} == {(r, b, "dir/file") for r, b in roots}


def chained(root, packs=3):
    """Packs of chains by offset and by id, and copies of their first object."""
    for n in range(packs):
        texts = [bytes([n]) * 3000]
        items = [(stores.oid("blob", texts[0]), "blob", texts[0], None)]
        for i in range(1, 9):
            delta = stores.append_delta(texts[-1], bytes([i]))
            texts.append(texts[-1] + bytes([i]))
            items.append((stores.oid("blob", texts[-1]), "ofs", delta, i - 1) if i % 2 else (stores.oid("blob", texts[-1]), "ref", delta, items[-1][0]))
        stores.put_pack(root, items)


def test_chains_are_followed_pack_by_pack(spark, tmp_path):
    chained(tmp_path)
    db = ObjectDB(spark, str(tmp_path))
    own = db.resolved()
    assert "Join" not in plan(own) and db.headers().rdd.getNumPartitions() == own.rdd.getNumPartitions() == 1
    db.local = 0  # every pack is large then
    far = db.resolved()
    assert "Join" in plan(far) and own.columns == far.columns
    assert sorted(map(str, own.collect())) == sorted(map(str, far.collect()))
    assert sorted(r.depth for r in own.collect()) == sorted([*range(9)] * 3)
    assert db.resolved(types=["tree"]).count() == 0 and own.filter("type = 'blob'").count() == db.resolved(types=["blob"]).count() == 27


def test_copies_that_do_not_count_are_not_inflated(spark, tmp_path):
    """Of three copies of a tag, the loose one is read; the spoilt ones in packs are not."""
    tag = b"object " + b"a" * 40 + b"\ntype commit\ntag v1\ntagger a <a> 0 +0000\n\nm\n"
    name = stores.put_loose(tmp_path, "tag", tag)
    tree = b"100644 a\0" + b"\1" * 20
    stores.put_pack(tmp_path, [(name, "tag", tag, None), (stores.oid("tree", tree), "tree", tree, None)])
    pack = next(p.stem[5:] for p in (tmp_path / "pack").glob("*.idx"))
    with open(tmp_path / "pack" / f"pack-{pack}.idx", "rb") as f:
        index = formats.read_index(f)
    raw = bytearray((tmp_path / "pack" / f"pack-{pack}.pack").read_bytes())
    at = int(index.offsets[index.ids.index(name)])
    for i in range(at + 3, at + 11):
        raw[i] ^= 0xFF
    (tmp_path / "pack" / f"pack-{pack}.pack").write_bytes(raw)
    db = ObjectDB(spark, str(tmp_path))
    assert [(r.oid, r.tag) for r in db.tags().collect()] == [(name, "v1")]
    assert {(r.oid, r.store) for r in db.objects().collect()} == {(name, "loose"), (stores.oid("tree", tree), "packed")}


def test_trees_are_not_moved_after_they_are_read(spark, tmp_path):
    chained(tmp_path)
    whole = plan(ObjectDB(spark, str(tmp_path)).tree_entries())
    assert "Join" not in whole and "Exchange" not in whole[: whole.index("FlatMapGroupsInArrow")]


def test_one_read_gives_content_and_checksum(spark, tmp_path):
    chained(tmp_path)
    db = ObjectDB(spark, str(tmp_path))
    found = db.verify()
    assert "Join" not in plan(found) and plan(found).count("InArrow") == 1
    assert found.filter("id_holds and crc_holds").count() == 27
    idx = next((tmp_path / "pack").glob("*.idx"))
    raw = bytearray(idx.read_bytes())
    raw[1032 + 20 * 9] ^= 1  # the checksum of the first id
    idx.write_bytes(raw)
    assert [r.oid for r in db.verify().filter("not crc_holds").collect()] == [raw[1032:1052].hex()]


def test_batches_of_long_texts_are_small(spark):
    texts = ["x" * 1_000_000] * 40
    given = pa.record_batch([pa.array(range(40)), pa.array(texts)], names=["n", "t"])
    out = list(binary.made(iter([given]), [["n", "bigint"], ["b", "binary"]], lambda n, t: (n, t.encode())))
    assert [x for b in out for x in b.column(0).to_pylist()] == list(range(40))
    assert len(out) > 5 and max(b.nbytes for b in out) < binary.BATCH_BYTES + 2_000_000
    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 1_000_000).alias("text")).coalesce(1)

    def most(batches):
        yield pa.record_batch([pa.array([max(b.nbytes for b in batches)])], names=["n"])

    binary.deltas(rows, "y")
    assert rows.mapInArrow(most, "n bigint").first().n < 12_000_000
    assert binary.deltas(rows, "y").filter("size = 1000001").count() == 40


def test_many_reads_are_spread_over_tasks(spark, tmp_path):
    """Rows of places are short: by their bytes, adaptive execution would put the reads of all of them in one task."""
    _, _, every = scattered(tmp_path)
    db = ObjectDB(spark, str(tmp_path))
    found = db.fetch(spark.createDataFrame([(o,) for o in every], "oid string"))
    assert found.count() == len(every) and found.select(F.spark_partition_id()).distinct().count() > 3


def test_histories_of_many_heads_are_spread_over_tasks(spark, tmp_path, monkeypatch):
    heads, _, _ = scattered(tmp_path)
    db, used = ObjectDB(spark, str(tmp_path)), []

    def placed(asked, own=db._placed):
        used.append(own(asked).select(F.spark_partition_id()).distinct().count())
        return own(asked)

    monkeypatch.setattr(db, "_placed", placed)
    assert db.history(spark.createDataFrame([(h,) for h in heads], "oid string"), 3).count() == 150
    assert used[0] > 3


def test_loose_objects_are_written_without_a_shuffle(spark, tmp_path):
    name = stores.oid("blob", b"text")
    rows = spark.createDataFrame([(name, "blob", b"text")] * 20, "oid string, type string, payload binary").repartition(4)
    for _ in range(2):
        assert store._write_loose(rows, str(tmp_path)).agg(F.sum("n")).first()[0] == 20
    assert [p.name for p in tmp_path.rglob("*") if p.is_file()] == [name[2:]]
    text = inspect.getsource(store.store)
    assert "dropDuplicates" not in text and "distinct" not in text


def test_trees_are_parsed_once(spark, tmp_path):
    """Modes, names with blanks and line breaks, ids with zeros and blanks; what is no entry is an error."""
    ids = [b"\0" * 20, b" " * 20, b"\n1 a\0" * 4]
    good = b"".join(m + b" " + n + b"\0" + i for m, n, i in zip((b"100644", b"40000", b"160000"), (b"a b", b"c\nd", b"\xff 1"), ids, strict=True))
    assert formats.tree_entries(b"") == [] and [x[2] for x in formats.tree_entries(good)] == ids
    for bad in (good[:-1], good + b"1", b"x" + good, good[:31] + b"8" + good[31:]):
        with pytest.raises(formats.Corrupt, match="not entries to its end"):
            formats.tree_entries(bad)
    for data in (good, b""):
        stores.put_loose(tmp_path, "tree", data)
    db = ObjectDB(spark, str(tmp_path))
    found = db.tree_entries()
    assert "regexp" not in plan(found)
    rows = sorted(found.collect(), key=lambda r: r.pos)
    assert [(r.tree_oid, r.pos, r.mode, r.kind, r.name, r.oid, r.mode_raw, bytes(r.name_raw)) for r in rows] == [
        (stores.oid("tree", good), 0, "100644", "blob", "a b", ids[0].hex(), "100644", b"a b"),
        (stores.oid("tree", good), 1, "040000", "tree", "c\nd", ids[1].hex(), "40000", b"c\nd"),
        (stores.oid("tree", good), 2, "160000", "commit", "\ufffd 1", ids[2].hex(), "160000", b"\xff 1"),
    ]
    stores.put_loose(tmp_path, "tree", good + b"1")
    assert ObjectDB(spark, str(tmp_path), "PERMISSIVE").tree_entries().count() == 3
