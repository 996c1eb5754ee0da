import gzip
import io
import random
import zlib

import pyarrow as pa
import pytest
from conftest_llm import SF, clash, duck, rows
from pyspark.sql import functions as F

from lodestore.llm import warc

PAGES = [(1, "http://a/é?x=1", "<p>a</p>"), (1, "http://a/é?x=1", "<p>a</p>"), (2, None, ""), (3, "u", None), (None, " line\nbreak ", "x\r\n\r\nWARC/1.0\r\n"), (None, None, None), (4, "%{a}", "é" * 300_000), (5, "", "\n")]
SCHEMA = "page_id long, url string, html string"


def record(body, kind="response", fold=False):
    return b"WARC/1.0\r\nWARC-Type: " + kind.encode() + (b"\r\nWARC-Target-URI: a\r\n b" if fold else b"") + f"\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def test_against_sql(spark):
    assert rows(warc.op7_warc(spark, SF)) == duck(warc.SQL)


def test_odd(spark):
    df = spark.createDataFrame(PAGES, SCHEMA)
    for size in (10, 1 << 30):
        got = warc.round_trip(df, file_bytes=size).drop("record_bytes")
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(PAGES, key=repr)
    assert rows(warc.round_trip(clash(df).withColumn("file", F.lit("c")).withColumn("offset", F.lit("c"))).drop("record_bytes")) == rows(df)
    assert warc.round_trip(df.limit(0)).collect() == []


def test_members_and_sidecar(spark, tmp_path):
    rng = random.Random(1)
    bodies = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 500, 40_000]))) for _ in range(60)]
    raw = b"".join(record(b, "warcinfo" if i == 0 else "response", i % 3 == 0) for i, b in enumerate(bodies))
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(raw))
    (tmp_path / "plain.warc").write_bytes(raw)
    (tmp_path / "many.warc.gz").write_bytes(b"".join(gzip.compress(record(b)) for b in bodies) + b"\0" * 40)
    names = [(str(tmp_path / n),) for n in ("one.warc.gz", "plain.warc", "many.warc.gz")]
    out = tmp_path / "out"
    index = warc.normalise(spark, spark.createDataFrame([*names, (None,)], "file string"), str(out)).collect()
    assert len(index) == 3 * len(bodies)
    for file in {r.file for r in index}:
        own = sorted((r for r in index if r.file == file), key=lambda r: r.record)
        data, at = open(file, "rb").read(), 0
        for r, body in zip(own, bodies, strict=True):
            assert r.offset == at
            member = zlib.decompressobj(31)
            text = member.decompress(data[r.offset : r.offset + r.length])
            assert member.eof and not member.unused_data and text.endswith(body + b"\r\n\r\n")
            at += r.length
        assert at == len(data)
        if "many" not in file:
            assert gzip.decompress(data) == raw and own[0].type == "warcinfo" and own[0].uri == "a b" and own[1].uri is None
        side = pa.ipc.open_stream(file.removesuffix(".gz") + ".idx").read_all().to_pylist()
        assert side == [r.asDict() for r in own]


@pytest.mark.parametrize("raw", [b"nonsense\r\n", b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc", b"WARC/1.0\r\nContent-Length: x\r\n\r\n", b"WARC/1.0\r\nabc\r\n\r\n", b"WARC/1.0\r\nA: b"])
def test_damage_is_told(raw):
    for data in (raw, gzip.compress(raw)):
        with pytest.raises(warc.Malformed):
            for _, _, payload in warc.records(warc.inflate(io.BytesIO(data))):
                list(payload)
    with pytest.raises((warc.Malformed, zlib.error)):
        list(warc.inflate(io.BytesIO(gzip.compress(record(b"abc" * 100))[:-9])))


def test_foreign_identifiers(spark, tmp_path):
    bad = [b"<urn:x>", b"\xc2\xb2", b"99999999999999999999", b"-7", b"9223372036854775807", b""]
    raw = b"".join(b"WARC/1.0\r\nWARC-Page-Id: " + i + b"\r\nContent-Length: 2\r\n\r\nab\r\n\r\n" for i in bad)
    (tmp_path / "f.warc.gz").write_bytes(gzip.compress(raw))
    index = warc.normalise(spark, spark.createDataFrame([(str(tmp_path / "f.warc.gz"),)], "file string"), str(tmp_path / "out"))
    want = sorted([None, None, None, None, -7, (1 << 63) - 1], key=repr)
    assert sorted((r.page_id for r in index.collect()), key=repr) == want
    assert sorted((r.page_id for r in warc.read_records(index).collect()), key=repr) == want
