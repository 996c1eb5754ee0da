"""Delta resolution: bases become offsets, chains collapse by doubling, and families are rebuilt in parallel."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore import formats
from lodestore.operators import graph
from lodestore.session import stash

#: Bytes of payload and rows in one batch.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 4096
CONTENT = "oid string, type string, size bigint, payload binary, pack_id string, offset bigint"


def pointers(headers: DataFrame) -> DataFrame:
    """``headers`` with base_at, the offset of an entry's base in the same pack; ofs and ref deltas alike."""
    named = headers.select("pack_id", F.col("oid").alias("base_ref"), F.col("offset").alias("ref_at"))
    met = headers.join(named, ["pack_id", "base_ref"], "left")
    lost = F.col("phys_type").isin("ofs_delta", "ref_delta") & F.coalesce("base_offset", "ref_at").isNull()
    checked = F.when(lost, F.raise_error(F.concat(F.lit("the base is not in the pack: "), F.col("base_ref"))).cast("bigint"))
    return met.withColumn("base_at", F.coalesce("base_offset", "ref_at", checked)).drop("ref_at")


def resolve(headers: DataFrame) -> DataFrame:
    """``headers`` with type, depth, root_offset and base_oid; no payload is read.

    Chains may mix both kinds of delta. One that leads to itself is a Circle.
    """
    at = stash(pointers(headers), "pointers")
    node = lambda c: F.struct("pack_id", F.col(c).alias("offset"))
    chains = graph.roots(at.select(node("offset").alias("node"), F.when(F.col("base_at").isNotNull(), node("base_at")).alias("parent")))
    chains = chains.select(F.col("node.pack_id").alias("pack_id"), F.col("node.offset").alias("offset"), F.col("root.offset").alias("root_offset"), "depth")
    root = at.select("pack_id", F.col("offset").alias("root_offset"), F.col("phys_type").alias("type"))
    base = at.select("pack_id", F.col("offset").alias("base_at"), F.col("oid").alias("base_oid"))
    return at.join(chains, ["pack_id", "offset"]).join(root, ["pack_id", "root_offset"]).join(base, ["pack_id", "base_at"], "left")


def needed(rows: list[dict]) -> list[dict]:
    """The entries of one family that are asked for (own), and those that they are made of."""
    if all(r["own"] for r in rows):
        return rows
    at = {r["offset"]: r for r in rows}
    kept: dict[int, dict] = {}
    for r in filter(itemgetter("own"), rows):
        while r is not None and r["offset"] not in kept:
            kept[r["offset"]] = r
            r = at.get(r["base_at"])
    return list(kept.values())


def rebuild(rows: list[dict], read: Callable[[int, int], bytes]) -> Iterator[tuple[dict, bytes]]:
    """(row, payload) of each entry of one family, of which each is inflated once, bases first.

    ``read`` gives the payload at a place of the pack. An entry's payload is held until its last user has been rebuilt.
    """
    users = Counter(r["base_at"] for r in rows if r["base_at"] is not None)
    held = {}
    for r in sorted(rows, key=lambda r: (r["depth"], r["offset"])):
        data, base = read(r["data_start"], r["inflated_size"]), r["base_at"]
        if base is not None:
            data = formats.apply_delta(held[base], data)
            users[base] -= 1
            if not users[base]:
                del held[base]
        if users[r["offset"]]:
            held[r["offset"]] = data
        yield r, data


#: Families whose roots lie in one stretch of a pack are rebuilt by one task, one after the other.
STRETCH = 1 << 24


def contents(resolved: DataFrame, checked: bool = False) -> DataFrame:
    """The objects of packs, or, with a column ``own``, those where it is true; ``checked`` adds crc_holds.

    Families are independent, so a pack is rebuilt by many tasks; each reads stretches of the pack and gives what it has
    rebuilt a batch at a time. Rows that are shuffled have places, not bytes. A family has one type, so a filter by type
    on ``resolved`` keeps all others from being inflated. crc_holds is null where the index has no checksum.
    """
    resolved = resolved if "own" in resolved.columns else resolved.withColumn("own", F.lit(True))
    rows = resolved.select("pack_id", "root_offset", "oid", "type", "offset", "data_start", "inflated_size", "base_at", "depth", "pack_path", "own", *(["crc32"] if checked else []))

    def stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = sorted((r for b in batches for r in b.to_pylist()), key=itemgetter("root_offset"))
        with open(members[0]["pack_path"], "rb") as f:
            ends: dict[int, int] = {}

            def read(start: int, n: int) -> bytes:
                data, ends[start] = formats.inflate_at(f, start, n)
                return data

            out, size = [], 0
            for _, family in groupby(members, itemgetter("root_offset")):
                for r, data in rebuild(needed(list(family)), read):
                    end = ends.pop(r["data_start"])
                    if not r["own"]:
                        continue
                    holds = None
                    if checked and r["crc32"] is not None:
                        f.seek(r["offset"])
                        holds = zlib.crc32(f.read(end - r["offset"])) == r["crc32"]
                    out.append((r["oid"], r["type"], len(data), data, r["pack_id"], r["offset"], *([holds] if checked else [])))
                    size += len(data)
                    if size > BATCH_BYTES or len(out) == BATCH_ROWS:
                        yield _contents(out, checked)
                        out, size = [], 0
            yield _contents(out, checked)

    return rows.groupBy("pack_id", F.floor(F.col("root_offset") / STRETCH).alias("stretch")).applyInArrow(stretch, CONTENT + (", crc_holds boolean" if checked else ""))


def _contents(rows: list[tuple], checked: bool) -> pa.RecordBatch:
    types = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64(), *([pa.bool_()] if checked else []))
    cols = zip(*rows, strict=True) if rows else [[]] * len(types)
    return pa.record_batch([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=[*(f.split()[0] for f in CONTENT.split(", ")), *(["crc_holds"] if checked else [])])


def raw_checksums(headers: DataFrame) -> DataFrame:
    """``headers`` with stored_crc32: of each entry's bytes as they stand in the pack, to where its stream ends."""

    def run(batches):
        for b in batches:
            sums, opened, name = [], None, None
            for path, at, start, size in zip(*(b.column(c).to_pylist() for c in ("pack_path", "offset", "data_start", "inflated_size")), strict=True):
                if path != name:
                    if opened:
                        opened.close()
                    opened, name = open(path, "rb"), path  # noqa: SIM115
                end = formats.inflate_at(opened, start, size)[1]
                opened.seek(at)
                sums.append(zlib.crc32(opened.read(end - at)))
            if opened:
                opened.close()
            yield pa.record_batch([*b.columns, pa.array(sums, pa.int64())], names=[*b.schema.names, "stored_crc32"])

    return headers.mapInArrow(run, headers.withColumn("stored_crc32", F.lit(0).cast("bigint")).schema)
