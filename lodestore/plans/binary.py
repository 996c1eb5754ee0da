"""Queries that encode to the binary formats and read them again, a batch of Arrow rows at a time."""

from __future__ import annotations

import io
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore import formats, session
from lodestore.operators import delta


#: Rows, and bytes of what is made, in one batch.
ROWS, BATCH_BYTES = 4096, 4 << 20


def made(batches: Iterator[pa.RecordBatch], fields: list[list[str]], one: Callable[..., tuple]) -> Iterator[pa.RecordBatch]:
    """``one`` over each row, which is converted alone; what is made goes on as soon as it has ROWS rows or BATCH_BYTES bytes."""
    types = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[i] for r in rows], types[t]) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])

    rows, size = [], 0
    for b in batches:
        for row in zip(*b.columns, strict=True):
            rows.append(one(*(x.as_py() for x in row)))
            size += sum(len(x) for x in rows[-1] if isinstance(x, (bytes, str)))
            if size > BATCH_BYTES or len(rows) == ROWS:
                yield batch(rows)
                rows, size = [], 0
    yield batch(rows)


def _each(df: DataFrame, columns: list[str], schema: str, one: Callable[..., tuple]) -> DataFrame:
    """``one`` over each row of ``columns``, by Arrow batches whose size doesn't follow from that of the batches read."""
    session.configure(df.sparkSession)
    fields = [f.split() for f in schema.split(", ")]
    return df.select(*columns).mapInArrow(lambda batches: made(batches, fields, one), schema)


def _bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode()


def loose_round_trip(df: DataFrame) -> DataFrame:
    """Documents as compressed loose objects, inflated and split again; a null text is empty."""

    def one(doc: int, text: str | None) -> tuple:
        kind, payload = formats.decode_loose(formats.encode_loose("blob", _bytes(text), 1))
        return doc, kind, len(payload), payload

    return _each(df, ["doc_id", "text"], "doc_id bigint, type string, size bigint, payload binary", one).select("doc_id", "type", "size", F.sha1("payload").alias("sha"))


def loose_headers(df: DataFrame) -> DataFrame:
    """Type and size from the first bytes of compressed objects, of which no more is made than a reader asks for."""

    def head(text: str | None) -> bytes:
        raw = _bytes(text)
        z = zlib.compressobj(1)
        made = z.compress(f"blob {len(raw)}".encode() + b"\0" + raw[:1024])
        return (made + z.flush(zlib.Z_SYNC_FLUSH))[: formats.LOOSE_HEAD]

    return _each(df, ["doc_id", "text"], "doc_id bigint, type string, size bigint", lambda doc, text: (doc, *formats.loose_header(head(text))))


def _columns(df: DataFrame, columns: list[str], schema: str, run_batch: Callable[..., list]) -> DataFrame:
    """``run_batch`` over the columns of each batch, as numpy arrays; rows with a null have no result."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.record_batch([pa.array(c) for c in run_batch(*(c.to_numpy() for c in b.columns))], names=names)

    return df.select(*columns).dropna().mapInArrow(run, schema)


def entry_headers(df: DataFrame) -> DataFrame:
    """Entry headers of every type, by doc_id, with n_chars as the size; encoded and read a batch at a time."""
    kinds = ("commit", "tree", "blob", "tag")
    numbers = np.array([formats.NUMBERS[k] for k in kinds])

    def run(doc: np.ndarray, n: np.ndarray) -> list:
        raw, length = formats.encode_entry_headers(numbers[doc % 4], n)
        kind, size, again = formats.entry_headers(raw)
        if (again != length).any():
            raise formats.Corrupt("a header is of another length")
        return [doc, np.array([formats.TYPES[int(k)] for k in kind], object), size]

    return _columns(df, ["doc_id", "n_chars"], "doc_id bigint, phys_type string, inflated_size bigint", run)


def offset_varints(df: DataFrame) -> DataFrame:
    return _columns(df, ["doc_id", "n_chars"], "doc_id bigint, value bigint", lambda doc, n: [doc, formats.offset_varints(*formats.encode_offset_varints(n * (doc + 1)))])


def deltas(df: DataFrame, suffix: str) -> DataFrame:
    """Each document with a suffix, as a delta over the document, applied."""

    def one(doc: int, text: str) -> tuple:
        base = _bytes(text)
        return doc, formats.apply_delta(base, formats.make_delta(base, base + suffix.encode()))

    return _each(df, ["doc_id", "text"], "doc_id bigint, result binary", one).select("doc_id", F.sha1("result").alias("sha"), F.octet_length("result").cast("bigint").alias("size"))


def index_round_trip(rows: DataFrame, version: int) -> DataFrame:
    """pack, oid, idx_pos and offset of rows (pack, oid, offset), through an encoded index for each pack."""

    def run(group: pa.Table) -> pa.Table:
        found = [(o, n, zlib.crc32(o.encode())) for o, n in zip(group.column("oid").to_pylist(), group.column("offset").to_pylist(), strict=True)]
        index = formats.read_index(io.BytesIO(formats.encode_index(found, version=version)))
        n = len(index.ids)
        return pa.table({"pack": pa.array([group.column("pack")[0].as_py()] * n, pa.int64()), "oid": index.ids, "idx_pos": pa.array(range(n), pa.int64()), "offset": index.offsets})

    return rows.select("pack", "oid", "offset").groupBy("pack").applyInArrow(run, "pack bigint, oid string, idx_pos bigint, offset bigint")


def delta_chains(turns: DataFrame) -> DataFrame:
    """Conversations as packs in which each turn is a delta over the text so far; resolved and rebuilt from bytes."""

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["turn"])
        entries, text = [], b""
        for k, r in enumerate(rows):
            new = text + _bytes(r["text"])
            entries.append(("ofs_delta", formats.make_delta(text, new), k - 1) if k else ("blob", new, None))
            text = new
        pack, offsets, _ = formats.encode_pack(entries)
        ends = [*offsets[1:], len(pack) - 20]
        found = []
        for r, at, end in zip(rows, offsets, ends, strict=True):
            e = formats.entry_header(pack[at : at + formats.HEADER_BYTES], at)
            found.append({"offset": at, "depth": len(found), "base_at": e.base_offset, "data_start": at + e.length, "inflated_size": e.size, "row": r, "kind": e.kind, "end": end})
        made = delta.rebuild(found, lambda start, n: formats.inflate_at(io.BytesIO(pack), start, n)[0])
        out = [(f["row"]["conv_id"], f["row"]["turn"], f["kind"], len(data), data) for f, data in made]
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["conv_id", "turn", "phys_type", "size", "payload"])

    found = turns.select("conv_id", "turn", "text").groupBy("conv_id").applyInArrow(run, "conv_id bigint, turn bigint, phys_type string, size bigint, payload binary")
    return found.select("conv_id", "turn", "phys_type", "size", F.sha1("payload").alias("sha"))
