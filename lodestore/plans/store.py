"""The driver's tables as an object store on disk, which the engine then reads like any other.

Documents are blobs: loose ones of source src0, the others in a pack for each thousand identifiers, stored undeflated, so
that their places follow from their sizes; indexes of version 2. Each turn of a conversation is a commit upon the turn
before, with a tree of the latest text and a folder of all texts so far; they lie in a pack for each fifty conversations,
with indexes of version 1, commits as deltas by id and folders as deltas by offset, a step deeper each turn. Each
conversation has a loose tag of its first commit.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore import formats, session
from lodestore.db import ObjectDB
from lodestore.functions import objects as B
from lodestore.plans import synth

DOCS_PER_PACK, CONVERSATIONS_PER_PACK = 1000, 50
_built: dict[tuple[str, str], str] = {}


def oid_of(kind: str, data: bytes) -> str:
    return hashlib.sha1(f"{kind} {len(data)}".encode() + b"\0" + data).hexdigest()


def store(spark: SparkSession, sf_dir: str) -> ObjectDB:
    """The store of the tables in ``sf_dir``, written once a session."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _built:
        root = f"{session.mounted(session.scratch(spark, 'store'))}/objects"
        os.makedirs(f"{root}/pack")
        documents = synth.blobs(spark, sf_dir)
        loose = documents.filter("source = 'src0'").select("oid", F.lit("blob").alias("type"), synth.text_bytes().alias("payload"))
        turns = synth.table(spark, sf_dir, "conversations")
        packed = documents.filter("not (source <=> 'src0')").select(F.floor(F.col("doc_id") / DOCS_PER_PACK).alias("pack"), "doc_id", "oid", synth.text_bytes().alias("payload"))
        tags = _conversations(turns, root)
        done = [_write_loose(loose, root), packed.groupBy("pack").applyInArrow(_document_pack(root), "n bigint"), _write_loose(tags, root)]
        for df in done:
            df.agg(F.sum("n")).first()
        _built[key] = root
    return ObjectDB(spark, _built[key])


def _put(path: str, data: bytes) -> None:
    """Writes under another name and renames, as a task may run twice."""
    own = f"{os.path.dirname(path)}/tmp_{uuid.uuid4().hex}"
    try:
        f = open(own, "xb")  # noqa: SIM115
    except FileNotFoundError:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        f = open(own, "xb")  # noqa: SIM115
    with f:
        f.write(data)
    os.replace(own, path)


def _write_loose(rows: DataFrame, root: str) -> DataFrame:
    """Writes each object where it isn't yet: copies need no shuffle of their texts, since a name holds one content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, kind, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not os.path.exists(path := f"{root}/{name[:2]}/{name[2:]}"):
                    _put(path, formats.encode_loose(kind, data, 1))
            yield pa.record_batch([pa.array([b.num_rows], pa.int64())], names=["n"])

    return rows.select("oid", "type", "payload").mapInArrow(run, "n bigint")


def _write_pack(root: str, name: str, ids: list[str], entries: list, version: int, index_version: int, deflate) -> None:
    pack, offsets, sums = formats.encode_pack(entries, version, deflate)
    base = f"{root}/pack/pack-{hashlib.sha1(name.encode()).hexdigest()}"
    _put(f"{base}.pack", pack)
    _put(f"{base}.idx", formats.encode_index(list(zip(ids, offsets, sums, strict=True)), pack[-20:], index_version))


def _document_pack(root: str):
    def run(group: pa.Table) -> pa.Table:
        rows = {}
        for r in sorted(group.to_pylist(), key=lambda r: r["doc_id"]):
            rows.setdefault(r["oid"], r["payload"])
        _write_pack(root, f"pack:documents:{group.column('pack')[0].as_py()}", list(rows), [("blob", p, None) for p in rows.values()], 2, 2, formats.stored)
        return pa.table({"n": pa.array([len(rows)], pa.int64())})

    return run


def _conversations(turns: DataFrame, root: str) -> DataFrame:
    """Writes the packs; oid, type and payload of the tags."""

    def run(group: pa.Table) -> pa.Table:
        at: dict[str, int] = {}
        entries, tags = [], []

        def put(kind: str, data: bytes, like: tuple[str, bytes] | None = None, by_id: bool = False) -> str:
            name = oid_of(kind, data)
            if name not in at:
                at[name] = len(entries)
                delta = like and formats.make_delta(like[1], data)
                entries.append((kind, data, None) if like is None else ("ref_delta", delta, like[0]) if by_id else ("ofs_delta", delta, at[like[0]]))
            return name

        last = before = folder = None
        for r in sorted(group.to_pylist(), key=lambda r: (r["conv_id"], r["turn"])):
            if r["conv_id"] != last:
                last, before, folder = r["conv_id"], None, None
            blob = put("blob", r["text"].encode())
            inner = (folder[1] if folder else b"") + f"100644 turn-{r['turn']:04d}.txt".encode() + b"\0" + bytes.fromhex(blob)
            folder = put("tree", inner, folder), inner
            tree = put("tree", b"100755 latest\0" + bytes.fromhex(blob) + b"40000 turns\0" + bytes.fromhex(folder[0]))
            who = f"{r['role']} <{r['role']}@x.org> {r['conv_id'] * 1000 + r['turn']} +0000"
            payload = f"tree {tree}\n{f'parent {before[0]}' + chr(10) if before else ''}author {who}\ncommitter {who}\n\n{r['text']}".encode()
            first, before = before is None, (put("commit", payload, before, True), payload)
            if first:
                tag = f"object {before[0]}\ntype commit\ntag v{r['conv_id']}\ntagger {who}\n\n{r['text']}\n".encode()
                tags.append((oid_of("tag", tag), "tag", tag))
        _write_pack(root, f"pack:conversations:{group.column('pack')[0].as_py()}", list(at), entries, 3, 1, zlib.compress)
        return pa.table([pa.array(c, t) for c, t in zip(zip(*tags, strict=True), (pa.string(), pa.string(), pa.binary()), strict=True)], names=["oid", "type", "payload"])

    block = F.floor(F.col("conv_id") / CONVERSATIONS_PER_PACK).alias("pack")
    return turns.select(block, "conv_id", "turn", "role", "text").groupBy("pack").applyInArrow(run, "oid string, type string, payload binary")


def sha(payload=None):
    return F.sha1(F.col("payload") if payload is None else payload)


def _sql_object(kind: str, payload: str) -> str:
    """The id of an object whose payload is a BLOB, in DuckDB."""
    return f"sha1(encode('{kind} ' || octet_length({payload})) || '\\x00'::BLOB || {payload})"


_WHO = "role || ' <' || role || '@x.org> ' || (conv_id * 1000 + turn) || ' +0000'"

#: The store in DuckDB: ``packed`` and ``loose`` have every copy of every object, ``turns`` every conversation's ids.
SQL = f"""RECURSIVE texts AS (SELECT conv_id, turn, role, text, {_sql_object('blob', 'encode(text)')} AS blob FROM conversations),
folders AS (
  SELECT *, unhex(string_agg(hex(encode('100644 turn-' || lpad(CAST(turn AS VARCHAR), 4, '0') || '.txt')) || '00' || blob, '') OVER (PARTITION BY conv_id ORDER BY turn)) AS folder_bytes FROM texts),
trees AS (
  SELECT *, unhex(hex(encode('100755 latest')) || '00' || blob || hex(encode('40000 turns')) || '00' || folder) AS tree_bytes
  FROM (SELECT *, {_sql_object('tree', 'folder_bytes')} AS folder FROM folders)),
rooted AS (SELECT *, {_sql_object('tree', 'tree_bytes')} AS tree FROM trees),
turns AS (
  SELECT *, CAST(NULL AS VARCHAR) AS parent, {_sql_object('commit', 'encode(payload)')} AS commit FROM (
    SELECT *, 'tree ' || tree || chr(10) || 'author ' || {_WHO} || chr(10) || 'committer ' || {_WHO} || chr(10) || chr(10) || text AS payload FROM rooted WHERE turn = 0)
  UNION ALL
  SELECT *, {_sql_object('commit', 'encode(payload)')} AS commit FROM (
    SELECT r.*, 'tree ' || r.tree || chr(10) || 'parent ' || t.commit || chr(10) || 'author ' || {_WHO.replace('role', 'r.role').replace('conv_id', 'r.conv_id').replace('turn', 'r.turn')} || chr(10) || 'committer ' || {_WHO.replace('role', 'r.role').replace('conv_id', 'r.conv_id').replace('turn', 'r.turn')} || chr(10) || chr(10) || r.text AS payload, t.commit AS parent
    FROM turns t JOIN rooted r ON r.conv_id = t.conv_id AND r.turn = t.turn + 1)),
tagged AS (
  SELECT *, {_sql_object('tag', 'encode(tag_text)')} AS tag FROM (
    SELECT *, 'object ' || commit || chr(10) || 'type commit' || chr(10) || 'tag v' || conv_id || chr(10) || 'tagger ' || {_WHO} || chr(10) || chr(10) || text || chr(10) AS tag_text FROM turns WHERE turn = 0)),
blobs AS (SELECT doc_id, source, text, {_sql_object('blob', 'encode(text)')} AS oid FROM documents),
conv_packed AS (
  SELECT DISTINCT sha1('pack:conversations:' || conv_id // {CONVERSATIONS_PER_PACK}) AS pack_id, u.* FROM (
    SELECT conv_id, unnest([
      {{'oid': blob, 'type': 'blob', 'payload': encode(text), 'depth': 0, 'base_oid': CAST(NULL AS VARCHAR), 'phys_type': 'blob'}},
      {{'oid': folder, 'type': 'tree', 'payload': folder_bytes, 'depth': turn, 'base_oid': lag(folder) OVER w, 'phys_type': CASE WHEN turn = 0 THEN 'tree' ELSE 'ofs_delta' END}},
      {{'oid': tree, 'type': 'tree', 'payload': tree_bytes, 'depth': 0, 'base_oid': CAST(NULL AS VARCHAR), 'phys_type': 'tree'}},
      {{'oid': commit, 'type': 'commit', 'payload': encode(payload), 'depth': turn, 'base_oid': parent, 'phys_type': CASE WHEN turn = 0 THEN 'commit' ELSE 'ref_delta' END}}]) AS u
    FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn))),
doc_packed AS (
  SELECT pack, sha1('pack:documents:' || pack) AS pack_id, oid, any_value(encode(text)) AS payload, min(doc_id) AS doc_id
  FROM (SELECT *, doc_id // {DOCS_PER_PACK} AS pack FROM blobs WHERE source IS DISTINCT FROM 'src0') GROUP BY pack, oid),
doc_sized AS (
  SELECT *, octet_length(payload) AS size, CASE WHEN octet_length(payload) < 16 THEN 1 WHEN octet_length(payload) < 2048 THEN 2 WHEN octet_length(payload) < 262144 THEN 3 WHEN octet_length(payload) < 33554432 THEN 4 ELSE 5 END
    + 6 + 5 * greatest(1, CAST(ceil(octet_length(payload) / 65535) AS BIGINT)) + octet_length(payload) AS size_in_pack FROM doc_packed),
doc_placed AS (SELECT *, CAST(12 + sum(size_in_pack) OVER (PARTITION BY pack ORDER BY doc_id) - size_in_pack AS BIGINT) AS "offset" FROM doc_sized),
loose AS (
  SELECT DISTINCT oid, 'blob' AS type, encode(text) AS payload FROM blobs WHERE source = 'src0'
  UNION ALL SELECT tag, 'tag', encode(tag_text) FROM tagged),
packed AS (SELECT pack_id, oid, type, payload FROM conv_packed UNION ALL SELECT pack_id, oid, 'blob', payload FROM doc_packed),
every AS (SELECT oid, type, payload, 'loose' AS store FROM loose UNION ALL SELECT DISTINCT oid, type, payload, 'packed' FROM packed),
once AS (SELECT oid, any_value(type) AS type, any_value(payload) AS payload, min(store) AS store FROM every GROUP BY oid)"""
