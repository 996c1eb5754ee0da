"""Exact dedup: Patricia-trie owners.

Texts are partitioned by length and content hash, so equal ones meet in one task; before they move, each task keeps one
of the copies that it has itself, so that thousands of copies are as many texts as there are tasks. There, full byte
strings go into a compressed radix trie whose terminal nodes hold the smallest identifier: the owner. A trie that
outgrows its budget spills whole subtrees, below the radix node at which their keys part, to the shared folder; later
keys of such a subtree are appended there. A spilled subtree is settled afterwards by a trie of its own, which begins
where its keys parted, so no shared head is read or written again. Its file goes as soon as it is read.

Rows are then told their owner by the text's length and 128 bits of hash. The tries see every byte, so two texts that
share these would be noticed, and fail the query.
"""

from __future__ import annotations

import heapq
import struct
import uuid
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm import common

#: Bytes of distinct text that a task's trie holds before it spills.
SPILL_BYTES = 128 << 20
#: Bytes of distinct text that a task holds back to find copies before texts move.
COMBINE_BYTES = 32 << 20
_NODE_BYTES = 400
_HEAD = struct.Struct("<qBqqq")

#: (whether the identifier is null, the identifier, two hashes of the text): what a terminal node holds, least first.
Value = tuple[int, int, int, int]


class _Node:
    __slots__ = ("label", "children", "owner", "run")

    def __init__(self, label: bytes, owner: Value | None = None):
        self.label, self.children, self.owner, self.run = label, {}, owner, None


def _shared(a: bytes, b: bytes, at: int) -> int:
    """Length of the prefix that ``a`` shares with ``b[at:]``."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Trie:
    """Compressed radix trie; subtrees without room are written out and settled one after the other."""

    def __init__(self, folder: str, budget: int = SPILL_BYTES):
        self.folder, self.budget = folder, budget
        self.root, self.held, self.limit, self.runs = _Node(b""), 0, budget, []

    def insert(self, key: bytes, value: Value) -> None:
        """Gives ``key`` the lower of ``value`` and what it has."""
        at, size, node, grown = 0, len(key), self.root, 0
        while at < size:
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = _Node(key[at:])
                grown += size - at + _NODE_BYTES
            if key.startswith(child.label, at):
                at += len(child.label)
                node = child
                if node.run is not None:
                    return node.run.append(key[at:], value)
                continue
            n = _shared(child.label, key, at)
            fork = _Node(child.label[:n])
            child.label = child.label[n:]
            fork.children[child.label[0]] = child
            node.children[key[at]] = fork
            at += n
            node = fork
            grown += _NODE_BYTES
        if node.owner is None or value < node.owner:
            node.owner = value
        # only now, since what is spilled must not be where this key goes on
        self._grow(grown)

    def _grow(self, n: int) -> None:
        self.held += n
        if n and self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        """Writes out the largest subtrees that have nothing spilled below them until half of the budget is free."""
        order, stack = [], [self.root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack += node.children.values()
        size, bare = {}, {}
        for node in reversed(order):
            size[id(node)] = len(node.label) + _NODE_BYTES + sum(size[id(c)] for c in node.children.values())
            bare[id(node)] = node.run is None and all(bare[id(c)] for c in node.children.values())
        goal, n = self.held - self.budget // 2, 0
        heap = [(-size[id(self.root)], n, self.root)]
        while heap and goal > 0:
            s, _, node = heapq.heappop(heap)
            if node is not self.root and bare[id(node)] and -s <= max(goal, self.budget // 8):
                free = -s - self._write(node)
                goal -= free
                self.held -= free
            else:
                for c in node.children.values():
                    heapq.heappush(heap, (-size[id(c)], n := n + 1, c))
        # where single keys are over the budget, the next look waits until as much has come again
        self.limit = max(self.budget, self.held + self.budget // 2)

    def _write(self, top: _Node) -> int:
        """Writes out a subtree and leaves a stub of it; the bytes that are free then."""
        before = len(top.label)
        # a head that many keys share stays here, unless it is long or there is but one key
        cut = top.label[1:] if not top.children or before > _NODE_BYTES else b""
        run = _Run(f"{self.folder}-{uuid.uuid4().hex}", max(4096, self.budget // 256))
        for tail, value in _terminals(top, cut):
            run.append(tail, value)
        top.label = top.label[: before - len(cut)]
        top.children, top.owner, top.run = {}, None, run
        self.runs.append(run)
        return len(top.label) + _NODE_BYTES

    def settle(self) -> Iterator[Value]:
        """What every distinct key holds in the end. The trie is used up."""
        waiting = [self]
        while waiting:
            trie = waiting.pop()
            yield from trie._values()
            while trie.runs:
                run = trie.runs.pop()
                inner = Trie(self.folder, self.budget)
                for key, value in run.read():
                    inner.insert(key, value)
                waiting.append(trie)
                trie = inner
                yield from trie._values()

    def _values(self) -> Iterator[Value]:
        stack = [self.root]
        self.root = _Node(b"")
        while stack:
            node = stack.pop()
            if node.owner is not None:
                yield node.owner
            stack += node.children.values()


def _terminals(top: _Node, head: bytes) -> Iterator[tuple[bytes, Value]]:
    """The ends of the keys in a subtree, each with ``head`` for the label of ``top``."""
    if top.owner is not None:
        yield head, top.owner
    stack = [(c, head) for c in top.children.values()]
    while stack:
        node, before = stack.pop()
        path = before + node.label
        if node.owner is not None:
            yield path, node.owner
        stack += [(c, path) for c in node.children.values()]


class _Run:
    """The ends of the keys of a spilled subtree: part files in the shared folder, none of them held open."""

    def __init__(self, uri: str, part: int):
        self.fs, self.path = common.filesystem(uri)
        self.part, self.parts, self.held = part, 0, bytearray()

    def append(self, tail: bytes, value: Value) -> None:
        self.held += _HEAD.pack(len(tail), *value)
        self.held += tail
        if len(self.held) >= self.part:
            with self.fs.open_output_stream(f"{self.path}-{self.parts}") as f:
                f.write(self.held)
            self.parts, self.held = self.parts + 1, bytearray()

    def read(self) -> Iterator[tuple[bytes, Value]]:
        """Every key once; a part's file goes as soon as it is read."""
        last, self.held = bytes(self.held), bytearray()
        for i in range(self.parts + 1):
            data = last
            if i < self.parts:
                with self.fs.open_input_stream(f"{self.path}-{i}") as f:
                    data = f.read()
                self.fs.delete_file(f"{self.path}-{i}")
            at = 0
            while at < len(data):
                n, *value = _HEAD.unpack_from(data, at)
                at += _HEAD.size + n
                yield data[at - n : at], tuple(value)


def _keys(b: pa.RecordBatch) -> Iterator[tuple[bytes, Value]]:
    for key, i, h1, h2 in zip(b.column(0).cast(pa.binary()).to_pylist(), *(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
        yield key, (i is None, i or 0, h1, h2)


def _combine(budget: int):
    """One row for the copies of a text that a task has, as long as it can remember the text."""

    def batch(held: dict[bytes, Value]) -> pa.RecordBatch:
        v = list(held.values())
        cols = [pa.array(held.keys(), pa.binary()).cast(pa.string()), pa.array([None if x[0] else x[1] for x in v], pa.int64()), *(pa.array([x[k] for x in v], pa.int64()) for k in (2, 3))]
        return pa.record_batch(cols, names=["text", "doc_id", "h1", "h2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, Value] = {}
        size = 0
        for b in batches:
            for key, value in _keys(b):
                old = held.get(key)
                if old is None:
                    size += len(key) + _NODE_BYTES
                if old is None or value < old:
                    held[key] = value
                if size > budget:
                    yield batch(held)
                    held, size = {}, 0
        if held:
            yield batch(held)

    return run


def _owners(folder: str, budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(folder, budget)
        for b in batches:
            for key, value in _keys(b):
                trie.insert(key, value)
        found = trie.settle()
        while v := list(islice(found, 50_000)):
            yield pa.record_batch([*(pa.array([x[k] for x in v], pa.int64()) for k in (2, 3)), pa.array([None if x[0] else x[1] for x in v], pa.int64())], names=["h1", "h2", "owner_id"])

    return run


def _hashes(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.xxhash64(F.lit("2"), F.octet_length(text), text)


def exact_owners(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", spill_bytes: int = SPILL_BYTES, combine_bytes: int = COMBINE_BYTES) -> DataFrame:
    """doc_id, owner_id and is_duplicate, a row for every row of ``df``.

    The owner is the smallest identifier among the documents with the same bytes. Exactly one row of each group is no
    duplicate. Identifiers are whole numbers of 64 bits. Nulls: a document without text has no owner and is nobody's
    copy; null identifiers order last, so they own a group only where it has no other. The empty text is a text like
    any other, and texts may share heads of any length. Repeated rows are copies of each other. Other columns of
    ``df`` are ignored. No rows give no rows.
    """
    spark = df.sparkSession
    common.bound_batches(spark)
    folder = common.scratch(spark, "trie")
    fs, at = common.filesystem(folder.rpartition("/")[0])
    fs.create_dir(at, recursive=True)
    picked = common.pick(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    h1, h2 = _hashes(F.col("text"))
    bare = F.col("text").isNull()
    # narrow rows, with a number that tells repeated ones apart; written, since it may not come out the same again
    rows = common.stash(picked.select("doc_id", F.when(~bare, h1).alias("h1"), F.when(~bare, h2).alias("h2"), F.monotonically_increasing_id().alias("token")), "rows")
    texts = picked.filter(~bare).select("text", "doc_id", h1.alias("h1"), h2.alias("h2")).mapInArrow(_combine(combine_bytes), "text string, doc_id long, h1 long, h2 long")
    met = texts.repartition(F.octet_length("text"), "h1")
    owners = met.mapInArrow(_owners(folder, spill_bytes), "h1 long, h2 long, owner_id long").groupBy("h1", "h2").agg(F.first("owner_id").alias("owner_id"), F.count(F.lit(1)).alias("n"))
    clash = F.when(F.col("n") > 1, F.raise_error(F.lit("two texts share 128 bits of hash")).cast("long")).otherwise(F.col("owner_id"))
    # of repeated rows of the owner, one is no duplicate
    first = rows.filter("h1 is not null").groupBy("h1", "h2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("token").alias("t"))).alias("f"))
    told = rows.join(owners.withColumn("owner_id", clash).join(first, ["h1", "h2"]).select("h1", "h2", "owner_id", F.col("f.t").alias("first")), ["h1", "h2"])
    none = rows.filter("h1 is null").select("doc_id", F.lit(None).cast("long").alias("owner_id"), F.lit(False).alias("is_duplicate"))
    return told.select("doc_id", "owner_id", (F.col("token") != F.col("first")).alias("is_duplicate")).unionByName(none)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` with its owner."""
    return exact_owners(common.table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, CASE WHEN text IS NOT NULL THEN min(doc_id) OVER (PARTITION BY text) END AS owner_id,
       text IS NOT NULL AND row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS is_duplicate
FROM documents
"""
