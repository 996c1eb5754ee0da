"""An object store as DataFrames."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestore import formats, schema, session
from lodestore.functions import objects, oid
from lodestore.operators import delta, lookup
from lodestore.session import configure, stash
from lodestore.sources.reader import INDEX_BYTES, StoreReader, large_packs

#: Ids that are looked up in every index, one after the other; more are joined with the entries of all indexes.
FEW = 32
#: Entries of trees in one batch, which a longer tree exceeds alone.
TREE_ROWS = 8192


def find_store(path: str) -> str:
    """The folder of objects at ``path``: itself, or that of a repository at or above it."""
    at = os.path.abspath(path)
    if not os.path.isdir(at):
        raise FileNotFoundError(f"no folder: {path}")
    while True:
        for found in (f"{at}/.git/objects", f"{at}/objects", at):
            if os.path.basename(found) == "objects" and os.path.isdir(found):
                return found
        if at == os.path.dirname(at):
            raise FileNotFoundError(f"no object store at or above {path}")
        at = os.path.dirname(at)


class ObjectDB:
    """A handle on a store; nothing is read before a DataFrame is."""

    def __init__(self, spark: SparkSession, path: str, mode: str = "FAILFAST"):
        self.spark, self.path, self.mode = configure(spark), path.rstrip("/"), mode
        #: Bytes of an index beyond which its pack's chains are resolved by joins.
        self.local = INDEX_BYTES
        if not os.path.isdir(self.path):
            raise FileNotFoundError(f"no object store: {path}")

    def scan(self, kind: str, prefix: str | None = None, packs: list[str] | None = None, types: Sequence[str] | None = None) -> DataFrame:
        """A table of the source; a prefix, packs or types leave out what can't match before it is read."""
        less = ({"prefix": oid.check_prefix(prefix)} if prefix else {}) | ({"packs": ",".join(packs)} if packs is not None else {}) | ({"types": ",".join(types)} if types is not None else {})
        df = self.spark.read.format("objectdb").options(path=self.path, kind=kind, mode=self.mode, local=str(self.local), **less).load()
        df = df.filter(oid.matches(F.col("oid"), prefix)) if prefix else df
        return df.filter(F.col("pack_id").isin(packs)) if packs is not None else df

    def loose_ids(self, prefix: str | None = None) -> DataFrame:
        return self.scan("ids", prefix)

    def packs(self) -> DataFrame:
        return self.scan("packs")

    def entries(self, prefix: str | None = None, packs: list[str] | None = None) -> DataFrame:
        return self.scan("entries", prefix, packs)

    def headers(self, packs: list[str] | None = None) -> DataFrame:
        return self.scan("headers", None, packs)

    def resolved(self, packs: list[str] | None = None, types: Sequence[str] | None = None) -> DataFrame:
        """The headers of packed entries, copies included, with type, depth, root_offset, base_at and base_oid.

        Chains stay in their pack: one task follows those of a pack, in memory, unless its index is large; those of
        large packs are joined by doubling.
        """
        found = self.scan("chains", None, packs, types)
        if large := [p for p in large_packs(self.path, self.local) if packs is None or p in packs]:
            found = found.unionByName(delta.resolve(self.headers(large)).select(found.columns))
        return found if types is None else found.filter(F.col("type").isin(*types))

    def locations(self, prefix: str | None = None) -> DataFrame:
        """oid, store, path, pack_id, offset, idx_pos of every copy of every object, or of those with a prefix."""
        none = lambda t: F.lit(None).cast(t)
        loose = self.loose_ids(prefix).select("oid", F.lit("loose").alias("store"), "path", none("string").alias("pack_id"), none("bigint").alias("offset"), none("bigint").alias("idx_pos"))
        packed = self.entries(prefix).select("oid", F.lit("packed").alias("store"), oid.pack_path(self.path, F.col("pack_id")).alias("path"), "pack_id", "offset", "idx_pos")
        return loose.unionByName(packed)

    def ids(self) -> DataFrame:
        """All ids, copies included."""
        return self.loose_ids().select("oid").union(self.entries().select("oid"))

    def kinds(self) -> DataFrame:
        """oid and type of every object once, from headers alone."""
        return self.scan("loose_headers").select("oid", "type").unionByName(self.resolved().select("oid", "type")).distinct()

    def objects(self, types: Sequence[str] | None = None, checked: bool = False) -> DataFrame:
        """Every object once, or those of ``types``, of which alone payloads are inflated: loose before packed, then the lowest pack.

        Which copies count is settled on places, before any is read. ``checked`` adds crc_holds, null where no checksum is stored.
        """
        none = lambda t: F.lit(None).cast(t)
        columns = ["oid", "pack_id", "offset", "type", "root_offset", "data_start", "inflated_size", "base_at", "depth", "crc32"]
        places = self.resolved(types=types).select(*columns).unionByName(self.loose_ids().select("oid"), allowMissingColumns=True)
        first = F.row_number().over(Window.partitionBy("oid").orderBy(F.col("pack_id").isNotNull(), "pack_id", "offset")) == 1
        packed = places.withColumn("own", first).filter(F.col("pack_id").isNotNull()).withColumn("pack_path", oid.pack_path(self.path, F.col("pack_id")))
        sums = ["crc_holds"] if checked else []
        loose = self.scan("loose", types=types).select("oid", "type", "size", "payload", F.lit("loose").alias("store"), "path", none("string").alias("pack_id"), none("bigint").alias("offset"), *(none("boolean").alias(c) for c in sums))
        found = delta.contents(packed, checked).select("oid", "type", "size", "payload", F.lit("packed").alias("store"), oid.pack_path(self.path, F.col("pack_id")).alias("path"), "pack_id", "offset", *sums)
        return loose.unionByName(found)

    def _map(self, rows: DataFrame, each: Callable[[StoreReader, tuple], Iterator[tuple]], schema: str) -> DataFrame:
        """What ``each`` gives for every row, a batch at a time."""
        root, permissive = self.path, self.mode.upper() == "PERMISSIVE"
        types = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
        fields = [f.split() for f in schema.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = zip(*rows, strict=True) if rows else [[]] * len(fields)
            return pa.record_batch([pa.array(list(c), types[t]) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader, rows, size = StoreReader(root), [], 0
            try:
                for given in (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)):
                    try:
                        for row in each(reader, given):
                            rows.append(row)
                            size += sum(len(x) for x in row if isinstance(x, bytes))
                            if size > delta.BATCH_BYTES or len(rows) > 4096:
                                yield batch(rows)
                                rows, size = [], 0
                    except formats.Corrupt:
                        if not permissive:
                            raise
                yield batch(rows)
            finally:
                reader.close()

        return rows.mapInArrow(run, schema)

    def _placed(self, asked: DataFrame) -> DataFrame:
        """``asked`` (column oid, written to a file) with pack_id and offset of each one's first copy, in the order of packs.

        pack_id is null for loose objects; ids of no object have no row. All indexes are read once, none by every task.
        """
        ids = asked.select("oid").distinct()
        none = lambda t: F.lit(None).cast(t)
        copies = self.entries().select("oid", "pack_id", "offset").unionByName(self.loose_ids().select("oid", none("string").alias("pack_id"), none("bigint").alias("offset")))
        # of structs that begin with null and others, the least begins with null
        first = copies.join(ids, "oid", "left_semi").groupBy("oid").agg(F.min(F.struct("pack_id", "offset")).alias("at"))
        placed = asked.join(first, "oid").select(*asked.columns, "at.pack_id", "at.offset")
        near = F.coalesce(F.floor(F.col("offset") / delta.STRETCH).cast("string"), F.substring("oid", 1, 3))
        # a number of tasks is given, as rows are short and adaptive execution would put the reads of tens of thousands in one task
        return placed.withColumn("near", near).repartition(session.tasks(self.spark), "pack_id", "near").sortWithinPartitions("pack_id", "offset").drop("near")

    def _asked(self, ids: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """``ids``, written to a file, and the same as rows of one task if they are few."""
        asked = stash(ids.filter(F.col("oid").rlike("^[0-9a-f]{40}$")), "asked")
        found = asked.limit(FEW + 1).collect()
        return asked, self.spark.createDataFrame(found, asked.schema).coalesce(1) if len(found) <= FEW else None

    def fetch(self, ids: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
        """The objects in ``ids`` (column oid), each once; ids of no object, or of none of ``types``, have no row.

        Few are looked up by fanout and bisection in every index; more are joined with the entries of the indexes. Of a
        pack only the chains that they are made of are read.
        """
        wanted = None if types is None else frozenset(types)
        asked, few = self._asked(ids.select("oid").distinct())

        def one(reader: StoreReader, row: tuple) -> Iterator[tuple]:
            at = row[1:] or reader.place(row[0])
            if at and (found := reader.read_at(row[0], *at, wanted)):
                yield found

        return self._map(self._placed(asked) if few is None else few, one, schema.OBJECTS)

    def history(self, heads: DataFrame, limit: int) -> DataFrame:
        """head, depth, oid and payload of the first ``limit`` commits from each of ``heads`` (oid) along first parents.

        No other object is read. A parent that the store doesn't have ends a history. Few heads are walked commit by
        commit. More are walked as far as their packs go, and where the next commit isn't in the same one, all those
        that are left are looked up together.
        """
        step = "head string, depth bigint, oid string, payload binary"
        wanted = frozenset(["commit"])
        asked, few = self._asked(heads.select(F.col("oid").alias("head"), F.lit(0).cast("bigint").alias("depth"), "oid"))
        alone = few is not None

        def walk(reader: StoreReader, row: tuple) -> Iterator[tuple]:
            head, first, name, *at = row
            at = tuple(at) or reader.place(name)
            for depth in range(first, limit):
                if at is None:
                    if not alone:
                        yield head, depth, name, None
                    return
                found = reader.read_at(name, *at, wanted)
                if found is None:
                    return
                yield head, depth, name, found.payload
                above = re.search(rb"^parent ([0-9a-f]{40})$", found.payload.partition(b"\n\n")[0], re.M)
                if above is None:
                    return
                name = above[1].decode()
                at = reader.beside(name, at[0]) or (reader.place(name) if alone else None)

        if alone:
            return self._map(few, walk, step)
        out = None
        while True:
            walked = stash(self._map(self._placed(asked), walk, step), "history")
            found = walked.filter("payload is not null")
            out = found if out is None else out.unionByName(found)
            asked = walked.filter("payload is null").drop("payload")
            if asked.isEmpty():
                return out

    def one(self, prefix: str) -> DataFrame:
        """A row with the id of the one object with a prefix; Missing or Ambiguous otherwise."""
        return self.spark.createDataFrame([(lookup.resolve(self.locations(prefix), prefix),)], "oid string")

    def get(self, prefix: str, types: Sequence[str] | None = None) -> DataFrame:
        """The one object with a prefix; Missing or Ambiguous otherwise. Only its folder, bucket and chain are read."""
        return self.fetch(self.one(prefix), types)

    def _checked(self, found: DataFrame, wrong: Column) -> DataFrame:
        """``found`` where ``wrong`` is null; elsewhere an error, or no row if damage is skipped."""
        if self.mode.upper() == "PERMISSIVE":
            return found.filter(wrong.isNull())
        return found.withColumn("payload", F.when(wrong.isNull(), F.col("payload")).otherwise(F.raise_error(F.concat("oid", F.lit(": "), wrong)).cast("binary")))

    def commits(self, preset: str = "full") -> DataFrame:
        found = self._checked(self.objects(["commit"]), objects.commit_error(F.col("payload")))
        return found.select("oid", *objects.parse_commit(F.col("payload"), preset))

    def commit_parents(self) -> DataFrame:
        return self.commits("parents").select("oid", F.posexplode("parents").alias("pos", "parent"))

    def tree_entries(self, ids: DataFrame | None = None) -> DataFrame:
        """The entries of every tree, or of those in ``ids`` (column tree_oid); a tree that is not entries to its end is an error."""
        found = self.objects(["tree"]) if ids is None else self.fetch(ids.select(F.col("tree_oid").alias("oid")), ["tree"])
        permissive = self.mode.upper() == "PERMISSIVE"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees, places, entries = [], [], []

            def batch() -> pa.RecordBatch:
                modes, names, ids = zip(*entries, strict=True) if entries else ((), (), ())
                digits = b"".join(ids).hex()
                oids = [digits[i : i + 40] for i in range(0, len(digits), 40)]
                cols = [pa.array(trees, pa.string()), pa.array(places, pa.int32()), pa.array(modes, pa.binary()).cast(pa.string()), pa.array(names, pa.binary()), pa.array(oids, pa.string())]
                return pa.record_batch(cols, names="tree_oid pos mode_raw name_raw oid".split())

            for b in batches:
                for name, payload in zip(*b.columns, strict=True):
                    try:
                        own = formats.tree_entries(payload.as_py())
                    except formats.Corrupt as e:
                        if permissive:
                            continue
                        raise formats.Corrupt(f"{name}: {e}") from None
                    trees += [name.as_py()] * len(own)
                    places += range(len(own))
                    entries += own
                    if len(entries) > TREE_ROWS:
                        yield batch()
                        trees, places, entries = [], [], []
            yield batch()

        entries = found.select("oid", "payload").mapInArrow(run, "tree_oid string, pos int, mode_raw string, name_raw binary, oid string")
        mode = objects.tree_mode(F.col("mode_raw"))
        return entries.select("tree_oid", "pos", mode.alias("mode"), objects.mode_kind(mode).alias("kind"), objects.utf8_lossy(F.col("name_raw")).alias("name"), "oid", "mode_raw", "name_raw")

    def blobs(self) -> DataFrame:
        return self.objects(["blob"]).select("oid", "size", F.col("payload").alias("content"), objects.utf8_lossy(F.col("payload")).alias("text"))

    def tags(self) -> DataFrame:
        return self.objects(["tag"]).select("oid", *objects.parse_tag(F.col("payload")))

    def verify(self) -> DataFrame:
        """oid, store, pack_id, id_holds and crc_holds (null where no checksum is stored) of every object once."""
        holds = objects.object_id(F.col("type"), F.col("payload")) == F.col("oid")
        return self.objects(checked=True).select("oid", "store", "pack_id", holds.alias("id_holds"), "crc_holds")
