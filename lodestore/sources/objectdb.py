"""The source ``objectdb``: an object store's folder as narrow tables, one for each ``kind``.

kind=ids            loose identifiers and paths, from folder listings alone
kind=packs          packs and their indexes
kind=entries        index entries, sliced by position
kind=headers        entries with type, size and base from the pack, without inflating
kind=chains         headers with type, depth, root and base resolved, of packs whose index isn't large (option local, in bytes)
kind=loose_headers  type and size of loose objects, from their first bytes
kind=loose          loose objects, inflated

A source can't be told which columns are wanted, so payloads are a kind of their own. The options prefix, low and high
(ids, ends included) and packs (pack ids, by commas) leave out folders that can't match, and of an index all but the
positions between the ends, which are bisected; no task reads an index beyond its slice, and small slices share a task.
The option types (by commas) leaves out loose objects of other types, of which only the head is inflated, and chains of
other types. They are options because in Spark 4.1 what one scan of a DataFrame pushes into a Python source stays there for its next scan, which then lacks
rows. Folders and slices are partitions. mode=PERMISSIVE skips damaged files, FAILFAST (the default) fails. The folder
has to be mounted on every executor.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestore import formats
from lodestore.schema import KINDS
from lodestore.sources.reader import INDEX_BYTES, Circle, large_packs, pack_ids

#: Index entries and folders of loose objects that one task reads, and objects in one batch.
SLICE, FOLDERS, ROWS = 1 << 20, 8, 4096
#: Entries of small slices, of several packs, that one task reads, so that tasks don't grow in number with packs.
SHARED = 1 << 15
#: Bytes of payload in one batch.
BATCH_BYTES = 8 << 20
_HEX38 = re.compile("^[0-9a-f]{38}$")
_LOW, _HIGH = "0" * 40, "f" * 40


class Folders(InputPartition):
    """Loose objects of some folders; ``low`` and ``high`` are the ends of what can match in each."""

    def __init__(self, buckets: list[tuple[str, str, str]]):
        self.buckets = buckets


class Slice(InputPartition):
    def __init__(self, pack: str, lo: int, hi: int):
        self.pack, self.lo, self.hi = pack, lo, hi


class Slices(InputPartition):
    def __init__(self, slices: list[Slice]):
        self.slices = slices


class All(InputPartition):
    pass


class ObjectStoreSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "objectdb"

    def schema(self) -> str:
        kind = self.options.get("kind", "ids")
        if kind not in KINDS:
            raise ValueError(f"no kind of an object store: {kind}")
        return KINDS[kind]

    def reader(self, schema) -> ObjectStoreReader:  # noqa: ARG002
        return ObjectStoreReader(dict(self.options))

    def streamReader(self, schema):  # noqa: ARG002
        from lodestore.streaming.loose import LooseStream

        return LooseStream(dict(self.options))


class ObjectStoreReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("the path of the object store is missing")
        self.root, self.kind = options["path"].rstrip("/"), options.get("kind", "ids")
        self.permissive = options.get("mode", "FAILFAST").upper() == "PERMISSIVE"
        self.slice, self.local = int(options.get("slice", SLICE)), int(options.get("local", INDEX_BYTES))
        #: Ranges of ids, ends included, that can match.
        self.ranges: list[tuple[str, str]] = [(_LOW, _HIGH)]
        if prefix := options.get("prefix", "").lower():
            self._narrow(prefix, prefix.ljust(40, "f"))
        self._narrow(options.get("low", _LOW), options.get("high", _HIGH))
        self.types = frozenset(t for t in options["types"].split(",") if t) if "types" in options else None
        self.only = {p for p in options["packs"].split(",") if p} if "packs" in options else None
        if not os.path.isdir(self.root):
            raise FileNotFoundError(f"no object store: {self.root}")

    def _narrow(self, low: str, high: str) -> None:
        self.ranges = [(max(a, low), min(b, high)) for a, b in self.ranges if max(a, low) <= min(b, high)]

    def packs(self) -> list[str]:
        return [p for p in pack_ids(self.root) if self.only is None or p in self.only]

    def partitions(self) -> Sequence[InputPartition]:
        if self.kind == "packs":
            return [All(None)]
        if self.kind in ("ids", "loose_headers", "loose"):
            out = []
            for n in range(256):
                own = [(a, b) for a, b in self.ranges if a[:2] <= f"{n:02x}" <= b[:2]]
                if own and os.path.isdir(f"{self.root}/{n:02x}"):
                    out.append((f"{n:02x}", min(a for a, _ in own), max(b for _, b in own)))
            return [Folders(out[i : i + FOLDERS]) for i in range(0, len(out), FOLDERS)] or [Folders([])]
        out = []
        large = set(large_packs(self.root, self.local)) if self.kind == "chains" else ()
        for pack in self.packs():
            if pack in large:
                continue
            try:
                index = formats.IndexMap(f"{self.root}/pack/pack-{pack}.idx")
            except formats.Corrupt:
                if self.permissive:
                    continue
                raise
            if self.kind == "chains":
                out += [Slice(pack, 0, index.total)] if index.total else []
                continue
            spans = [index.bounds(a, b) for a, b in self.ranges]
            for lo, hi in _merged(spans):
                out += [Slice(pack, i, min(i + self.slice, hi)) for i in range(lo, hi, self.slice)]
        return _shared(out, min(SHARED, self.slice)) or [Folders([])]

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        if isinstance(part, All):
            yield from self._packs()
        elif isinstance(part, Slices):
            for own in part.slices:
                yield from self._guard({"entries": self._entries, "headers": self._headers, "chains": self._chains}[self.kind](own))
        else:
            for bucket, low, high in part.buckets:
                yield from self._loose(bucket, low, high)

    def _guard(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from batches
        except formats.Corrupt:
            if not self.permissive:
                raise

    def _packs(self) -> Iterator[pa.RecordBatch]:
        rows = []
        for pack in self.packs():
            idx, path = (f"{self.root}/pack/pack-{pack}.{s}" for s in ("idx", "pack"))
            try:
                with open(idx, "rb") as f:
                    version, fanout = formats.index_head(f)
                with open(path, "rb") as f:
                    pack_version, n = formats.pack_head(f.read(12))
                if n != fanout[255]:
                    raise formats.Corrupt("pack and index have different numbers of objects")
                rows.append((pack, version, pack_version, n, idx, path, os.path.getsize(path)))
            except (formats.Corrupt, FileNotFoundError):
                if not self.permissive:
                    raise
        types = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64())
        yield _batch(rows, types, "pack_id idx_version pack_version num_objects idx_path pack_path pack_size")

    def _loose(self, bucket: str, low: str, high: str) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for name in sorted(os.listdir(f"{self.root}/{bucket}")):
            oid, path = bucket + name, f"{self.root}/{bucket}/{name}"
            if not _HEX38.match(name) or not low <= oid <= high:
                continue
            if self.kind == "ids":
                rows.append((oid, path))
            else:
                try:
                    if self.kind == "loose_headers":
                        with open(path, "rb") as f:
                            rows.append((oid, *formats.loose_header(f.read(formats.LOOSE_HEAD)), path))
                    elif found := formats.read_loose(path, self.types):
                            rows.append((oid, found[0], len(found[1]), found[1], path))
                            size += len(found[1])
                except formats.Corrupt as e:
                    if not self.permissive:
                        raise formats.Corrupt(f"{path}: {e}") from None
            if len(rows) == ROWS or size > BATCH_BYTES:
                yield self._rows(rows)
                rows, size = [], 0
        if rows:
            yield self._rows(rows)

    def _rows(self, rows: list[tuple]) -> pa.RecordBatch:
        s, n = pa.string(), pa.int64()
        types, names = {"ids": ((s, s), "oid path"), "loose_headers": ((s, s, n, s), "oid type size path"), "loose": ((s, s, n, pa.binary(), s), "oid type size payload path")}[self.kind]
        return _batch(rows, types, names)

    def _slice(self, part: Slice):
        with open(f"{self.root}/pack/pack-{part.pack}.idx", "rb") as f:
            return formats.read_index(f, part.lo, part.hi)

    def _entries(self, part: Slice) -> Iterator[pa.RecordBatch]:
        index = self._slice(part)
        for i in range(0, len(index.ids), 1 << 16):
            k = slice(i, i + (1 << 16))
            n = len(index.ids[k])
            crc = pa.nulls(n, pa.int64()) if index.crc is None else pa.array(index.crc[k])
            cols = [pa.array([part.pack] * n), pa.array(range(part.lo + i, part.lo + i + n), pa.int64()), pa.array(index.ids[k]), pa.array(index.offsets[k]), crc]
            yield pa.record_batch(cols, names="pack_id idx_pos oid offset crc32".split())

    def _headers(self, part: Slice) -> Iterator[pa.RecordBatch]:
        index = self._slice(part)
        path = f"{self.root}/pack/pack-{part.pack}.pack"
        types = (pa.string(), *[pa.int64()], pa.string(), *[pa.int64()] * 2, pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = "pack_id idx_pos oid offset crc32 phys_type inflated_size data_start base_offset base_ref pack_path"
        rows = []
        with open(path, "rb") as f:
            formats.pack_head(f.read(12))
            for i in sorted(range(len(index.ids)), key=index.offsets.__getitem__):
                at = int(index.offsets[i])
                f.seek(at)
                e = formats.entry_header(f.read(formats.HEADER_BYTES), at)
                crc = None if index.crc is None else int(index.crc[i])
                rows.append((part.pack, part.lo + i, index.ids[i], at, crc, e.kind, e.size, at + e.length, e.base_offset, e.base_ref, path))
                if len(rows) == ROWS:
                    yield _batch(rows, types, names)
                    rows = []
        if rows:
            yield _batch(rows, types, names)


    def _chains(self, part: Slice) -> Iterator[pa.RecordBatch]:
        """A whole pack, whose index is at hand: bases are found in it, and a chain is followed to what is known of it."""
        index, path = self._slice(part), f"{self.root}/pack/pack-{part.pack}.pack"
        place = {int(at): i for i, at in enumerate(index.offsets)}
        named: dict[str, int] = {}
        entries: dict[int, formats.Entry] = {}
        with open(path, "rb") as f:
            formats.pack_head(f.read(12))
            for at in sorted(place):
                f.seek(at)
                entries[at] = formats.entry_header(f.read(formats.HEADER_BYTES), at)
        bases: dict[int, int | None] = {}
        for at, e in entries.items():
            base = e.base_offset
            if e.base_ref is not None:
                named = named or dict(zip(index.ids, index.offsets.tolist(), strict=True))
                base = named.get(e.base_ref)
                if base is None:
                    raise LookupError(f"the base is not in the pack: {e.base_ref}")
            elif base is not None and base not in place:
                raise formats.Corrupt(f"no entry of pack {part.pack} begins at {base}")
            bases[at] = base
        known: dict[int, tuple[int, int]] = {}
        s, n = pa.string(), pa.int64()
        types, names = (s, n, s, n, n, s, n, n, n, s, s, n, n, n, s, s), [f.split()[0] for f in KINDS["chains"].split(", ")]
        rows = []
        for at, e in entries.items():
            way, to = [], at
            while to not in known:
                way.append(to)
                if len(way) > len(entries):
                    raise Circle("an entry is its own ancestor")
                if bases[to] is None:
                    known[to] = to, 0
                else:
                    to = bases[to]
            root, depth = known[to]
            for below in reversed(way):
                if below not in known:
                    depth += 1
                    known[below] = root, depth
            root, depth = known[at]
            kind = entries[root].kind
            if self.types is not None and kind not in self.types:
                continue
            i, base = place[at], bases[at]
            crc = None if index.crc is None else int(index.crc[i])
            rows.append((part.pack, part.lo + i, index.ids[i], at, crc, e.kind, e.size, at + e.length, e.base_offset, e.base_ref, path, base, root, depth, kind, None if base is None else index.ids[place[base]]))
            if len(rows) == ROWS:
                yield _batch(rows, types, " ".join(names))
                rows = []
        if rows:
            yield _batch(rows, types, " ".join(names))


def _shared(slices: list[Slice], most: int) -> list[Slices]:
    """Slices, in order, put together while they have no more than ``most`` entries."""
    out: list[list[Slice]] = []
    held = 0
    for s in slices:
        n = s.hi - s.lo
        if not out or held + n > most:
            out.append([])
            held = 0
        out[-1].append(s)
        held += n
    return [Slices(x) for x in out]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        elif lo < hi:
            out.append((lo, hi))
    return out


def _batch(rows: list[tuple], types: Sequence[pa.DataType], names: str) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[]] * len(types)
    return pa.record_batch([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names.split())
