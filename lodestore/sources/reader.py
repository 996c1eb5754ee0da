"""Single objects of a store, read where they are: what a task that has ids, and not the whole store, goes by."""

from __future__ import annotations

import os
import re
from collections import OrderedDict
from typing import NamedTuple

from lodestore import formats

#: Bytes of bases that are remembered, since chains share them.
MEMO_BYTES = 64 << 20
IDX = re.compile("^pack-([0-9a-f]{40})\\.idx$")


class Circle(ValueError):
    """References that lead back to themselves."""


class Found(NamedTuple):
    oid: str
    type: str
    size: int
    payload: bytes
    store: str
    path: str
    pack_id: str | None
    offset: int | None


def pack_ids(root: str) -> list[str]:
    """The packs of a store that have an index, in order."""
    folder = f"{root}/pack"
    return sorted(m[1] for n in os.listdir(folder) if (m := IDX.match(n))) if os.path.isdir(folder) else []


#: Bytes of an index up to which its pack's chains are followed by one task: some 290,000 entries.
INDEX_BYTES = 8 << 20


def large_packs(root: str, most: int = INDEX_BYTES) -> list[str]:
    """The packs whose index has more than ``most`` bytes."""
    return [p for p in pack_ids(root) if os.path.getsize(f"{root}/pack/pack-{p}.idx") > most]


#: Indexes and packs that a reader keeps open.
OPEN = 64


class StoreReader:
    """Opens what it needs and keeps the last of it open: loose before packed, then the lowest pack."""

    def __init__(self, root: str):
        self.root, self.ids = root, pack_ids(root)
        self.indexes: OrderedDict[str, formats.IndexMap] = OrderedDict()
        self.packs: OrderedDict = OrderedDict()
        self.memo: OrderedDict[tuple[str, int], tuple[str, bytes]] = OrderedDict()
        self.held = 0

    def close(self) -> None:
        for f in (*self.packs.values(), *(x.map for x in self.indexes.values())):
            f.close()

    def index(self, pack: str) -> formats.IndexMap:
        if pack not in self.indexes:
            if len(self.indexes) == OPEN:
                self.indexes.popitem(last=False)[1].map.close()
            self.indexes[pack] = formats.IndexMap(f"{self.root}/pack/pack-{pack}.idx")
        return self.indexes[pack]

    def pack(self, pack: str):
        if pack not in self.packs:
            if len(self.packs) == OPEN:
                self.packs.popitem(last=False)[1].close()
            self.packs[pack] = open(f"{self.root}/pack/pack-{pack}.pack", "rb")  # noqa: SIM115
        return self.packs[pack]

    def place(self, oid: str) -> tuple[str | None, int | None] | None:
        """(pack, offset) of the first copy, nulls for a loose one; None where there is none. Every index may be opened."""
        return (None, None) if os.path.exists(f"{self.root}/{oid[:2]}/{oid[2:]}") else next(((p, at) for p in self.ids if (at := self.index(p).find(oid)) is not None), None)

    def beside(self, oid: str, pack: str | None) -> tuple[str | None, int | None] | None:
        """(pack, offset) of a copy in the same pack, or among the loose objects for no pack; None where there is none."""
        if pack is None:
            return (None, None) if os.path.exists(f"{self.root}/{oid[:2]}/{oid[2:]}") else None
        at = self.index(pack).find(oid)
        return None if at is None else (pack, at)

    def read_at(self, oid: str, pack: str | None, offset: int | None, types: frozenset[str] | None = None) -> Found | None:
        """The object at a place, or None if it is none of ``types``; then no more than headers is inflated."""
        path = f"{self.root}/{oid[:2]}/{oid[2:]}" if pack is None else f"{self.root}/pack/pack-{pack}.pack"
        found = formats.read_loose(path, types) if pack is None else self.chain(pack, offset, types)
        return found and Found(oid, found[0], len(found[1]), found[1], "loose" if pack is None else "packed", path, pack, offset)

    def chain(self, pack: str, offset: int, types: frozenset[str] | None = None) -> tuple[str, bytes] | None:
        """(type, payload) of the entry at ``offset``: its bases are followed by offset or id, none else is opened."""
        f, on_way, at = self.pack(pack), [], offset
        seen = set()
        while (held := self.memo.get((pack, at))) is None:
            if at in seen:
                raise Circle(f"an entry of pack {pack} is its own base")
            seen.add(at)
            f.seek(at)
            e = formats.entry_header(f.read(formats.HEADER_BYTES), at)
            on_way.append((at, e))
            if e.kind not in ("ofs_delta", "ref_delta"):
                break
            at = e.base_offset if e.base_ref is None else self.index(pack).find(e.base_ref)
            if at is None:
                raise formats.Corrupt(f"the base is not in the pack: {e.base_ref}")
        kind, data = held or (on_way[-1][1].kind, None)
        if types is not None and kind not in types:
            return None
        for at, e in reversed(on_way):
            raw = formats.inflate_at(f, at + e.length, e.size)[0]
            data = raw if data is None else formats.apply_delta(data, raw)
            self._remember((pack, at), kind, data)
        return kind, data

    def _remember(self, key: tuple[str, int], kind: str, data: bytes) -> None:
        self.memo[key] = kind, data
        self.held += len(data)
        while self.held > MEMO_BYTES and len(self.memo) > 1:
            self.held -= len(self.memo.popitem(last=False)[1][1])
