"""Byte codecs of loose objects, pack indexes, packs and deltas, used inside tasks only.

Written from the public descriptions of the formats; both directions, since queries encode what they read.
"""

from __future__ import annotations

import hashlib
import mmap
import re
import struct
import zlib
from collections.abc import Callable
from typing import NamedTuple

import numpy as np

IDX_MAGIC, PACK_MAGIC = b"\xfftOc", b"PACK"
TYPES = {1: "commit", 2: "tree", 3: "blob", 4: "tag", 6: "ofs_delta", 7: "ref_delta"}
NUMBERS = {name: n for n, name in TYPES.items()}
#: Bytes of an entry that hold its header, whatever it is: ten of size and type, and ten of offset or twenty of base.
HEADER_BYTES = 32


class Corrupt(ValueError):
    """Bytes that don't follow the format."""


# loose objects


def encode_loose(kind: str, payload: bytes, level: int = -1) -> bytes:
    return zlib.compress(f"{kind} {len(payload)}\0".encode() + payload, level)


def split_header(raw: bytes) -> tuple[str, int, int]:
    """(type, size, where the payload starts) of an inflated object."""
    end = raw.find(b"\0")
    kind, _, size = raw[: max(end, 0)].partition(b" ")
    if end < 0 or kind not in (b"commit", b"tree", b"blob", b"tag") or not size.isdigit():
        raise Corrupt(f"no object header: {raw[:20]!r}")
    return kind.decode(), int(size), end + 1


def decode_loose(data: bytes) -> tuple[str, bytes]:
    """(type, payload); the declared size has to be the payload's."""
    z = zlib.decompressobj()
    try:
        raw = z.decompress(data)
    except zlib.error as e:
        raise Corrupt(f"not inflatable: {e}") from None
    kind, size, start = split_header(raw)
    if not z.eof or len(raw) - start != size:
        raise Corrupt("the payload is not as long as declared")
    return kind, raw[start:]


#: Bytes of a loose object that hold its header, deflated.
LOOSE_HEAD = 512


def read_loose(path: str, types: frozenset[str] | None = None) -> tuple[str, bytes] | None:
    """(type, payload) of the file; None for another type, of which only the head is read."""
    with open(path, "rb") as f:
        data = f.read(LOOSE_HEAD)
        if types is not None and loose_header(data)[0] not in types:
            return None
        return decode_loose(data + f.read())


def loose_header(data: bytes) -> tuple[str, int]:
    """(type, size) from the first bytes alone."""
    try:
        return split_header(zlib.decompressobj().decompress(data, 64))[:2]
    except zlib.error as e:
        raise Corrupt(f"not inflatable: {e}") from None


# pack indexes


class Index(NamedTuple):
    """An index's version, fanout and, for a stretch of positions, ids (hex), checksums and offsets."""

    version: int
    fanout: np.ndarray
    ids: list[str]
    crc: np.ndarray | None
    offsets: np.ndarray


def index_head(f) -> tuple[int, np.ndarray]:
    """(version, fanout) of an open index file."""
    head = f.read(8)
    if head[:4] == IDX_MAGIC:
        if head[4:] != b"\0\0\0\2":
            raise Corrupt("unknown index version")
        version, raw = 2, f.read(1024)
    else:
        version, raw = 1, head + f.read(1016)
    if len(raw) != 1024:
        raise Corrupt("the fanout is short")
    fanout = np.frombuffer(raw, ">u4").astype(np.int64)
    if (np.diff(fanout) < 0).any():
        raise Corrupt("the fanout falls")
    return version, fanout


def read_index(f, lo: int = 0, hi: int | None = None) -> Index:
    """Positions lo to hi of an open index file, by seeking."""
    version, fanout = index_head(f)
    total = int(fanout[255])
    hi = total if hi is None else min(hi, total)
    n = max(0, hi - lo)

    def column(at: int, dtype: str, first: int, count: int) -> np.ndarray:
        width = np.dtype(dtype).itemsize
        f.seek(at + first * width)
        raw = f.read(count * width)
        if len(raw) != count * width:
            raise Corrupt("the index is short")
        return np.frombuffer(raw, dtype)

    if version == 1:
        rows = column(1024, "V24", lo, n).view([("offset", ">u4"), ("oid", "V20")]) if n else np.zeros(0, [("offset", ">u4"), ("oid", "V20")])
        return Index(1, fanout, _hex(rows["oid"].tobytes()), None, rows["offset"].astype(np.int64))
    ids = column(1032, "V20", lo, n).tobytes()
    crc = column(1032 + 20 * total, ">u4", lo, n).astype(np.int64)
    offsets = column(1032 + 24 * total, ">u4", lo, n).astype(np.int64)
    far = np.flatnonzero(offsets >> 31)
    if len(far):
        places = offsets[far] & 0x7FFFFFFF
        first = int(places.min())
        offsets[far] = column(1032 + 28 * total, ">u8", first, int(places.max()) + 1 - first).astype(np.int64)[places - first]
    return Index(2, fanout, _hex(ids), crc, offsets)


class IndexMap:
    """A mapped index in which single ids are looked up: the fanout leaves a bucket, which is bisected."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.version, self.fanout = index_head(f)
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self.total = int(self.fanout[255])
        self.at, self.width, self.skip = (1024, 24, 4) if self.version == 1 else (1032, 20, 0)
        if len(self.map) < self.at + self.total * (24 if self.version == 1 else 28) + 40:
            raise Corrupt("the index is short")

    def id(self, pos: int) -> bytes:
        at = self.at + pos * self.width + self.skip
        return self.map[at : at + 20]

    def bisect(self, raw: bytes) -> int:
        """The first position with an id of at least ``raw``, which has 20 bytes."""
        lo, hi = int(self.fanout[raw[0] - 1]) if raw[0] else 0, int(self.fanout[raw[0]])
        while lo < hi:
            mid = (lo + hi) // 2
            if self.id(mid) < raw:
                lo = mid + 1
            else:
                hi = mid
        return lo

    def bounds(self, low: str, high: str) -> tuple[int, int]:
        """Positions from ``low`` to ``high``, hexadecimal, ends included; shorter ones are filled up."""
        lo = self.bisect(bytes.fromhex(low[:40].ljust(40, "0")))
        top = bytes.fromhex(high[:40].ljust(40, "f"))
        hi = self.bisect(top)
        while hi < self.total and self.id(hi) == top:
            hi += 1
        return lo, hi

    def offset(self, pos: int) -> int:
        if self.version == 1:
            return int.from_bytes(self.map[1024 + 24 * pos : 1028 + 24 * pos], "big")
        base = 1032 + 24 * self.total
        near = int.from_bytes(self.map[base + 4 * pos : base + 4 * pos + 4], "big")
        if not near >> 31:
            return near
        at = base + 4 * self.total + 8 * (near & 0x7FFFFFFF)
        return int.from_bytes(self.map[at : at + 8], "big")

    def find(self, oid: str) -> int | None:
        """The offset of an object in the pack."""
        raw = bytes.fromhex(oid)
        pos = self.bisect(raw)
        return self.offset(pos) if pos < self.total and self.id(pos) == raw else None


def _hex(raw: bytes) -> list[str]:
    text = raw.hex()
    return [text[i : i + 40] for i in range(0, len(text), 40)]


def encode_index(rows: list[tuple[str, int, int]], pack_sha: bytes = b"\0" * 20, version: int = 2) -> bytes:
    """An index of (id, offset, crc) rows."""
    rows = sorted(rows)
    first = np.array([int(r[0][:2], 16) for r in rows], np.int64)
    fanout = np.cumsum(np.bincount(first, minlength=256)).astype(">u4").tobytes()
    if version == 1:
        out = fanout + b"".join(struct.pack(">I", off) + bytes.fromhex(oid) for oid, off, _ in rows)
    else:
        far = [off for _, off, _ in rows if off >> 31]
        place = {off: i for i, off in enumerate(far)}
        near = b"".join(struct.pack(">I", place[off] | 1 << 31 if off >> 31 else off) for _, off, _ in rows)
        out = IDX_MAGIC + b"\0\0\0\2" + fanout + b"".join(bytes.fromhex(r[0]) for r in rows) + b"".join(struct.pack(">I", r[2]) for r in rows) + near + b"".join(struct.pack(">Q", x) for x in far)
    out += pack_sha
    return out + hashlib.sha1(out).digest()


# packs


def pack_head(data: bytes) -> tuple[int, int]:
    """(version, objects)."""
    if len(data) < 12 or data[:4] != PACK_MAGIC:
        raise Corrupt("no pack")
    version, n = struct.unpack(">II", data[4:12])
    if version not in (2, 3):
        raise Corrupt("unknown pack version")
    return version, n


def encode_entry_headers(numbers: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The headers of many base entries as rows of ten bytes, and how many of these each one takes."""
    out, left = np.zeros((len(sizes), 10), np.uint8), sizes >> 4
    out[:, 0] = numbers << 4 | sizes & 15
    length = np.ones(len(sizes), np.int64)
    for k in range(1, 10):
        more = left > 0
        out[more, k - 1] |= 128
        out[:, k] = np.where(more, left & 127, 0)
        length += more
        left = left >> 7
    return out, length


def entry_headers(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(type number, size, length) of many headers, rows of at least ten bytes each."""
    size, length, go = (raw[:, 0] & 15).astype(np.int64), np.ones(len(raw), np.int64), raw[:, 0] >> 7 == 1
    for k in range(1, 10):
        size |= np.where(go, (raw[:, k] & 127).astype(np.int64) << (7 * k - 3), 0)
        length += go
        go = go & (raw[:, k] >> 7 == 1)
    return raw[:, 0] >> 4 & 7, size, length


def encode_offset_varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Many offsets as rows of ten bytes, right-aligned, and how many of these each one takes."""
    out, length, left = np.zeros((len(values), 10), np.uint8), np.ones(len(values), np.int64), values >> 7
    out[:, 9] = values & 127
    for k in range(8, -1, -1):
        more = left > 0
        left = np.where(more, left - 1, 0)
        out[:, k] = np.where(more, left & 127 | 128, 0)
        length += more
        left = left >> 7
    return out, length


def offset_varints(raw: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The values of rows as ``encode_offset_varints`` makes them."""
    value = np.zeros(len(raw), np.int64)
    for k in range(10):
        own, first = length >= 10 - k, length == 10 - k
        value = np.where(own, np.where(first, 0, value + 1 << 7) | (raw[:, k] & 127), value)
    return value


class Entry(NamedTuple):
    kind: str
    size: int
    length: int
    base_offset: int | None
    base_ref: str | None


def entry_header(data: bytes, offset: int) -> Entry:
    """The header of the entry at ``offset`` of its pack; ``data`` begins there."""
    try:
        byte = data[0]
        kind, size, shift, at = byte >> 4 & 7, byte & 15, 4, 1
        while byte & 128:
            byte = data[at]
            size |= (byte & 127) << shift
            shift += 7
            at += 1
        if kind not in TYPES:
            raise Corrupt(f"unknown entry type {kind}")
        if kind == 6:
            back, at = offset_varint(data, at)
            if not 0 < back <= offset - 12:
                raise Corrupt("the base is outside the pack")
            return Entry("ofs_delta", size, at, offset - back, None)
        if kind == 7:
            if len(data) < at + 20:
                raise Corrupt("the entry is short")
            return Entry("ref_delta", size, at + 20, None, data[at : at + 20].hex())
        return Entry(TYPES[kind], size, at, None, None)
    except IndexError:
        raise Corrupt("the entry is short") from None


def encode_entry_header(kind: str, size: int) -> bytes:
    byte, size, out = NUMBERS[kind] << 4 | size & 15, size >> 4, bytearray()
    while size:
        out.append(byte | 128)
        byte, size = size & 127, size >> 7
    return bytes(out) + bytes([byte])


def offset_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """(value, where it ends): groups of seven bits, high ones first, one added for each group that follows."""
    value = data[at] & 127
    while data[at] & 128:
        at += 1
        value = value + 1 << 7 | data[at] & 127
    return value, at + 1


def encode_offset_varint(value: int) -> bytes:
    out = [value & 127]
    while value := value >> 7:
        value -= 1
        out.append(value & 127 | 128)
    return bytes(reversed(out))


def inflate(data: bytes, size: int) -> bytes:
    z = zlib.decompressobj()
    try:
        out = z.decompress(data)
    except zlib.error as e:
        raise Corrupt(f"not inflatable: {e}") from None
    if not z.eof or len(out) != size:
        raise Corrupt("the entry is not as long as declared")
    return out


def inflate_at(f, start: int, size: int) -> tuple[bytes, int]:
    """(payload, where its stream ends) of the stream at ``start`` of an open file; it is read until it ends, no further."""
    z, out, at = zlib.decompressobj(), [], start
    f.seek(start)
    try:
        while not z.eof:
            data = f.read(min(1 << 20, size + 256))
            if not data:
                raise Corrupt("the entry is short")
            out.append(z.decompress(data))
            at += len(data)
    except zlib.error as e:
        raise Corrupt(f"not inflatable: {e}") from None
    payload = b"".join(out)
    if len(payload) != size:
        raise Corrupt("the entry is not as long as declared")
    return payload, at - len(z.unused_data)


def stored(data: bytes) -> bytes:
    """A zlib stream of stored blocks, whose size follows from that of ``data``."""
    parts = [data[i : i + 65535] for i in range(0, len(data), 65535)] or [b""]
    blocks = [struct.pack("<BHH", i + 1 == len(parts), len(p), len(p) ^ 0xFFFF) + p for i, p in enumerate(parts)]
    return b"\x78\x01" + b"".join(blocks) + struct.pack(">I", zlib.adler32(data))


def encode_pack(entries: list[tuple[str, bytes, int | str | None]], version: int = 2, deflate: Callable[[bytes], bytes] = zlib.compress) -> tuple[bytes, list[int], list[int]]:
    """(pack, offsets, checksums) of (kind, data, base): for deltas, base is the place of an earlier entry or an id."""
    out, offsets, sums = bytearray(PACK_MAGIC + struct.pack(">II", version, len(entries))), [], []
    for kind, data, base in entries:
        raw = encode_entry_header(kind, len(data))
        if kind == "ofs_delta":
            raw += encode_offset_varint(len(out) - offsets[base])
        elif kind == "ref_delta":
            raw += bytes.fromhex(base)
        raw += deflate(data)
        offsets.append(len(out))
        sums.append(zlib.crc32(raw))
        out += raw
    return bytes(out + hashlib.sha1(out).digest()), offsets, sums


# trees

_TREE_ENTRY = re.compile(rb"([0-7]+) (.+?)\0(.{20})", re.S)


def tree_entries(payload: bytes) -> list[tuple[bytes, bytes, bytes]]:
    """(mode, name, id in bytes) of each entry of a tree, in stored order; they have to reach to its end."""
    found = _TREE_ENTRY.findall(payload)
    if sum(len(mode) + len(name) for mode, name, _ in found) + 22 * len(found) != len(payload):
        raise Corrupt("a tree is not entries to its end")
    return found


# deltas


def size_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """(value, where it ends): groups of seven bits, low ones first."""
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if not byte & 128:
            return value, at


def encode_size_varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes(out) + bytes([value])


def apply_delta(base: bytes, delta: bytes) -> bytes:
    """The object that ``delta`` makes of ``base``; declared sizes have to hold."""
    try:
        source, at = size_varint(delta)
        size, at = size_varint(delta, at)
        if source != len(base):
            raise Corrupt("the delta is for another base")
        parts = []
        while at < len(delta):
            op = delta[at]
            at += 1
            if op & 128:
                args = [0] * 7
                for i in range(7):
                    if op >> i & 1:
                        args[i] = delta[at]
                        at += 1
                start = int.from_bytes(bytes(args[:4]), "little")
                n = int.from_bytes(bytes(args[4:]), "little") or 0x10000
                if start + n > len(base):
                    raise Corrupt("the delta copies from outside its base")
                parts.append(base[start : start + n])
            elif op:
                if at + op > len(delta):
                    raise Corrupt("the delta is short")
                parts.append(delta[at : at + op])
                at += op
            else:
                raise Corrupt("a delta has no instruction 0")
    except IndexError:
        raise Corrupt("the delta is short") from None
    out = b"".join(parts)
    if len(out) != size:
        raise Corrupt("the delta makes another size")
    return out


def make_delta(base: bytes, target: bytes) -> bytes:
    """A delta of the longest common prefix and suffix, copied, and what lies between, inserted."""
    most = min(len(base), len(target))
    a, b = np.frombuffer(base, np.uint8), np.frombuffer(target, np.uint8)
    differ = np.flatnonzero(a[:most] != b[:most])
    head = int(differ[0]) if len(differ) else most
    rest = most - head
    differ = np.flatnonzero(a[len(a) - rest :][::-1] != b[len(b) - rest :][::-1])
    tail = int(differ[0]) if len(differ) else rest
    out = encode_size_varint(len(base)) + encode_size_varint(len(target))

    def copy(start: int, n: int) -> bytes:
        made = b""
        while n:
            part = min(n, 0xFFFFFF)
            made += b"\xff" + struct.pack("<I", start) + struct.pack("<I", part)[:3]
            start, n = start + part, n - part
        return made

    middle = target[head : len(target) - tail]
    out += copy(0, head)
    for i in range(0, len(middle), 127):
        out += bytes([len(middle[i : i + 127])]) + middle[i : i + 127]
    return out + copy(len(base) - tail, tail)
