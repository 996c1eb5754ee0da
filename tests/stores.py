"""Object stores for tests: written by plain git where it is there, and by an encoder of the tests' own."""

import hashlib
import os
import shutil
import struct
import subprocess
import zlib

HAS_GIT = shutil.which("git") is not None
ENV = {"GIT_AUTHOR_NAME": "Ann Müller", "GIT_AUTHOR_EMAIL": "a@x.org", "GIT_COMMITTER_NAME": "Bo", "GIT_COMMITTER_EMAIL": "b@x.org", "GIT_AUTHOR_DATE": "1700000000 +0100", "GIT_COMMITTER_DATE": "1700000100 -0330", "HOME": "/nonexistent", "GIT_CONFIG_NOSYSTEM": "1"}


def git(repo, *args, data=None):
    return subprocess.run(["git", "-C", str(repo), *args], input=data, capture_output=True, check=True, env=os.environ | ENV).stdout


def git_store(path):
    """A repository with two packs (one of ofs, one of ref deltas), loose objects, a merge and a tag."""
    path.mkdir()
    git(path, "init", "-q", "-b", "main")
    text = [f"line {i} of a file that is long enough to be stored as a delta\n" for i in range(400)]
    (path / "dir" / "deep").mkdir(parents=True)
    for n in range(12):
        text[n * 7] = f"changed in {n}\n"
        (path / "dir" / "file.txt").write_text("".join(text))
        (path / "dir" / "deep" / "ü b.txt").write_bytes(b"\xff\xfe" + bytes([n]))
        git(path, "add", "-A")
        git(path, "commit", "-qm", f"step {n}\n\nwhat was done in {n}\n")
    git(path, "repack", "-adq", "--depth=50", "--window=50")
    git(path, "checkout", "-qb", "side")
    (path / "dir" / "other").write_text("".join(text[::-1]))
    os.symlink("dir/other", path / "link")
    (path / "run.sh").write_text("x")
    os.chmod(path / "run.sh", 0o755)
    git(path, "add", "-A")
    git(path, "commit", "-qm", "on the side")
    git(path, "checkout", "-q", "main")
    (path / "m").write_text("m")
    git(path, "add", "-A")
    git(path, "commit", "-qm", "on main")
    git(path, "merge", "-q", "--no-edit", "side")
    objects = git(path, "rev-list", "--objects", "--all").split(b"\n")
    ids = b"\n".join(sorted({x.split(b" ")[0] for x in objects if x})[:60])
    git(path, "pack-objects", "-q", "--no-reuse-delta", "--window=50", str(path / ".git/objects/pack/pack"), data=ids)
    git(path, "tag", "-am", "a tag\n\nof some lines", "v1")
    (path / ".git/objects/00").mkdir(exist_ok=True)
    (path / ".git/objects/00/tmp_obj_x").write_bytes(b"x")
    return path / ".git" / "objects"


def oid(kind, data):
    return hashlib.sha1(f"{kind} {len(data)}".encode() + b"\0" + data).hexdigest()


def put_loose(root, kind, data):
    name = oid(kind, data)
    (root / name[:2]).mkdir(parents=True, exist_ok=True)
    (root / name[:2] / name[2:]).write_bytes(zlib.compress(f"{kind} {len(data)}".encode() + b"\0" + data))
    return name


def entry(kind, size, extra=b""):
    number = {"commit": 1, "tree": 2, "blob": 3, "tag": 4, "ofs": 6, "ref": 7}[kind]
    out, size, first = [], size, True
    while True:
        bits = 4 if first else 7
        part = size & (1 << bits) - 1
        size >>= bits
        out.append((0x80 if size else 0) | (number << 4 if first else 0) | part)
        first = False
        if not size:
            return bytes(out) + extra


def back(n):
    out = bytes([n % 128])
    n //= 128
    while n:
        n -= 1
        out = bytes([128 | n % 128]) + out
        n //= 128
    return out


def le(n):
    out = b""
    while n >= 128:
        out += bytes([128 | n % 128])
        n //= 128
    return out + bytes([n])


def append_delta(base, tail):
    """Copies all of ``base`` and inserts up to 127 bytes."""
    copy = b""
    for at in range(0, len(base), 0x10000):
        n = min(0x10000, len(base) - at)
        copy += b"\xb3" + struct.pack("<H", at & 0xFFFF) + struct.pack("<H", n & 0xFFFF) if at < 0x10000 and n < 0x10000 else b"\xbf" + struct.pack("<I", at) + struct.pack("<H", n & 0xFFFF)
    return le(len(base)) + le(len(base) + len(tail)) + copy + bytes([len(tail)]) + tail


def put_pack(root, items, version=2, idx=2, far=False):
    """items: (id, kind, data, base): base is the place of an item for ofs, an id for ref."""
    raw, rows, at = b"PACK" + struct.pack(">II", version, len(items)), [], []
    for name, kind, data, base in items:
        extra = back(len(raw) - at[base]) if kind == "ofs" else bytes.fromhex(base) if kind == "ref" else b""
        one = entry(kind, len(data), extra) + zlib.compress(data)
        at.append(len(raw))
        rows.append((name, len(raw), zlib.crc32(one)))
        raw += one
    raw += hashlib.sha1(raw).digest()
    rows.sort()
    fan = b"".join(struct.pack(">I", sum(int(r[0][:2], 16) <= b for r in rows)) for b in range(256))
    if idx == 1:
        index = fan + b"".join(struct.pack(">I", r[1]) + bytes.fromhex(r[0]) for r in rows)
    else:
        index = b"\xfftOc" + struct.pack(">I", 2) + fan + b"".join(bytes.fromhex(r[0]) for r in rows) + b"".join(struct.pack(">I", r[2]) for r in rows)
        index += b"".join(struct.pack(">I", 0x80000000 | i if far else r[1]) for i, r in enumerate(rows)) + (b"".join(struct.pack(">Q", r[1]) for r in rows) if far else b"")
    index += raw[-20:]
    index += hashlib.sha1(index).digest()
    name = raw[-20:].hex()
    (root / "pack").mkdir(parents=True, exist_ok=True)
    (root / "pack" / f"pack-{name}.pack").write_bytes(raw)
    (root / "pack" / f"pack-{name}.idx").write_bytes(index)
    return name
