"""Identifiers as Columns: full ids are strings of 40 lower-case hexadecimal digits, which sort as their bytes do."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_PACK = "pack-([0-9a-f]{40})\\.(?:idx|pack)$"


def check_prefix(prefix: str) -> str:
    """``prefix`` in lower case; a ValueError unless it is 1 to 40 hexadecimal digits."""
    if not re.fullmatch("[0-9a-fA-F]{1,40}", prefix):
        raise ValueError(f"no prefix of an id: {prefix!r}")
    return prefix.lower()


def matches(oid: Column, prefix: str) -> Column:
    """Equality for a whole id, else a prefix test; both reach the scan."""
    prefix = check_prefix(prefix)
    return oid == prefix if len(prefix) == 40 else oid.startswith(prefix)


def first_byte(oid: Column) -> Column:
    return F.conv(F.substring(oid, 1, 2), 16, 10).cast("int")


def bucket(oid: Column, bits: int = 8) -> Column:
    """The top ``bits`` (8 to 16) of an id."""
    if not 8 <= bits <= 16:
        raise ValueError("8 to 16 bits")
    return F.shiftright(F.conv(F.substring(oid, 1, 4), 16, 10).cast("int"), 16 - bits)


def short(oid: Column, digits: int = 32) -> Column:
    return F.substring(oid, 1, digits)


def full(text: Column) -> Column:
    """The first 40 digits of ``text`` as an id, null if they are none."""
    head = F.lower(F.substring(text, 1, 40))
    return F.when(head.rlike("^[0-9a-f]{40}$"), head)


def truncated(text: Column) -> Column:
    """The first 32 digits of ``text``, null if they are no hexadecimal digits."""
    head = F.lower(F.substring(text, 1, 32))
    return F.when(head.rlike("^[0-9a-f]{32}$"), head)


def to_bytes(oid: Column) -> Column:
    return F.unhex(oid)


def from_bytes(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def parts(oid: Column) -> tuple[Column, Column]:
    """The first 32 digits and the last 8 as a number."""
    return short(oid), F.conv(F.substring(oid, 33, 8), 16, 10).cast("bigint")


def from_parts(head: Column, rest: Column) -> Column:
    return F.concat(head, F.lpad(F.lower(F.hex(rest)), 8, "0"))


def from_path(path: Column) -> Column:
    """The id of a loose object's path, null for other files."""
    found = F.concat(F.regexp_extract(path, "(?:^|/)([0-9a-f]{2})/([0-9a-f]{38})$", 1), F.regexp_extract(path, "(?:^|/)([0-9a-f]{2})/([0-9a-f]{38})$", 2))
    return F.when(found != "", found)


def from_folder_and_file(folder: Column, file: Column) -> Column:
    return full(F.concat(folder, file))


def pack_id(path: Column) -> Column:
    """The id in a pack's or an index's name, null for other files."""
    found = F.regexp_extract(path, _PACK, 1)
    return F.when(found != "", found)


def loose_path(root: Column | str, oid: Column) -> Column:
    root = F.lit(root) if isinstance(root, str) else root
    return F.concat_ws("/", root, F.substring(oid, 1, 2), F.substring(oid, 3, 38))


def pack_path(root: Column | str, pack: Column, suffix: str = "pack") -> Column:
    root = F.lit(root) if isinstance(root, str) else root
    return F.concat(root, F.lit("/pack/pack-"), pack, F.lit(f".{suffix}"))
