"""Objects as Columns: identity, parsing, encoding and rendering of commits, trees, blobs and tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Which fields of a commit each preset keeps; what is not selected is not computed.
PRESETS = {
    "full": ["tree", "parents", "author", "committer", "message"],
    "full_subject": ["tree", "parents", "author", "committer", "subject"],
    "subject_and_description": ["tree", "parents", "author", "committer", "subject", "description"],
    "tree_parents_subject": ["tree", "parents", "subject"],
    "parents_subject": ["parents", "subject"],
    "tree_parents": ["tree", "parents"],
    "parents": ["parents"],
    "no_message": ["tree", "parents", "author", "committer"],
}

_MODES = ["40000", "100644", "100664", "100640", "100755", "120000", "160000"]


def object_id(kind: Column | str, payload: Column) -> Column:
    """The content id: SHA-1 of type, size and payload."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    head = F.encode(F.concat(kind, F.lit(" "), F.octet_length(payload).cast("string")), "utf-8")
    return F.sha1(F.concat(head, F.unhex(F.lit("00")), payload))


def split_object(raw: Column) -> tuple[Column, Column, Column]:
    """Type, declared size and payload of an inflated object."""
    text = F.hex(F.substring(raw, 1, 32))
    head = F.decode(F.unhex(F.regexp_extract(text, "^((?:(?!00)..)*)00", 1)), "utf-8")
    return F.substring_index(head, " ", 1), F.substring_index(head, " ", -1).cast("bigint"), F.substring(raw, F.length(head) + 2, F.octet_length(raw))


# blobs


def utf8_strict(payload: Column) -> Column:
    """The text; an error for bytes that are no UTF-8."""
    return F.validate_utf8(payload.cast("string"))


def utf8_or_null(payload: Column) -> Column:
    return F.try_validate_utf8(payload.cast("string"))


def utf8_lossy(payload: Column) -> Column:
    """The text, with U+FFFD for what is no UTF-8."""
    return F.make_valid_utf8(payload.cast("string"))


# commits


def commit_text(payload: Column) -> tuple[Column, Column]:
    """Head and body: headers that go on over lines begin those with a blank, so the first empty line ends the head."""
    text = utf8_lossy(payload)
    at = F.instr(text, "\n\n")
    return F.when(at > 0, F.substring_index(text, "\n\n", 1)).otherwise(text), F.when(at > 0, F.substring(text, at + 2, F.length(text))).otherwise(F.lit(""))


def commit_field(payload: Column, name: str) -> Column:
    """One field: tree, parents, author, committer, message, subject or description; null where it is missing."""
    head, body = commit_text(payload)
    if name == "tree":
        found = F.regexp_extract(head, "^tree ([0-9a-f]{40})(?:\n|$)", 1)
    elif name == "parents":
        return F.regexp_extract_all(head, F.lit("(?dm)^parent ([0-9a-f]{40})$"), F.lit(1))
    elif name in ("author", "committer"):
        return F.when(head.rlike(f"(?dm)^{name} "), F.regexp_extract(head, f"(?dm)^{name} (.*)$", 1))
    else:
        message = F.rtrim(body, F.lit("\n"))
        if name == "message":
            return message
        if name == "subject":
            return F.substring_index(body, "\n", 1)
        if name == "description":
            at = F.instr(message, "\n\n")
            return F.when(at > 0, F.ltrim(F.substring(message, at + 2, F.length(message)), F.lit("\n"))).otherwise(F.lit(""))
        if name == "title":
            return F.substring_index(message, "\n\n", 1)
        raise ValueError(f"no field of a commit: {name}")
    return F.when(found != "", found)


def parse_commit(payload: Column, preset: str = "full") -> list[Column]:
    """The columns of a preset."""
    return [commit_field(payload, c).alias(c) for c in PRESETS[preset]]


def commit_error(payload: Column) -> Column:
    """What is wrong with a commit's head, null for a good one."""
    return F.when(commit_field(payload, "tree").isNull(), "no tree").when(commit_field(payload, "author").isNull(), "no author").when(commit_field(payload, "committer").isNull(), "no committer")


def person(line: Column) -> dict[str, Column]:
    """name, email, epoch seconds and zone of an author's or committer's line; nulls where it has another form."""
    form = r"^(.*?) ?<([^>]*)> (-?\d{1,18}) ([+-]\d{4})$"
    ok = line.rlike(form)
    part = lambda i: F.when(ok, F.regexp_extract(line, form, i))
    return {"name": part(1), "email": part(2), "seconds": part(3).cast("bigint"), "zone": part(4)}


def encode_commit(tree: Column, parents: Column, author: Column, committer: Column, message: Column, extra: Column | None = None) -> Column:
    """The bytes of a commit; ``extra`` are whole header lines, each with its end."""
    lines = [F.concat(F.lit("tree "), tree, F.lit("\n")), F.array_join(F.transform(parents, lambda p: F.concat(F.lit("parent "), p, F.lit("\n"))), ""), F.concat(F.lit("author "), author, F.lit("\n")), F.concat(F.lit("committer "), committer, F.lit("\n"))]
    return F.encode(F.concat(*lines, *([extra] if extra is not None else []), F.lit("\n"), message), "utf-8")


# tags


def parse_tag(payload: Column) -> list[Column]:
    head, body = commit_text(payload)
    part = lambda name: F.when(head.rlike(f"(?dm)^{name} "), F.regexp_extract(head, f"(?dm)^{name} (.*)$", 1))
    return [part("object").alias("object"), part("type").alias("object_type"), part("tag").alias("tag"), part("tagger").alias("tagger"), F.rtrim(body, F.lit("\n")).alias("message")]


# trees


def tree_mode(raw: Column) -> Column:
    """The canonical six digits; an error for what is no mode."""
    return F.when(raw == "100640", "100644").when(raw.isin(_MODES), F.lpad(raw, 6, "0")).otherwise(F.raise_error(F.concat(F.lit("no file mode: "), raw)))


def mode_kind(mode: Column) -> Column:
    return F.when(mode == "040000", "tree").when(mode == "160000", "commit").otherwise("blob")


def parse_tree(payload: Column) -> Column:
    """An array of (mode_raw, name_raw, oid) in stored order; one expression over the payload's hexadecimal digits."""
    entry = "\\G((?:3[0-7])+)20((?:[0-9A-F]{2})+?)00([0-9A-F]{40})"
    text = F.hex(payload)
    part = lambda k: F.regexp_extract_all(text, F.lit(entry), F.lit(k))
    zipped = F.arrays_zip(part(1).alias("mode"), part(2).alias("name"), part(3).alias("oid"))
    return F.transform(zipped, lambda e: F.struct(F.decode(F.unhex(e["mode"]), "utf-8").alias("mode_raw"), F.unhex(e["name"]).alias("name_raw"), F.lower(e["oid"]).alias("oid")))


def encode_tree(entries: Column) -> Column:
    """The bytes of an array of (mode, name, oid)."""
    return F.unhex(F.array_join(F.transform(entries, lambda e: F.concat(F.hex(F.encode(F.concat(e["mode"], F.lit(" "), e["name"]), "utf-8")), F.lit("00"), e["oid"])), ""))


# rendering


def render_commit(tree: Column, parents: Column, author: Column, committer: Column, message: Column, digits: int = 40) -> Column:
    shown = F.transform(parents, lambda p: F.concat(F.lit("parent "), F.substring(p, 1, digits), F.lit("\n")))
    return F.concat(F.lit("tree "), F.substring(tree, 1, digits), F.lit("\n"), F.array_join(shown, ""), F.lit("author "), author, F.lit("\ncommitter "), committer, F.lit("\n\n"), message)


def render_entry(mode: Column, oid: Column, name: Column, digits: int = 40) -> Column:
    return F.concat(mode, F.lit(" "), mode_kind(mode), F.lit(" "), F.substring(oid, 1, digits), F.lit("\t"), name)


def render_tree(entries: Column, digits: int = 40) -> Column:
    """The lines of a parsed tree."""
    return F.array_join(F.transform(entries, lambda e: render_entry(tree_mode(e["mode_raw"]), e["oid"], utf8_lossy(e["name_raw"]), digits)), "\n")
