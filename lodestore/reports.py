"""The reports: listings and renderings as DataFrames with a line for each row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.db import ObjectDB
from lodestore.functions import objects as B
from lodestore.functions import oid as O
from lodestore.operators import graph, index, lookup
from lodestore.session import stash


def cat_file(db: ObjectDB, prefix: str, digits: int = 40) -> DataFrame:
    """oid, type and text of the one object with a prefix."""
    return render(db.get(prefix), digits)


def render(found: DataFrame, digits: int = 40) -> DataFrame:
    """oid, type and text of objects: heads and message, entries, or content."""
    p = F.col("payload")
    commit = B.render_commit(*B.parse_commit(p, "full"), digits=digits)
    text = F.when(F.col("type") == "commit", commit).when(F.col("type") == "tree", B.render_tree(B.parse_tree(p), digits)).otherwise(B.utf8_lossy(p))
    return found.select("oid", "type", text.alias("text"))


def resolve_ambiguous(db: ObjectDB, prefix: str) -> DataFrame:
    """The ids with a prefix, each once, in order."""
    return lookup.distinct_ids(db.locations(prefix), prefix)


def index_line(digits: int = 40):
    crc = F.when(F.col("crc32").isNotNull(), F.concat(F.lit(" ("), F.lpad(F.lower(F.hex("crc32")), 8, "0"), F.lit(")"))).otherwise("")
    return F.concat(F.col("offset").cast("string"), F.lit(" "), O.short(F.col("oid"), digits), crc)


def show_index(db: ObjectDB, pack_id: str, digits: int = 40) -> DataFrame:
    """idx_pos and line, in the order of the index."""
    return db.entries(packs=[pack_id]).select("idx_pos", index_line(digits).alias("line")).orderBy("idx_pos")


def verify_pack(db: ObjectDB, pack_id: str, digits: int = 40) -> DataFrame:
    """offset and line (id, type, size as stored, size in the pack, offset, depth and base), in the order of offsets."""
    rows = index.size_in_pack(db.resolved([pack_id]), db.packs())
    return rows.select("offset", pack_line(digits).alias("line")).orderBy("offset")


def pack_line(digits: int = 40):
    base = F.when(F.col("depth") > 0, F.concat_ws(" ", F.lit(""), F.col("depth").cast("string"), O.short(F.col("base_oid"), digits))).otherwise("")
    return F.concat(F.concat_ws(" ", O.short(F.col("oid"), digits), F.rpad("type", 6, " "), *(F.col(c).cast("string") for c in ("inflated_size", "size_in_pack", "offset"))), base)


def log_oneline(db: ObjectDB, prefix: str, limit: int | None = None, digits: int = 40) -> DataFrame:
    """depth and line (id and subject), from the commit with a prefix along first parents.

    With a ``limit`` no more commits than that are read, one after the other; without, all are, and joined by doubling.
    """
    head = db.one(prefix)
    if limit is None:
        commits = stash(db.commits("parents_subject"), "commits")
        return log(commits, head, None, digits).select("depth", "line").orderBy("depth")
    subject = B.commit_field(F.col("payload"), "subject")
    return db.history(head, limit).select("depth", F.concat_ws(" ", O.short(F.col("oid"), digits), subject).alias("line")).orderBy("depth")


def log(commits: DataFrame, heads: DataFrame, limit: int | None = None, digits: int = 40) -> DataFrame:
    """head, depth, oid, subject and line of the first-parent history of each of ``heads``."""
    edges = commits.select(F.col("oid").alias("node"), F.element_at("parents", F.when(F.size("parents") > 0, 1)).alias("parent"))
    walked = graph.chain(edges, heads.select(F.col("oid").alias("node")), limit)
    return walked.join(commits.select(F.col("oid").alias("node"), "subject"), "node").select("head", "depth", F.col("node").alias("oid"), "subject", F.concat_ws(" ", O.short(F.col("node"), digits), F.col("subject")).alias("line"))


def list_ids(db: ObjectDB) -> DataFrame:
    """Every id once, in order."""
    return db.ids().distinct().orderBy("oid")


def which_pack(db: ObjectDB, prefix: str) -> DataFrame:
    """oid, store and path of every copy of the one object with a prefix."""
    one = lookup.resolve(db.locations(prefix), prefix)
    return db.locations(one).select("oid", "store", "pack_id", "path", "offset")


def walk(db: ObjectDB, prefix: str) -> DataFrame:
    """oid and path of every blob of the commit with a prefix; of other objects only the trees on the way are read."""
    found = db.get(prefix, ["commit"]).select(B.commit_field(F.col("payload"), "tree").alias("root"))
    return graph.descend(db.tree_entries, found).select("oid", "path")
