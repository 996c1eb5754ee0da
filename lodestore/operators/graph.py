"""Walks over edge tables, by doubling: n levels take log2(n) joins, and each round is written to the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.session import drop, stash
from lodestore.sources.reader import Circle

#: Rounds after which a chain has to be a circle: 2 ** 40 levels.
ROUNDS = 40


def chain(edges: DataFrame, heads: DataFrame, limit: int | None = None) -> DataFrame:
    """(head, node, depth): what each head leads to by edges (node, parent), itself at depth 0.

    A node has one parent at most. Only what heads reach is ever joined to a jump table whose steps double. With a
    ``limit``, depths below it. A null parent ends a chain, as does one that is no node, which is its last member.
    """
    jump = stash(edges.filter("parent is not null").select("node", "parent"), "jump")
    reach = stash(heads.select(F.col("node").alias("head"), "node", F.lit(0).cast("bigint").alias("depth")), "reach")
    for k in range(ROUNDS):
        if limit is not None and 1 << k >= limit:
            break
        more = stash(reach.join(jump, "node").select("head", F.col("parent").alias("node"), (F.col("depth") + (1 << k)).alias("depth")), "reach")
        found = more.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("head") == F.col("node")).alias("own")).first()
        if not found.n:
            break
        if found.own:
            raise Circle("a node is its own ancestor")
        reach = reach.unionByName(more)
        last = jump
        jump = stash(jump.alias("a").join(jump.alias("b"), F.col("a.parent") == F.col("b.node")).select("a.node", "b.parent"), "jump")
        drop(last)
    else:
        raise Circle("a chain does not end")
    return reach if limit is None else reach.filter(F.col("depth") < limit)


def roots(edges: DataFrame) -> DataFrame:
    """(node, root, depth) of every node; edges are (node, parent), a node without parent has null."""
    at = stash(edges.select("node", F.coalesce("parent", "node").alias("root"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("depth")), "roots")
    # n nodes have chains of n - 1 steps at most
    for _ in range(at.count().bit_length() + 1):
        ahead = at.select(F.col("node").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        met = at.join(ahead, "root", "left")
        last = at
        at = stash(met.select("node", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), (F.coalesce("more", F.lit(0)) > 0).alias("moved")), "roots")
        found = at.agg(F.count_if("moved").alias("moved"), F.count_if((F.col("node") == F.col("root")) & (F.col("depth") > 0)).alias("own")).first()
        drop(last)
        if found.own:
            raise Circle("a node is its own ancestor")
        if not found.moved:
            return at.drop("moved")
    raise Circle("a chain does not end")


def descend(entries: Callable[[DataFrame], DataFrame], start: DataFrame) -> DataFrame:
    """(root, oid, path) of every blob below the trees in ``start`` (column root), level by level.

    ``entries`` gives the entries (tree_oid, kind, name, oid) of the trees that it is handed, each once (tree_oid). Trees
    are as deep as paths are, so rounds are few; each asks for the trees found last, and those alone. Submodules are not
    followed.
    """
    level = stash(start.select("root", F.col("root").alias("tree_oid"), F.lit("").alias("path")), "walk")
    found = None
    while True:
        inner = level.join(entries(level.select("tree_oid").distinct()), "tree_oid").select("root", "kind", "oid", F.concat(F.col("path"), F.when(F.col("path") == "", "").otherwise("/"), F.col("name")).alias("path"))
        inner = stash(inner, "walk")
        blobs = inner.filter("kind = 'blob'").select("root", "oid", "path")
        found = blobs if found is None else found.unionByName(blobs)
        level = inner.filter("kind = 'tree'").select("root", F.col("oid").alias("tree_oid"), "path")
        if level.isEmpty():
            return found
