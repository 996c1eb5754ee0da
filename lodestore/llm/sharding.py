"""Sharding: Karmarkar-Karp differencing of indivisible groups into k shards of nearly equal bytes.

A partial partition is a k-tuple of sums. The two with the largest spread are combined oppositely ordered, largest
with smallest, until one is left. No task could difference all groups of a large corpus, so they form a tree of nodes
by a hash of their key, FAN below each, and a group is in the deepest node of its path that is large beside it: it has
at most 1 / (HOT * k) of the bytes below that node. Large groups then stay at the top, where they are few, and the
leaves have the small ones, about LEAF_GROUPS each. Level by level from the top, each node is differenced in an executor
together with its part of the k sums that the nodes above it left, so that it fills the shards around them. Nothing
reaches the driver but two numbers, and a level moves k numbers a node.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm import common

#: Shards into which the corpus goes.
SHARDS = 16
#: Groups that one task differences.
LEAF_GROUPS = 20_000
#: A group is differenced in a node in which it has at most this part of a shard's mean bytes.
HOT = 16
#: Nodes below each node.
FAN = 64


def differencing(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp over rows of ``sizes`` (m partial partitions of k sums each).

    Returns the k final sums, descending, and an m by k array: the final slot of each row's slots. Ties go to the
    row that came first.
    """
    m, k = sizes.shape
    order = np.argsort(-sizes, axis=1, kind="stable")
    sums = {i: sizes[i][order[i]] for i in range(m)}
    kids: dict[int, tuple[int, int, np.ndarray]] = {}
    heap = [(-int(s[0] - s[-1]), i) for i, s in sums.items()]
    heapq.heapify(heap)
    at = m
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums.pop(a) + sums.pop(b)[::-1]
        p = np.argsort(-both, kind="stable")
        both = both[p]
        kids[at] = a, b, np.argsort(p, kind="stable")  # where each old slot went
        sums[at] = both
        heapq.heappush(heap, (-int(both[0] - both[-1]), at))
        at += 1
    final = sums[at - 1]
    where = {at - 1: np.arange(k)}
    slots = np.empty((m, k), np.int64)
    for node in range(at - 1, -1, -1):
        w = where.pop(node)
        if node < m:
            slots[node][order[node]] = w
        else:
            a, b, went = kids[node]
            where[a] = w[went]
            where[b] = w[went[::-1]]
    return final, slots


_LEVEL = "g1 long, g2 long, shard long, node long, sums array<long>"


def _node(k: int):
    """Differences a node's groups together with its part of the sums above it.

    Beside the shards of its groups it returns a row with the sums that it leaves. What can't be evened out in it would
    go to the same shard in every node where the sums above are equal, so each node turns the shards by its number.
    """

    def run(groups: pa.Table, above: pa.Table) -> pa.Table:
        node = above.column("node")[0].as_py()
        groups = groups.sort_by([("bytes", "descending"), ("g1", "ascending"), ("g2", "ascending")])
        turned = (np.arange(k) + node) % k
        sizes = np.zeros((len(groups) + 1, k), np.int64)
        sizes[:-1, 0] = groups.column("bytes").to_numpy()
        sizes[-1] = np.array(above.column("sums")[0].as_py(), np.int64)[turned]
        final, slots = differencing(sizes)
        shard = np.empty(k, np.int64)
        shard[slots[-1]] = turned
        left = np.empty(k, np.int64)
        left[shard] = final
        none = pa.nulls(1, pa.int64())
        own = [pa.concat_arrays([none, *groups.column(c).chunks]) for c in ("g1", "g2")]
        own.append(pa.concat_arrays([none, pa.array(shard[slots[:-1, 0]], pa.int64())]))
        own.append(pa.array([node] * (len(groups) + 1), pa.int64()))
        own.append(pa.array([left.tolist()] + [None] * len(groups), pa.list_(pa.int64())))
        return pa.table(own, names=["g1", "g2", "shard", "node", "sums"])

    return run


def shard(df: DataFrame, group: Column, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, leaf_groups: int = LEAF_GROUPS, fan: int = FAN) -> DataFrame:
    """doc_id, group_key, bytes and shard, a row for every row of ``df``; rows of one ``group`` share a shard.

    A row weighs its UTF-8 bytes, a null text 0. Rows with a null group form one group. Equal inputs give equal
    shards, whatever the cluster: nodes, orders and ties depend on keys and bytes alone. Up to ``leaf_groups`` groups
    are one node, which is plain differencing. No rows give no rows; with fewer groups than shards, some shards stay
    empty. Identifiers are passed on as they are. Other columns are ignored.
    """
    rows = df.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(group, group.isNull()).alias("g1"), F.xxhash64(group.isNull(), F.lit("g2"), group).alias("g2"),
        F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long").alias("bytes"),
    )
    rows = common.stash(rows, "rows")
    groups = common.stash(rows.groupBy("g1", "g2").agg(F.sum("bytes").alias("bytes")), "groups")
    # two numbers
    n, total = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    depth = 0
    while leaf_groups * fan**depth < n:
        depth += 1
    level = F.lit(depth)
    for d in reversed(range(depth)):
        level = F.when(F.col("bytes") > total // (shards * HOT * fan ** (d + 1)), d).otherwise(level)
    at = lambda d: F.pmod("g1", F.lit(fan**d))
    groups = groups.withColumn("level", level)
    placed, left = None, None
    for d in range(depth + 1):
        # the bytes at and below each node of this level
        nodes = groups.filter(F.col("level") >= d).groupBy(at(d).alias("node")).agg(F.sum("bytes").alias("below"))
        if left is None:
            above = nodes.select("node", F.array_repeat(F.lit(0).cast("long"), shards).alias("sums"))
        else:
            up = nodes.withColumn("up", F.pmod("node", F.lit(fan ** (d - 1))))
            whole = up.groupBy("up").agg(F.sum("below").alias("whole"))
            share = F.transform("sums", lambda x: F.rint(x * (F.col("below") / F.greatest(F.col("whole"), F.lit(1)))).cast("long"))
            above = up.join(whole, "up").join(left.select(F.col("node").alias("up"), "sums"), "up").select("node", share.alias("sums"))
        own = groups.filter(F.col("level") == d).select(at(d).alias("node"), "g1", "g2", "bytes")
        done = common.stash(own.groupBy("node").cogroup(above.groupBy("node")).applyInArrow(_node(shards), _LEVEL), "level")
        left = done.filter("sums is not null").select("node", "sums")
        found = done.filter("sums is null").select("g1", "g2", "shard")
        placed = found if placed is None else placed.unionByName(found)
    return rows.join(placed, ["g1", "g2"]).select("doc_id", F.col("g1").alias("group_key"), "bytes", "shard")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` in one of 16 shards; exact copies share one."""
    return shard(common.table(spark, sf_dir, "documents"), F.col("text"))
