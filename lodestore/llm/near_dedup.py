"""SimHash near-dedup: covering locality-sensitive hashing.

Each text has a 128-bit SimHash of its words, weighted by 1 + 2 ln(count), in two halves, and one of the set of its word
pairs. Structured bit masks cover the halves: bit i of a half is given the vector m(i) = (1, binary digits of i) of
seven bits, and the mask of a vector v has the 32 bits with <m(i), v> = 1. At most six differing bits span at most six
dimensions, so some v is orthogonal to all of them, and under its mask the two texts agree. Of two texts that are at
most RADIUS = 13 bits apart, one half differs by six bits at most: every pair within the radius collides in some table.
Pairs up to REACH bits apart are taken too where they collide, which most do. A pair counts as near copies if the
hashes of their word pairs are within PAIR_RADIUS as well. Near copies are linked into groups, and the document with
the smallest identifier stays.

Only distinct pairs of hashes are searched, as packed arrays: texts don't move for it, and thousands of copies are one.
The tables are gone through twice: first with sixteen bytes a fingerprint, to see which have any other
within reach; then with those only and with the hashes of their word pairs, to apply both radii to every pair of a
bucket. What is left of a bucket is a spanning forest of all its accepted pairs. A large bucket is searched component by
component: what one pivot reaches need not be compared among itself, and of the rest only what the triangle inequality
leaves. A part of a table that a hot key makes too large is cut into blocks, and each two blocks are a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm import common

#: Guaranteed radius, the distance up to which colliding pairs are taken, and the radius of the hash of word pairs.
RADIUS, REACH, PAIR_RADIUS = 13, 22, 34
#: Bytes of fingerprints that one task compares at a time; the number of a table's parts follows from it.
PART_BYTES = 16 << 20
#: A part with so many times the mean is cut into blocks of BLOCK fingerprints.
HOT, BLOCK = 1.5, 1 << 17
#: Fingerprints of a bucket from which on it is searched component by component.
LARGE = 64
_STRETCH = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = np.array([chr(b).isalnum() or b >= 128 for b in range(128)] + [True] * 128)


def masks() -> np.ndarray:
    """The mask of each non-zero vector of seven bits but the one with all 64 bits, which covers nothing of its own."""
    i = np.arange(64)
    rows = np.array([np.ones(64, int), *((i >> k) & 1 for k in range(6))])
    bits = [np.array([(v >> k) & 1 for k in range(7)]) @ rows % 2 for v in range(2, 128)]
    return np.packbits(np.array(bits, np.uint8), axis=1, bitorder="little").view(np.uint64).ravel()


#: (half, mask) of each table.
TABLES = [(half, mask) for half in (0, 1) for mask in masks()]


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word in the texts ``raw[start:end]`` and the number of words of each text.

    Words are runs of letters and digits; every byte of a sign beyond ASCII counts as a letter.
    """
    a, z = (int(start[0]), int(end[-1])) if len(start) else (0, 0)
    edge = np.zeros(z - a + 1, bool)
    edge[start - a] = True
    hashes, places = [], []
    at = a
    while at < z:
        stop = min(z, at + _STRETCH)
        if stop < z and _WORD[raw[stop - 1]]:
            rest = _WORD[raw[stop:z]] & ~edge[stop - a : z - a]
            stop += int(rest.argmin()) if not rest.all() else len(rest)
        part = raw[at:stop]
        inside = _WORD[part]
        new = edge[at - a : stop - a]
        first = inside & (new | ~np.concatenate([[False], inside[:-1]]))
        last = inside & ~np.concatenate([inside[1:] & ~new[1:], [False]])
        b, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        power, inverse = _powers(len(part) + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], dtype=np.uint64)])
            hashes.append(common.mix((sums[e] - sums[b]) * inverse[b] ^ (e - b).astype(np.uint64)))
        places.append(at + b)
        at = stop
    place = np.concatenate(places) if places else np.zeros(0, np.int64)
    n = np.searchsorted(place, end) - np.searchsorted(place, start)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), n


_held: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse modulo 2**64."""
    if len(_held[0]) < n:
        with np.errstate(over="ignore"):
            for k, base in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
                x = np.full(max(n, _STRETCH + 1), base, np.uint64)
                x[0] = 1
                _held[k] = np.multiply.accumulate(x)
    return _held[0], _held[1]


def _bits(hashes: np.ndarray, weights: np.ndarray) -> int:
    """The SimHash of 64-bit features: bits with more weight for one than for nought. Weights are whole numbers."""
    each = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    return int.from_bytes(np.packbits(weights @ each * 2 > weights.sum(), bitorder="little").tobytes(), "little", signed=True)


def fingerprint(words: np.ndarray) -> tuple[int, int, int, int]:
    """The two halves of the SimHash of a text's words and of that of its word pairs."""
    seen, n = np.unique(words, return_counts=True)
    weight = np.round(64 * (1 + 2 * np.log(n)))
    with np.errstate(over="ignore"):
        pairs = np.unique(common.mix(words[:-1] * _BASE + words[1:])) if len(words) > 1 else seen
    one = np.ones(len(pairs))
    return _bits(seen, weight), _bits(common.mix(seen ^ _BASE), weight), _bits(pairs, one), _bits(common.mix(pairs ^ _BASE), one)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw, start, end = common.utf8_buffer(b.column(3))
        hashes, n = word_hashes(raw, start, end)
        stop = np.cumsum(n)
        found = [fingerprint(hashes[z - k : z]) if k else (0, 0, 0, 0) for k, z in zip(n, stop, strict=True)]
        c = np.array(found, np.int64).reshape(-1, 4)
        fp = pa.StructArray.from_arrays([pa.array(c[:, 0]), pa.array(c[:, 1])], ["x", "y"], mask=pa.array(n == 0))
        yield pa.record_batch([*b.columns[:3], fp, *(pa.array(c[:, i], mask=n == 0) for i in (2, 3))], names=["doc_id", "k1", "k2", "fp", "v1", "v2"])


def _places(fp: np.ndarray, t: int, parts: int) -> np.ndarray:
    """The part of table ``t`` that each fingerprint belongs to."""
    half, mask = TABLES[t]
    return (common.mix(fp[:, half] & mask) % np.uint64(parts)).astype(np.int64)


def _sizes(parts: int):
    """Parts (slot) in which a task has clearly more than the mean of its fingerprints, and how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(parts * len(TABLES), np.int64), 0
        for b in batches:
            fp = np.stack([c.to_numpy() for c in b.columns], 1).view(np.uint64)
            rows += len(fp)
            for t in range(len(TABLES)):
                counts[t * parts : (t + 1) * parts] += np.bincount(_places(fp, t, parts), minlength=parts)
        over = np.flatnonzero(counts > 1.25 * rows / parts + 4 * np.sqrt(rows / parts))
        yield pa.record_batch([pa.array(over), pa.array(counts[over])], names=["slot", "n"])

    return run


def _hot(prints: DataFrame, parts: int, total: int) -> dict[int, int]:
    """The parts that are too large for a task, and the number of blocks that each is cut into.

    Hashes spread fingerprints evenly over tasks, so a task's counts show what is hot in all.
    """
    if total <= 2 * BLOCK:
        return {}
    sizes = prints.mapInArrow(_sizes(parts), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    limit = max(2 * BLOCK, HOT * total / parts)
    # fewer than len(TABLES) / HOT for each part
    return {r.slot: -(-r.n // BLOCK) for r in sizes.filter(F.col("n") > limit).collect()}


def _tables(parts: int, hot: dict[int, int]):
    """Sends each fingerprint, its halves first, to its part of every table, packed.

    In a part of several blocks, each goes to all pairs of blocks that have its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.stack([c.to_numpy() for c in b.columns], 1).view(np.uint64)
            own_hash = common.mix(common.mix(fp[:, 0] ^ _BASE) ^ fp[:, -1] ^ (fp[:, 1] << np.uint64(1)))
            slots, pairs, packs, size = [], [], [], 0
            for t in range(len(TABLES)):
                part = _places(fp, t, parts)
                order = np.argsort(part, kind="stable")
                cuts = np.flatnonzero(np.diff(part[order])) + 1
                for own in np.split(order, cuts) if len(order) else []:
                    slot = t * parts + int(part[own[0]])
                    blocks = hot.get(slot, 1)
                    block = (own_hash[own] % np.uint64(blocks)).astype(np.int64)
                    for i in np.unique(block).tolist():
                        pack = fp[own[block == i]].tobytes()
                        for j in range(blocks) if blocks > 1 else [i]:
                            if j != i or blocks == 1:
                                slots.append(slot)
                                pairs.append(min(i, j) * blocks + max(i, j))
                                packs.append(pack)
                                size += len(pack)
                    if size > common.ARROW_BATCH_BYTES:
                        yield pa.record_batch([pa.array(slots, pa.int64()), pa.array(pairs, pa.int64()), pa.array(packs, pa.binary())], names=["slot", "pair", "pack"])
                        slots, pairs, packs, size = [], [], [], 0
            yield pa.record_batch([pa.array(slots, pa.int64()), pa.array(pairs, pa.int64()), pa.array(packs, pa.binary())], names=["slot", "pair", "pack"])

    return run


_PACKED = "slot long, pair long, pack binary"


def _root(parent: np.ndarray, i: np.ndarray) -> np.ndarray:
    """The roots of ``i``, whose paths are shortened."""
    r = parent[i]
    while (up := parent[r] != r).any():
        r[up] = parent[r[up]]
    parent[i] = r
    return r


def linked(fp: np.ndarray, half: int, mask: np.uint64, reach: int, pair_radius: int = PAIR_RADIUS) -> np.ndarray:
    """Pairs of rows of ``fp`` whose halves agree under ``mask`` and that are at most ``reach`` bits apart.

    If rows have the two halves of the hash of word pairs as well, these are at most ``pair_radius`` bits apart. All
    pairs that agree are compared; those returned are a spanning forest of all that are near enough. Rows are a row of
    ``fp`` and another, signed.
    """
    key = fp[:, half] & mask
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(order) else order
    fp, key = fp[order], key[order]
    order = np.lexsort((*fp.T[::-1], key))
    fp, key = fp[order], key[order]
    n = len(fp)
    bounds = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [n]]) if n else np.zeros(1, np.int64)
    sizes = np.diff(bounds)
    parent, pairs = np.arange(n), [np.zeros((0, 2), np.int64)]
    # small buckets all at once: each row is compared with the one so many places on
    small = np.repeat(sizes < LARGE, sizes)
    at, step = np.flatnonzero(small[: max(0, n - 1)]), 1
    while len(at := at[key[at] == key[at + step]]):
        i = at[np.bitwise_count(fp[at, :2] ^ fp[at + step, :2]).sum(1, dtype=np.int64) <= reach]
        i = i[np.bitwise_count(fp[i, 2:] ^ fp[i + step, 2:]).sum(1, dtype=np.int64) <= pair_radius]
        j = i + step
        while len(i):
            a, b = _root(parent, i), _root(parent, j)
            i, j, a, b = (x[a != b] for x in (i, j, a, b))
            # each root is hung once, on a lower one
            high, one = np.unique(np.maximum(a, b), return_index=True)
            parent[high] = np.minimum(a, b)[one]
            pairs.append(np.stack([i[one], j[one]], 1))
        step += 1
        at = at[at + step < n]
    for k in np.flatnonzero(sizes >= LARGE):
        pairs.append(bounds[k] + _forest(fp[bounds[k] : bounds[k + 1]], 1 - half, reach, pair_radius))
    return fp.view(np.int64)[np.concatenate(pairs)].reshape(-1, 2 * fp.shape[1])


#: Rows and columns of the comparisons of a step.
_ROWS, _COLUMNS = 64, 1 << 15


def _forest(fp: np.ndarray, first: int, reach: int, pair_radius: int) -> np.ndarray:
    """A spanning forest of all near pairs of rows; ``first`` is the half that tells most of them apart.

    One component after the other is completed. A pivot is compared with all that is left; what it reaches, and what
    that reaches in turn, joins its component and is compared with what is still left. As far as distances obey the
    triangle inequality by the pivot, of these only those can be near whose distance from the pivot differs by ``reach``
    at most, and that of their word pairs by ``pair_radius``.
    """
    cols = [np.ascontiguousarray(fp[:, k]) for k in (first, 1 - first, *range(2, fp.shape[1]))]
    left = np.arange(len(fp))
    links = []
    while len(left) > 1:
        pivot, at = [c[0] for c in cols], left[0]
        left, cols = left[1:], [c[1:] for c in cols]
        near = np.flatnonzero(np.bitwise_count(cols[0] ^ pivot[0]) <= reach)
        if len(near):
            near = near[_apart([c[near] for c in cols[:2]], pivot[:2]) <= reach]
        if len(near) and len(cols) > 2:
            near = near[_apart([c[near] for c in cols[2:]], pivot[2:]) <= pair_radius]
        if not len(near):
            continue
        links.append(np.stack([np.full(len(near), at), left[near]], 1))
        # distances from the pivot, once for the whole component
        far = [_apart(cols[:2], pivot[:2]), _apart(cols[2:], pivot[2:]) if len(cols) > 2 else np.zeros(len(left), np.int16)]
        new = left[near], [c[near] for c in cols], [d[near] for d in far]
        rest = np.ones(len(left), bool)
        rest[near] = False
        left, cols, far = left[rest], [c[rest] for c in cols], [d[rest] for d in far]
        while len(new[0]) and len(left):
            joined = np.full(len(left), -1)
            order = np.argsort(new[2][0], kind="stable")
            for i in range(0, len(order), _ROWS):
                own = order[i : i + _ROWS]
                d, e = new[2][0][own], new[2][1][own]
                open_ = np.flatnonzero((joined < 0) & (far[0] >= d.min() - reach) & (far[0] <= d.max() + reach) & (far[1] >= e.min() - pair_radius) & (far[1] <= e.max() + pair_radius))
                for k in range(0, len(open_), _COLUMNS):
                    j = open_[k : k + _COLUMNS]
                    ok = _apart([c[None, j] for c in cols[:2]], [c[own, None] for c in new[1][:2]]) <= reach
                    if len(cols) > 2:
                        ok &= _apart([c[None, j] for c in cols[2:]], [c[own, None] for c in new[1][2:]]) <= pair_radius
                    hit = ok.any(0)
                    joined[j[hit]] = new[0][own][ok[:, hit].argmax(0)]
            got = joined >= 0
            links.append(np.stack([joined[got], left[got]], 1))
            new = left[got], [c[got] for c in cols], [d[got] for d in far]
            left, cols, far = left[~got], [c[~got] for c in cols], [d[~got] for d in far]
    return np.concatenate(links) if links else np.zeros((0, 2), np.int64)


def _apart(a: list[np.ndarray], b: list) -> np.ndarray:
    """Differing bits of words ``a`` and ``b``, summed."""
    return sum(np.bitwise_count(x ^ y).astype(np.int16) for x, y in zip(a, b, strict=True))


#: A fingerprint, and one with the hash of word pairs.
_PRINT, _NODE = "x long, y long", "x long, y long, v1 long, v2 long"


def _packed(group: pa.Table, parts: int, width: int) -> tuple[np.ndarray, int, np.uint64]:
    half, mask = TABLES[group.column("slot")[0].as_py() // parts]
    return np.frombuffer(b"".join(x.as_py() for x in group.column("pack")), np.uint64).reshape(-1, width), half, mask


def _reached(parts: int, reach: int):
    """The fingerprints that have another within reach."""

    def run(group: pa.Table) -> pa.Table:
        ends = np.unique(linked(*_packed(group, parts, 2), reach).reshape(-1, 2), axis=0)
        return pa.table({"x": ends[:, 0], "y": ends[:, 1]})

    return run


def _links(parts: int, reach: int, pair_radius: int):
    def run(group: pa.Table) -> pa.Table:
        pairs = linked(*_packed(group, parts, 4), reach, pair_radius)
        end = lambda i: pa.StructArray.from_arrays([pa.array(pairs[:, i + k]) for k in range(4)], ["x", "y", "v1", "v2"])
        return pa.table({"a": end(0), "b": end(4)})

    return run


def near_links(prints: DataFrame, reach: int, pair_radius: int) -> DataFrame:
    """Links a, b between near ones of the distinct ``prints`` (x, y, v1, v2) that hold all near ones together."""

    def packed(rows: DataFrame) -> tuple:
        total = rows.count()
        parts = max(1, -(-total * 8 * len(rows.columns) // PART_BYTES))
        return rows.mapInArrow(_tables(parts, _hot(rows, parts, total)), _PACKED).groupBy("slot", "pair"), parts

    groups, parts = packed(prints.select("x", "y"))
    reached = groups.applyInArrow(_reached(parts, reach), _PRINT).distinct()
    prints = common.stash(prints.join(reached, ["x", "y"], "left_semi"), "reached")
    groups, parts = packed(prints)
    node = f"struct<{_NODE.replace(' long', ': long')}>"
    return groups.applyInArrow(_links(parts, reach, pair_radius), f"a {node}, b {node}").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link (a, b); the root is the smallest node of its component.

    Alternating large and small stars, as often as the links still change: a few rounds for any but very long chains.
    Each round is written to the shared folder.
    """
    # the least neighbour comes by an aggregate and a join, which a node with very many neighbours can't crowd into one task
    lowest = lambda e: e.join(e.groupBy("a").agg(F.min("b").alias("m")), "a")
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges, before = common.stash(edges, "links"), None
    while True:
        last = edges
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = lowest(both).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        low = lowest(large)
        edges = common.stash(low.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct(), "links")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        common.drop(last)
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
        before = now


def _verdicts(df: DataFrame, id_col: str, text_col: str, reach: int, pair_radius: int) -> DataFrame:
    """doc_id, k1, k2, keeper_id and is_duplicate of each row; k1 and k2 are the row's keys."""
    spark = df.sparkSession
    common.bound_batches(spark)
    k1, k2 = common.row_keys("doc_id", "text")
    picked = common.pick(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = picked.select("doc_id", k1.alias("k1"), k2.alias("k2"), F.lower("text").alias("text"))
    rows = rows.mapInArrow(_fingerprints, "doc_id long, k1 long, k2 long, fp struct<x: long, y: long>, v1 long, v2 long")
    # the number tells repeated rows apart; it is written with them, since it may not come out the same again
    rows = common.stash(rows.withColumn("token", F.monotonically_increasing_id()), "prints")
    # texts that agree in both hashes are one; those with one fingerprint and other word pairs are compared like any others
    node = F.struct("fp.x", "fp.y", "v1", "v2")
    prints = common.stash(rows.filter("fp is not null").select(node.alias("p")).distinct().select("p.*"), "distinct")
    roots = components(near_links(prints, reach, pair_radius))
    # a text without words is a group of its own
    bare = rows.filter("fp is null").select("doc_id", "k1", "k2", F.col("doc_id").alias("keeper_id"), F.lit(False).alias("is_duplicate"))
    told = rows.filter("fp is not null").withColumn("node", node).join(roots, "node", "left").select("doc_id", "k1", "k2", "token", F.coalesce("root", "node").alias("root"))
    told = common.stash(told, "told")
    # a group's keeper is an aggregate, which no size of a group can crowd into one task
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), "k1", "k2", F.col("token").alias("t")))
    keepers = told.groupBy("root").agg(first.alias("f")).select("root", F.col("f.i").alias("keeper_id"), F.col("f.t").alias("t"))
    return told.join(keepers, "root").select("doc_id", "k1", "k2", "keeper_id", (F.col("token") != F.col("t")).alias("is_duplicate")).unionByName(bare)


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH, pair_radius: int = PAIR_RADIUS) -> DataFrame:
    """doc_id, keeper_id and is_duplicate, a row for every row of ``df``.

    The keeper is the group's smallest identifier; exactly one row of a group is no duplicate. Identifiers are whole
    numbers of 64 bits. Words are compared without case and punctuation. Null texts and texts without words are nobody's copies and keep themselves. Null
    identifiers order last. Repeated rows are copies of each other. Other columns are ignored. No rows give no rows.
    """
    return _verdicts(df, id_col, text_col, reach, pair_radius).select("doc_id", "keeper_id", "is_duplicate")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH, pair_radius: int = PAIR_RADIUS) -> DataFrame:
    """The rows of ``df`` that ``near_copies`` calls no duplicates, with all their columns.

    Of rows that have the same identifier and the same text, one stays; if they have no words, all stay.
    """
    own = ["__near_k1", "__near_k2"]
    told = _verdicts(df, id_col, text_col, reach, pair_radius)
    counts = told.groupBy(F.col("k1").alias(own[0]), F.col("k2").alias(own[1])).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("is_duplicate")).alias("stay"))
    counts = common.stash(counts.filter("stay > 0"), "kept")
    i, t = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    k1 = F.xxhash64(i.isNull(), i, t.isNull(), t)
    k2 = F.xxhash64(F.lit("k2"), t, t.isNull(), i, i.isNull())
    rows = df.withColumns({own[0]: k1, own[1]: k2})
    columns = [F.col(f"`{c}`") for c in df.columns]
    whole = rows.join(counts.filter("n = stay").select(*own), own, "left_semi").select(*columns)
    # of repeated rows one stays: an aggregate too, over the few rows that are such
    repeated = common.stash(counts.filter("n > stay").select(*own), "repeated")
    one = rows.join(repeated, own, "left_semi").groupBy(*own).agg(F.first(F.struct(*columns)).alias("__near_row")).select("__near_row.*")
    return whole.unionByName(one)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` with the one that stays of its near copies."""
    return near_copies(common.table(spark, sf_dir, "documents"))
