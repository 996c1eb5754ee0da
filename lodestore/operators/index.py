"""Sorted-index operators: positions, fanout, buckets, ranges and running offsets, without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestore.functions import oid as O


def fanout(ids: DataFrame) -> DataFrame:
    """byte, objects and cumulative of all 256 first bytes."""
    counts = ids.groupBy(F.substring("oid", 1, 2).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    spark = ids.sparkSession
    every = spark.range(256).select(F.col("id").alias("byte"), F.lpad(F.lower(F.hex("id")), 2, "0").alias("b"))
    # 256 rows from here on
    total = F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("byte").rowsBetween(Window.unboundedPreceding, 0))
    return every.join(counts, "b", "left").select("byte", F.coalesce("n", F.lit(0)).cast("bigint").alias("objects"), total.cast("bigint").alias("cumulative"))


def positions(ids: DataFrame, digits: int = 3) -> DataFrame:
    """``ids`` with idx_pos, the place of each row in the order of all ids.

    Each bucket of leading digits is ranked alone and starts after the buckets before it, whose counts are a table of
    16 ** digits rows at most; so no task sorts everything.
    """
    head = F.substring("oid", 1, digits)
    counts = ids.groupBy(head.alias("head")).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("head", (F.sum("n").over(Window.orderBy("head").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    placed = ids.withColumn("head", head).withColumn("rank", F.row_number().over(Window.partitionBy("head").orderBy("oid")))
    return placed.join(before, "head").withColumn("idx_pos", (F.col("before") + F.col("rank") - 1).cast("bigint")).drop("head", "rank", "before")


def from_byte(ids: DataFrame, byte: int) -> DataFrame:
    """Ids whose first byte is at least ``byte``; a bound that reaches the scan."""
    return ids.filter(F.col("oid") >= f"{byte:02x}")


def between(ids: DataFrame, low: str, high: str) -> DataFrame:
    return ids.filter(F.col("oid").between(low, high))


def bucket_report(ids: DataFrame, bits: int = 8) -> DataFrame:
    """bucket and objects, of buckets that have some."""
    return ids.groupBy(O.bucket(F.col("oid"), bits).cast("bigint").alias("bucket")).agg(F.count(F.lit(1)).alias("objects"))


def table_report(ids: DataFrame, bits: int = 8) -> DataFrame:
    """One row: objects, buckets (all 2 ** bits), how many are used, and the least, most and mean objects of a bucket."""
    n = 1 << bits
    least = F.when(F.count(F.lit(1)) < n, 0).otherwise(F.min("objects"))
    found = bucket_report(ids, bits).agg(F.coalesce(F.sum("objects"), F.lit(0)).alias("objects"), F.count(F.lit(1)).alias("used"), least.cast("bigint").alias("least"), F.coalesce(F.max("objects"), F.lit(0)).alias("most"))
    return found.select("objects", F.lit(n).cast("bigint").alias("buckets"), "used", "least", "most", (F.col("objects") / n).alias("mean"))


#: Bytes of a pack in which the entries are ordered by one task.
STRETCH = 1 << 26


def end_offsets(entries: DataFrame, packs: DataFrame) -> DataFrame:
    """``entries`` (pack_id, offset) with end_offset: where the next entry of the pack begins, the last up to the trailer.

    ``packs`` has pack_id and pack_size. Entries are ordered in stretches of a pack; what follows a stretch is in a table
    of a row for each stretch.
    """
    cut = F.floor(F.col("offset") / STRETCH)
    heads = entries.groupBy("pack_id", cut.alias("stretch")).agg(F.min("offset").alias("at"))
    after = F.lead("at").over(Window.partitionBy("pack_id").orderBy("stretch"))
    ends = heads.join(packs.select("pack_id", "pack_size"), "pack_id").select("pack_id", "stretch", F.coalesce(after, F.col("pack_size") - 20).alias("beyond"))
    inner = F.lead("offset").over(Window.partitionBy("pack_id", "stretch").orderBy("offset"))
    placed = entries.withColumn("stretch", cut).withColumn("inner", inner)
    return placed.join(ends, ["pack_id", "stretch"]).withColumn("end_offset", F.coalesce("inner", "beyond").cast("bigint")).drop("stretch", "inner", "beyond")


def size_in_pack(entries: DataFrame, packs: DataFrame) -> DataFrame:
    """``entries`` with size_in_pack; see ``end_offsets``."""
    return end_offsets(entries, packs).withColumn("size_in_pack", F.col("end_offset") - F.col("offset")).drop("end_offset")
