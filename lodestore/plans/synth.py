"""The driver's tables as an object graph: blobs, commits, trees and packs, encoded to real bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestore.functions import objects as B


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str = "text") -> Column:
    return F.encode(F.col(column), "utf-8")


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text and oid of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars", B.object_id("blob", text_bytes()).alias("oid"))


def blob_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blobs(spark, sf_dir).select("doc_id", "oid")


def name_id(kind: str, *key: Column | str) -> Column:
    """An id made of a name, for objects that are no documents."""
    return F.sha1(F.encode(F.concat_ws(":", F.lit(kind), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key)), "utf-8"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a commit: its id and that of the turn before it."""
    t = table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", "role", "text", name_id("commit", "conv_id", "turn").alias("oid"), F.when(F.col("turn") > 0, name_id("commit", F.col("conv_id"), F.col("turn") - 1)).alias("parent"))


def person(name: Column, seconds: Column) -> Column:
    return F.concat(name, F.lit(" <"), name, F.lit("@x.org> "), seconds.cast("string"), F.lit(" +0000"))


def commit_bytes(t: DataFrame, message: Column, extra: Column | None = None) -> DataFrame:
    """conv_id, turn, oid and payload."""
    parents = F.when(F.col("parent").isNull(), F.array().cast("array<string>")).otherwise(F.array("parent"))
    who = person(F.col("role"), F.col("conv_id") * 1000 + F.col("turn"))
    return t.select("conv_id", "turn", "oid", B.encode_commit(name_id("tree", "conv_id"), parents, who, who, message, extra).alias("payload"))


def region_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tree_oid and payload of regions (of nations' trees) and nations (of suppliers' blobs)."""
    nation = table(spark, sf_dir, "nation")
    supplier = table(spark, sf_dir, "supplier")
    inner = nation.select(name_id("region", "n_regionkey").alias("tree_oid"), F.struct(F.lit("40000").alias("mode"), F.col("n_name").alias("name"), name_id("nation", "n_nationkey").alias("oid")).alias("e"))
    outer = supplier.select(name_id("nation", "s_nationkey").alias("tree_oid"), F.struct(F.when(F.col("s_suppkey") % 2 == 0, "100755").otherwise("100644").alias("mode"), F.col("s_name").alias("name"), name_id("supplier", "s_suppkey").alias("oid")).alias("e"))
    entries = inner.unionByName(outer).groupBy("tree_oid").agg(F.array_sort(F.collect_list(F.struct(F.col("e.name").alias("name"), F.col("e.oid").alias("oid"), F.col("e.mode").alias("mode")))).alias("es"))
    return entries.select("tree_oid", B.encode_tree(F.col("es")).alias("payload"))


def tree_entries(trees: DataFrame) -> DataFrame:
    """tree_oid, pos, mode, kind, name and oid, parsed."""
    e = trees.select("tree_oid", F.posexplode(B.parse_tree(F.col("payload"))).alias("pos", "e"))
    mode = B.tree_mode(F.col("e.mode_raw"))
    return e.select("tree_oid", F.col("pos").cast("bigint").alias("pos"), mode.alias("mode"), B.mode_kind(mode).alias("kind"), B.utf8_lossy(F.col("e.name_raw")).alias("name"), "e.oid")


def packed(spark: SparkSession, sf_dir: str, per_pack: int = 1000) -> DataFrame:
    """Documents laid end to end in packs of ``per_pack`` identifiers: pack, doc_id, oid, offset, end_offset."""
    before = Window.partitionBy("pack").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = blobs(spark, sf_dir).withColumn("pack", F.floor(F.col("doc_id") / per_pack))
    end = F.lit(12) + F.sum("n_chars").over(before)
    return rows.withColumn("end_offset", end).select("pack", "doc_id", "oid", (F.col("end_offset") - F.col("n_chars")).alias("offset"), "end_offset", F.max("end_offset").over(Window.partitionBy("pack")).alias("last"))
