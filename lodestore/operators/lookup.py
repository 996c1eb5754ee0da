"""Selection of objects: by id, by prefix, by many prefixes, with one rule for copies in several places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestore.functions import oid as O


class Ambiguous(LookupError):
    """A prefix of several objects: ``candidates`` has the first of them in order, ``every`` is a table of all."""

    def __init__(self, prefix: str, candidates: list[str], every: DataFrame | None = None):
        super().__init__(f"{prefix} is ambiguous: {', '.join(candidates)}")
        self.candidates, self.every = candidates, every


class Missing(LookupError):
    """No such object."""


def find(locations: DataFrame, prefix: str) -> DataFrame:
    """All places of objects with a prefix (or of one object), copies included."""
    return locations.filter(O.matches(F.col("oid"), prefix))


def distinct_ids(locations: DataFrame, prefix: str) -> DataFrame:
    """The ids with a prefix, each once, in order."""
    return find(locations, prefix).select("oid").distinct().orderBy("oid")


def resolve(locations: DataFrame, prefix: str, shown: int = 20) -> str:
    """The one id with a prefix; Missing or Ambiguous (which shows the first ``shown`` and can list all) if there isn't one."""
    every = distinct_ids(locations, prefix)
    found = [r.oid for r in every.limit(shown).collect()]
    if not found:
        raise Missing(O.check_prefix(prefix))
    if len(found) > 1:
        raise Ambiguous(prefix, found, every)
    return found[0]


def _rank() -> Column:
    return F.when(F.col("store") == "loose", 0).otherwise(1)


def first_match(locations: DataFrame) -> DataFrame:
    """One place for each id: loose before packed, then the lowest pack and offset."""
    order = Window.partitionBy("oid").orderBy(_rank(), F.col("pack_id"), F.col("offset"), F.col("path"))
    return locations.withColumn("__place", F.row_number().over(order)).filter("__place = 1").drop("__place")


def join_prefixes(locations: DataFrame, prefixes: DataFrame, column: str = "prefix") -> DataFrame:
    """(prefix, and the columns of ``locations``) for a table of prefixes, by one equi-join on their lengths.

    Each id is taken once for each length that occurs, so a join of text with LIKE is never needed. Prefixes that are
    null or no hexadecimal digits match nothing.
    """
    asked = prefixes.select(F.lower(F.col(column)).alias("prefix")).filter(F.col("prefix").rlike("^[0-9a-f]{1,40}$")).distinct()
    lengths = [r.n for r in asked.select(F.length("prefix").alias("n")).distinct().orderBy("n").collect()]
    if not lengths:
        return locations.limit(0).select(F.lit("").alias("prefix"), "*")
    heads = F.explode(F.array(*(F.substring("oid", 1, n) for n in lengths)))
    return locations.withColumn("prefix", heads).join(asked, "prefix").select("prefix", *locations.columns)


def select_ids(table: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``table`` whose id is in ``ids``."""
    return table.join(ids.select("oid"), "oid", "left_semi")


def missing_ids(ids: DataFrame, table: DataFrame) -> DataFrame:
    """The ids that ``table`` lacks."""
    return ids.select("oid").join(table.select("oid"), "oid", "left_anti").distinct()
