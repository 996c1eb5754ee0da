"""A stream of loose objects as they appear in a store.

Offsets are times in nanoseconds: a batch has the objects that got their names after the last offset and not after the
new one. Files are written under another name and renamed, so a name that is there is whole; a rename sets a file's time
of status change, not that of modification, which may lie long before, or be kept from another store.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSourceStreamReader, InputPartition

from lodestore.sources.objectdb import Folders, ObjectStoreReader

#: Younger files wait for the next batch, so that none of a coarse clock's tick is missed.
SETTLE_NS = 50_000_000


class Since(InputPartition):
    def __init__(self, bucket: str, start: int, end: int):
        self.bucket, self.start, self.end = bucket, start, end


class LooseStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        if options.get("kind", "ids") not in ("ids", "loose_headers", "loose"):
            raise ValueError("only loose objects can be streamed")
        self.options = options
        self.root = options["path"].rstrip("/")

    def initialOffset(self) -> dict:
        return {"ns": 0}

    def latestOffset(self) -> dict:
        """The time of the newest object; it stays where it is while none comes, so that a stream comes to rest."""
        settled, newest = time.time_ns() - SETTLE_NS, 0
        for n in range(256):
            folder = f"{self.root}/{n:02x}"
            if os.path.isdir(folder):
                with os.scandir(folder) as found:
                    newest = max([newest, *(t for f in found if len(f.name) == 38 and (t := f.stat().st_ctime_ns) <= settled)])
        return {"ns": newest}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        found = [f"{n:02x}" for n in range(256) if os.path.isdir(f"{self.root}/{n:02x}")]
        return [Since(b, start["ns"], end["ns"]) for b in found] or [Since("", 0, 0)]

    def read(self, part: Since) -> Iterator[pa.RecordBatch]:
        if part.bucket:
            reader = ObjectStoreReader(self.options)
            for batch in reader.read(Folders([(part.bucket, "0" * 40, "f" * 40)])):
                when = [os.stat(p).st_ctime_ns for p in batch.column(batch.num_columns - 1).to_pylist()]
                yield batch.filter(pa.array([part.start < w <= part.end for w in when]))

    def commit(self, end: dict) -> None:
        pass


def new_objects(spark: SparkSession, path: str, kind: str = "loose") -> DataFrame:
    """The stream; ``spark`` has to be configured."""
    return spark.readStream.format("objectdb").option("path", path).option("kind", kind).load()


def counts_by_type(stream: DataFrame, every: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """New objects and their bytes by type and window of arrival; later ones than ``late`` are dropped."""
    from pyspark.sql import functions as F

    seen = stream.withColumn("seen", F.current_timestamp()).withWatermark("seen", late)
    return seen.groupBy(F.window("seen", every), "type").agg(F.count(F.lit(1)).alias("objects"), F.sum("size").alias("bytes"))
