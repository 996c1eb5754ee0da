"""The session's settings, and the folder that its executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch that goes to Python, which holds as much again as objects; else 10,000 rows go at once, of whatever length.
ARROW_BATCH_BYTES = 8 << 20
SETTINGS = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.maxBytesPerBatch": str(ARROW_BATCH_BYTES)}


def configure(spark: SparkSession) -> SparkSession:
    """Applies the engine's settings and registers its sources."""
    from lodestore.sources.objectdb import ObjectStoreSource

    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    spark.dataSource.register(ObjectStoreSource)
    return spark


def tasks(spark: SparkSession) -> int:
    """Tasks of a stage whose rows are short and whose work is long, which adaptive execution, that goes by bytes, would join."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Where that is unset, a temporary one if the master is local; executors elsewhere would each write to a disk of
    their own, so on a cluster it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir has to name a folder that the executors of {master} share")
        found = tempfile.mkdtemp(prefix="lodestore-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def filesystem(uri: str):
    """The pyarrow file system of ``uri`` and the path in it; usable on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def remove(path: str) -> None:
    """Deletes a folder below the shared one; nothing where it isn't there."""
    from pyarrow import fs

    system, at = filesystem(path)
    if system.get_file_info(at).type != fs.FileType.NotFound:
        system.delete_dir(at)


def mounted(uri: str) -> str:
    """The path of a folder that is mounted on all executors; an error for any other."""
    from pyarrow import fs

    system, path = filesystem(uri)
    if not isinstance(system, fs.LocalFileSystem):
        raise ValueError(f"an object store has to lie on a mounted file system: {uri}")
    return path


_own: set[str] = set()


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder; all of a session's lie in one folder, which goes when Python ends."""
    own = f"{shared_dir(spark)}/lodestore-{spark.sparkContext.applicationId}"
    if own not in _own:
        _own.add(own)
        atexit.register(remove, own)
    return f"{own}/{what}-{uuid.uuid4().hex}"


def stash(df: DataFrame, what: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` to the shared folder, where a lost executor takes nothing with it, and reads it."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash = path
    return out


def drop(stashed: DataFrame) -> None:
    """Deletes what ``stash`` wrote; no frame that reads it may be used again."""
    remove(stashed._stash)
