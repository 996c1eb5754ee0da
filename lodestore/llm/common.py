"""What the operators of this subpackage share: tables, the shared folder, row keys and Arrow buffers.

Identifiers are whole numbers of 64 bits in every operator that takes any.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.session import drop, filesystem, scratch, shared_dir, stash  # noqa: F401

#: Bytes of one Arrow batch on its way to a Python worker; long documents then travel few at a time.
ARROW_BATCH_BYTES = 8 << 20

_MIX = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of ``sf_dir``, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, since a count of rows says nothing about their size."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def row_keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    """Two 64-bit hashes that stand for (id, text), nulls included; equal rows have equal keys."""
    i, t = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return F.xxhash64(i.isNull(), i, t.isNull(), t), F.xxhash64(F.lit("k2"), t, t.isNull(), i, i.isNull())


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, renamed; what else the table has, clashing names too, stays out."""
    return df.select(*(F.col(f"`{c}`").alias(name) for name, c in columns.items()))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * _MIX
        h = (h ^ (h >> np.uint64(27))) * _MIX2
        return h ^ (h >> np.uint64(31))


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a string column without a copy, and each value's start and end; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets is not None else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at[:-1], at[1:]


def gather(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``flat[start:end]`` one after the other, and their lengths."""
    n = end - start
    where = np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(n) else np.zeros(0, np.int64)
    return flat[where + np.arange(len(where))], n
