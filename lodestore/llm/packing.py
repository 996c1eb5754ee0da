"""Packing: power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are the powers of two in n's binary form, longest first, with
whole pieces of the largest length before them. Pieces of equal length share a bucket, and batches are filled from
one bucket, so no sequence crosses documents and nothing is padded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestore.llm import common

#: Tokens of the longest piece, a power of two.
MAX_LENGTH = 4096
#: Tokens of a batch: as many sequences of one bucket as make this many.
BATCH_TOKENS = 16384
#: Tokens of a shard of a bucket; shards are numbered independently, so that no bucket is one task.
SHARD_TOKENS = 4 << 20


def _tokens(text: str = "text"):
    return F.filter(F.split(text, "[ \t\n\r]+"), lambda t: t != "")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_length: int = MAX_LENGTH, batch_tokens: int = BATCH_TOKENS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """doc_id, start, length, shard, batch, slot and the piece's ``tokens``, a row for every piece.

    Tokens are the runs between blanks. Pieces of a document, put together by ``start``, are the document's tokens.
    ``batch`` and ``slot`` number a shard's sequences of one length by (doc_id, start). The number of a bucket's
    shards follows the bucket's tokens, which a first pass counts over all documents; a hash of identifier, start and
    tokens says which one a piece is in, so that neither null nor equal identifiers meet in one shard. Identifiers are
    whole numbers of 64 bits. Nulls and texts without tokens give no piece. Repeated rows are packed as often as they
    come, in one shard; other columns are ignored. No rows give no rows.
    """
    if max_length & (max_length - 1) or max_length < 1:
        raise ValueError("max_length must be a power of two")
    top = max_length.bit_length() - 1
    rows = common.pick(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).filter(F.col("text").isNotNull())
    n = F.col("n")
    sums = [F.sum(n.bitwiseAND(F.lit(1 << b)).cast("long")).alias(str(1 << b)) for b in range(top)]
    # a row of log2(max_length) + 1 sums
    totals = rows.select(F.size(_tokens()).alias("n")).agg(*sums, F.sum(F.floor(n / max_length) * max_length).alias(str(max_length))).first().asDict()
    shards = F.create_map(*(F.lit(x) for k, v in totals.items() for x in (int(k), max(1, -(-(v or 0) // shard_tokens)))))
    whole = F.when(n >= max_length, F.transform(F.sequence(F.lit(0), F.floor(n / max_length).cast("int") - 1), lambda i: F.struct((i * max_length).alias("start"), F.lit(max_length).alias("length")))).otherwise(F.array().cast("array<struct<start:int,length:int>>"))
    rest = F.array(*(F.when(n.bitwiseAND(F.lit(1 << b)) != 0, F.struct(F.shiftleft(F.shiftright(n, b + 1), b + 1).alias("start"), F.lit(1 << b).alias("length"))) for b in reversed(range(top)))) if top else F.array().cast("array<struct<start:int,length:int>>")
    pieces = rows.select("doc_id", _tokens().alias("t")).withColumn("n", F.size("t")).select("doc_id", "t", F.inline(F.concat(whole, F.array_compact(rest))))
    pieces = pieces.select(
        "doc_id", F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"),
        F.element_at(shards, F.col("length")).alias("k"), F.array_join(F.slice("t", F.col("start") + 1, F.col("length")), " ").alias("tokens"),
    )
    key = F.md5(F.encode(F.concat_ws("/", "doc_id", "start", "tokens"), "utf-8"))
    pieces = pieces.withColumn("shard", F.pmod(F.conv(F.substring(key, 1, 15), 16, 10).cast("long"), "k")).drop("k")
    place = F.row_number().over(Window.partitionBy("length", "shard").orderBy("doc_id", "start", "tokens")) - 1
    each = F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.col("length")))
    return pieces.withColumn("place", place).select("doc_id", "start", "length", "shard", F.floor(F.col("place") / each).cast("long").alias("batch"), F.pmod(F.col("place"), each).cast("long").alias("slot"), "tokens")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents``, packed."""
    return pack(common.table(spark, sf_dir, "documents"))


SQL = f"""
WITH tok AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '') AS t FROM documents WHERE text IS NOT NULL),
cnt AS (SELECT doc_id, t, CAST(len(t) AS BIGINT) AS n FROM tok),
pieces AS (
  SELECT doc_id, t, i * {MAX_LENGTH} AS start, CAST({MAX_LENGTH} AS BIGINT) AS length
  FROM (SELECT doc_id, t, unnest(range(n // {MAX_LENGTH})) AS i FROM cnt)
  UNION ALL
  SELECT doc_id, t, (n >> (b + 1)) << (b + 1) AS start, CAST(1 AS BIGINT) << b AS length
  FROM cnt, (SELECT unnest(range({MAX_LENGTH.bit_length() - 1})) AS b) WHERE (n >> b) & 1 = 1),
shards AS (SELECT length, greatest(1, CAST(ceil(sum(length) / {SHARD_TOKENS}) AS BIGINT)) AS k FROM pieces GROUP BY length),
cut AS (
  SELECT doc_id, start, length, tokens, CAST('0x' || substr(md5(concat_ws('/', doc_id, start, tokens)), 1, 15) AS BIGINT) % k AS shard
  FROM (SELECT doc_id, start, length, array_to_string(list_slice(t, start + 1, start + length), ' ') AS tokens FROM pieces)
  JOIN shards USING (length)),
placed AS (SELECT *, row_number() OVER (PARTITION BY length, shard ORDER BY doc_id NULLS FIRST, start, tokens) - 1 AS place FROM cut)
SELECT doc_id, CAST(start AS BIGINT) AS start, length, CAST(shard AS BIGINT) AS shard,
       CAST(place // greatest(1, {BATCH_TOKENS} // length) AS BIGINT) AS batch, CAST(place % greatest(1, {BATCH_TOKENS} // length) AS BIGINT) AS slot, tokens
FROM placed
"""
