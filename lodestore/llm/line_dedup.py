"""Line dedup: lines are exploded, normalised and hashed; distinct documents are counted for each hash; lines over the
threshold go; what is left is put together by position.

Only hashes and numbers are shuffled for the counting. A document's text moves once at most, to meet the list of its
dropped positions, and not at all where that list is small enough for Spark to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm import common

#: A line that more documents than this hold is boilerplate.
THRESHOLD = 20


def _normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, "[ \t\r]+", " ")))


def _drops(rows: DataFrame, threshold: int) -> DataFrame:
    """k1, k2 and the positions of dropped lines, of those rows (doc_id, text, k1, k2) that have some."""
    lines = (
        rows.select("doc_id", "k1", "k2", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .select("doc_id", "k1", "k2", "pos", _normal(F.col("line")).alias("line"))
        .filter("line <> ''")
        # 64 + 32 bits and the length stand for the line
        .select("doc_id", "k1", "k2", "pos", F.xxhash64("line").alias("h1"), F.hash(F.reverse("line")).alias("h2"), F.octet_length("line").alias("n"))
    )
    held = lines.select("h1", "h2", "n", "doc_id").distinct().groupBy("h1", "h2", "n").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first_doc"))
    often = common.stash(held.filter(F.col("docs") > threshold).select("h1", "h2", "n", "first_doc"), "lines")
    return lines.join(often, ["h1", "h2", "n"]).filter(~F.col("doc_id").eqNullSafe(F.col("first_doc"))).groupBy("k1", "k2").agg(F.collect_set("pos").alias("drops"))


def _left(text: Column, drops: Column) -> Column:
    """``text`` without the lines at ``drops``, put together from the stretches between them: linear in its lines."""

    def stretches(lines: Column) -> Column:
        at = F.array_sort(drops)
        start = F.concat(F.array(F.lit(0)), F.transform(at, lambda d: d + 1))
        end = F.concat(at, F.array(F.size(lines)))
        return F.flatten(F.zip_with(start, end, lambda s, e: F.slice(lines, s + 1, e - s)))

    # as the variable of a lambda the lines are split once, not once for each stretch
    left = F.transform(F.array(F.split(text, "\n", -1)), lambda lines: F.array_join(stretches(lines), "\n"))[0]
    return F.when(drops.isNull(), text).otherwise(left)


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """``doc_id``, ``text`` without repeated lines and ``lines_dropped``, a row for every row of ``df``.

    Lines are compared without case and with runs of blanks as one. A line in more than ``threshold`` distinct
    documents stays in the lowest-numbered one only, so that the last copy of a passage is never lost. Blank lines
    are never dropped. Nulls: a null text stays null; null identifiers count as one document, which keeps a line only
    where no numbered document has it. Repeated rows (same identifier, same text) are treated alike and count once.
    A text without dropped lines comes back byte for byte; one of which nothing stays is empty. Other columns are
    ignored.
    """
    k1, k2 = common.row_keys("doc_id", "text")
    rows = common.pick(df, doc_id=id_col, text=text_col).select("doc_id", "text", k1.alias("k1"), k2.alias("k2"))
    out = rows.join(_drops(rows, threshold), ["k1", "k2"], "left")
    return out.select("doc_id", _left(F.col("text"), F.col("drops")).alias("text"), F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("lines_dropped"))


def drop_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars", threshold: int = THRESHOLD) -> DataFrame:
    """``df`` with all its rows and columns, its texts as ``dedup_lines`` leaves them.

    Where a text has changed, ``size_col`` gets its number of characters.
    """
    k1, k2 = common.row_keys("doc_id", "text")
    drops = _drops(common.pick(df, doc_id=id_col, text=text_col).select("doc_id", "text", k1.alias("k1"), k2.alias("k2")), threshold)
    own = ["__lines_k1", "__lines_k2"]
    k1, k2 = common.row_keys(id_col, text_col)
    met = df.withColumns(dict(zip(own, (k1, k2), strict=True))).join(drops.select(F.col("k1").alias(own[0]), F.col("k2").alias(own[1]), F.col("drops").alias("__lines_drops")), own, "left")
    gone = F.col("__lines_drops")
    text = _left(F.col(f"`{text_col}`"), gone)
    new = {text_col: text, size_col: F.when(gone.isNull(), F.col(f"`{size_col}`")).otherwise(F.length(text).cast(df.schema[size_col].dataType))}
    return met.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in df.columns))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` without its boilerplate lines."""
    return dedup_lines(common.table(spark, sf_dir, "documents"))


SQL = f"""
WITH lines AS (
  SELECT doc_id, text, pos, string_split(text, chr(10))[pos] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents)),
norm AS (SELECT *, lower(trim(regexp_replace(line, '[ \\t\\r]+', ' ', 'g'))) AS n FROM lines),
often AS (
  SELECT n, min(doc_id) AS first_doc FROM norm WHERE n <> '' GROUP BY n
  HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) > {THRESHOLD}),
judged AS (
  SELECT norm.doc_id, norm.text, pos, line, often.n IS NOT NULL AND norm.doc_id IS DISTINCT FROM first_doc AS dropped
  FROM norm LEFT JOIN often USING (n)),
built AS (
  SELECT doc_id, text, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '') AS kept,
         count(*) FILTER (WHERE dropped) AS lines_dropped
  FROM (SELECT DISTINCT * FROM judged) GROUP BY doc_id, text)
SELECT d.doc_id, b.kept AS text, CAST(coalesce(lines_dropped, 0) AS BIGINT) AS lines_dropped
FROM documents d LEFT JOIN built b ON d.doc_id IS NOT DISTINCT FROM b.doc_id AND d.text = b.text
"""
