"""From raw documents to packed training sequences: five stages, each on all that its predecessor kept.

Identifiers are whole numbers of 64 bits. Extra columns, whatever their names, pass all stages but the last unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestore.llm import common, language_id, line_dedup, near_dedup, packing, quality


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is known; the network is trained on the labels of ``docs``.

    Null and empty texts go, and so do texts of no language; texts under 32 bytes stay, too short to tell. Without any
    labelled row there is no network, and all but null texts stay. Repeated rows stay or go together. No rows give none.
    """
    return language_id.drop_rejected(docs, language_id.train(docs))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose tokeniser fertility is in the bands of their language, or of their script where that is null.

    Null texts and texts without words go, texts under 32 tokens stay. Repeated rows count as often as they come and
    stay or go together. No rows give none.
    """
    return quality.drop_rejected(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that more than 20 documents share from all but the lowest-numbered one; n_chars follows.

    All rows stay, also those of which no line does, whose text is empty then. Null texts stay null, null identifiers
    count as one document, and repeated rows count once and are treated alike.
    """
    return line_dedup.drop_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the lowest-numbered; null identifiers come last.

    Null texts and texts without words are nobody's copies and stay. Of rows with one identifier and one text, one
    stays. No rows give none.
    """
    return near_dedup.drop_near_copies(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left: a row for every piece, with its tokens.

    Null texts and texts without words give no piece; repeated rows are packed as often as they come.
    """
    return packing.pack(docs)


STAGES = [("language_id", languages), ("quality", rules), ("line_dedup", lines), ("near_dedup", near_copies), ("packing", sequences)]

#: Neither the network nor the tokenisers can be written in SQL; tests hold the stages against the operators by hand.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read by the next one."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
