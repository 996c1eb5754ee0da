import duckdb
import pytest

SF = "/root/testdata/sf0.001"


def rows(df):
    """Rows of a Spark frame with columns by name, as sorted text."""
    names = sorted(df.columns)
    return sorted(repr(tuple(r[n] for n in names)) for r in df.collect())


def duck(sql, **tables):
    """Rows of ``sql`` over pandas tables or, by default, over the small driver tables."""
    con = duckdb.connect()
    if not tables:
        for t in ("documents", "pages", "benchmark", "labels", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, t in tables.items():
        con.register(name, t)
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    at = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr(tuple(r[i] for i in at)) for r in got.fetchall())


#: Nulls in any column, empty and very long texts, ties, repeated rows.
ODD = [
    (1, "a b c\nsame line\nd", "en", "s", 3),
    (2, "a b c\nsame line\nd", "en", "s", 3),
    (2, "a b c\nsame line\nd", "en", "s", 3),
    (3, "", "en", "s", 0),
    (4, "", None, None, None),
    (5, None, "en", "s", None),
    (None, "a b c\nsame line\nd", "en", "s", 3),
    (None, None, None, None, None),
    (None, "only here", "fr", "s", 9),
    (None, "only here", "fr", "s", 9),
    (6, "Same  LINE\nother " + "word " * 20000 + "\nend", "en", "hot", 1),
    (7, "é ü \U0001f600 \x00\nsame line", "xx", "hot", 1),
    (8, "   \n \n", "en", "hot", 1),
    (9, "x" * 300_000, "de", "hot", 1),
    (10, "x" * 299_999 + "y", "de", "hot", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def clash(df):
    """Extra columns named like those that operators make or use inside."""
    from pyspark.sql import functions as F

    for c in ("owner_id", "is_duplicate", "k1", "k2", "pos", "line", "h1", "n", "drops", "tokens", "start", "length", "t", "batch", "shard", "bytes", "g1", "leaf", "slot", "keep", "group_id", "fp", "script", "band", "ids"):
        df = df.withColumn(c, F.lit("clash"))
    return df
