import duckdb
import pytest

from lodestore.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_against_duckdb(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    assert all(t in ("string", "bigint", "int", "boolean", "double") for _, t in df.dtypes)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
    assert got
