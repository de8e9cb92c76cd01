"""Every query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from lacuna.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DIR)
    want = duck.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


def test_catalogue_is_consistent():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["target", "rank", "cell", "score"] and df.count() > 0
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
