"""Every query of the catalogue against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from textloom.plans import catalogue, oracles

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else round(float(v), 6) if isinstance(v, float) else v
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    found = duck.execute(oracles.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, found.fetchall())


def test_every_query_is_known():
    assert set(oracles.ORACLES) <= set(catalogue.QUERIES)
    assert set(catalogue.QUERIES) - set(oracles.ORACLES) == {"embed_stub"}


def test_entry():
    import __spark_entry__

    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries()) and set(oracles.ORACLES) <= set(__spark_entry__.oracle_sql())
