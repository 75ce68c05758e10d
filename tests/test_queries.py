"""Every registered query beside its SQL, over whole tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from maskframe.queries.base import TABLES
from tools.check import normal

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return db


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, SF)
    got = normal(df.collect(), df.columns)
    if name not in oracle_sql():
        assert got
        return
    result = duck.execute(oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == normal(result.fetchall(), columns)


def test_entry(spark):
    assert entry(spark).count() > 0


def test_registry_of_queries():
    assert set(oracle_sql()) <= set(queries())
