"""Every registered query with an SQL twin gives the twin's rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from corpusloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation supplier customer orders lineitem part events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def values(frame):
    names = sorted(frame.columns)
    return names, sorted(map(str, frame[names].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_twin(spark, sql, name):
    assert values(catalog.QUERIES[name](spark, SF).toPandas()) == values(sql.execute(catalog.ORACLES[name]).df())


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
