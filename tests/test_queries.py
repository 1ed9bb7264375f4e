"""Every registered query against its SQL on the smallest data set."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from marginalia.plans import catalog
from tests.conftest import plain

QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in Path(tiny).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, tiny, duck, name):
    df = QUERIES[name](spark, tiny)
    columns = sorted(df.columns)
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = sorted((tuple(plain(r[k]) for k in order) for r in result.fetchall()), key=repr)
    assert sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"missing_keys", "field_mismatches", "duplicate_items"}))
def test_gives_rows(spark, tiny, name):
    """An empty result proves nothing; those left out look for faults that the data may not have."""
    assert not QUERIES[name](spark, tiny).isEmpty()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["collection_key", "root_key", "depth", "path", "n_descendants"]
    assert df.count() > 0
