"""Every query against DuckDB over the same tables."""

import os

import duckdb
import pytest

from tuplewright import queries

SLOW_ORACLES = ()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr([r[k] for k in order]) for r in found)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_oracle(spark, sf, duck, name):
    got = queries.QUERIES[name](spark, sf)
    want = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, map(tuple, got.collect())) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_without_oracle_gives_rows(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_oracles_are_not_vacuous(duck):
    empty = [n for n, sql in queries.ORACLES.items() if not duck.execute(sql).fetchall()]
    assert not empty


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
