"""Closures and their maintenance against plain search, over random graphs with cycles and self-loops."""

import random

import pytest

from tuplewright.plans import fixpoint


def closed(pairs):
    ways, out = {}, set()
    for a, b in pairs:
        ways.setdefault(a, set()).add(b)
    for s in ways:
        seen, todo = set(), list(ways[s])
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += ways.get(n, ())
        out |= {(s, n) for n in seen}
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("seed", range(6))
def test_closure_insert_delete(spark, seed):
    r = random.Random(seed)
    n, own = (12, 14) if seed % 2 else (40, 30)
    old = {(r.randrange(n), r.randrange(n)) for _ in range(own)}
    new = {(r.randrange(n + 3), r.randrange(n + 3)) for _ in range(5)} | set(sorted(old)[:2])
    df = lambda pairs: spark.createDataFrame(sorted(pairs), "a long, b long")
    before = fixpoint.closure(df(old))
    assert got(before) == closed(old)
    after = fixpoint.closure_after_insert(before, df(new))
    assert got(after) == closed(old | new)
    gone = set(sorted(old | new)[::3])
    rest = (old | new) - gone
    assert got(fixpoint.closure_after_delete(after, df(rest or {(n + 9, n + 9)}), df(gone))) == closed(rest or {(n + 9, n + 9)})


def test_long_chain_and_cycle(spark):
    chain, ring = {(k, k + 1) for k in range(70)}, {(100 + k, 100 + (k + 1) % 37) for k in range(37)}
    assert got(fixpoint.closure(spark.createDataFrame(sorted(chain | ring), "a long, b long"))) == closed(chain | ring)


def test_insert_does_not_store_the_added_pairs(spark, monkeypatch):
    """300 sources above one end of a new edge with 300 nodes below it: 90,000 pairs are made only as they are read."""
    rows, keep = [], fixpoint.stored
    monkeypatch.setattr(fixpoint, "stored", lambda df: rows.append((out := keep(df)).count()) or out)
    monkeypatch.setattr(fixpoint, "durable", lambda df: rows.append((out := keep(df)).count()) or out)
    e = spark.range(300).selectExpr("id a", "1000L b").union(spark.range(300).selectExpr("2000L", "3000 + id"))
    after = fixpoint.closure_after_insert(fixpoint.closure(e), spark.sql("select 1000L, 2000L"))
    assert after.count() == 600 + 301 * 301
    assert max(rows) <= 700


def test_insert_into_nothing_and_of_nothing(spark):
    none = spark.createDataFrame([], "a long, b long")
    ring = {(1, 2), (2, 3), (3, 1), (3, 4)}
    assert got(fixpoint.closure_after_insert(none, spark.createDataFrame(sorted(ring), "a long, b long"))) == closed(ring)
    assert got(fixpoint.closure_after_insert(fixpoint.closure(spark.createDataFrame(sorted(ring), "a long, b long")), none)) == closed(ring)
