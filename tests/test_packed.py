"""Reach by packed lists: the codec, and the operators against plain breadth-first search."""

import random
from collections import deque

import numpy as np
import pytest

from tuplewright.operators import graph
from tuplewright.plans import packed


@pytest.mark.parametrize("high", [1, 5, 300, 70000, 2**40, 2**63 - 1])
def test_pack_and_unpack(high):
    r = np.random.default_rng(high % 97)
    starts, nodes, _ = packed.least(np.sort(r.integers(0, 50, 500)), r.integers(-high, high, 500), r.integers(0, 4, 500))
    rows, back = packed.unpack(packed.pack(starts, nodes, 53))
    assert rows.tolist() == starts.tolist() and back.tolist() == nodes.tolist()


def distances(edges, start, most):
    out, queue = {start: 0}, deque([start])
    while queue:
        n = queue.popleft()
        for b in edges.get(n, ()) if out[n] < most else ():
            if b not in out:
                out[b] = out[n] + 1
                queue.append(b)
    return out


@pytest.mark.parametrize("depth", [2, 3, 4])
def test_khop_of_any_longs(spark, depth, monkeypatch):
    monkeypatch.setattr(packed, "BYTES", 50)
    r = random.Random(depth)
    names = [-(2**63), 2**63 - 1, 0, -1, *(r.randrange(-(2**62), 2**62) for _ in range(40))]
    pairs = [(r.choice(names), r.choice(names)) for _ in range(90)] + [(names[0], names[0]), (None, 0), (0, None)]
    ways = {}
    for a, b in pairs:
        if a is not None and b is not None:
            ways.setdefault(a, set()).add(b)
    starts = [*names, 7, None, 7]
    e, s = spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame([(x,) for x in starts], "n long")
    want = {x: distances(ways, x, depth) for x in starts if x is not None}
    got = sorted(map(tuple, graph.khop(e, s, depth).collect()))
    assert got == sorted((x, n, d) for x, far in want.items() for n, d in far.items() if n != x)
    assert sorted(map(tuple, graph.khop_counts(e, s, depth).collect())) == sorted((x, len(far) - 1) for x, far in want.items())


def test_found_pairs_are_not_shuffled(spark):
    """300 starts share 10 neighbours of 300 nodes: 93,000 pairs from 3,000 first steps."""
    e = spark.range(300).selectExpr("id a", "explode(sequence(1000L, 1009L)) b").union(spark.range(1000, 1010).selectExpr("id", "explode(sequence(id * 1000, id * 1000 + 299))"))
    found = graph.khop(e, spark.range(300), 2)
    assert found.count() == 300 * (10 + 10 * 300)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Exchange")  # the plan's last step is on top


@pytest.mark.parametrize("depth", [2, 3, 4])
def test_reachable_from_both_sides(spark, depth):
    r = random.Random(depth)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(90)] + [(None, 1), (1, None)]
    ways = {}
    for a, b in pairs:
        if a is not None and b is not None:
            ways.setdefault(a, set()).add(b)
    asked = [(u, v) for u in range(0, 62, 3) for v in range(62)] + [(None, 1), (1, None), (5, 5), (5, 5)]
    got = graph.reachable(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(asked, "a long, b long"), depth)
    want = {(u, v, u is not None and v in distances(ways, u, depth)) for u, v in asked}
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_reachable_steps_back_from_few_ends(spark, monkeypatch):
    """200 starts reach 40,000 nodes each in two steps, but the one end asked for has a single node before it."""
    rows = []
    keep = graph.stored
    monkeypatch.setattr(graph, "stored", lambda df: rows.append((out := keep(df)).count()) or out)
    e = spark.range(200).selectExpr("id a", "explode(sequence(1000L, 1019L)) b").union(spark.range(1000, 1020).selectExpr("id", "explode(sequence(id * 10000, id * 10000 + 199))"))
    e = e.union(spark.sql("select 10190007L, 5L"))
    assert graph.reachable(e, spark.range(200).selectExpr("id", "5L"), 3).where("found").count() == 200
    assert max(rows[1:]) <= e.count()


def test_counts_are_made_where_pairs_are_found(spark):
    e = spark.range(300).selectExpr("id a", "explode(sequence(1000L, 1009L)) b").union(spark.range(1000, 1010).selectExpr("id", "explode(sequence(id * 1000, id * 1000 + 299))"))
    counts = graph.khop_counts(e, spark.range(301), 2)
    assert {tuple(r) for r in counts.collect()} == {(k, 10 + 10 * 300) for k in range(300)} | {(300, 0)}
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Exchange")


def test_many_counts_are_made_in_parts(spark, monkeypatch):
    """3,000 first steps, and never more than a third of them or so shuffled with their lists at once."""
    made, keep = [], packed.stored
    monkeypatch.setattr(packed, "stored", lambda df: made.append((df.columns, (out := keep(df)).count())) or out)
    monkeypatch.setattr(packed, "AT_ONCE", 1000, raising=False)
    e = spark.range(300).selectExpr("id a", "explode(sequence(1000L, 1009L)) b").union(spark.range(1000, 1010).selectExpr("id", "explode(sequence(id * 1000, id * 1000 + 299))"))
    counts = graph.khop_counts(e, spark.range(301), 2)
    assert sorted(map(tuple, counts.collect())) == [(k, 10 + 10 * 300) for k in range(300)] + [(300, 0)]
    parts = [n for columns, n in made if columns == ["start", "found"]]
    assert len(parts) == 4 and sum(parts) == 301 and max(parts) <= 120
