"""Bulk checks by shared frames against the walks of whole starts, and what they store."""

import random

import pytest
from pyspark.sql import functions as F
from test_counts import some
from test_permissions import MODEL, random_tuples

from tuplewright import fixtures as X
from tuplewright.model import TUPLE, TUPLE_COLUMNS
from tuplewright.operators import permissions
from tuplewright.plans.schema_language import parse


walk_of_each = permissions._walk


def by_walks(tuples, schema, questions, limit):
    q = questions.toDF("object", "permission", "subject").distinct().withColumn("begin", F.concat("object", F.lit("#"), "permission"))
    reached, cut = walk_of_each(permissions.stored(permissions.frame_edges(tuples, schema)), q.select("begin").distinct(), limit)
    ends, far = {}, {r[0] for r in cut.collect()}
    for r in reached.where(F.col("frames") <= limit).join(permissions.direct(tuples), F.col("node") == F.col("frame")).select("start", "subject").collect():
        ends.setdefault(r[0], set()).add(r[1])
    return sorted((r[0], r[1], r[2], "ALLOW" if r[2] in ends.get(r[3], ()) else "DEPTH" if r[3] in far else "DENY") for r in q.collect())


def asked(spark, r):
    kinds = [("crew", "hand"), ("site", "enter"), ("site", "manage"), ("site", "guard"), ("machine", "inspect"), ("machine", "run")]
    rows = [(f"{k}:{r.randrange(7)}", d, f"person:{r.randrange(7)}") for k, d in kinds for _ in range(25)]
    return spark.createDataFrame(rows, "o string, p string, s string")


@pytest.mark.parametrize("back", [True, False])
@pytest.mark.parametrize(("seed", "limit"), [(11, 3), (12, 5), (13, 32)])
def test_check_as_by_walks(spark, monkeypatch, back, seed, limit):
    monkeypatch.setattr(permissions, "_backward", lambda *_: back)
    schema, tuples = random_tuples(seed, 45)
    df, questions = spark.createDataFrame(tuples, TUPLE).localCheckpoint(), asked(spark, random.Random(seed)).localCheckpoint()
    assert sorted(map(tuple, permissions.check(df, schema, questions, limit).collect())) == by_walks(df, parse(MODEL), questions, limit)


def chain(orders, long, more=()):
    rows = [("order", f"o{k}", "listed", "catalog", f"own{k}", "") for k in range(orders)] + [("catalog", f"own{k}", "within", "catalog", "p0", "") for k in range(orders)]
    rows += [("catalog", f"p{k}", "within", "catalog", f"p{k + 1}", "") for k in range(long)]
    return rows + [("catalog", f"p{long}", "steward", "customer", "c1", ""), ("order", "o1", "buyer", "customer", "c2", ""), *more]


def test_check_stores_no_row_for_each_question_and_frame(spark, monkeypatch):
    """200 orders, each in a catalog of its own above which the same 20 lie, with one steward on top: 12,000 frames are on their ways."""
    rows, keep = [], permissions.stored
    monkeypatch.setattr(permissions, "stored", lambda df: rows.append((out := keep(df)).count()) or out)
    t = spark.createDataFrame(chain(200, 20), ", ".join(f"{c} string" for c in TUPLE_COLUMNS))
    questions = spark.range(200).selectExpr("concat('order:o', id)", "'track'", "explode(array('customer:c1', 'customer:c2', 'customer:no'))")
    got = permissions.check(t, parse(X.MODEL), questions)
    assert {tuple(r) for r in got.where("status = 'ALLOW'").select("object", "subject").collect()} == {(f"order:o{k}", "customer:c1") for k in range(200)} | {("order:o1", "customer:c2")}
    assert got.where("status = 'DENY'").count() == 399
    assert max(rows) <= 1000


@pytest.mark.parametrize("back", [True, False])
@pytest.mark.parametrize(("seed", "limit"), [(1, 3), (2, 6), (3, 9)])
def test_limits_in_forks_and_cycles(spark, monkeypatch, back, seed, limit):
    monkeypatch.setattr(permissions, "_backward", lambda *_: back)
    r = random.Random(seed)
    t = spark.createDataFrame(some(r), ", ".join(f"{c} string" for c in TUPLE_COLUMNS)).localCheckpoint()
    rows = [(f"order:o{r.randrange(60)}", "track", f"customer:c{r.randrange(45)}") for _ in range(200)]
    questions = spark.createDataFrame(rows, "o string, p string, s string").localCheckpoint()
    assert sorted(map(tuple, permissions.check(t, parse(X.MODEL), questions, limit).collect())) == by_walks(t, parse(X.MODEL), questions, limit)


def test_cycle_at_the_limit_is_told_without_walks_of_starts(spark, monkeypatch):
    """Catalogs own0 to own99 below a ring of 24, at which they hang by chains of 0 to 9: only the longer chains pass the limit."""
    more = [("catalog", f"own{k}", "within", "catalog", f"own{k - 10}" if k >= 10 else f"p{k}", "") for k in range(100)] + [("catalog", "p23", "within", "catalog", "p0", "")]
    rows = [x for x in chain(100, 23) if not x[1].startswith("own")] + more
    t = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in TUPLE_COLUMNS)).localCheckpoint()
    questions = spark.range(100).selectExpr("concat('order:o', id)", "'track'", "explode(array('customer:c1', 'customer:c2', 'customer:no'))").localCheckpoint()
    want = by_walks(t, parse(X.MODEL), questions, 32)
    starts, keep = [], permissions._walk
    monkeypatch.setattr(permissions, "_walk", lambda e, s, limit: starts.append(s.count()) or keep(e, s, limit))
    assert sorted(map(tuple, permissions.check(t, parse(X.MODEL), questions).collect())) == want
    assert max(starts) <= 24
    assert {x[3] for x in want} == {"ALLOW", "DENY", "DEPTH"}
