"""Counts of lookups against the lookups themselves, over random tuples with cycles, with big frames of several sizes."""

import random

import pytest
from pyspark.sql import functions as F

from tuplewright import fixtures as X
from tuplewright.model import TUPLE_COLUMNS, CheckDepthError
from tuplewright.operators import permissions
from tuplewright.plans.schema_language import parse


def some(r):
    rows = [("territory", f"n{r.randrange(6)}", "resident", "customer", f"c{k}", "") for k in range(40) for _ in range(r.choice([0, 1, 1, 2]))]
    rows += [("territory", f"n{r.randrange(6)}", "resident", "territory", f"n{r.randrange(6)}", "resident") for _ in range(4)]
    rows += [("catalog", f"p{k}", "within", "catalog", f"p{r.randrange(12)}", "") for k in range(12)]
    rows += [("catalog", f"p{r.randrange(12)}", "steward", "customer", f"c{r.randrange(40)}", "") for _ in range(8)]
    rows += [("catalog", f"p{r.randrange(12)}", "audience", "territory", f"n{r.randrange(6)}", "resident") for _ in range(5)]
    rows += [("order", f"o{k}", "listed", "catalog", f"p{r.randrange(12)}", "") for k in range(50) for _ in range(r.choice([0, 1, 1, 2]))]
    return list(set(rows + [("order", f"o{r.randrange(60)}", "buyer", "customer", f"c{r.randrange(45)}", "") for _ in range(60)]))


@pytest.mark.parametrize("big", [1, 5, 10**9])
def test_counts_equal_lookups(spark, big, monkeypatch):
    monkeypatch.setattr(permissions, "BIG", big)
    t = spark.createDataFrame(some(random.Random(big)), ", ".join(f"{c} string" for c in TUPLE_COLUMNS)).localCheckpoint()
    model = parse(X.MODEL)
    objects, subjects = spark.range(70).selectExpr("'order:o' || id"), spark.range(0, 50, 2).selectExpr("'customer:c' || id")
    want = permissions.lookup_subjects(t, model, objects, "track", "customer").groupBy("object").agg(F.count("*"))
    assert sorted(map(tuple, permissions.count_subjects(t, model, objects, "track", "customer").collect())) == sorted(map(tuple, want.collect()))
    want = permissions.lookup_resources(t, model, subjects, "order", "track").groupBy("subject").agg(F.count("*"))
    assert sorted(map(tuple, permissions.count_resources(t, model, subjects, "order", "track").collect())) == sorted(map(tuple, want.collect()))


def test_counts_raise_where_the_limit_cuts(spark):
    rows = [("order", "o1", "listed", "catalog", "p0", "")] + [("catalog", f"p{k}", "within", "catalog", f"p{k + 1}", "") for k in range(40)] + [("catalog", "p40", "steward", "customer", "c1", "")]
    t = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in TUPLE_COLUMNS))
    with pytest.raises(CheckDepthError):
        permissions.count_subjects(t, parse(X.MODEL), spark.sql("select 'order:o1'"), "track", "customer")
    assert permissions.count_subjects(t, parse(X.MODEL), spark.sql("select 'order:o1'"), "track", "customer", limit=60).collect()[0][1] == 1
