"""Bulk checks against a naive evaluator over random tuples, cycles included."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tuplewright.model import TUPLE, CheckDepthError, SchemaError, Tuple, make_tuple
from tuplewright.operators import permissions
from tuplewright.plans.fixpoint import closure, closure_after_delete, closure_after_insert, reach
from tuplewright.plans.schema_language import parse

MODEL = """
schema 1
type person
type crew { relation hand: person | crew#hand }
type site {
  relation part_of: site
  relation guard: person | crew#hand
  relation owner: person
  permission enter = guard + manage + part_of->enter
  permission manage = owner + part_of->manage
}
type machine {
  relation stands_at: site
  relation operator: person | crew#hand
  permission run = operator + stands_at->manage
  permission inspect = run + stands_at->enter
}
"""


def naive(tuples, schema, o, name, s):
    by = defaultdict(list)
    for t in tuples:
        by[t.object_type, t.object_id, t.relation].append(t)
    seen, todo = set(), [(*o, name)]
    while todo:
        kind, rest, d = todo.pop()
        if (kind, rest, d) in seen:
            continue
        seen.add((kind, rest, d))
        ty = schema.types[kind]
        if d in ty.relations:
            for t in by[kind, rest, d]:
                if t.subject_relation:
                    todo.append((t.subject_type, t.subject_id, t.subject_relation))
                elif (t.subject_type, t.subject_id) == s:
                    return True
        for term in ty.permissions.get(d, ()):
            if not term.through:
                todo.append((kind, rest, term.name))
                continue
            for t in by[kind, rest, term.through]:
                if not t.subject_relation and schema.types[t.subject_type].has(term.name):
                    todo.append((t.subject_type, t.subject_id, term.name))
    return False


def random_tuples(seed, n=60):
    rng = random.Random(seed)
    schema = parse(MODEL)
    found = set()
    for _ in range(n):
        ty = rng.choice(["crew", "site", "machine"])
        r = rng.choice(list(schema.types[ty].relations))
        s = rng.choice(schema.types[ty].relations[r])
        found.add(Tuple(ty, f"{rng.randrange(6)}", r, s.type, f"{rng.randrange(6)}", s.relation))
    return schema, sorted(found)


@pytest.mark.parametrize("seed", range(3))
def test_check_against_naive(spark, seed):
    schema, tuples = random_tuples(seed)
    df = spark.createDataFrame(tuples, TUPLE)
    asked = [(f"{ty}:{k}", d, f"person:{u}") for ty, ds in (("crew", ["hand"]), ("site", ["enter", "manage", "guard"]), ("machine", ["inspect", "run", "operator"])) for d in ds for k in range(6) for u in range(7)]
    got = {(r["object"], r["permission"], r["subject"]): r["status"] for r in permissions.check(df, schema, spark.createDataFrame(asked, "o string, p string, s string")).collect()}
    want = {q: "ALLOW" if naive(tuples, schema, tuple(q[0].split(":")), q[1], tuple(q[2].split(":"))) else "DENY" for q in asked}
    assert got == want
    assert sum(v == "ALLOW" for v in want.values()) > 20 < sum(v == "DENY" for v in want.values())
    objects = spark.createDataFrame([(f"machine:{k}",) for k in range(6)], "o string")
    viewers = {(r["object"], r["subject"]) for r in permissions.lookup_subjects(df, schema, objects, "inspect", "person").collect()}
    assert viewers == {(o, s) for (o, p, s), v in want.items() if v == "ALLOW" and p == "inspect" and o.startswith("machine")}
    users = spark.createDataFrame([(f"person:{k}",) for k in range(7)], "s string")
    own = {(r["object"], r["subject"]) for r in permissions.lookup_resources(df, schema, users, "machine", "inspect").collect()}
    assert own == viewers


def test_depth(spark):
    schema = parse(MODEL)
    rows = [make_tuple(f"site:{k}", "part_of", f"site:{k + 1}") for k in range(40)] + [make_tuple("site:29", "guard", "person:near"), make_tuple("site:40", "guard", "person:far")]
    rows += [make_tuple(f"crew:{k}", "hand", f"crew:{k + 1}", "hand") for k in range(60)] + [make_tuple("crew:60", "hand", "person:deep"), make_tuple("site:0", "guard", "crew:0", "hand")]
    asked = [("site:0", "enter", f"person:{u}") for u in ("near", "far", "deep", "none")]
    got = {r["subject"]: r["status"] for r in permissions.check(spark.createDataFrame(rows, TUPLE), schema, spark.createDataFrame(asked, "o string, p string, s string")).collect()}
    assert got == {"person:near": "ALLOW", "person:far": "DEPTH", "person:deep": "ALLOW", "person:none": "DEPTH"}


def test_lookups_tell_of_the_limit(spark):
    schema = parse(MODEL)
    rows = [make_tuple(f"site:{k}", "part_of", f"site:{k + 1}") for k in range(12)] + [make_tuple("site:3", "guard", "person:near"), make_tuple("site:12", "guard", "person:far")]
    df, one = spark.createDataFrame(rows, TUPLE), lambda x: spark.createDataFrame([(x,)], "x string")
    with pytest.raises(CheckDepthError):
        permissions.lookup_subjects(df, schema, one("site:0"), "enter", limit=6)
    assert [r["subject"] for r in permissions.lookup_subjects(df, schema, one("site:0"), "enter", limit=6, partial=True).collect()] == ["person:near"]
    with pytest.raises(CheckDepthError):
        permissions.lookup_resources(df, schema, one("person:far"), "site", "enter", limit=6)
    assert {r["object"] for r in permissions.lookup_resources(df, schema, one("person:near"), "site", "enter", limit=6).collect()} == {f"site:{k}" for k in range(4)}


def test_strange_kinds_among_many(spark):
    many = spark.range(30_000).select(F.concat(F.lit("kind"), "id", F.lit(":1")).alias("o"), F.lit("enter").alias("p"), F.lit("person:1").alias("s"))
    with pytest.raises(SchemaError):
        permissions.check(permissions.empty(spark), parse(MODEL), many)
    fine = spark.range(30_000).select(F.concat(F.lit("site:"), "id").alias("o"), F.lit("enter").alias("p"), F.lit("person:1").alias("s"))
    with pytest.raises(SchemaError):
        permissions.check(permissions.empty(spark), parse(MODEL), fine.unionAll(fine.limit(1).withColumn("s", F.lit("robot:1"))))


def test_errors(spark):
    schema, tuples = random_tuples(0)
    df = spark.createDataFrame(tuples, TUPLE)
    for q in (("planet:1", "enter", "person:1"), ("site:1", "fly", "person:1"), ("site:1", "enter", "robot:1"), ("site", "enter", "person:1"), ("site:1", "enter", "person")):
        with pytest.raises(SchemaError):
            permissions.check(df, schema, spark.createDataFrame([q], "o string, p string, s string"))
    with pytest.raises(SchemaError):
        permissions.validate(spark.createDataFrame([make_tuple("site:1", "guard", "site:2")], TUPLE), schema)
    for name in ("x", ":x", "x:"):
        with pytest.raises(SchemaError):
            make_tuple(name, "guard", "person:1")
    assert permissions.check(permissions.empty(spark), schema, spark.createDataFrame([("site:1", "enter", "person:1")], "o string, p string, s string")).first()["status"] == "DENY"


def pairs_closed(edges):
    out = set(edges)
    while True:
        more = {(a, d) for a, b in out for c, d in out if b == c} - out
        if not more:
            return out
        out |= more


@pytest.mark.parametrize("seed", range(2))
def test_closures(spark, seed):
    rng = random.Random(seed)
    old = {(rng.randrange(14), rng.randrange(14)) for _ in range(14)}
    new = {(rng.randrange(14), rng.randrange(14)) for _ in range(4)} - old
    df = lambda e: spark.createDataFrame(sorted(e), "src long, dst long")
    got = lambda d: {tuple(r) for r in d.collect()}
    assert got(closure(df(old))) == pairs_closed(old)
    assert got(closure_after_insert(closure(df(old)), df(new))) == pairs_closed(old | new)
    assert got(closure_after_delete(closure(df(old | new)), df(old), df(new))) == pairs_closed(old)


def test_reach(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 3), (3, 4), (9, 9)], "src long, dst long")
    starts = spark.createDataFrame([(1,), (9,), (50,)], "n long")
    for depth in (0, 1, 2, 3, 6, None):
        got = {(r["start"], r["node"]): r["depth"] for r in reach(edges, starts, depth).collect()}
        want = {(1, 1): 0, (1, 2): 1, (1, 3): 2, (1, 4): 3, (9, 9): 0, (50, 50): 0}
        assert got == {k: v for k, v in want.items() if depth is None or v <= depth}
