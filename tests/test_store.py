"""Stores, time travel, feeds, erasure, keyed tables and streams end to end."""

import math
import random
import uuid
from array import array
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tuplewright.functions.names import hash_key, hash_text
from tuplewright.model import ClosedError, CorruptLogError, HistoryExpiredError, KeyKindError, SchemaError, StaleReadError, StoreError, Token, TokenLostError, token_position
from tuplewright.operators import erasure, graph, history
from tuplewright.sources.edge_inputs import from_pairs
from tuplewright.sources.lake_table import LakeTable
from tuplewright.store import Store, Transaction, restore
from tuplewright.streaming import feeds

MODEL = """schema 1
type user
type team { relation staff: user | team#staff }
type document { relation viewer: user | team#staff relation editor: user permission view = viewer + editor }
"""


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/store"


def test_write_check_and_travel(spark, path):
    with Store(spark, path) as s:
        with pytest.raises(SchemaError):
            s.add_tuple("document:a", "viewer", "user:x")
        s.apply_schema(MODEL)
        first = s.write(Transaction().add("document:a", "viewer", "team:g", "staff").add("team:g", "staff", "user:ann").add("document:a", "editor", "user:bob"))
        assert s.check("document:a", "view", "user:ann", at_least=first) and s.check("document:a", "view", "user:bob")
        assert not s.check("document:a", "view", "user:nobody")
        assert s.add_tuple("team:g", "staff", "user:ann") == first
        assert s.remove_tuple("team:g", "staff", "user:zoe") == first
        between = datetime.now(UTC)
        second = s.remove_tuple("team:g", "staff", "user:ann")
        assert second > first and not s.check("document:a", "view", "user:ann")
        assert s.as_of(first).check("document:a", "view", "user:ann")
        past = s.as_of(between)
        assert past.check("document:a", "view", "user:ann") and past.commit_time() is not None
        s.checkpoint()
        third = s.add_tuple("team:g", "staff", "user:cy")
        assert s.check("document:a", "view", "user:cy")
        past.advance(third)
        assert not past.check("document:a", "view", "user:ann") and past.check("document:a", "view", "user:cy")
        with pytest.raises(ValueError):
            past.advance(first)
        with pytest.raises(StaleReadError):
            s.check("document:a", "view", "user:cy", at_least=Token(third.epoch, third.lsn + 1))
        with pytest.raises(ValueError):
            s.as_of(datetime.now())
        with pytest.raises(ValueError):
            s.as_of(datetime.now(UTC) + timedelta(days=1))
        assert {r["subject"] for r in s.lookup_subjects("document:a", "view", "user").collect()} == {"user:cy", "user:bob"}
        assert {r["object"] for r in s.lookup_resources("user:cy", "document", "view").collect()} == {"document:a"}
    with pytest.raises(ClosedError):
        s.add_tuple("team:g", "staff", "user:q")


def test_reopen_and_take_over(spark, path):
    old = Store(spark, path)
    old.apply_schema(MODEL)
    token = old.add_tuple("document:a", "viewer", "user:ann")
    new = Store(spark, path)
    assert new.epoch == old.epoch + 1 and new.check("document:a", "view", "user:ann", at_least=token)
    with pytest.raises(StoreError, match="took over"):
        old.add_tuple("document:a", "viewer", "user:bob")
    with pytest.raises(SchemaError):
        new.apply_schema(MODEL)
    with pytest.raises(SchemaError):
        new.apply_schema(MODEL.replace("schema 1", "schema 2").replace("relation viewer: user | team#staff ", "").replace("viewer + ", ""))
    new.remove_tuple("document:a", "viewer", "user:ann")
    new.apply_schema(MODEL.replace("schema 1", "schema 2").replace("relation viewer: user | team#staff ", "").replace("viewer + ", ""))
    with pytest.raises(SchemaError):
        new.add_tuple("document:a", "viewer", "user:ann")


def test_changes_are_whole_transactions(spark, path):
    s = Store(spark, path)
    s.apply_schema(MODEL)
    start = s.token()
    for k in range(3):
        s.write(Transaction().add(f"document:{k}", "viewer", "user:a").add(f"document:{k}", "viewer", "user:b"))
    rows, after = s.changes(start, limit=3)
    assert [r["object_id"] for r in rows] == ["0", "0", "1", "1"]
    rest, end = s.changes(after)
    assert [r["object_id"] for r in rest] == ["2", "2"] and s.changes(end) == ([], end)
    assert s.stats().agg(F.sum("adds")).first()[0] == 6
    feed = s.watch(start)
    assert [next(feed)["event"] for _ in range(6)] == ["add"] * 6


def test_erasure(spark, path):
    s = Store(spark, path)
    s.apply_schema(MODEL)
    before = s.write(Transaction().add("document:a", "viewer", "user:ann").add("team:g", "staff", "user:ann").add("team:g", "staff", "user:bob"))
    s.checkpoint()
    assert s.erase("user:nobody") == s.token()
    with pytest.raises(SchemaError):
        s.erase("user")
    token = s.erase("user:ann")
    assert not s.check("document:a", "view", "user:ann") and s.check("team:g", "staff", "user:bob")
    assert erasure.leaks(s.log(), "user:ann").count() == 0
    assert s.log().where("subject_type = 'erased'").count() >= 2
    with pytest.raises(HistoryExpiredError):
        s.as_of(before)
    s.add_tuple("document:a", "viewer", "user:ann")
    assert s.check("document:a", "view", "user:ann") and s.as_of(token).check("team:g", "staff", "user:bob")


def test_load_restore_and_retention(spark, path, tmp_path):
    s = Store(spark, path)
    s.apply_schema(MODEL)
    rows = spark.range(500).select(F.lit("document").alias("object_type"), F.col("id").cast("string").alias("object_id"), F.lit("viewer").alias("relation"), F.lit("user").alias("subject_type"), F.lit("ann").alias("subject_id"), F.lit("").alias("subject_relation"))
    token = s.load(rows.repartition(3))
    assert s.tuples().count() == 500 and s.load(rows) == token
    assert s.log().select("lsn").distinct().count() == s.log().count() == token.lsn
    s.checkpoint()
    s.add_tuple("document:a", "viewer", "user:bob")
    restore(spark, path, f"file://{tmp_path}/copy", upto=token.lsn)
    copy = Store(spark, f"file://{tmp_path}/copy")
    assert copy.tuples().count() == 500 and copy.check("document:7", "view", "user:ann")
    with pytest.raises(StoreError):
        restore(spark, path, f"file://{tmp_path}/copy")
    s.retain(datetime.now(UTC) - timedelta(days=1))
    assert s.tuples().count() == 501


def test_streams(spark, path, tmp_path):
    s = Store(spark, path)
    s.apply_schema(MODEL)
    s.write(Transaction().add("document:a", "viewer", "user:ann").add("document:a", "viewer", "user:bob"))
    follower = feeds.Follower(spark, s.folder.at("log"), f"file://{tmp_path}/follower")
    assert follower.wait_until_current() == s.token().lsn and follower.tuples().count() == 2
    asked = spark.createDataFrame([("document:a", "view", f"user:{u}") for u in ("ann", "bob", "cy")], "o string, p string, s string")
    watch = feeds.AccessWatch(s, asked)
    s.write(Transaction().remove("document:a", "viewer", "user:ann").add("document:a", "viewer", "user:cy").remove("document:a", "viewer", "user:bob").add("document:a", "viewer", "user:bob"))
    assert {(r["subject"], r["allowed"]) for r in watch.poll()} == {("user:ann", False), ("user:cy", True)} and watch.poll() == []
    assert feeds.lag(s.log(), follower.position()).first()["rows"] == 4
    assert {r["subject"] for r in follower.check(s.schema(), asked, at_least=s.token()).where("status = 'ALLOW'").collect()} == {"user:bob", "user:cy"}
    with pytest.raises(StaleReadError):
        follower.gate(Token(1, s.token().lsn + 1))
    assert {r["subject_id"] for r in follower.tuples().collect()} == {"bob", "cy"}
    seen = []
    feeds.feed(spark, s.folder.at("log"), lambda df, _: seen.extend(df.collect()), f"file://{tmp_path}/feed").awaitTermination()
    assert len(seen) == s.log().count()
    for _ in range(2):
        feeds.project(spark, s.folder.at("log"), f"file://{tmp_path}/table", f"file://{tmp_path}/projector").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/table").count() == s.log().count()


def test_tokens_over_tenures():
    tenures = [(1, 1, 10), (2, 11, 20), (3, 21, None)]
    assert token_position(Token(1, 10), tenures, Token(3, 30)) == 10
    with pytest.raises(TokenLostError):
        token_position(Token(1, 11), tenures, Token(3, 30))
    with pytest.raises(StaleReadError):
        token_position(Token(3, 31), tenures, Token(3, 30))
    with pytest.raises(StaleReadError):
        token_position(Token(4, 1), tenures, Token(3, 30))


def test_running_values_over_buckets(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([None, None, k * 10])) for k in range(300)]
    df = spark.createDataFrame(rows, "lsn long, v long")
    last = {r["lsn"]: r["x"] for r in history.running_last(df, "lsn", F.col("v"), "x", 7).collect()}
    after = {r["lsn"]: r["x"] for r in history.running_next(df, "lsn", F.col("v"), "x", 7).collect()}
    for k, _ in rows:
        assert last[k] == next((v for j, v in reversed(rows[: k + 1]) if v is not None), None)
        assert after[k] == next((v for j, v in rows[k:] if v is not None), None)


def test_chain(spark, path):
    s = Store(spark, path)
    s.apply_schema(MODEL)
    for k in range(6):
        s.write(Transaction().add(f"document:{k}", "viewer", "user:a").add(f"document:{k}", "viewer", "user:b"))
    log, chain = s.log(), history.segments(s.log(), 4)
    history.verify_chain(log, chain, 4)
    with pytest.raises(CorruptLogError, match="gap"):
        history.verify_chain(log, chain.where("seq <> 2"), 4)
    with pytest.raises(CorruptLogError, match="digest"):
        history.verify_chain(log.withColumn("object_id", F.when(F.col("lsn") == 5, "z").otherwise(F.col("object_id"))), chain, 4)


# edges


def test_edge_inputs(spark):
    assert from_pairs(spark, array("q", [1, 2, 1, 2, 3, 3])).count() == 2
    u = uuid.uuid4()
    assert {tuple(r) for r in from_pairs(spark, [(u, "b"), (str(u), "b")]).collect()} == {(str(u), "b")}
    for bad, error in (([(1, "a")], KeyKindError), ([(1, True)], TypeError), ([(1, -1)], ValueError), ([(1, 2**31)], ValueError), (array("q", [1]), ValueError)):
        with pytest.raises(error):
            from_pairs(spark, bad)


def test_graph_against_sets(spark):
    rng = random.Random(3)
    now = set()
    for _ in range(4):
        more = {(rng.randrange(12), rng.randrange(12)) for _ in range(15)}
        gone = {(rng.randrange(12), rng.randrange(12)) for _ in range(10)}
        df = from_pairs(spark, sorted(now)) if now else spark.createDataFrame([], "src long, dst long")
        assert graph.added(df, from_pairs(spark, list(more) * 2)).count() == len(more - now)
        assert graph.removed(df, from_pairs(spark, list(gone))).count() == len(now & gone)
        after = graph.after_remove(graph.after_add(df, from_pairs(spark, list(more))), from_pairs(spark, list(gone)))
        now = (now | more) - gone
        assert {tuple(r) for r in after.collect()} == now
    df = from_pairs(spark, sorted(now))
    nodes = spark.createDataFrame([(k,) for k in range(13)], "n long")
    assert {r["node"]: r["degree"] for r in graph.degrees(df, nodes).collect()} == {k: sum(a == k for a, _ in now) for k in range(13)}
    assert {r["node"]: r["degree"] for r in graph.in_degrees(df, nodes).collect()} == {k: sum(b == k for _, b in now) for k in range(13)}
    with pytest.raises(ValueError):
        graph.khop(df, nodes, -1)


# keyed tables

COLUMNS = {"amount": "int64", "score": "float64", "status": "int32", "label": "utf8"}


def test_lake_against_a_dict(spark, tmp_path):
    rng = random.Random(4)
    want = {}
    with LakeTable(spark, f"file://{tmp_path}/t", COLUMNS) as t:
        for k in range(14):
            key = rng.choice([1, 2, 3, "a", "b"])
            if rng.random() < 0.3:
                t.delete(key)
                want.pop(key, None)
            else:
                row = {"amount": k, "score": k / 2, "status": k % 3, "label": f"l{k}"}
                t.upsert(key, **row)
                want[key] = row
            if rng.random() < 0.3:
                t.flush()
        for key in (1, 2, 3, "a", "b", "never"):
            assert t.get(key) == want.get(key)
        assert {r["key_hash"] for r in t.rows().collect()} == {hash_key(k) for k in want}
        t.compact()
        assert t.rows().count() == len(want)
    with pytest.raises(ClosedError):
        t.upsert(1, amount=1, score=1.0, status=1, label="")
    again = LakeTable(spark, f"file://{tmp_path}/t", COLUMNS)
    assert again.rows().count() == len(want) and again.sum("amount") == 0.0 and again.average("amount") is None
    with pytest.raises(SchemaError):
        LakeTable(spark, f"file://{tmp_path}/t", {"amount": "int64"})


def test_lake_rules(spark, tmp_path):
    t = LakeTable(spark, f"file://{tmp_path}/t", COLUMNS)
    t.upsert(1, amount=2**62, score=-0.0, status=1, label="x")
    t.upsert(2, amount=2**62, score=math.nan, status=2, label=b"y")
    assert t.sum("status") == 3.0 and t.average("status") == 1.5
    with pytest.raises(Exception, match="(?i)overflow"):
        t.sum("amount")
    t.delete(2)
    assert t.sum("amount") == float(2**62)
    for call, error in ((lambda: t.sum("label"), TypeError), (lambda: t.sum("nope"), KeyError), (lambda: t.upsert(1, amount=1), KeyError), (lambda: t.upsert(1, amount=1.5, score=1.0, status=1, label=""), TypeError), (lambda: t.upsert(1, amount=1, score=1.0, status=2**31, label=""), ValueError), (lambda: t.upsert(True, amount=1, score=1.0, status=2, label=""), TypeError)):
        with pytest.raises(error):
            call()
    assert math.copysign(1, t.get(1)["score"]) == -1
    for columns in ({"key_hash": "int64"}, {"1a": "int64"}, {"a": "int16"}, {}):
        with pytest.raises(ValueError):
            LakeTable(spark, f"file://{tmp_path}/u", columns)


def test_lake_tables_in(spark, tmp_path):
    t = LakeTable(spark, f"file://{tmp_path}/t", {"amount": "int64", "label": "utf8"})
    rows = spark.range(100).select((F.col("id") % 10).alias("k"), F.col("id").alias("amount"), F.lit("x").alias("label"))
    t.upsert_table(rows, "k", order="amount")
    assert {r["amount"] for r in t.rows().collect()} == set(range(90, 100))
    t.delete_table(spark.range(5), "id")
    t.flush()
    assert t.rows().count() == 5
    with pytest.raises(TypeError):
        t.upsert_table(rows.withColumn("amount", F.lit(1.5)), "k")
    with pytest.raises(ValueError):
        t.upsert_table(rows.withColumn("label", F.lit(None).cast("string")), "k")
    files = spark.read.parquet(t.folder.at("data")).select(F.regexp_extract(F.col("_metadata.file_path"), "entry=([0-9]+)", 1).alias("e")).distinct().collect()
    assert [r["e"] for r in files] == ["1"]


def test_hash_key(spark):
    import hashlib

    assert hash_key("a") == int.from_bytes(hashlib.blake2b(b"a", digest_size=8).digest(), "little", signed=True) == hash_key(b"a")
    assert hash_key(-5) == -5
    got = spark.createDataFrame([("a",), (None,), ("é",)], "k string").select("k", hash_text(F.col("k")).alias("h")).collect()
    assert {r["k"]: r["h"] for r in got} == {"a": hash_key("a"), None: None, "é": hash_key("é")}
    for bad, error in ((True, TypeError), (1.5, TypeError), (2**63, ValueError)):
        with pytest.raises(error):
            hash_key(bad)


def test_lake_triggers(spark, tmp_path, monkeypatch):
    columns = {"amount": "int64", "label": "utf8"}
    t = LakeTable(spark, f"file://{tmp_path}/bytes", columns, flush_bytes=1000)
    t.upsert(1, amount=1, label="x" * 500)
    assert t.entries == [] and t.waiting == 1
    t.upsert(2, amount=1, label="x" * 500)
    assert t.entries == [1] and (t.waiting, t.bytes) == (0, 0)
    now = [100.0]
    monkeypatch.setattr("tuplewright.sources.lake_table.time.monotonic", lambda: now[0])
    t = LakeTable(spark, f"file://{tmp_path}/seconds", columns, flush_seconds=60)
    t.upsert(1, amount=1, label="a")
    t.delete(1)
    now[0] = 161.0
    t.upsert(2, amount=2, label="b")
    assert t.entries == [1] and [(r["key_hash"], r["amount"]) for r in t.rows().collect()] == [(2, 2)]
    with pytest.raises(KeyError):
        t.upsert_from([(3, {"amount": 1, "label": "c"}), (4, {"amount": 1})])
    assert t.get(3) is None
    with pytest.raises(ValueError):
        t.upsert_columns([1, 2], {"amount": [1], "label": ["a", "b"]})
