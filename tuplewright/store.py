"""A durable store of permission tuples over one append-only log on any file system Spark reads.

Layout under the store's path: log/commit_day=D (a file for each transaction, renamed into place as a whole),
checkpoints/lsn=N (the live tuples at N), schemas in the log's rows, epochs/N (claims of writers), salt.
One writer has the newest epoch; a writer that finds a newer claim stops. Readers need no claim.
"""

from __future__ import annotations

import os
import time
import uuid
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.names import pseudonym
from .model import LOG, TUPLE, CheckDepthError, ClosedError, HistoryExpiredError, SchemaError, StoreError, Token, Tuple, make_tuple, split_object, token_position
from .operators import erasure, history, permissions
from .plans.durable import checkpoint_folder, durable
from .plans.schema_language import Catalog, Schema, next_version, parse, write
from .sources.files import Folder

LARGEST_TRANSACTION = 1 << 20
STORED = T.StructType([*LOG.fields, T.StructField("commit_day", T.DateType())])


class Transaction:
    """Adds and removes that are written all or none."""

    def __init__(self):
        self.operations: list[tuple[str, Tuple]] = []

    def add(self, object: str, relation: str, subject: str, subject_relation: str | None = None) -> Transaction:
        self.operations.append(("add", make_tuple(object, relation, subject, subject_relation)))
        return self

    def remove(self, object: str, relation: str, subject: str, subject_relation: str | None = None) -> Transaction:
        self.operations.append(("remove", make_tuple(object, relation, subject, subject_relation)))
        return self

    def __len__(self) -> int:
        return len(self.operations)


class Reader:
    """Reads of a log; the writer and every follower share them."""

    spark: SparkSession
    folder: Folder

    def log(self) -> DataFrame:
        if not self.folder.exists("log"):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(STORED).parquet(self.folder.at("log")).select(*LOG.names)

    def checkpoints(self) -> dict[int, DataFrame]:
        found = [int(n.removeprefix("lsn=")) for n in self.folder.names("checkpoints") if n.startswith("lsn=") and self.folder.exists(f"checkpoints/{n}/_SUCCESS")]
        return {n: self.spark.read.schema(TUPLE).parquet(self.folder.at(f"checkpoints/lsn={n}")) for n in found}

    def tuples(self, upto: int | None = None) -> DataFrame:
        """The live tuples: the newest checkpoint and the log behind it."""
        points = {k: v for k, v in self.checkpoints().items() if upto is None or k <= upto}
        if points:
            at = max(points)
            return history.replay(self.log(), upto, points[at], at)
        return history.replay(self.log(), upto)

    def token(self) -> Token:
        return history.head(self.log())

    def schemas(self) -> list[Schema]:
        rows = self.log().where("event = 'schema'").orderBy("lsn").select("detail").collect()
        return [parse(r["detail"]) for r in rows]

    def schema(self) -> Schema:
        found = self.schemas()
        if not found:
            raise SchemaError("there is no schema yet")
        return found[-1]

    def tenures(self) -> list[tuple[int, int, int | None]]:
        rows = self.log().where("event = 'epoch'").groupBy("epoch").agg(F.min("lsn").alias("first")).orderBy("epoch").collect()
        return [(r["epoch"], r["first"], b["first"] - 1 if b else None) for r, b in zip(rows, [*rows[1:], None], strict=True)]

    def _at_least(self, token: Token | None) -> None:
        if token is not None:
            token_position(token, self.tenures(), self.token())

    def check_many(self, questions: DataFrame, at_least: Token | None = None) -> DataFrame:
        self._at_least(at_least)
        return permissions.check(self.tuples(), self.schema(), questions)

    def check(self, object: str, permission: str, subject: str, *, at_least: Token | None = None) -> bool:
        split_object(object), split_object(subject)
        asked = self.spark.createDataFrame([(object, permission, subject)], "object string, permission string, subject string")
        status = self.check_many(asked, at_least).first()["status"]
        if status == "DEPTH":
            raise CheckDepthError(f"{object}#{permission} for {subject} needs more than {permissions.LIMIT} steps")
        return status == "ALLOW"

    def lookup_subjects(self, object: str, permission: str, subject_type: str | None = None) -> DataFrame:
        schema = self.schema()
        schema.define(split_object(object)[0], permission)
        return permissions.lookup_subjects(self.tuples(), schema, self.spark.createDataFrame([(object,)], "o string"), permission, subject_type)

    def lookup_resources(self, subject: str, object_type: str, permission: str) -> DataFrame:
        return permissions.lookup_resources(self.tuples(), self.schema(), self.spark.createDataFrame([(subject,)], "s string"), object_type, permission)

    def kept_from(self) -> int:
        return self.folder.read_json("retention.json")["kept_from"] if self.folder.exists("retention.json") else 0

    def as_of(self, when: Token | datetime) -> Past:
        return Past(self, when)

    def changes_table(self, after: Token | None = None, limit: int = 1000) -> tuple[DataFrame, Token]:
        """Whole transactions behind a token, with names as they read now, and the token to go on from. A bulk load is one
        transaction, whatever limit says, so its rows stay in a table."""
        log = self.log()
        if after is not None:
            current = self.token()
            if after.epoch > current.epoch:
                return log.limit(0), after
            token_position(after, self.tenures(), max(after, current))
            if after.lsn < self.kept_from():
                raise HistoryExpiredError(f"{after} is older than what is kept")
        rows, at = history.changes(log, after.lsn if after else 0, limit)
        last = rows.agg(F.max_by("epoch", "lsn")).first()[0]
        return rows, Token(last, at) if last is not None else after or Token(0, 0)

    def changes(self, after: Token | None = None, limit: int = 1000) -> tuple[list, Token]:
        """The same as a list in order; for logs that hold bulk loads take changes_table."""
        rows, token = self.changes_table(after, limit)
        return rows.orderBy("txn_lsn", "lsn").collect(), token

    def watch(self, after: Token | None = None, limit: int = 1000, poll: float = 1.0):
        """Changes without end."""
        while True:
            rows, after = self.changes(after, limit)
            yield from rows
            if not rows:
                time.sleep(poll)

    def stats(self) -> DataFrame:
        return history.stats(self.log())


class Store(Reader):
    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.folder = Folder(spark, path or f"{checkpoint_folder(spark)}/store-{uuid.uuid4().hex}")
        claimed = [int(n) for n in self.folder.names("epochs") if n.isdigit()]
        self.epoch = max(claimed, default=0) + 1
        if not self.folder.claim(f"epochs/{self.epoch}"):
            raise StoreError(f"epoch {self.epoch} went to another writer")
        log = self.log()
        last = log.agg(F.max("lsn").alias("lsn"), F.max("commit_ts").alias("ts")).first()
        self.next_lsn, self.last_commit = (last["lsn"] or 0) + 1, last["ts"]
        found = self.schemas()
        self._schema, self.catalog = (found[-1] if found else None), Catalog()
        for s in found:
            self.catalog = self.catalog.evolve(s)
        self.open = True
        self._append([("epoch", Tuple(*[""] * 6), str(self.epoch))])

    def _append(self, rows: list[tuple[str, Tuple, str]]) -> Token:
        if not self.open:
            raise ClosedError("the store is closed")
        newest = max(int(n) for n in self.folder.names("epochs") if n.isdigit())
        if newest != self.epoch:
            raise StoreError(f"a writer of epoch {newest} took over")
        now = datetime.now(UTC).replace(tzinfo=None)
        if self.last_commit is not None:
            now = max(now, self.last_commit.replace(tzinfo=None) + timedelta(microseconds=1))
        txn = self.next_lsn + len(rows) - 1
        version = self._schema.version if self._schema else 0
        out = [(self.next_lsn + k, now, txn, self.epoch, event, *t, version, detail) for k, (event, t, detail) in enumerate(rows)]
        df = self.spark.createDataFrame(out, LOG).coalesce(1)  # a transaction is bounded, and one file is renamed at once
        df.withColumn("commit_day", F.to_date("commit_ts")).sortWithinPartitions("lsn").write.mode("append").partitionBy("commit_day").parquet(self.folder.at("log"))
        self.next_lsn, self.last_commit = txn + 1, now
        return Token(self.epoch, txn)

    def schema(self) -> Schema:
        if self._schema is None:
            raise SchemaError("there is no schema yet")
        return self._schema

    def apply_schema(self, document: str) -> Token:
        new = parse(document)
        blocked = next_version(self._schema, new)
        catalog = self.catalog.evolve(new)
        if blocked and not permissions.blocked_changes(self.tuples(), blocked).isEmpty():
            raise SchemaError("a relation that the new version removes, or turns into or from a link, holds tuples")
        old, self._schema = self._schema, new
        try:
            token = self._append([("schema", Tuple(*[""] * 6), write(new))])
        except Exception:
            self._schema = old
            raise
        self.catalog = catalog
        return token

    def write(self, transaction: Transaction) -> Token:
        if not transaction.operations:
            return self.token()
        if sum(sum(map(len, t)) + 16 for _, t in transaction.operations) > LARGEST_TRANSACTION:
            raise ValueError("a transaction is at most 1 MiB")
        schema = self.schema()
        for _, t in transaction.operations:
            if not schema.allows(t.object_type, t.relation, permissions.subject(t.subject_type, t.subject_relation)):
                raise SchemaError(f"the schema doesn't allow {t}")
        return self._append([(event, t, "") for event, t in transaction.operations])

    def _holds(self, t: Tuple) -> bool:
        own = self.spark.createDataFrame([t], TUPLE)
        return not self.tuples().join(F.broadcast(own), list(t._fields), "left_semi").isEmpty()

    def add_tuple(self, object: str, relation: str, subject: str, subject_relation: str | None = None) -> Token:
        transaction = Transaction().add(object, relation, subject, subject_relation)
        return self.token() if self._holds(transaction.operations[0][1]) else self.write(transaction)

    def remove_tuple(self, object: str, relation: str, subject: str, subject_relation: str | None = None) -> Token:
        transaction = Transaction().remove(object, relation, subject, subject_relation)
        return self.write(transaction) if self._holds(transaction.operations[0][1]) else self.token()

    def load(self, rows: DataFrame) -> Token:
        """Adds many tuples as one transaction: a bulk load that Spark writes in parallel.

        Its files are renamed by one job commit; lsns come from partition offsets, not from a sort.
        """
        permissions.validate(rows, self.schema())
        fresh = rows.select(*TUPLE.names).distinct().join(self.tuples().toDF(*[f"_{c}" for c in TUPLE.names]), [F.col(c) == F.col(f"_{c}") for c in TUPLE.names], "left_anti")
        numbered = durable(fresh.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
        sizes = {r["_part"]: r["n"] for r in numbered.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # a row per partition
        total = sum(sizes.values())
        if not total:
            return self.token()
        starts, offset = [], self.next_lsn
        for part in sorted(sizes):
            starts += [F.lit(part), F.lit(offset)]
            offset += sizes[part]
        now = datetime.now(UTC).replace(tzinfo=None)
        if self.last_commit is not None:
            now = max(now, self.last_commit.replace(tzinfo=None) + timedelta(microseconds=1))
        txn = self.next_lsn + total - 1
        out = numbered.select(
            (F.create_map(*starts)[F.col("_part")] + F.col("_at")).cast("long").alias("lsn"), F.lit(now).alias("commit_ts"), F.lit(txn).cast("long").alias("txn_lsn"), F.lit(self.epoch).cast("long").alias("epoch"), F.lit("add").alias("event"),
            *TUPLE.names, F.lit(self._schema.version).cast("int").alias("schema_version"), F.lit("").alias("detail"),
        )
        out.withColumn("commit_day", F.to_date("commit_ts")).write.mode("append").partitionBy("commit_day").parquet(self.folder.at("log"))
        self.next_lsn, self.last_commit = txn + 1, now
        return Token(self.epoch, txn)

    def checkpoint(self) -> Token:
        """Writes the live tuples, so that reads replay only what came later."""
        now = self.token()
        if now.lsn not in self.checkpoints():
            self.tuples(now.lsn).write.mode("overwrite").parquet(self.folder.at(f"checkpoints/lsn={now.lsn}"))
        return now

    def _salt(self) -> bytes:
        if not self.folder.exists("salt"):
            self.folder.put("salt", os.urandom(32))
        return self.folder.read("salt")

    def erase(self, name: str) -> Token:
        """Removes every tuple of a name, and puts a pseudonym for it in the stored history up to now."""
        found = [Tuple(*r) for r in erasure.tuples_of(self.tuples(), name).collect()]  # one name's tuples, as the removes to write
        known = bool(found) or not self._mentions(name).isEmpty()
        if self._schema and (name in self._schema.types or any(t.has(name) for t in self._schema.types.values())):
            raise SchemaError(f"{name!r} is a name of the schema")
        if not known:
            return self.token()
        alias = self.spark.range(1).select(pseudonym(F.lit(name), self._salt()).alias("a")).first()["a"]
        for k in range(0, len(found), 30_000):
            self._append([("remove", t, "") for t in found[k : k + 30_000]])
        token = self._append([("erase", Tuple(*[""] * 6), alias)])
        self._rewrite(name, alias, token.lsn)
        return token

    def _mentions(self, name: str) -> DataFrame:
        log = self.log()
        kind, _, rest = name.partition(":")
        kind, rest = (kind, rest) if rest else ("", name)
        return log.where(((F.col("object_type") == kind) & (F.col("object_id") == rest)) | ((F.col("subject_type") == kind) & (F.col("subject_id") == rest)))

    def _rewrite(self, name: str, alias: str, upto: int) -> None:
        """Only the days that hold the name are written again, each replaced as a whole; old checkpoints go."""
        self.checkpoint()  # while the removes still bear the name that an older checkpoint may hold
        stored = self.spark.read.schema(STORED).parquet(self.folder.at("log"))
        days = [r["commit_day"] for r in erasure.affected_days(stored, self.spark.createDataFrame([(name,)], "n string")).collect()]  # days of one log
        gone = self.spark.createDataFrame([(name, alias, upto)], "name string, alias string, erase_lsn long")
        new = durable(erasure.redact(stored.where(F.col("commit_day").isin(days)), gone))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("commit_day").parquet(self.folder.at("log"))
        for n in self.checkpoints():
            if n < upto:
                self.folder.delete(f"checkpoints/lsn={n}")

    def retain(self, older_than: datetime) -> None:
        """Drops log days that end before a time and that the newest checkpoint covers."""
        points = self.checkpoints()
        if not points:
            return
        at = max(points)
        days = self.spark.read.schema(STORED).parquet(self.folder.at("log")).groupBy("commit_day").agg(F.max("txn_lsn").alias("last"), F.max("commit_ts").alias("ts"), F.count_if(F.col("event").isin("schema", "epoch", "erase")).alias("kept"))
        gone = [r for r in days.where((F.col("ts") < F.lit(older_than)) & (F.col("last") <= at) & (F.col("kept") == 0)).collect()]
        if gone:
            self.folder.put_json("retention.json", {"kept_from": max(r["last"] for r in gone)})
            for r in gone:
                self.folder.delete(f"log/commit_day={r['commit_day']}")

    def close(self) -> None:
        self.open = False

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


class Past(Reader):
    """The store as it was at a token or time."""

    def __init__(self, source: Reader, when: Token | datetime):
        self.spark, self.folder, self.source = source.spark, source.folder, source
        self._go(when)

    def _go(self, when: Token | datetime) -> None:
        log = self.source.log()
        if isinstance(when, Token):
            token_position(when, self.source.tenures(), self.source.token())
        self._tuples = history.as_of(log, when, self.source.checkpoints(), self.source.kept_from())
        self.at = when.lsn if isinstance(when, Token) else history.position_at(log, when)

    def log(self) -> DataFrame:
        return self.source.log().where(F.col("txn_lsn") <= self.at)

    def tuples(self, upto: int | None = None) -> DataFrame:
        return self._tuples if upto is None else super().tuples(upto)

    def commit_time(self) -> datetime:
        return self.log().agg(F.max("commit_ts")).first()[0]

    def advance(self, when: Token | datetime) -> None:
        """Forward only, and not across an erasure."""
        old = self.at
        at = when.lsn if isinstance(when, Token) else history.position_at(self.source.log(), when)
        if at is None or at < old:
            raise ValueError("a view of the past only goes forward")
        if not self.source.log().where((F.col("event") == "erase") & (F.col("txn_lsn") > old) & (F.col("txn_lsn") <= at)).isEmpty():
            raise HistoryExpiredError("an erasure lies between")
        self._go(when)


def restore(spark: SparkSession, source: str, target: str, upto: int | None = None) -> None:
    """Copies a store's log (up to a position) and newest checkpoint into an empty path."""
    old, new = Folder(spark, source), Folder(spark, target)
    if new.names():
        raise StoreError(f"{target} isn't empty")
    reader = Reader()
    reader.spark, reader.folder = spark, old
    log = reader.log()
    log = log if upto is None else log.where(F.col("txn_lsn") <= upto)
    points = {k: v for k, v in reader.checkpoints().items() if upto is None or k <= upto}
    log.withColumn("commit_day", F.to_date("commit_ts")).write.partitionBy("commit_day").parquet(new.at("log"))
    if points:
        points[max(points)].write.parquet(new.at(f"checkpoints/lsn={max(points)}"))
    for n in old.names("epochs"):
        new.claim(f"epochs/{n}")
    if old.exists("salt"):
        new.put("salt", old.read("salt"))
