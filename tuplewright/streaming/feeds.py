"""Streams over a change log's files: feed, projection, follower state and access watch.

The log's order is total, so nothing is late and no watermark on event time is needed; progress is the stream's
checkpoint, and every sink is idempotent by batch or by position, so that a batch that runs twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import LOG, TUPLE_COLUMNS, StaleReadError, Token
from ..operators import history, permissions
from ..plans.durable import durable
from ..plans.schema_language import Schema
from ..sources.files import Folder


STRETCH = 1 << 20


def read(spark: SparkSession, log_path: str, files_per_batch: int = 1000) -> DataFrame:
    """The log as a stream; files_per_batch is the back-pressure."""
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(log_path)


def feed(spark: SparkSession, log_path: str, each: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Calls each(rows, batch) with new change rows."""
    rows = read(spark, log_path).where(F.col("event").isin("add", "remove", "schema", "epoch", "erase"))
    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def project(spark: SparkSession, log_path: str, table_path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Projects the log to a table partitioned by day, sorted by position in files: a batch writes its own folder. A day
    is dealt over tasks by stretches of STRETCH positions, so a bulk load's day is not one task."""

    def write(rows: DataFrame, batch: int) -> None:
        days = rows.withColumn("commit_day", F.to_date("commit_ts")).withColumn("batch", F.lit(batch))
        days.repartition("commit_day", F.floor(F.col("lsn") / F.lit(STRETCH))).sortWithinPartitions("commit_day", "lsn").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("commit_day", "batch").parquet(table_path)

    return read(spark, log_path).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class Follower:
    """The live tuples of a log, kept by a stream: state N is written whole, then named current."""

    def __init__(self, spark: SparkSession, log_path: str, path: str):
        self.spark, self.log_path, self.folder = spark, log_path, Folder(spark, path)

    def position(self) -> int:
        return self.folder.read_json("current.json")["lsn"] if self.folder.exists("current.json") else 0

    def tuples(self) -> DataFrame:
        """Rows (tuple columns, event, lsn) of the last event of each tuple are the state; live ones are adds."""
        return self._state().where("event = 'add'").select(*TUPLE_COLUMNS)

    def _state(self) -> DataFrame:
        if not self.folder.exists("current.json"):
            return self.spark.createDataFrame([], ", ".join(f"{c} string" for c in TUPLE_COLUMNS) + ", event string, lsn long")
        return self.spark.read.parquet(self.folder.at(self.folder.read_json("current.json")["state"]))

    def _apply(self, rows: DataFrame, batch: int) -> None:
        if self.folder.exists("current.json") and self.folder.read_json("current.json")["state"] == f"state-{batch}":
            return  # the batch runs again after its state was named
        own = rows.where("event in ('add', 'remove')").select(*TUPLE_COLUMNS, "event", "lsn")
        last = self._state().unionByName(own).groupBy(*TUPLE_COLUMNS).agg(F.max_by(F.struct("event", "lsn"), "lsn").alias("e")).select(*TUPLE_COLUMNS, "e.*")
        name = f"state-{batch}"
        last.write.mode("overwrite").parquet(self.folder.at(name))
        top = rows.agg(F.max("txn_lsn")).first()[0]
        old = self.folder.read_json("current.json") if self.folder.exists("current.json") else None
        self.folder.put_json("current.json", {"state": name, "lsn": max(top or 0, self.position())})
        if old and old["state"] != name:
            self.folder.delete(old["state"])

    def follow(self, trigger: dict | None = None) -> StreamingQuery:
        return read(self.spark, self.log_path).writeStream.foreachBatch(self._apply).option("checkpointLocation", self.folder.at("progress")).trigger(**(trigger or {"availableNow": True})).start()

    def gate(self, at_least: Token) -> None:
        """Catches up once if the state is older than the token, and raises if it still is."""
        if at_least.lsn > self.position() and at_least.lsn > self.wait_until_current():
            raise StaleReadError(f"position {self.position()} is before {at_least.lsn}")

    def check(self, schema: Schema, questions: DataFrame, at_least: Token | None = None) -> DataFrame:
        if at_least is not None:
            self.gate(at_least)
        return permissions.check(self.tuples(), schema, questions)

    def wait_until_current(self) -> int:
        query = self.follow()
        query.awaitTermination()
        return self.position()


class AccessWatch:
    """Net changes of the answers to registered questions (object, permission, subject), from one poll to the next. The
    answers lie in a checkpoint, not on the driver."""

    def __init__(self, source, questions: DataFrame):
        self.source, self.questions = source, questions
        self.answers = self._now()

    def _now(self) -> DataFrame:
        return durable(permissions.check(self.source.tuples(), self.source.schema(), self.questions))

    def changed(self) -> DataFrame:
        """(object, permission, subject, allowed) of the answers that changed since the last poll, as a table."""
        new = self._now()
        out = durable(permissions.access_changes(self.answers, new))
        self.answers = new
        return out

    def poll(self) -> list:
        return self.changed().collect()


def watch_access(before: DataFrame, after: DataFrame, schema: Schema, questions: DataFrame) -> DataFrame:
    """The same for two sets of tuples, as tables."""
    return permissions.access_changes(permissions.check(before, schema, questions), permissions.check(after, schema, questions))


def lag(log: DataFrame, position: int) -> DataFrame:
    """How far a follower is behind: transactions and rows behind its position."""
    return history.change_rows(log, position).agg(F.count_distinct("txn_lsn").alias("transactions"), F.count("*").alias("rows"))
