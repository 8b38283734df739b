"""The change log as a table: replay, time travel, feeds, and checks of its chain.

A log row is visible from its transaction's commit, txn_lsn; the state at N is the last event of each tuple among
rows with txn_lsn <= N. Logs can hold redundant events, so replay never sums.

Running values over the log (commit boundaries, epochs, schema versions) are computed per stretch of BUCKET
positions, and one row per stretch carries them on: no task sorts the whole log.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import id_of, type_of
from ..model import TUPLE_COLUMNS, CorruptLogError, HistoryExpiredError, Token, aware

BUCKET = 1 << 20
MOST_TENURES = 64


def running_last(rows: DataFrame, order: str, value: Column, name: str, bucket: int = BUCKET) -> DataFrame:
    """rows with name: the last non-null value at or before the row, by order (a long)."""
    own = rows.withColumn("_v", value).withColumn("_b", F.floor(F.col(order) / F.lit(bucket)))
    ends = own.where("_v is not null").groupBy("_b").agg(F.max_by("_v", order).alias("_last"))
    every = own.groupBy("_b").agg(F.lit(1).alias("_")).join(ends, "_b", "left")
    carried = every.withColumn("_carry", F.last("_last", True).over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).select(F.col("_b").alias("_c"), "_carry")
    within = F.last("_v", True).over(Window.partitionBy("_b").orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
    out = own.withColumn("_w", within).join(carried, F.col("_b") == F.col("_c"), "left")
    return out.withColumn(name, F.coalesce("_w", "_carry")).drop("_v", "_b", "_c", "_w", "_carry")


def running_next(rows: DataFrame, order: str, value: Column, name: str, bucket: int = BUCKET) -> DataFrame:
    """rows with name: the first non-null value at or after the row, by order."""
    own = rows.withColumn("_v", value).withColumn("_b", F.floor(F.col(order) / F.lit(bucket)))
    starts = own.where("_v is not null").groupBy("_b").agg(F.min_by("_v", order).alias("_first"))
    every = own.groupBy("_b").agg(F.lit(1).alias("_")).join(starts, "_b", "left")
    carried = every.withColumn("_carry", F.last("_first", True).over(Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1))).select(F.col("_b").alias("_c"), "_carry")
    # backwards, as a frame that only grows costs one pass and one that only shrinks is computed anew for each row
    within = F.last("_v", True).over(Window.partitionBy("_b").orderBy(F.desc(order)).rangeBetween(Window.unboundedPreceding, 0))
    out = own.withColumn("_w", within).join(carried, F.col("_b") == F.col("_c"), "left")
    return out.withColumn(name, F.coalesce("_w", "_carry")).drop("_v", "_b", "_c", "_w", "_carry")


def commit_boundaries(records: DataFrame) -> DataFrame:
    """Rows (lsn, ..., kind) with txn_lsn, the next commit's lsn, without the commit rows; rows with no commit yet are cut."""
    out = running_next(records, "lsn", F.when(F.col("kind") == "commit", F.col("lsn")), "txn_lsn")
    return out.where("kind <> 'commit' and txn_lsn is not null")


def with_epoch(rows: DataFrame, tenures: DataFrame) -> DataFrame:
    """rows with the epoch of the last tenure (epoch, first_lsn) that begins at or before their lsn."""
    span = Window.orderBy("first_lsn")
    t = tenures.select("epoch", "first_lsn").withColumn("next_lsn", F.lead("first_lsn").over(span))
    if tenures.limit(MOST_TENURES + 1).count() <= MOST_TENURES:
        on = (F.col("lsn") >= F.col("first_lsn")) & (F.col("next_lsn").isNull() | (F.col("lsn") < F.col("next_lsn")))
        return rows.join(F.broadcast(t), on, "left").drop("first_lsn", "next_lsn")
    marks = rows.withColumn("_mark", F.lit(False)).unionByName(tenures.select(F.col("first_lsn").alias("lsn"), F.col("epoch").alias("_e"), F.lit(True).alias("_mark")), allowMissingColumns=True)
    return running_last(marks, "lsn", F.col("_e"), "epoch").where("not _mark").drop("_mark", "_e")


def with_schema_version(rows: DataFrame) -> DataFrame:
    """rows with schema_version in force: that of the last schema event at or before the row (0 before the first)."""
    out = running_last(rows, "lsn", F.when(F.col("event") == "schema", F.col("version")), "schema_version")
    return out.withColumn("schema_version", F.coalesce("schema_version", F.lit(0)).cast("int"))


def decode(records: DataFrame) -> DataFrame:
    """Log rows of records (lsn, event, object, relation, subject, subject_relation, detail): names split, gaps ''."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    keep = [c for c in records.columns if c not in ("object", "relation", "subject", "subject_relation", "detail")]
    return records.select(
        *keep,
        type_of(blank("object")).alias("object_type"),
        id_of(blank("object")).alias("object_id"),
        blank("relation").alias("relation"),
        type_of(blank("subject")).alias("subject_type"),
        id_of(blank("subject")).alias("subject_id"),
        blank("subject_relation").alias("subject_relation"),
        blank("detail").alias("detail"),
    )


def replay(log: DataFrame, upto: int | None = None, base: DataFrame | None = None, after: int | None = None) -> DataFrame:
    """The tuples live at txn_lsn upto: those whose last event is an add.

    base: a checkpoint's tuples at after; only the log behind it is read then, and base rows count as older adds.
    """
    rows = log.where("event in ('add', 'remove')")
    if upto is not None:
        rows = rows.where(F.col("txn_lsn") <= upto)
    if after is not None:
        rows = rows.where(F.col("txn_lsn") > after)
    rows = rows.select(*TUPLE_COLUMNS, "event", "lsn")
    if base is not None:
        rows = rows.unionByName(base.select(*TUPLE_COLUMNS, F.lit("add").alias("event"), F.lit(-1).cast("long").alias("lsn")))
    return rows.groupBy(*TUPLE_COLUMNS).agg(F.max_by("event", "lsn").alias("last")).where("last = 'add'").drop("last")


def position_at(log: DataFrame, when: datetime) -> int | None:
    """The last commit at or before a time; commit times strictly increase."""
    return log.where(F.col("commit_ts") <= F.lit(aware(when))).agg(F.max("txn_lsn")).first()[0]


def head(log: DataFrame) -> Token:
    """The last committed position."""
    r = log.agg(F.max(F.struct("txn_lsn", "epoch")).alias("t")).first()["t"]
    return Token(0, 0) if r is None else Token(r["epoch"], r["txn_lsn"])


def floor_of(log: DataFrame, kept_from: int = 0) -> int:
    """The oldest position that can be asked for: retention's, or that of the newest erasure."""
    erased = log.where("event = 'erase'").agg(F.max("txn_lsn")).first()[0]
    return max(kept_from, erased or 0)


def as_of(log: DataFrame, when: Token | int | datetime, checkpoints: dict[int, DataFrame] | None = None, kept_from: int = 0) -> DataFrame:
    """The tuples at a token, position or time, from the newest checkpoint at or before it."""
    if isinstance(when, datetime):
        now = F.current_timestamp()
        if log.sparkSession.range(1).select(now < F.lit(aware(when))).first()[0]:
            raise ValueError("the time lies in the future")
        at = position_at(log, when)
        if at is None:
            raise HistoryExpiredError("nothing was committed by then")
    else:
        at = when.lsn if isinstance(when, Token) else when
    if at < floor_of(log, kept_from):
        raise HistoryExpiredError(f"position {at} is older than what is kept, or than the newest erasure")
    usable = [k for k in checkpoints or {} if k <= at]
    if usable:
        return replay(log, at, checkpoints[max(usable)], max(usable))
    return replay(log, at)


def change_rows(log: DataFrame, after: int = 0) -> DataFrame:
    return log.where((F.col("txn_lsn") > after) & F.col("event").isin("add", "remove", "schema", "epoch", "erase"))


def changes(log: DataFrame, after: int = 0, limit: int = 1000) -> tuple[DataFrame, int]:
    """(rows, next position): whole transactions after a position, up to the first that makes limit rows or more.

    Every transaction has a row, so the first `limit` transactions are enough to find the cut: a top-n, not a sort.
    """
    rows = change_rows(log, after)
    first = rows.groupBy("txn_lsn").agg(F.count("*").alias("n")).orderBy("txn_lsn").limit(limit)
    counted = first.withColumn("before", F.sum("n").over(Window.orderBy("txn_lsn")) - F.col("n"))
    last = counted.where(F.col("before") < limit).agg(F.max("txn_lsn")).first()[0]
    return (rows.where(F.col("txn_lsn") <= last), last) if last is not None else (rows.limit(0), after)


def stats(log: DataFrame) -> DataFrame:
    """Rows, transactions, first and last position and time by epoch."""
    return log.groupBy("epoch").agg(
        F.count("*").alias("rows"),
        F.count_distinct("txn_lsn").alias("transactions"),
        F.min("lsn").alias("first_lsn"),
        F.max("txn_lsn").alias("last_txn_lsn"),
        F.count_if(F.col("event") == "add").alias("adds"),
        F.count_if(F.col("event") == "remove").alias("removes"),
    )


def segments(log: DataFrame, size: int) -> DataFrame:
    """Chain segments of about size positions: seq, first_lsn, last_lsn, epoch, rows, digest, prev_digest.

    A segment ends with a transaction. Its digest covers its rows' digests in order; prev_digest links it.
    """
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in ("lsn", "txn_lsn", "epoch", "event", *TUPLE_COLUMNS, "detail")]).cast("binary"), 256)
    own = log.withColumn("seq", F.floor((F.col("txn_lsn") - 1) / F.lit(size)).cast("long")).withColumn("_row", row)
    parts = own.groupBy("seq").agg(F.min("lsn").alias("first_lsn"), F.max("txn_lsn").alias("last_lsn"), F.max("epoch").alias("epoch"), F.count("*").alias("rows"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("lsn", "_row"))), lambda x: x["_row"]), "").cast("binary"), 256).alias("digest"))
    order = Window.orderBy("seq")
    return parts.withColumn("seq", F.row_number().over(order).cast("long")).withColumn("prev_digest", F.coalesce(F.lag("digest").over(order), F.lit("")))


def chain_faults(chain: DataFrame) -> DataFrame:
    """Segments that don't follow on the one before: gap in seq, other digest, epoch going back, positions overlapping."""
    order = Window.orderBy("seq")
    before = lambda c: F.lag(c).over(order)
    checked = chain.select("seq", "prev_digest", "first_lsn", "epoch", before("seq").alias("ps"), before("digest").alias("pd"), before("epoch").alias("pe"), before("last_lsn").alias("pl"))
    fault = (
        F.when(F.col("ps").isNull(), F.lit(None).cast("string"))
        .when(F.col("seq") != F.col("ps") + 1, F.lit("gap"))
        .when(F.col("prev_digest") != F.col("pd"), F.lit("digest"))
        .when(F.col("epoch") < F.col("pe"), F.lit("epoch"))
        .when(F.col("first_lsn") <= F.col("pl"), F.lit("position"))
    )
    return checked.select("seq", fault.alias("fault")).where("fault is not null")


def verify_chain(log: DataFrame, chain: DataFrame, size: int) -> None:
    """Raises unless the chain's links hold and the log's rows have its digests."""
    bad = chain_faults(chain).limit(1).collect()
    if bad:
        raise CorruptLogError(f"segment {bad[0]['seq']}: {bad[0]['fault']}")
    now = segments(log, size).select(F.col("seq").alias("s"), F.col("digest").alias("d"))
    off = chain.join(now, F.col("seq") == F.col("s"), "left").where("d is null or d <> digest").select("seq").limit(1).collect()
    if off:
        raise CorruptLogError(f"segment {off[0]['seq']}: its rows have another digest")


def salvage(local: DataFrame, handoff_lsn: int) -> DataFrame:
    """Transactions of a former writer's log that were not handed over: those that begin behind the handoff."""
    first = local.groupBy("txn_lsn").agg(F.min("lsn").alias("first_lsn")).where(F.col("first_lsn") > handoff_lsn).select(F.col("txn_lsn").alias("t"))
    return local.join(first, F.col("txn_lsn") == F.col("t"), "left_semi")


def retained(log: DataFrame, older_than: datetime, referenced_lsn: int, projected_lsn: int) -> DataFrame:
    """The rows that retention keeps: it drops what is older than the cutoff, below the newest reference and projected."""
    drop = (F.col("commit_ts") < F.lit(aware(older_than))) & (F.col("txn_lsn") <= referenced_lsn) & (F.col("txn_lsn") <= projected_lsn)
    return log.where(~drop)


def newest_checkpoint(positions: DataFrame, upto: int) -> DataFrame:
    """The position of the newest checkpoint at or before upto."""
    return positions.where(F.col("lsn") <= upto).agg(F.max("lsn").alias("lsn"))


def committed(records: DataFrame) -> DataFrame:
    """Recovery: records up to the last commit; a torn tail goes."""
    last = records.where("kind = 'commit'").agg(F.max("lsn").alias("_last"))
    return records.join(F.broadcast(last), F.col("lsn") <= F.col("_last")).drop("_last")  # one row
