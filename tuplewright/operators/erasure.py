"""Erasing a name: its tuples go, and its history keeps a pseudonym in its place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import joined, pseudonym
from ..model import TUPLE_COLUMNS

PSEUDONYM_TYPE = "erased"
#: Erased names up to this many are broadcast when redacting; more are joined by shuffle.
MOST_BROADCAST = 100_000


def _names(object_: Column | str, subject: Column | str) -> Column:
    return F.array(object_, subject)


def tuples_of(tuples: DataFrame, name: str) -> DataFrame:
    """Every live tuple in which a name is object or subject, each once: the removes that an erasure writes."""
    kind, _, rest = name.partition(":")
    if not rest:
        kind, rest = "", name
    here = lambda t, i: (F.col(t) == kind) & (F.col(i) == rest)
    return tuples.select(*TUPLE_COLUMNS).where(here("object_type", "object_id") | here("subject_type", "subject_id")).distinct()


def pseudonyms(names: DataFrame, salt: bytes) -> DataFrame:
    """(name, alias) of each name."""
    return names.toDF("name").select("name", pseudonym(F.col("name"), salt).alias("alias"))


def redact(log: DataFrame, erased: DataFrame) -> DataFrame:
    """log with the pseudonym for each erased name (name, alias, erase_lsn) in rows at or before its erasure.

    A name that is used again later is a new subject and stays. A name erased twice takes, for a row, the first
    erasure that comes after it.
    """
    e = erased.select("name", "alias", "erase_lsn")
    if erased.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        e = F.broadcast(e.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("erase_lsn", "alias"))).alias("times")))
    else:
        e = e.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("erase_lsn", "alias"))).alias("times"))
    out = log
    for kind, rest in (("object_type", "object_id"), ("subject_type", "subject_id")):
        own = e.toDF("_name", "_times")
        out = out.join(own, joined(F.col(kind), F.col(rest)) == F.col("_name"), "left")
        alias = F.get(F.filter("_times", lambda t: t["erase_lsn"] >= F.col("lsn")), F.lit(0))["alias"]
        out = out.withColumn("_alias", alias)
        out = out.withColumn(rest, F.when(F.col("_alias").isNotNull(), F.substr("_alias", F.lit(len(PSEUDONYM_TYPE) + 2))).otherwise(F.col(rest)))
        out = out.withColumn(kind, F.when(F.col("_alias").isNotNull(), F.lit(PSEUDONYM_TYPE)).otherwise(F.col(kind))).drop("_name", "_times", "_alias")
    return out.select(*log.columns)


def affected_days(log: DataFrame, names: DataFrame, day: str = "commit_day") -> DataFrame:
    """The day partitions that hold any of the names: the only ones a redaction writes again."""
    own = log.select(F.col(day), F.explode(F.array(joined(F.col("object_type"), F.col("object_id")), joined(F.col("subject_type"), F.col("subject_id")))).alias("n"))
    return own.join(names.toDF("name"), F.col("n") == F.col("name"), "left_semi").select(day).distinct()


def leaks(rows: DataFrame, name: str) -> DataFrame:
    """Rows of any table in which a name still stands in some string column, whole or as id."""
    rest = name.partition(":")[2] or name
    texts = [c for c, t in rows.dtypes if t == "string"]
    hit = F.lit(False)
    for c in texts:
        hit = hit | (F.col(c) == rest) | F.contains(F.col(c), F.lit(name))
    return rows.where(F.coalesce(hit, F.lit(False)))
