"""Keyed tables of upserts and deletes: the newest entry of a key wins."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = {"int64": T.LongType(), "int32": T.IntegerType(), "float64": T.DoubleType(), "utf8": T.StringType()}
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def schema_of(columns: dict[str, str]) -> T.StructType:
    """The table type of {column: kind}; all columns are required."""
    if not columns:
        raise ValueError("a table needs a column")
    for name, kind in columns.items():
        if not _NAME.fullmatch(name) or name == "key_hash":
            raise ValueError(f"not a column name: {name!r}")
        if kind not in KINDS:
            raise ValueError(f"column {name!r}: no kind {kind!r}; there are {', '.join(KINDS)}")
    return T.StructType([T.StructField(n, KINDS[k], False) for n, k in columns.items()])


def last_writes(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key by order: an aggregate with map-side combination, not a window."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def current(versions: DataFrame, removed: DataFrame) -> DataFrame:
    """Merge on read: of versions (key_hash, entry, ...), the newest of each key, without keys that removed
    (key_hash, entry) deletes in that entry or a later one."""
    newest = last_writes(versions, ["key_hash"], F.col("entry"))
    gone = removed.groupBy(F.col("key_hash").alias("k")).agg(F.max("entry").alias("removed_in"))
    return newest.join(gone, (F.col("key_hash") == F.col("k")) & (F.col("removed_in") >= F.col("entry")), "left_anti")


def current_by_window(versions: DataFrame, removed: DataFrame) -> DataFrame:
    """current, as row numbers over each key's entries."""
    order = Window.partitionBy("key_hash").orderBy(F.desc("entry"))
    newest = versions.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return newest.join(removed.toDF("k", "e"), (F.col("key_hash") == F.col("k")) & (F.col("e") >= F.col("entry")), "left_anti")


def entries(operations: DataFrame, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(data, deletes) of operations (entry, key_hash, order, kind: upsert or delete, ...): one state per key and entry."""
    last = last_writes(operations, ["entry", "key_hash"], F.col(order))
    return last.where("kind = 'upsert'").drop("kind", order), last.where("kind = 'delete'").select("key_hash", "entry")


def compact(versions: DataFrame, removed: DataFrame, entry: int) -> DataFrame:
    """The whole table as one entry."""
    return current(versions, removed).withColumn("entry", F.lit(entry))


def get(versions: DataFrame, removed: DataFrame, keys: DataFrame) -> DataFrame:
    """The current rows of the keys asked: both sides are cut to them before the merge."""
    k = keys.toDF("asked").distinct()
    own = lambda df: df.join(k, F.col("key_hash") == F.col("asked"), "left_semi")
    return current(own(versions), own(removed))


def total(rows: DataFrame, column: str) -> DataFrame:
    """The sum as a double, 0.0 of no rows; integer sums overflow to an error, as Spark's ANSI mode says."""
    _number(rows, column)
    return rows.agg(F.coalesce(F.sum(column).cast("double"), F.lit(0.0)).alias("total"))


def average(rows: DataFrame, column: str) -> DataFrame:
    """The mean as a double, null of no rows."""
    _number(rows, column)
    return rows.agg(F.avg(column).alias("average"))


def _number(rows: DataFrame, column: str) -> None:
    kinds = dict(rows.dtypes)
    if column not in kinds:
        raise KeyError(column)
    if kinds[column] not in ("bigint", "int", "double"):
        raise TypeError(f"column {column!r} is no number")


def grouped_scan(rows: DataFrame, group: str, amount: str, distance: str) -> DataFrame:
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.round(F.sum(amount), 2).alias("total"), F.round(F.avg(distance), 6).alias("mean"))


def ungrouped_scan(rows: DataFrame, amount: str, distance: str) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.round(F.sum(amount), 2).alias("total"), F.round(F.avg(distance), 6).alias("mean"))


def statistics(rows: DataFrame) -> DataFrame:
    """(name, rows, nulls, low, high) of each column, bounds as text; those of a double column that holds NaN or zero
    are left out, as its order or sign would be in doubt. One pass."""
    aggregates = []
    for c, t in rows.dtypes:
        col = F.col(c)
        bad = F.count_if(F.isnan(col) | (col == 0)) > 0 if t == "double" else F.lit(False)
        aggregates.append(F.struct(F.lit(c).alias("name"), F.count("*").alias("rows"), F.count_if(col.isNull()).alias("nulls"), F.when(~bad, F.min(col).cast("string")).alias("low"), F.when(~bad, F.max(col).cast("string")).alias("high")))
    return rows.agg(F.array(*aggregates).alias("s")).select(F.inline("s"))
