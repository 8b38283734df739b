"""Sharding by fixed virtual slots, in DataFrame expressions only.

Records hash into SLOTS slots by id and text. Bytes are summed per slot, and a versioned map gives each slot its
shard. Rebalancing edits the map, never the hash: `assign` fills shards greedily, the heaviest slot first, into
the lightest shard; `rebalance` moves only the slots that an overfull or missing shard has to give up. The law
is `bytes`: shards' sizes are near equal.

Places in a shard are gapless from 0: a record's place in its slot plus the records in the slots before it in the
shard, so that the only sort is within slots, never within a whole shard.

`SlotMaps` stores the versions of the map: a version is written once, read by every later run and never changed; a
run whose slots or number of shards the newest version no longer suits writes the next one.

Groups, as far as this law has them, are equal texts: they aren't kept together, as one may hold a third of all bytes.

The map has SLOTS rows, which bounds what is broadcast; per-slot totals are aggregated before any shuffle. Copies of
a text have different ids and spread over slots. Rows that repeat an id and a text share a slot; if they make it
hold over HOT times the mean number of rows, its rows are dealt over all slots by their row number instead.

Cases: null text has no bytes and size 8, crc32 null as of no bytes (0); null id hashes like a fixed value; an empty table
gives an empty result.
"""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import Folder
from ._common import checkpoint_folder, durable

SLOTS = 4096
SHARDS = 24
BASE = 8
HOT = 8


class SlotMaps:
    """Versions of a slot map as Parquet under a folder that all executors share: version=1, version=2, ..."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, Folder(spark, folder)

    def _path(self, version: int) -> str:
        return self.folder.at(f"version={version}")

    def newest(self) -> int:
        """The newest version whose write has ended, 0 if there is none."""
        done = [n for n in self.folder.names() if n.startswith("version=") and self.folder.exists(f"{n}/_SUCCESS")]
        return max((int(n.removeprefix("version=")) for n in done), default=0)

    def load(self, version: int) -> DataFrame:
        return self.spark.read.parquet(self._path(version)).select(F.lit(version).alias("version"), "virtual_slot", "shard")

    def save(self, slot_map: DataFrame, version: int) -> DataFrame:
        """Writes a version that isn't there yet (an unfinished one is replaced) and reads it back."""
        if version <= self.newest():
            raise ValueError(f"version {version} is there already")
        slot_map.select("virtual_slot", "shard").coalesce(1).write.mode("overwrite").parquet(self._path(version))  # SLOTS rows
        return self.load(version)

    def current(self, sizes: DataFrame, shards: int, slack: float = 1.02) -> DataFrame:
        """The newest version if it suits the slots' sizes and the number of shards; else the next, made and stored."""
        newest = self.newest()
        if not newest:
            return self.save(assign(sizes, shards), 1)
        old = self.load(newest)
        return old if suits(old, sizes, shards, slack) else self.save(durable(rebalance(old, sizes, shards, slack)), newest + 1)


def suits(slot_map: DataFrame, sizes: DataFrame, shards: int, slack: float) -> bool:
    """Whether every slot has a shard, all shards are used, and none holds over slack times the mean and a slot."""
    own = sizes.join(slot_map.select(F.col("virtual_slot").alias("s"), "shard"), F.col("virtual_slot") == F.col("s"), "left")
    of = own.groupBy("shard").agg(F.sum("bytes").alias("load"), F.max("bytes").alias("slot"), F.count("*").alias("slots"))
    row = of.agg(F.sum("slots").alias("slots"), F.count("shard").alias("used"), F.max(F.col("shard").isNull() | (F.col("shard") >= shards)).alias("strange"), F.max("load").alias("most"), F.sum("load").alias("all"), F.max("slot").alias("slot")).first()
    return not row["all"] or (not row["strange"] and row["used"] == min(shards, row["slots"]) and row["most"] <= slack * row["all"] / shards + row["slot"])


def slot_of(slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(F.lit("slot"), F.col("doc_id"), F.col("text_crc32"), F.col("size")), F.lit(slots)).cast("int")


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot of every row."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sized = docs.select("doc_id", (F.octet_length(text) + F.lit(BASE)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return sized.withColumn("virtual_slot", slot_of(slots))


def slot_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def _fill(slots: Column, loads: Column) -> Column:
    """Structs (virtual_slot, shard) of slots (bytes, virtual_slot), in order, each to the lightest shard then."""
    start = F.struct(loads.alias("loads"), F.array().cast("array<struct<virtual_slot:int,shard:int>>").alias("map"))

    def put(acc: Column, x: Column) -> Column:
        shard = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1
        return F.struct(
            F.transform(acc["loads"], lambda v, k: F.when(k == shard, v + x["bytes"]).otherwise(v)).alias("loads"),
            F.concat(acc["map"], F.array(F.struct(x["virtual_slot"].alias("virtual_slot"), shard.alias("shard")))).alias("map"),
        )

    return F.aggregate(slots, start, put, lambda acc: acc["map"])


def assign(sizes: DataFrame, shards: int = SHARDS, version: int = 1) -> DataFrame:
    """The first slot map: version, virtual_slot, shard. One row per slot goes in, so one task fills the shards."""
    heavy = sizes.agg(F.sort_array(F.collect_list(F.struct("bytes", "virtual_slot")), False).alias("slots"))
    loads = F.array_repeat(F.lit(0).cast("long"), shards)
    return heavy.select(F.inline(_fill(F.col("slots"), loads))).select(F.lit(version).alias("version"), "virtual_slot", "shard")


def rebalance(old: DataFrame, sizes: DataFrame, shards: int, slack: float = 1.02) -> DataFrame:
    """The next version of a slot map for new sizes or a new number of shards.

    A shard that stays keeps its heaviest slots up to slack times the mean; other slots, slots of shards that are
    gone and new slots go, heaviest first, to the lightest shard.
    """
    now = sizes.join(old.select(F.col("virtual_slot").alias("s"), "shard", "version"), F.col("virtual_slot") == F.col("s"), "left").drop("s")
    total = F.sum("bytes").over(Window.partitionBy())
    held = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot"))
    now = now.withColumn("stays", F.coalesce((F.col("shard") < shards) & (held <= total * F.lit(slack) / F.lit(shards)), F.lit(False)))
    now = now.withColumn("version", F.max("version").over(Window.partitionBy()) + 1)
    stay = now.where("stays").select("version", "virtual_slot", "shard")
    loads = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: F.coalesce(F.element_at("held", k), F.lit(0).cast("long")))
    kept = now.where("stays").groupBy("shard").agg(F.sum("bytes").alias("b")).agg(F.map_from_entries(F.collect_list(F.struct("shard", "b"))).alias("held"))
    moved = now.where(~F.col("stays")).agg(F.max("version").alias("version"), F.sort_array(F.collect_list(F.struct("bytes", "virtual_slot")), False).alias("slots"))
    moved = moved.crossJoin(kept).select("version", F.inline(_fill(F.col("slots"), loads)))  # one row and one row
    return stay.unionByName(moved)


def place(rows: DataFrame, sizes: DataFrame, slot_map: DataFrame) -> DataFrame:
    """rows with shard, and slot: the place in the shard, gapless from 0."""
    order = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    own = sizes.join(slot_map.select(F.col("virtual_slot").alias("s"), "shard"), F.col("virtual_slot") == F.col("s"))
    own = own.select(F.col("virtual_slot").alias("s"), "shard", F.coalesce(F.sum("rows").over(order), F.lit(0)).alias("first"))
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    out = rows.withColumn("place", F.row_number().over(within) - 1)
    out = out.join(F.broadcast(own), F.col("virtual_slot") == F.col("s"))  # at most SLOTS rows
    return out.withColumn("slot", F.col("first") + F.col("place")).drop("s", "first", "place")


def spread(rows: DataFrame, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """rows (a checkpoint, so that row numbers stay) without hot slots, and the sizes of their slots."""
    sizes = durable(slot_sizes(rows))
    mean = F.sum("rows").over(Window.partitionBy()) / F.lit(slots)
    hot = [r["virtual_slot"] for r in sizes.withColumn("mean", mean).where(F.col("rows") > F.greatest(F.lit(1000), HOT * F.col("mean"))).collect()]
    if not hot:
        return rows, sizes
    dealt = F.pmod(F.xxhash64(F.lit("hot"), F.monotonically_increasing_id()), F.lit(slots)).cast("int")
    rows = durable(rows.withColumn("virtual_slot", F.when(F.col("virtual_slot").isin(hot), dealt).otherwise(F.col("virtual_slot"))))
    return rows, durable(slot_sizes(rows))


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, maps: SlotMaps | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, version of every row.

    maps: where the versions of the slot map lie; None: in a new folder beside the checkpoints.
    """
    maps = maps or SlotMaps(docs.sparkSession, f"{checkpoint_folder(docs.sparkSession)}/slot-maps-{uuid.uuid4().hex}")
    rows, sizes = spread(durable(records(docs, slots)), slots)
    slot_map = maps.current(sizes, shards)
    out = place(rows, sizes, slot_map)
    version = F.lit(maps.newest())
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", version.alias("version"))


def contract(docs: DataFrame) -> DataFrame:
    return shard(docs)
