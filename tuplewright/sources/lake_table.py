"""A keyed table of Parquet entries: a flush writes one entry of upserts (data) and one of deletes.

Changes wait in a buffer until a trigger flushes it: a number of rows, of bytes (as rows are estimated), or seconds since
the first of them, looked at with each call. The call that reaches a trigger does the flush itself, which is the
back-pressure: a writer never has more than a call over the trigger waiting. Single changes gather in a list of at most
BATCH before they become a table.

Layout: data/entry=N, delete/entry=N and a manifest, written last, that names the entries. Reads merge entries on
read; compact writes one entry in their place.
"""

from __future__ import annotations

import time
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import hash_key, hash_text
from ..model import ClosedError, SchemaError
from ..operators import lake
from ..plans.durable import durable
from .files import Folder


#: Single changes that become a table at once.
BATCH = 65_536


class LakeTable:
    """Upserts and deletes by key; unflushed changes are the active buffer, which sum and average cover."""

    def __init__(self, spark: SparkSession, path: str, columns: dict[str, str], compression: str = "snappy", flush_rows: int = 1 << 20, flush_bytes: int = 1 << 26, flush_seconds: float | None = None):
        self.spark, self.folder, self.columns, self.compression = spark, Folder(spark, path), dict(columns), compression
        self.schema = lake.schema_of(columns)
        if self.folder.exists("manifest.json"):
            manifest = self.folder.read_json("manifest.json")
            if manifest["columns"] != [[k, v] for k, v in columns.items()]:
                raise SchemaError("the table was created with other columns")
            self.entries, self.next = manifest["entries"], manifest["next"]
        else:
            self.entries, self.next = [], 1
        self.buffer: DataFrame | None = None
        self.seq, self.open = 0, True
        self.flush_rows, self.flush_bytes, self.flush_seconds = flush_rows, flush_bytes, flush_seconds
        self.single: list[tuple] = []  # (key_hash, kind, values) not yet in the buffer
        self.waiting, self.bytes, self.since = 0, 0, None

    def _require(self) -> None:
        if not self.open:
            raise ClosedError("the table is closed")

    def _hashed(self, rows: DataFrame, key: str) -> DataFrame:
        kind = dict(rows.dtypes)[key]
        if kind in ("bigint", "int"):
            return rows.withColumn("key_hash", F.col(key).cast("long"))
        if kind != "string":
            raise TypeError(f"key column {key!r} is {kind}")
        return rows.withColumn("key_hash", hash_text(F.col(key)))

    def _add(self, rows: DataFrame, kind) -> None:
        """kind: a word for all rows, or their column of words."""
        self.seq += 1
        names = list(self.columns)
        filled = [F.col(f"`{c}`") if c in rows.columns else F.lit(None).cast(self.schema[c].dataType).alias(c) for c in names]
        order = F.col("_order") if "_order" in rows.columns else F.lit(0).cast("long")
        kind = F.lit(kind) if isinstance(kind, str) else kind
        own = durable(rows.select("key_hash", *filled, kind.alias("kind"), F.struct(F.lit(self.seq).cast("long").alias("call"), order.alias("at")).alias("seq")))
        self.buffer = own if self.buffer is None else self.buffer.unionByName(own)

    def _gather(self) -> None:
        """The single changes so far become one table, in the order they came."""
        if not self.single:
            return
        kinds = ", ".join(["key_hash long", "_kind string", "_order long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)])
        rows = [(key, kind, k, *(values or [None] * len(self.columns))) for k, (key, kind, values) in enumerate(self.single)]
        self.single = []
        self._add(self.spark.createDataFrame(rows, kinds), F.col("_kind"))

    def _came(self, rows: int, size: int) -> None:
        self.waiting, self.bytes = self.waiting + rows, self.bytes + size
        now = time.monotonic()
        self.since = now if self.since is None else self.since
        if len(self.single) >= BATCH:
            self._gather()
        if self.waiting >= self.flush_rows or self.bytes >= self.flush_bytes or (self.flush_seconds is not None and now - self.since >= self.flush_seconds):
            self.flush()

    def _size(self) -> int:
        """An estimate of a row's bytes, text apart."""
        return 24 + sum(8 for k in self.columns.values() if k != "utf8")

    def _came_table(self, before: DataFrame) -> None:
        text = [f.name for f in self.schema.fields if self.columns[f.name] == "utf8" and f.name in before.columns]
        size = sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c in text), F.lit(self._size())).cast("long")
        row = before.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
        self._came(row["n"], row["b"])

    def upsert_table(self, rows: DataFrame, key: str, order: str | None = None) -> None:
        """Rows of a DataFrame; of one key's rows the last by order wins. Types are exact and nothing is null."""
        self._require()
        kinds = dict(rows.dtypes)
        for f in self.schema.fields:
            if kinds.get(f.name) != f.dataType.simpleString():
                raise TypeError(f"column {f.name!r} is {kinds.get(f.name)}, not {f.dataType.simpleString()}")
        blank = F.col(key).isNull()
        for f in self.schema.fields:
            blank = blank | F.col(f.name).isNull()
        if not rows.where(blank).isEmpty():
            raise ValueError("a key or column is null")
        own = self._hashed(rows, key)
        self._gather()
        self._add(own.withColumn("_order", F.col(order).cast("long")) if order else own.withColumn("_order", F.monotonically_increasing_id()), "upsert")
        self._came_table(rows)

    def _checked(self, key, values: dict) -> tuple:
        if missing := self.columns.keys() ^ values.keys():
            raise KeyError(sorted(missing)[0])
        out = []
        for name, kind in self.columns.items():
            value = values[name]
            fits = isinstance(value, str | bytes) if kind == "utf8" else isinstance(value, int | float) and not isinstance(value, bool) if kind == "float64" else isinstance(value, int) and not isinstance(value, bool)
            if not fits:
                raise TypeError(f"column {name!r} is {kind}")
            if kind in ("int64", "int32") and not -(2 ** (int(kind[3:]) - 1)) <= value < 2 ** (int(kind[3:]) - 1):
                raise ValueError(f"column {name!r}: out of range")
            out.append(value.decode() if isinstance(value, bytes) else float(value) if kind == "float64" else value)
        return hash_key(key), "upsert", out

    def upsert(self, key, **values) -> None:
        self._require()
        self.upsert_from([(key, values)])

    def upsert_from(self, rows, batch: int = BATCH) -> None:
        """(key, values) pairs, in batches; a batch that holds a wrong pair is refused whole, those before it stay."""
        self._require()
        rows = iter(rows)
        while own := list(islice(rows, batch)):
            checked = [self._checked(key, values) for key, values in own]
            self.single += checked
            self._came(len(checked), sum(self._size() + sum(len(v.encode()) for v in values if isinstance(v, str)) for _, _, values in checked))

    def upsert_columns(self, keys, columns: dict) -> None:
        """Keys and a sequence of values for each column, all of one length."""
        keys = list(keys)
        values = {name: list(column) for name, column in columns.items()}
        if any(len(v) != len(keys) for v in values.values()):
            raise ValueError("columns of different lengths")
        self.upsert_from((key, {name: v[k] for name, v in values.items()}) for k, key in enumerate(keys))

    def delete(self, key) -> None:
        """Writes a tombstone, known key or not."""
        self._require()
        self.single.append((hash_key(key), "delete", None))
        self._came(1, 24)

    def delete_table(self, rows: DataFrame, key: str) -> None:
        self._require()
        self._gather()
        self._add(self._hashed(rows, key), "delete")
        self._came_table(rows.select(key))

    def _active(self) -> tuple[DataFrame, DataFrame] | None:
        self._gather()
        if self.buffer is None:
            return None
        return lake.entries(self.buffer.withColumn("entry", F.lit(self.next)))

    def flush(self) -> int | None:
        """Writes the buffer as one entry; the manifest makes it visible."""
        self._require()
        active = self._active()
        if active is None:
            return None
        entry = self.next
        for kind, rows in zip(("data", "delete"), active, strict=True):
            rows.drop("entry").write.mode("overwrite").option("compression", self.compression).parquet(self.folder.at(f"{kind}/entry={entry}"))
        self.entries.append(entry)
        self.next += 1
        self._publish()
        self.buffer, self.waiting, self.bytes, self.since = None, 0, 0, None
        return entry

    def _publish(self) -> None:
        self.folder.put_json("manifest.json", {"columns": [[k, v] for k, v in self.columns.items()], "entries": self.entries, "next": self.next})

    def _read(self, kind: str) -> DataFrame:
        paths = [self.folder.at(f"{kind}/entry={e}") for e in self.entries]
        data = [f.name for f in self.schema.fields] if kind == "data" else []
        if not paths:
            return self.spark.createDataFrame([], "key_hash long, " + ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in self.schema.fields if data), "entry int"]))
        return self.spark.read.option("basePath", self.folder.at(kind)).parquet(*paths).select("key_hash", *data, F.col("entry").cast("int"))

    def versions(self) -> tuple[DataFrame, DataFrame]:
        """Flushed entries and the active buffer."""
        data, deletes = self._read("data"), self._read("delete")
        active = self._active()
        if active is not None:
            data, deletes = data.unionByName(active[0].select(data.columns)), deletes.unionByName(active[1].select(deletes.columns))
        return data, deletes

    def rows(self) -> DataFrame:
        return lake.current(*self.versions())

    def get(self, key) -> dict | None:
        data, deletes = self.versions()
        found = lake.get(data, deletes, self.spark.createDataFrame([(hash_key(key),)], "k long")).select(*self.columns).first()
        return found.asDict() if found else None

    def sum(self, column: str) -> float:
        return self._of_active(lake.total, column) or 0.0

    def average(self, column: str) -> float | None:
        return self._of_active(lake.average, column)

    def _of_active(self, what, column: str):
        self._require()
        if column not in self.columns:
            raise KeyError(column)
        if self.columns[column] == "utf8":
            raise TypeError(f"column {column!r} is text")
        active = self._active()
        return None if active is None else what(active[0], column).first()[0]

    def compact(self) -> None:
        self.flush()
        data, deletes = self.versions()
        whole = durable(lake.current(data, deletes))
        entry, old = self.next, self.entries
        whole.drop("entry").write.mode("overwrite").option("compression", self.compression).parquet(self.folder.at(f"data/entry={entry}"))
        whole.limit(0).select("key_hash").write.mode("overwrite").parquet(self.folder.at(f"delete/entry={entry}"))
        self.entries, self.next = [entry], entry + 1
        self._publish()
        for e in old:
            self.folder.delete(f"data/entry={e}")
            self.folder.delete(f"delete/entry={e}")

    def close(self) -> None:
        if self.open:
            self.flush()
            self.open = False

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()
