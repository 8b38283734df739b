"""Small control files through Hadoop's file systems, so that any store Spark reads will do."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Folder:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._p("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._p(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._p(name))) if self.exists(name) else []

    def claim(self, name: str) -> bool:
        """Creates an empty file; False if another writer has."""
        self.fs.mkdirs(self._p(name).getParent())
        return self.fs.createNewFile(self._p(name))

    def put(self, name: str, data: bytes) -> None:
        """Writes beside the name, then renames over it."""
        beside = f"{name}.new"
        out = self.fs.create(self._p(beside), True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        if self.exists(name):
            self.fs.delete(self._p(name), False)
        if not self.fs.rename(self._p(beside), self._p(name)):
            raise OSError(f"can't write {self.at(name)}")

    def read(self, name: str) -> bytes:
        if not self.exists(name) and self.exists(f"{name}.new"):
            name = f"{name}.new"  # the writer stopped between delete and rename
        stream = self.fs.open(self._p(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def put_json(self, name: str, value) -> None:
        self.put(name, json.dumps(value).encode())

    def read_json(self, name: str):
        return json.loads(self.read(name))

    def delete(self, name: str) -> bool:
        return self.fs.delete(self._p(name), True)
