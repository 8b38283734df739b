"""Intermediate results that outlive the executors that made them."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset and Spark runs on this machine alone, a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint: lineage ends there, and a lost executor doesn't lose it."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df as Parquet in the checkpoint folder: as durable, but columnar and compressed, and `forget` can delete it.

    The shuffles behind it are free for Spark's cleaner once it is written, which a collection of the driver's heap tells.
    """
    spark = df.sparkSession
    folder = f"{checkpoint_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(folder)
    out._stored = folder
    return out


def forget(*frames: DataFrame) -> None:
    """Deletes what `stored` wrote, for frames that nothing reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
