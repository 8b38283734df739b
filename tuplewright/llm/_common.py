"""What the operators of this package share: tables, durable intermediate results, vectors, components."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import checkpoint_folder, durable

__all__ = ["SEGMENT", "WORD", "bounded", "checkpoint_folder", "components", "dimension", "durable", "matrix", "merge_labels", "runs", "segments", "small", "table", "unit"]

#: White space and words of the contracts on words.
WORD = r"[^\x20\x09-\x0D]+"
#: Characters of text that a worker holds as Python words at once.
SEGMENT = 1_000_000


#: Bytes of a batch of rows on its way to or from Python.
BATCH_BYTES = 4 << 20


def bounded(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches are bounded by bytes, however long the rows; a bound that is set stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, None) is None:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(text: str, limit: int = SEGMENT):
    """text in pieces of about limit characters, cut only before a white-space character, so that words stay whole."""
    start, n = 0, len(text)
    while n - start > limit:
        cut = start + limit
        while cut < n and not text[cut].isspace():
            cut += 1
        yield text[start:cut]
        start = cut
    yield text[start:]


def runs(lengths, limit: int = SEGMENT):
    """(start, stop) of neighbouring items of about limit characters together."""
    start, total = 0, 0
    for k, n in enumerate(lengths):
        if total and total + n > limit:
            yield start, k
            start, total = k, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def dimension(df: DataFrame, vector: str) -> int:
    """The commonest vector length (ties: the longest), 0 if there is none. Vectors of other lengths take no part."""
    row = (
        df.where(F.col(vector).isNotNull() & (F.size(vector) > 0))
        .groupBy(F.size(vector).alias("d"))
        .count()
        .agg(F.max_by("d", F.struct("count", "d")).alias("d"))
        .first()
    )
    return row["d"] or 0


def matrix(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of column that can be compared, their vectors as doubles): length d, finite, no null, not zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    rows = np.flatnonzero(lengths == d)
    if not len(rows):
        return rows, np.zeros((0, d))
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64())
    x = np.asarray(flat.fill_null(float("nan"))).reshape(-1, d)
    top = np.abs(x).max(1)
    fine = np.isfinite(top) & (top > 0)
    return rows[fine], x[fine]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def merge_labels(labels: np.ndarray, members: np.ndarray) -> None:
    """Give all classes that members touch their smallest label."""
    found = np.unique(labels[members])
    if len(found) > 1:
        labels[np.isin(labels, found)] = found[0]


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df (a checkpoint of a few narrow columns), marked for broadcast if it has at most so many rows; else as it is, so
    that its join is a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Edges in a partition of `components`.
EDGES = 250_000


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, component) of an undirected edge table (a, b), component the smallest node reachable.

    Large-star and small-star rounds (Kiveris et al., 2014): each is an aggregation with map-side minimum and a join on
    the edge table, never a collected neighbour list; the number of rounds is logarithmic in the longest path. Each
    step ends in a reliable checkpoint of partitions of about EDGES rows. Both sides of a join are plain shuffles, so a
    hub's rows can be split by the adaptive skew join. Rounds end when every node has one edge, to a node
    without one. Nodes without an edge to another node are absent. Null ends are dropped.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        near = e
        if large:
            near = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = durable(near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).toDF("k", "m").coalesce(parts))
        joined = near.join(least, near["a"] == least["k"])
        if large:
            out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.toDF("a", "b"))
        return durable(out.where(F.col("a") != F.col("b")).coalesce(parts))

    def settled(e: DataFrame) -> bool:
        ends = e.select(F.col("a").alias("x"), F.lit(1).alias("own"), F.lit(0).alias("other"))
        ends = ends.union(e.select("b", F.lit(0), F.lit(1))).groupBy("x").agg(F.sum("own").alias("own"), F.max("other").alias("other"))
        return ends.where("own > 1 or own = 1 and other = 1").isEmpty()

    e = durable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    n = e.count()
    parts = max(8, -(-n // EDGES))
    if n and e.rdd.getNumPartitions() > parts:
        e = durable(e.coalesce(parts))
    for _ in range(rounds):
        if not n or settled(e):
            return e.toDF("node", "component")
        e = star(star(e, True), False)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
