"""Approximate nearest neighbours by randomly rotated one-bit codes.

Unit vectors are rotated by one random orthogonal matrix and each coordinate is kept as its sign: d packed bits
and one correction scalar per row. With o the vector, b = sign(R o) / sqrt(d) its code and q a query,
<b, R q> / <b, R o> is an unbiased estimate of <o, q> whose error is below
EPSILON * sqrt((1 - c^2) / c^2) / sqrt(d - 1), c = <b, R o>, but for a small probability that EPSILON sets
(Gao and Long, 2024). Per block, vectors whose upper bound reaches the k-th best value known so far, over different
ids, are reranked by their exact cosine in double precision.

Queries are a stated set. They are taken in blocks of at most QUERY_BYTES, each block broadcast and compared with
all rows where they lie: rows are never shuffled, only k results per query and task are.

Cases: vectors that are null, zero, of another length than the commonest, or hold null or non-finite components
take no part, as query or candidate; fewer candidates than k are all returned; equal scores go to the smaller id;
rows that repeat an id count once, with their best score, and never answer their own id's query. Null ids take no part.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import bounded, dimension, durable, matrix, unit

EPSILON = 2.5
QUERY_BYTES = 16 << 20
#: Rows and queries compared at once, and pairs reranked at once: these bound a task's memory.
ROWS = 2048
ASKING = 512
PAIRS = 1 << 15


def rotation(d: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated unit vectors, and <code, vector>."""
    y = x @ turn.T
    return np.packbits(y > 0, axis=1), np.abs(y).sum(1) / np.sqrt(x.shape[1])


def best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k largest scores, ties to smaller ids; an id counts once per query."""
    order = np.lexsort((ids, -scores, query))
    q, i = query[order], ids[order]
    same = np.append(False, (q[1:] == q[:-1]) & (i[1:] == i[:-1]))[: len(q)]  # nothing of nothing
    order, q = order[~same], q[~same]
    first = np.append(True, q[1:] != q[:-1])[: len(q)]
    start = np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    return order[np.arange(len(q)) - start < k]


class Searcher:
    """Queries (ids, unit vectors) against rows that arrive in batches; keeps k per query."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, epsilon: float = EPSILON):
        d = x.shape[1]
        self.ids, self.x, self.k, self.epsilon = ids, x, k, epsilon
        self.turn = rotation(d)
        self.turned = (x @ self.turn.T).astype(np.float32)
        self.q = np.zeros(0, np.int64)
        self.i, self.s = np.zeros(0, np.int64), np.zeros(0)
        self.least = np.full(len(ids), -2.0)
        self.reranked = self.compared = 0

    def add(self, ids: np.ndarray, x: np.ndarray, step: int = ASKING) -> None:
        d = x.shape[1]
        codes, c = encode(x, self.turn)
        signs = (np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(d))
        bound = (self.epsilon * np.sqrt(np.maximum(1 - c * c, 0)) / c / np.sqrt(max(d - 1, 1)) + 1e-6).astype(np.float32)
        by_id = np.argsort(ids, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(ids[by_id]) != 0))
        for at in range(0, len(self.ids), step):
            block = slice(at, at + step)
            guess = (self.turned[block] @ signs.T) / c.astype(np.float32)
            floor = self.least[block].astype(np.float32) - np.float32(1e-6)
            if len(starts) > self.k:  # the k-th largest lower bound of an id; one place more for the query's own id
                under = bound - guess
                if len(starts) < len(ids):
                    under = np.minimum.reduceat(under[:, by_id], starts, axis=1)
                floor = np.maximum(floor, -np.partition(under, self.k, axis=1)[:, self.k])
            q, r = np.nonzero(guess + bound >= floor[:, None])
            other = self.ids[at + q] != ids[r]
            q, r = q[other] + at, r[other]
            s = np.empty(len(q))
            for k in range(0, len(q), PAIRS):
                some = slice(k, k + PAIRS)
                s[some] = np.einsum("ij,ij->i", self.x[q[some]], x[r[some]])
            self.compared += guess.size
            self.reranked += len(q)
            old = (self.q >= at) & (self.q < at + step)
            qs, rs, ss = np.append(self.q[old], q), np.append(self.i[old], ids[r]), np.append(self.s[old], s)
            keep = best(qs, rs, ss, self.k)
            self.q, self.i, self.s = (np.append(a[~old], b[keep]) for a, b in ((self.q, qs), (self.i, rs), (self.s, ss)))
            full = np.bincount(qs[keep] - at, minlength=len(self.ids[block])) >= self.k
            low = np.full(len(full), 2.0)
            np.minimum.at(low, qs[keep] - at, ss[keep])
            self.least[block] = np.where(full, low, -2.0)


def _usable(batch: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray]:
    rows, x = matrix(batch.column(1), d)
    ids = batch.column(0)
    some = np.asarray(ids.is_valid())[rows]
    return np.asarray(ids.fill_null(0)).astype(np.int64)[rows[some]], unit(x[some]) if some.any() else x[some]


def search(df: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", epsilon: float = EPSILON, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank (from 1), the id and score (cosine) of the k rows nearest to each row where queries holds."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("x"), F.coalesce(queries, F.lit(False)).alias("asks"))
    d = dimension(rows, "x")
    asks = rows.where("asks and id is not null").select("id", "x")
    n = asks.count() if d else 0
    blocks = max(1, -(-n * d * 16 // query_bytes))  # half full on average, so that none is over the bound
    found = None
    for b in range(blocks):
        own = asks.where(F.pmod(F.xxhash64(F.lit("block"), "id"), F.lit(blocks)) == b) if blocks > 1 else asks
        got = own.toArrow().combine_chunks().to_batches() if d else []
        if sum(g.nbytes for g in got) > 4 * query_bytes:
            raise ValueError("a block of queries is over its bound: ids repeat too often")
        pairs = [_usable(g, d) for g in got]
        if not sum(len(p[0]) for p in pairs):
            continue
        shared = spark.sparkContext.broadcast((np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])))

        def run(batches, shared=shared):
            ids, x = shared.value
            search = Searcher(ids, x, k, epsilon)
            for batch in batches:
                i, y = _usable(batch, d)
                for at in range(0, len(i), ROWS):
                    search.add(i[at : at + ROWS], y[at : at + ROWS])
            yield pa.record_batch([pa.array(ids[search.q]), pa.array(search.i), pa.array(search.s)], ["query_id", "id", "score"])

        part = bounded(rows.select("id", "x")).mapInArrow(run, "query_id long, id long, score double")
        if blocks > 1:  # one block's queries are held at a time
            part = durable(part)
            shared.destroy()
        found = part if found is None else found.unionAll(part)
    if found is None:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    found = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def contract(vectors: DataFrame) -> DataFrame:
    return search(vectors, F.col("vec_id") % 50 == 0)
