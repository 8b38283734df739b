"""Near-duplicate vectors by product quantisation, with an exact cosine rerank.

A coarse quantiser (lists) and residual subspace codebooks are fitted on a bounded sample. Every row then gets its
home list, its residual's code and the code's error e. A row visits a list if the plane that bisects that list's
centre and its own home's is at most `margin` away. Two partners at most r apart lie on either side of the plane of
their homes, so the nearer one is at most r / 2 from it: one of them visits the other's list for margin r / 2,
whatever the data. In a list, visitors estimate their distance to each member from lookup tables, one per subspace,
over the member's code; by the triangle inequality a partner's estimate is at most r + e, so no partner within a
visited list is missed, and pairs that pass are compared by exact cosine in double precision.

margin None, or "exact", takes r / 2. A smaller number visits fewer lists and loses the pairs that both lie further
than that from their plane.

Plan: home lists with many members, or visitors, are dealt over cells (list, member part, visitor part) of at
most MEMBERS x VISITORS rows, from counts per list. A cell returns how many links each row has in it and a
spanning forest of its links, never its pairs; a pair that two cells could see counts in the one of the smaller
list. Components come from the forests.

Cases: vectors that are null, zero, of another length than the commonest, or hold null or non-finite components
link with nothing and stay as their own component, as do null ids; rows that repeat an id are one node, whose links to
other ids add up over its rows.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded, components, dimension, durable, matrix, merge_labels, unit

SAMPLE = 16_384
LISTS = 1024
MEMBERS = 4096
VISITORS = 8192


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1) - 2 * (x @ centres.T)).argmin(1)


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        at = nearest(x, centres)
        n = np.bincount(at, minlength=k)
        total = np.stack([np.bincount(at, x[:, j], k) for j in range(x.shape[1])], 1)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


class Quantiser:
    """Coarse centres, and codebooks for the residual in each of up to 8 subspaces."""

    def __init__(self, sample: np.ndarray, rows: int, subspaces: int = 8, words: int = 256):
        lists = int(np.clip(rows // 256, 1, min(LISTS, max(1, len(sample) // 8))))
        self.centres = kmeans(sample, lists, 1)
        rest = sample - self.centres[nearest(sample, self.centres)]
        self.cuts = np.linspace(0, sample.shape[1], min(subspaces, sample.shape[1]) + 1).astype(int)
        self.books = [kmeans(rest[:, a:b], words, 2) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]
        gaps = self.centres[:, None] - self.centres[None] if lists <= 256 else None
        self.apart = np.sqrt((gaps**2).sum(2)) if gaps is not None else np.stack([np.sqrt(((self.centres - c) ** 2).sum(1)) for c in self.centres])

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        home = nearest(x, self.centres)
        rest = x - self.centres[home]
        codes = np.stack([nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)], 1).astype(np.uint8)
        error = np.sqrt(sum(((rest[:, a:b] - book[codes[:, j]]) ** 2).sum(1) for j, (a, b, book) in enumerate(zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True))))
        return home, codes, error

    def visits(self, x: np.ndarray, home: np.ndarray, margin: float) -> np.ndarray:
        """(rows, lists): home, and the lists whose bisecting plane is within margin."""
        far = (self.centres * self.centres).sum(1) - 2 * (x @ self.centres.T)
        plane = (far - far[np.arange(len(x)), home][:, None]) / np.maximum(2 * self.apart[home], 1e-12)
        out = plane <= margin
        out[np.arange(len(x)), home] = True
        return out

    def estimate(self, rest: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Distances of residuals to coded members: table lookups, summed over subspaces."""
        total = np.zeros((len(rest), len(codes)), np.float32)
        for j, (a, b, book) in enumerate(zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)):
            part = rest[:, a:b]
            lookup = ((part * part).sum(1)[:, None] - 2 * (part @ book.T) + (book * book).sum(1)).astype(np.float32)
            total += lookup[:, codes[:, j]]
        return np.sqrt(np.maximum(total, 0))


def _sample(rows: DataFrame, d: int, total: int, most: int = SAMPLE) -> np.ndarray:
    """At most most vectors, chosen by a hash of the id."""
    share = min(1_000_000, int(1_000_000 * most / max(total, 1)) + 1)
    got = rows.where(F.pmod(F.xxhash64(F.lit("fit"), "id"), F.lit(1_000_000)) < share).select("x").limit(2 * most).toArrow()
    _, x = matrix(got.column(0), d)
    return unit(x)[:most] if len(x) else x


def link(df: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector: str = "embedding", margin=None) -> DataFrame:
    """id, n_links, component_id, kept for every row's id."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("x"))
    d = dimension(rows, "x")
    everyone = rows.groupBy("id").agg(F.lit(1).alias("_")).select("id")
    found = _links(rows.where("id is not null"), d, least, margin) if d else None
    if found is None:
        out = everyone.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    else:
        counts, comps = found
        out = everyone.join(counts.withColumnRenamed("id", "c"), F.col("id") == F.col("c"), "left")
        out = out.join(comps, F.col("id") == F.col("node"), "left")
        out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _links(rows: DataFrame, d: int, least: float, margin) -> tuple[DataFrame, DataFrame] | None:
    spark = rows.sparkSession
    r = float(np.sqrt(max(2 - 2 * least, 0))) + 1e-6
    margin = r / 2 if margin in (None, "exact") else float(margin)
    total = rows.count()
    sample = _sample(rows, d, total)
    if not len(sample):
        return None
    shared = spark.sparkContext.broadcast(Quantiser(sample, total))  # LISTS centres and 8 x 256 codewords at most

    def place(batches):
        quantiser = shared.value
        for batch in batches:
            at, x = matrix(batch.column(1), d)
            for k in range(0, len(at), 4096):
                own, y = at[k : k + 4096], x[k : k + 4096]
                z = unit(y)
                home, codes, error = quantiser.code(z)
                seen = quantiser.visits(z, home, margin)
                ends = np.cumsum(seen.sum(1))
                yield pa.record_batch(
                    [batch.column(0).take(pa.array(own)), pa.array([v.tobytes() for v in y], pa.binary()), pa.array(home.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), np.nonzero(seen)[1].astype(np.int32))],
                    ["id", "x", "home", "code", "error", "visits"],
                )

    placed = durable(bounded(rows).mapInArrow(place, "id long, x binary, home int, code binary, error double, visits array<int>"))
    members = {r["home"]: r["n"] for r in placed.groupBy("home").agg(F.count("*").alias("n")).collect()}  # at most LISTS rows
    visitors = {r["l"]: r["n"] for r in placed.select(F.explode("visits").alias("l")).groupBy("l").agg(F.count("*").alias("n")).collect()}
    lists = len(shared.value.centres)
    deal = lambda n, most: F.array(*[F.lit(max(1, -(-n.get(k, 0) // most))) for k in range(lists)])
    m_parts, v_parts = deal(members, MEMBERS), deal(visitors, VISITORS)
    h = F.pmod(F.xxhash64(F.lit("part"), "id", "x"), F.lit(1 << 20))
    own = placed.withColumn("list", F.col("home")).withColumn("mp", (h % F.element_at(m_parts, F.col("list") + 1)).cast("int"))
    own = own.withColumn("vp", F.explode(F.sequence(F.lit(0), F.element_at(v_parts, F.col("list") + 1) - 1)))
    come = placed.withColumn("list", F.explode("visits")).withColumn("vp", (h % F.element_at(v_parts, F.col("list") + 1)).cast("int"))
    come = come.withColumn("mp", F.explode(F.sequence(F.lit(0), F.element_at(m_parts, F.col("list") + 1) - 1)))
    cells = own.select("list", "mp", "vp", "id", "x", "code", "error", "visits")
    guests = come.select("list", "mp", "vp", "id", "x", "home")

    def compare(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        return cell(shared.value, mine, theirs, d, least, r)

    out = cells.groupBy("list", "mp", "vp").cogroup(guests.groupBy("list", "mp", "vp")).applyInPandas(compare, "id long, n long, b long")
    out = durable(out)
    counts = out.groupBy("id").agg(F.sum("n").alias("n_links")).where("n_links > 0")
    edges = out.where("b is not null").select(F.col("id").alias("a"), "b")
    return counts, components(edges)


def cell(quantiser: Quantiser, mine: pd.DataFrame, theirs: pd.DataFrame, d: int, least: float, r: float) -> pd.DataFrame:
    """Links between members (mine) and visitors (theirs) of one cell: id, its links here, its forest edge's other end."""
    nothing = pd.DataFrame({"id": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "b": pd.array([], "Int64")})
    if not len(mine) or not len(theirs):
        return nothing
    at = int(mine["list"].iloc[0])
    lists = len(quantiser.centres)
    y, x = (unit(np.frombuffer(b"".join(f["x"]), np.float64).reshape(-1, d)) for f in (mine, theirs))
    codes = np.frombuffer(b"".join(mine["code"]), np.uint8).reshape(len(mine), -1)
    reach = (r + mine["error"].to_numpy()).astype(np.float32) + np.float32(1e-4)
    y_id, x_id, home = mine["id"].to_numpy(), theirs["id"].to_numpy(), theirs["home"].to_numpy()
    back = np.zeros((len(mine), lists), bool)
    sizes = mine["visits"].map(len).to_numpy()
    back[np.repeat(np.arange(len(mine)), sizes), np.concatenate(list(mine["visits"]))] = True
    n_y, n_x = np.zeros(len(mine), np.int64), np.zeros(len(theirs), np.int64)
    # nodes of the forest: the ids of the cell
    nodes, where = np.unique(np.append(y_id, x_id), return_inverse=True)
    y_node, x_node = where[: len(mine)], where[len(mine) :]
    label = np.arange(len(nodes))
    for k in range(0, len(theirs), 512):
        part = slice(k, min(k + 512, len(theirs)))
        guess = quantiser.estimate(x[part] - quantiser.centres[at], codes)
        p, q = np.nonzero(guess <= reach)
        p += k
        if not len(p):
            continue
        # each pair once: inside the list by id order, across lists in the smaller of the lists that see it
        once = np.where(home[p] == at, x_id[p] < y_id[q], (x_id[p] != y_id[q]) & ((at < home[p]) | ~back[q, home[p]]))
        p, q = p[once], q[once]
        near = np.zeros(len(p), bool)
        for j in range(0, len(p), 200_000):
            s = slice(j, j + 200_000)
            near[s] = np.einsum("ij,ij->i", x[p[s]], y[q[s]]) >= least
        p, q = p[near], q[near]
        np.add.at(n_x, p, 1)
        np.add.at(n_y, q, 1)
        cuts = np.flatnonzero(np.diff(p)) + 1
        for g in np.split(np.arange(len(p)), cuts) if len(p) else ():
            merge_labels(label, np.append(y_node[q[g]], x_node[p[g[0]]]))
    total = np.bincount(y_node, n_y, len(nodes)) + np.bincount(x_node, n_x, len(nodes))
    some = np.flatnonzero(total > 0)
    if not len(some):
        return nothing
    b = pd.array(nodes[label[some]], "Int64")
    b[nodes[label[some]] == nodes[some]] = pd.NA
    return pd.DataFrame({"id": nodes[some], "n": total[some].astype(np.int64), "b": b})


def contract(vectors: DataFrame) -> DataFrame:
    return link(vectors)
