"""Bounded reach without a shuffle of what it finds: a start's neighbours bring lists of what lies behind them.

What lies within k steps of a start is the start, its neighbours and what lies within k - 1 steps of those. So the lists of
the neighbours are made first, once each, however many starts share them, and go to the starts packed: sorted, as
differences of as many bytes as a list needs. Each task puts the lists of its starts together, and found pairs are rows only there.
Nodes are longs. A task holds a batch of neighbours and what it has found of one start.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import forget, stored


def pack(starts: np.ndarray, nodes: np.ndarray, count: int) -> pa.Array:
    """The nodes of each start 0 to count - 1 as bytes; rows are sorted by start and node. A width, the first node, differences."""
    sizes = np.bincount(starts, minlength=count)
    ends = np.cumsum(sizes)
    first = ends - sizes
    gaps = np.diff(nodes.view(np.uint64), prepend=np.uint64(0))  # in two's complement, right for any two longs
    some = sizes > 0
    gaps[first[some]] = 0
    most = np.zeros(count, np.uint64)
    most[some] = np.maximum.reduceat(gaps, first[some]) if some.any() else 0
    width = np.ones(count, np.int64)
    for w in range(1, 8):
        width[most >> np.uint64(8 * w) > 0] = w + 1
    lengths = np.where(some, 9 + (sizes - 1) * width, 0)
    at = np.concatenate([[0], np.cumsum(lengths)])
    out = np.zeros(int(at[-1]), np.uint8)
    out[at[:-1][some]] = width[some]
    out[(at[:-1][some, None] + 1 + np.arange(8)).ravel()] = nodes[first[some]].astype("<i8").view(np.uint8)
    place = np.arange(len(nodes)) - first[starts]
    low = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)
    for w in np.unique(width[some]):
        rows = np.flatnonzero((width[starts] == w) & (place > 0))
        to = at[starts[rows]] + 9 + (place[rows] - 1) * w
        out[(to[:, None] + np.arange(w)).ravel()] = low[rows, :w].ravel()
    return pa.Array.from_buffers(pa.large_binary(), count, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(out)])


def unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, node) of a column that `pack` made; a null holds none."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    rows = np.flatnonzero(np.diff(at) > 0)
    at, lengths = at[rows], np.diff(at)[rows]
    width = data[at].astype(np.int64)
    sizes = (lengths - 9) // np.maximum(width, 1) + 1
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(rows)), sizes)
    place = np.arange(len(owner)) - first[owner]
    gaps = np.zeros((len(owner), 8), np.uint8)
    if len(rows):
        gaps[first] = data[at[:, None] + 1 + np.arange(8)]
    for w in np.unique(width):
        own = np.flatnonzero((width[owner] == w) & (place > 0))
        gaps[own, :w] = data[(at[owner[own]] + 9 + (place[own] - 1) * w)[:, None] + np.arange(w)]
    steps = gaps.view("<u8").ravel()
    total = np.cumsum(steps, dtype=np.uint64)  # wraps; differences of it are right
    base = total[first] - steps[first] if len(rows) else total
    return rows[owner], (total - base[owner]).view(np.int64)


def least(starts: np.ndarray, nodes: np.ndarray, depths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row per (start, node) with its least depth, sorted by start and node. Starts and depths are small numbers."""
    if not len(nodes):
        return starts, nodes, depths
    low, high = int(nodes.min()), int(nodes.max())
    bits, deep = (high - low).bit_length(), int(depths.max()).bit_length()
    if bits + deep + int(starts.max()).bit_length() < 63:
        key = np.sort((starts << (bits + deep)) | ((nodes - low) << deep) | depths)
        pair = key >> deep
        key = key[np.concatenate([[True], pair[1:] != pair[:-1]])]
        return key >> (bits + deep), ((key >> deep) & ((1 << bits) - 1)) + low, key & ((1 << deep) - 1)
    order = np.lexsort((depths, nodes, starts))
    starts, nodes, depths = starts[order], nodes[order], depths[order]
    new = np.concatenate([[True], (starts[1:] != starts[:-1]) | (nodes[1:] != nodes[:-1])])
    return starts[new], nodes[new], depths[new]


#: Bytes of lists that are unpacked at once; a node takes one or more.
BYTES = 2_000_000


def _parts(batch: pa.RecordBatch, lists: list[str]) -> Iterator[pa.RecordBatch]:
    """The batch in stretches of about BYTES of lists."""
    size = np.zeros(batch.num_rows, np.int64)
    for name in lists:
        size += pc.binary_length(batch[name]).fill_null(0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def _merged(batches: Iterator[pa.RecordBatch], lists: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(starts, row of a start, node, depth) of whole starts, from rows (src, dst, lists behind dst) sorted by src."""
    held = None  # the last start, its nodes and depths so far: its rows may go on in the next batch
    for batch in (part for whole in batches for part in _parts(whole, lists)):
        src = batch["src"].to_numpy(zero_copy_only=False)
        ids, row = np.unique(src, return_inverse=True)
        dst = batch["dst"]
        real = np.flatnonzero(dst.is_valid().to_numpy(zero_copy_only=False))
        parts = [(np.arange(len(ids)), ids, np.zeros(len(ids), np.int64)), (row[real], dst.drop_null().to_numpy(zero_copy_only=False), np.ones(len(real), np.int64))]
        for depth, name in enumerate(lists, 2):
            at, nodes = unpack(batch[name])
            parts.append((row[at], nodes, np.full(len(nodes), depth)))
        if held and held[0] == ids[0]:
            parts.append((np.zeros(len(held[1]), np.int64), held[1], held[2]))
        elif held:
            yield np.array([held[0]]), np.zeros(len(held[1]), np.int64), held[1], held[2]
        at, nodes, depths = least(*(np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True)))
        last = np.searchsorted(at, len(ids) - 1)
        held = (ids[-1], nodes[last:], depths[last:])
        if last:
            yield ids[:-1], at[:last], nodes[:last], depths[:last]
    if held:
        yield np.array([held[0]]), np.zeros(len(held[1]), np.int64), held[1], held[2]


#: Rows of one batch of results.
ROWS = 200_000


def _rows(lists):
    def run(batches):
        for ids, at, nodes, depths in _merged(batches, lists):
            for k in range(0, len(at), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at[k : k + ROWS]]), pa.array(nodes[k : k + ROWS]), pa.array(depths[k : k + ROWS].astype(np.int32))], ["start", "node", "depth"])

    return run


def _counts(lists):
    def run(batches):
        for ids, at, _, _ in _merged(batches, lists):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.bincount(at, minlength=len(ids)))], ["start", "found"])

    return run


def _packs(lists, out):
    def run(batches):
        for ids, at, nodes, depths in _merged(batches, lists):
            columns = [pack(at[depths == d], nodes[depths == d], len(ids)).cast(pa.binary()) for d in range(1, len(out) + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), *columns], ["src", *out])

    return run


def _steps(e: DataFrame, nodes: DataFrame, depth: int) -> tuple[DataFrame, list[str], list[DataFrame]]:
    """((src, dst, lists of what lies up to depth - 1 steps behind dst) sorted by src, the lists' names, what it reads)."""
    first = nodes.toDF("src").join(e.toDF("s", "dst"), F.col("src") == F.col("s"), "left").select("src", "dst")
    if depth == 1:
        return first.repartition("src").sortWithinPartitions("src"), [], []
    first = stored(first)
    behind, lists, used = _steps(e, first.select("dst").where("dst is not null").distinct(), depth - 1)
    out = [f"l{d}" for d in range(1, depth)]
    packs = stored(behind.mapInArrow(_packs(lists, out), "src long, " + ", ".join(f"{x} binary" for x in out)))
    forget(*used)
    rows = first.join(packs.withColumnRenamed("src", "p"), F.col("dst") == F.col("p"), "left").select("src", "dst", *out)
    return rows.repartition("src").sortWithinPartitions("src"), out, [first, packs]


def _prepared(edges: DataFrame, starts: DataFrame, depth: int) -> tuple[DataFrame, list[str], list[DataFrame]]:
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if edges.sparkSession.conf.get(key, None) is None:
        edges.sparkSession.conf.set(key, str(16 * BYTES))
    e = stored(edges.toDF("src", "dst").where("src is not null and dst is not null").selectExpr("cast(src as long) src", "cast(dst as long) dst").distinct())
    nodes = starts.toDF("start").where("start is not null").selectExpr("cast(start as long) start").distinct()
    rows, lists, used = _steps(e, nodes, depth)
    if depth > 1:
        forget(e)
    return rows, lists, used


def reach_packed(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, depth) as fixpoint.reach, for longs and a depth of 1 or more."""
    rows, lists, _ = _prepared(edges, starts, depth)
    return rows.mapInArrow(_rows(lists), "start long, node long, depth int")


#: First steps whose lists are shuffled at once when only counts are asked for.
AT_ONCE = 8_000_000


def reach_counts(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, found): how many nodes reach_packed finds, the start included. Many starts are counted in parts, one after the other."""
    rows, lists, used = _prepared(edges, starts, depth)
    counts = lambda part: part.mapInArrow(_counts(lists), "start long, found long")
    parts = 1 + used[0].count() // AT_ONCE if used else 1
    if parts == 1:
        return counts(rows)
    # not the hash that deals rows to tasks, so each part keeps all tasks busy
    done = [stored(counts(rows.where(F.pmod(F.xxhash64("src"), F.lit(parts)) == k))) for k in range(parts)]
    forget(*used)
    return reduce(DataFrame.unionByName, done)
