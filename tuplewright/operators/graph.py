"""Bulk reads and writes of directed graphs given as edge tables (src, dst).

Edges are a set; self-loops are allowed. Keys are longs or strings, one kind per graph. Every operator takes tables
of questions, so a million lookups are one join.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..plans.durable import forget, stored
from ..plans.fixpoint import UNROLLED, reach
from ..plans.packed import reach_counts, reach_packed

#: Nodes up to this many are broadcast to filter edges; more are joined by shuffle.
MOST_BROADCAST = 100_000


def edges(rows: DataFrame) -> DataFrame:
    """The edge set of two columns: no null ends, no repeats."""
    return rows.toDF("src", "dst").where("src is not null and dst is not null").distinct()


def added(current: DataFrame, new: DataFrame) -> DataFrame:
    """The edges of new that current lacks: what adding them changes."""
    return edges(new).join(current.toDF("s", "d"), (F.col("src") == F.col("s")) & (F.col("dst") == F.col("d")), "left_anti")


def removed(current: DataFrame, old: DataFrame) -> DataFrame:
    """The edges of old that current holds: what removing them changes."""
    return edges(old).join(current.toDF("s", "d"), (F.col("src") == F.col("s")) & (F.col("dst") == F.col("d")), "left_semi")


def after_add(current: DataFrame, new: DataFrame) -> DataFrame:
    return current.toDF("src", "dst").unionByName(added(current, new))


def after_remove(current: DataFrame, old: DataFrame) -> DataFrame:
    return current.toDF("src", "dst").join(edges(old).toDF("s", "d"), (F.col("src") == F.col("s")) & (F.col("dst") == F.col("d")), "left_anti")


def has_edges(current: DataFrame, pairs: DataFrame) -> DataFrame:
    """(u, v, found) of each pair asked."""
    e = current.toDF("s", "d").distinct().withColumn("hit", F.lit(True))
    return pairs.toDF("u", "v").join(e, (F.col("u") == F.col("s")) & (F.col("v") == F.col("d")), "left").select("u", "v", F.coalesce("hit", F.lit(False)).alias("found"))


def _degrees(current: DataFrame, nodes: DataFrame, end: str) -> DataFrame:
    counts = edges(current).groupBy(F.col(end).alias("n")).agg(F.count("*").alias("degree"))
    return nodes.toDF("node").join(counts, F.col("node") == F.col("n"), "left").select("node", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def degrees(current: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, degree) of each node asked: distinct targets, 0 where unknown."""
    return _degrees(current, nodes, "src")


def in_degrees(current: DataFrame, nodes: DataFrame) -> DataFrame:
    return _degrees(current, nodes, "dst")


def out_neighbors(current: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, neighbor) along outgoing edges."""
    return nodes.toDF("node").distinct().join(edges(current), F.col("node") == F.col("src")).select("node", F.col("dst").alias("neighbor"))


def in_neighbors(current: DataFrame, nodes: DataFrame) -> DataFrame:
    return nodes.toDF("node").distinct().join(edges(current), F.col("node") == F.col("dst")).select("node", F.col("src").alias("neighbor"))


def common_neighbors(current: DataFrame, pairs: DataFrame) -> DataFrame:
    """(u, v, neighbor): targets of both, for each pair asked. Pairs join their out-edges, then probe the second end."""
    e = edges(current)
    first = pairs.toDF("u", "v").distinct().join(e, F.col("u") == F.col("src")).select("u", "v", F.col("dst").alias("neighbor"))
    return first.join(e.toDF("s", "d"), (F.col("v") == F.col("s")) & (F.col("neighbor") == F.col("d")), "left_semi")


def khop(current: DataFrame, starts: DataFrame, max_depth: int) -> DataFrame:
    """(start, node, depth): nodes within max_depth steps, each once with its least depth, the start left out."""
    if max_depth < 0:
        raise ValueError("depth is not negative")
    if _packable(current, starts, max_depth):
        return reach_packed(current, starts, max_depth).where("node <> start")
    return reach(current, starts, max_depth).where("node <> start")


def _packable(current: DataFrame, nodes: DataFrame, depth: int) -> bool:
    """Whether reach_packed takes them: nodes are longs, and a first step is followed by a second."""
    whole = all(isinstance(f.dataType, LongType) for f in (*current.schema, *nodes.schema))
    return whole and 2 <= depth <= UNROLLED


def khop_counts(current: DataFrame, starts: DataFrame, max_depth: int) -> DataFrame:
    """(start, nodes): how many nodes khop finds, 0 included."""
    if _packable(current, starts, max_depth):
        return reach_counts(current, starts, max_depth).select("start", (F.col("found") - 1).alias("nodes"))
    found = reach(current, starts, max_depth)
    return found.groupBy("start").agg((F.count("*") - 1).alias("nodes"))


def reachable(current: DataFrame, questions: DataFrame, max_depth: int) -> DataFrame:
    """(u, v, found): whether v is within max_depth steps of u."""
    asked = questions.toDF("u", "v").distinct()
    if 2 <= max_depth <= UNROLLED:
        hits = _met(edges(current), asked, max_depth)
    else:
        found = reach(current, asked.select("u"), max_depth)
        hits = asked.join(found, (F.col("u") == F.col("start")) & (F.col("v") == F.col("node"))).select("u", "v")
    hits = hits.select(F.col("u").alias("s"), F.col("v").alias("n"), F.lit(True).alias("hit"))
    return asked.join(hits, (F.col("u") == F.col("s")) & (F.col("v") == F.col("n")), "left").select("u", "v", F.coalesce("hit", F.lit(False)).alias("found"))


def _met(e: DataFrame, asked: DataFrame, max_depth: int) -> DataFrame:
    """(u, v) of the questions whose v is within max_depth steps of u.

    Steps forward from all u and backward from all v, each time on the side whose next step has fewer rows to make; the
    questions whose two sides meet in a node are answered.
    """
    e = stored(e)
    sides = []
    for end, edge in (("u", e.toDF("at", "to")), ("v", e.select(F.col("dst").alias("at"), F.col("src").alias("to")))):
        degrees = stored(edge.groupBy(F.col("at").alias("d")).agg(F.count("*").alias("n")))
        ends = asked.where(F.col(end).isNotNull()).select(F.col(end).alias("start"), F.col(end).alias("node")).distinct()
        sides.append({"edge": edge, "degrees": degrees, "levels": [ends], "next": None})
    for step in range(max_depth):
        for side in sides:
            if side["next"] is None:
                side["next"] = side["levels"][-1].join(side["degrees"], F.col("node") == F.col("d")).agg(F.sum("n")).first()[0] or 0
        side = min(sides, key=lambda x: x["next"])
        wider = side["levels"][-1].join(side["edge"], F.col("node") == F.col("at")).select("start", F.col("to").alias("node")).distinct()
        side["levels"].append(stored(wider))
        side["next"] = None if step + 1 < max_depth else 0
    forget(e, *(x["degrees"] for x in sides))
    ahead, behind = (reduce(DataFrame.unionByName, x["levels"]) for x in sides)
    ways = asked.join(ahead, F.col("u") == F.col("start")).select("u", "v", F.col("node").alias("via"))
    return ways.join(behind, (F.col("v") == F.col("start")) & (F.col("via") == F.col("node")), "left_semi").select("u", "v").distinct()


def dictionary(names: Column, rows: DataFrame, first: int = 0) -> DataFrame:
    """(name, id): dense ids from first by name.

    Ids are a partition's offset plus the place in it, over range partitions, so no task sorts all names.
    """
    from ..plans.durable import durable

    distinct = rows.select(names.alias("name")).where("name is not null").distinct()
    ordered = durable(distinct.repartitionByRange("name").sortWithinPartitions("name").select("name", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    sizes = {r["part"]: r["n"] for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row per partition
    offset, starts = first, []
    for part in sorted(sizes):
        starts += [F.lit(part), F.lit(offset)]
        offset += sizes[part]
    if not starts:
        return distinct.select("name", F.lit(0).cast("long").alias("id"))
    place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.select("name", (F.create_map(*starts)[F.col("part")] + place).cast("long").alias("id"))


def intern(rows: DataFrame, names: DataFrame, columns: dict[str, str]) -> DataFrame:
    """rows with a column of ids for each column of names (from: to); unknown names give null and add nothing."""
    for column, to in columns.items():
        rows = rows.join(names.toDF("_name", to), F.col(column) == F.col("_name"), "left").drop("_name")
    return rows


def hubs(current: DataFrame, n: int = 50) -> DataFrame:
    """(node, degree) of the n largest out-degrees, ties to smaller nodes: a top-n report, never a full sort."""
    return edges(current).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node").limit(n)


def with_degree(current: DataFrame, low: int, high: int) -> DataFrame:
    return edges(current).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree")).where(F.col("degree").between(low, high))


def induced(current: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges between the nodes; the node table is broadcast behind a check of its size."""
    own = nodes.toDF("n").distinct()
    if own.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        own = F.broadcast(own)
    e = edges(current).join(own, F.col("src") == F.col("n"), "left_semi")
    return e.join(own.toDF("m"), F.col("dst") == F.col("m"), "left_semi")
