"""Reachability by semi-naive iteration, used by bounded traversal, closures and permission checks alike.

Every round joins only what the last round found with the edge table, keeps one row per (start, node), and ends
in a reliable checkpoint, so that neither lineage nor lost executors grow the work. The number of rounds is the
longest shortest path. A node that a third of all paths pass through is one join key; the join is an ordinary
shuffle join, which adaptive execution splits when a partition is skewed.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable, forget, stored

#: Depths up to this many rounds are one lazy plan, without checkpoints.
UNROLLED = 4


def reach(edges: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(start, node, depth): nodes within max_depth steps (None: any) of each start, the start at depth 0.

    edges: (src, dst); starts: (start). Depth is the least number of steps.
    """
    e = edges.toDF("src", "dst").where("src is not null and dst is not null").distinct()
    found = starts.toDF("start").where("start is not null").distinct().select("start", F.col("start").alias("node"), F.lit(0).alias("depth"))
    if max_depth is not None and max_depth <= UNROLLED:
        return _unrolled(e, found, max_depth)
    e, found = durable(e), durable(found)
    fresh, depth = found, 0
    while (max_depth is None or depth < max_depth) and not fresh.isEmpty():
        depth += 1
        step = fresh.select(F.col("start").alias("s"), F.col("node").alias("n")).join(e, F.col("n") == F.col("src")).select(F.col("s").alias("start"), F.col("dst").alias("node")).distinct()
        old = found.select(F.col("start").alias("os"), F.col("node").alias("on"))
        fresh = durable(step.join(old, (F.col("start") == F.col("os")) & (F.col("node") == F.col("on")), "left_anti").withColumn("depth", F.lit(depth)))
        found = found.unionByName(fresh)
        if depth % 8 == 0:
            found = durable(found)
    return found


def _unrolled(e: DataFrame, found: DataFrame, max_depth: int) -> DataFrame:
    level, levels = found.select("start", "node"), [found]
    for depth in range(1, max_depth + 1):
        level = level.toDF("s", "n").join(e, F.col("n") == F.col("src")).select(F.col("s").alias("start"), F.col("dst").alias("node")).distinct()
        levels.append(level.withColumn("depth", F.lit(depth)))
    out = levels[0]
    for one in levels[1:]:
        out = out.unionByName(one)
    return out.groupBy("start", "node").agg(F.min("depth").alias("depth"))


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst) of all pairs joined by a path of one or more edges.

    Paths double each round. A shortest path of over L and at most 2 L edges is one of exactly L and one of at most L, so only
    pairs exactly L apart are joined, and a pair is made about once for each node L steps along its shortest paths.
    """
    found, longest = stored(edges.toDF("src", "dst").where("src is not null and dst is not null").distinct().withColumn("length", F.lit(1))), 1
    while not (ends := found.where(F.col("length") == longest)).isEmpty():
        twice = ends.select("src", F.col("dst").alias("m")).join(found.toDF("at", "dst", "more"), F.col("m") == F.col("at"))
        both = found.unionByName(twice.select("src", "dst", (F.col("more") + longest).alias("length")))
        wider = stored(both.groupBy("src", "dst").agg(F.min("length").alias("length")))
        forget(found)
        found, longest = wider, 2 * longest
    return found.select("src", "dst")


#: Rows up to this many are broadcast.
MOST_BROADCAST = 100_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def closure_after_insert(closed: DataFrame, new: DataFrame) -> DataFrame:
    """closed, a closure, after edges new.

    A pair that is added leads to the first new edge of its path, and on from there. Sources that come to the same new
    edges add the same targets, so those are found once for each such class of sources. The pairs are made as the result is
    read, none twice, and are neither shuffled nor stored.
    """
    now = closed.toDF("src", "dst")
    edge = new.toDF("a", "b").where("a is not null and b is not null").distinct()
    edge = stored(edge.join(now.toDF("cs", "cd"), (F.col("a") == F.col("cs")) & (F.col("b") == F.col("cd")), "left_anti"))
    tails, heads = _small(edge.select("a").distinct()), _small(edge.select(F.col("b").alias("h")).distinct())
    above = stored(now.join(tails, F.col("dst") == F.col("a"), "left_semi").unionByName(edge.select(F.col("a").alias("src"), F.col("a").alias("dst"))).distinct())
    entries = above.join(edge, F.col("dst") == F.col("a")).select("src", "b").distinct()
    # from the end of a new edge to the ends of the next ones, over old edges
    onward = closure(entries.join(heads, F.col("src") == F.col("h"), "left_semi").select("src", "b"))
    own = edge.select(F.col("b").alias("src"), F.col("b").alias("dst")).distinct()
    onward = stored(onward.unionByName(own).distinct().toDF("h", "end"))
    below = now.join(heads, F.col("src") == F.col("h"), "left_semi").unionByName(own).distinct().toDF("end2", "x")
    behind = stored(onward.join(below, F.col("end") == F.col("end2")).select("h", "x").distinct())
    ways = stored(entries.groupBy("src").agg(F.sort_array(F.collect_set("b")).alias("ends")))
    classes = ways.groupBy("ends").agg(F.min("src").alias("class"))
    member = stored(ways.join(classes.toDF("e", "class"), F.col("ends") == F.col("e")).select(F.col("src").alias("s"), "class"))
    targets = stored(classes.select("class", F.explode("ends").alias("b")).join(behind, F.col("b") == F.col("h")).select(F.col("class").alias("c"), "x").distinct())
    forget(edge, above, onward, behind, ways)
    targets = _small(targets)
    added = member.join(targets, F.col("class") == F.col("c")).select(F.col("s").alias("src"), F.col("x").alias("dst"))
    old = now.join(member, F.col("src") == F.col("s"), "left").join(targets, (F.col("class") == F.col("c")) & (F.col("dst") == F.col("x")), "left_anti")
    return old.select("src", "dst").unionByName(added)


def closure_after_delete(closed: DataFrame, remaining: DataFrame, gone: DataFrame) -> DataFrame:
    """closed, a closure, after edges gone, with the edges that remain: pairs of affected sources are derived anew.

    Affected are the sources that reached an edge gone. Their paths lead over affected nodes, whose edges are closed
    anew, and from the first other node on they are as they were.
    """
    now = closed.toDF("src", "dst")
    tails = gone.toDF("a", "b").select("a").where("a is not null").distinct()
    hit = stored(now.join(_small(tails), F.col("dst") == F.col("a"), "left_semi").select("src").unionByName(tails.select(F.col("a").alias("src"))).distinct().toDF("h"))
    kept = stored(now.join(hit, F.col("src") == F.col("h"), "left_anti"))
    inner = closure(remaining.toDF("src", "dst").join(hit, F.col("src") == F.col("h"), "left_semi"))
    forget(hit)
    beyond = inner.join(kept.toDF("at", "far"), F.col("dst") == F.col("at")).select("src", F.col("far").alias("dst"))
    return kept.unionByName(inner.unionByName(beyond).distinct())
