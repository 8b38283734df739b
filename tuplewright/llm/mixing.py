"""Mixing sources to target weights by Pareto order sampling.

Every document is due the same number of copies as its source, target / source_size (0 to 2). The whole part is
allocated with certainty; the rest is the document's inclusion probability p, which differs between sources.
Documents rank by odds(u) / odds(p), u a hash of the id (Rosen 1997), and the smallest ranks fill the source's
remaining words. Sizes are in words, so a last place goes to the unchosen document whose size best fits the gap.

Plan: one scan computes id, source, size and u; everything else is aggregation with map-side combination. The
rank that closes a source is found through a histogram of ranks (sources x BINS rows), and only documents of the
one crossing bin are sorted, so that a source with a third of all rows is never in one task. The chosen copies are
a function of a document's own columns and one row per source.

Cases: null text has size 0; null source is a source of its own (last in order); rows that repeat a doc_id rank
alike and go together; a source of size 0 gets target 0 and no copies beyond the whole part; an empty table gives
an empty result.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, durable

BINS = 4096
#: Per-source parameters up to this many rows are broadcast; more are joined by shuffle.
MOST_BROADCAST = 50_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """48 bits of MD5 as a fraction in (0, 1)."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) with target: shares of share x all words by weight, none above most x its own words.

    The level at which filling by weight stops is the largest over sources, in order of saturation, of
    (words left) / (weights left); the windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    w = sizes.select("source", "source_size", weight.alias("w"))
    w = w.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    filled = w.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return filled.select("source", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def _rank(u: Column, p: Column) -> Column:
    """odds(u) / odds(p), mapped to [0, 1) by r / (1 + r); 1 where p is 0."""
    r = (u / (1 - u)) / (p / (1 - p))
    return F.when(p > 0, r / (1 + r)).otherwise(F.lit(1.0))


def plan(rows: DataFrame, **law) -> DataFrame:
    """One row per source: source, source_size, target, whole, p, last_rank, edge_bin, open, filler.

    rows: (doc_id, source, size, u). A document is taken whole times, once more if u <= last_u, and once more if
    it is the filler.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    law_of = targets(sizes, **law).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    law_of = law_of.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    law_of = law_of.withColumn("p", F.when(F.col("source_size") > 0, F.col("rest") / F.col("source_size")).otherwise(F.lit(0.0)))
    law_of = durable(law_of)
    each = with_sources(rows, law_of.select("source", "rest", "p"))
    each = each.withColumn("rank", _rank(F.col("u"), F.col("p"))).where("p > 0")
    each = each.withColumn("bin", F.floor(F.col("rank") * BINS))
    bins = each.groupBy("source", "bin").agg(F.sum("size").alias("size"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("source").orderBy("bin")
    bins = bins.withColumn("through", F.sum("size").over(upto)).withColumn("before", F.col("through") - F.col("size"))
    crossing = bins.where(F.col("through") > F.col("rest")).groupBy("source").agg(F.min(F.struct("bin", "before")).alias("x")).select("source", "x.bin", "x.before")
    inside = each.join(crossing.toDF("s", "b", "before"), each["source"].eqNullSafe(F.col("s")) & (each["bin"] == F.col("b")))
    inside = inside.select(each["source"], "u", "rank", "size", "rest", "before")
    # range frame: rows of equal rank enter together
    through = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("rank").rangeBetween(Window.unboundedPreceding, 0))
    closed = inside.withColumn("through", through).where(F.col("through") <= F.col("rest")).groupBy("source").agg(F.max("rank").alias("last_in"), F.max("through").alias("sum_in"))
    edge = crossing.select("source", "bin", "before").join(closed.toDF("s", "last_in", "sum_in"), F.col("source").eqNullSafe(F.col("s")), "left")
    # no document of the crossing bin fits: the bin's start closes the source
    edge = edge.select("source", F.col("last_in").alias("last_rank"), F.coalesce("sum_in", F.col("before")).alias("sum_in"), "bin", F.col("last_in").isNull().alias("open"))
    edge = durable(edge)
    rest = with_sources(each, edge.withColumnRenamed("bin", "edge_bin"))
    chosen = F.when(F.col("open"), F.col("bin") < F.col("edge_bin")).otherwise(F.col("rank") <= F.col("last_rank"))
    gap = F.col("rest") - F.col("sum_in")
    filler = rest.where(~chosen & (F.abs(F.col("size") - gap) < gap)).groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - gap).alias("off"), "rank", "doc_id")).alias("f"))
    done = law_of.join(edge.withColumnRenamed("source", "e"), F.col("source").eqNullSafe(F.col("e")), "left").drop("e")
    done = done.join(filler.select(F.col("source").alias("g"), F.col("f.doc_id").alias("filler")), F.col("source").eqNullSafe(F.col("g")), "left").drop("g")
    return durable(done.select("source", "source_size", "target", "whole", "p", "last_rank", F.col("bin").alias("edge_bin"), "open", "filler"))


def with_sources(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """rows with the columns of their source's row; broadcast behind a check of the number of sources."""
    named = per_source.withColumnRenamed("source", "_source")
    if per_source.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        named = F.broadcast(named)
    return rows.join(named, rows["source"].eqNullSafe(F.col("_source"))).drop("_source")


def copies() -> Column:
    """How often the mix takes a document; over the columns of plan, size, u and doc_id."""
    rank = _rank(F.col("u"), F.col("p"))
    picked = F.when(F.col("p") <= 0, F.lit(False)).when(F.col("open"), F.floor(rank * BINS) < F.col("edge_bin")).otherwise(rank <= F.col("last_rank"))
    filler = F.coalesce(F.col("doc_id") == F.col("filler"), F.lit(False))
    return F.col("whole") + (picked | filler).cast("long")


def sized(docs: DataFrame, seed: str) -> DataFrame:
    return docs.select("doc_id", "source", words(F.col("text")).alias("size"), uniform(F.col("doc_id"), seed).alias("u"))


def mix(docs: DataFrame, seed: str = "mix", **law) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every document."""
    rows = durable(sized(docs, seed))
    return with_sources(rows, plan(rows, **law)).select("doc_id", "source", "size", "source_size", "target", copies().alias("copies"), (F.col("size") * copies()).alias("taken"))


def mixed(docs: DataFrame, seed: str = "mix", **law) -> DataFrame:
    """The mix itself: docs, all columns, each row as often as the mix takes it. The text is not shuffled."""
    rows = durable(sized(docs, seed))
    keys = ["source", "source_size", "target", "whole", "p", "last_rank", "edge_bin", "open", "filler"]
    per_source = plan(rows, **law).select(F.col("source"), F.struct(*keys[1:]).alias("_plan"))
    out = with_sources(docs.withColumn("_u", uniform(F.col("doc_id"), seed)), per_source)
    inner = out.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id"), F.col("_u").alias("u"), "_plan.*")
    return inner.withColumn("_n", copies()).where("_n > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_k")).select("_row.*")


def contract(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         (CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3] AS w,
         2.0::DOUBLE * source_size AS cap FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0.0::DOUBLE)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0.0::DOUBLE)) AS lv
  FROM w WINDOW o AS (ORDER BY cap / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, max(lv) OVER () * w) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
q AS (SELECT *, target - whole * source_size AS rest FROM p),
r AS (SELECT *, CASE WHEN source_size > 0 THEN rest / source_size ELSE 0 END AS pr FROM q),
e AS (
  SELECT d.doc_id, d.source, d.size, d.u, r.source_size, r.target, r.whole, r.rest, r.pr,
         (d.u / (1 - d.u)) / (r.pr / (1 - r.pr)) AS odds
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
k AS (SELECT *, CASE WHEN pr > 0 THEN odds / (1 + odds) ELSE 1.0 END AS rank FROM e),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS through FROM k),
i AS (SELECT *, pr > 0 AND through <= rest AS picked FROM c),
g AS (SELECT *, rest - coalesce(max(CASE WHEN picked THEN through END) OVER (PARTITION BY source), 0) AS gap FROM i),
f AS (SELECT source, arg_min(doc_id, (abs(size - gap), rank, doc_id)) AS filler FROM g WHERE pr > 0 AND NOT picked AND abs(size - gap) < gap GROUP BY source)
SELECT g.doc_id, g.size, g.source_size, g.target,
       CAST(g.size * (g.whole + CASE WHEN g.picked OR coalesce(g.doc_id = f.filler, false) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM g LEFT JOIN f ON g.source IS NOT DISTINCT FROM f.source
"""
