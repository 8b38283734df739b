"""Relationship-based permissions over tuple tables, many questions at a time.

Tuples and a schema compile to a frame graph. A frame is object#definition; its edges are
  - set tuples:     object#relation -> subject#its relation          (free of depth: nesting of sets)
  - computed terms: object#permission -> object#name                 (one step)
  - arrow terms:    object#permission -> child#name, for each plain subject of the relation whose type has it (one step)
A subject has a permission if object#permission reaches, in any number of steps, a frame with a direct tuple to the
subject. Only frames that questions can reach are walked. A step beyond LIMIT frames makes an ungranted question
undecided instead of denied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import TUPLE_COLUMNS, CheckDepthError, SchemaError
from ..plans.durable import forget, stored
from ..plans.schema_language import Schema, Subject

#: Frames on a path, the question's own included.
LIMIT = 32
#: Steps of a walk between two checkpoints.
STEPS = 4


def _object(kind: str, rest: str):
    return F.concat(F.col(kind), F.lit(":"), F.col(rest))


def violations(tuples: DataFrame, schema: Schema) -> DataFrame:
    """The tuples that the schema doesn't allow."""
    spark = tuples.sparkSession
    allowed = spark.createDataFrame(schema.allowed_rows() or [("", "", "", "")], "ot string, r string, st string, sr string")
    match = (F.col("object_type") == F.col("ot")) & (F.col("relation") == F.col("r")) & (F.col("subject_type") == F.col("st")) & (F.col("subject_relation") == F.col("sr"))
    return tuples.select(*TUPLE_COLUMNS).join(F.broadcast(allowed), match, "left_anti")  # a row per allowed subject of the schema


def validate(tuples: DataFrame, schema: Schema) -> None:
    bad = violations(tuples, schema).limit(3).collect()
    if bad:
        raise SchemaError("the schema doesn't allow " + "; ".join(str(tuple(r)) for r in bad))


def blocked_changes(tuples: DataFrame, pairs: set[tuple[str, str]]) -> DataFrame:
    """Tuples on (type, relation) pairs that a new schema retires or turns into or from links."""
    spark = tuples.sparkSession
    rows = spark.createDataFrame(sorted(pairs) or [("", "")], "ot string, r string")
    return tuples.join(F.broadcast(rows), (F.col("object_type") == F.col("ot")) & (F.col("relation") == F.col("r")), "left_semi")


def frame_edges(tuples: DataFrame, schema: Schema) -> DataFrame:
    """(src, dst, cost) of the frame graph. Rules are a few rows per type, so they are broadcast."""
    spark = tuples.sparkSession
    t = tuples.select(*TUPLE_COLUMNS)
    sets = t.where("subject_relation <> ''").select(
        F.concat(_object("object_type", "object_id"), F.lit("#"), "relation").alias("src"), F.concat(_object("subject_type", "subject_id"), F.lit("#"), "subject_relation").alias("dst"), F.lit(0).alias("cost")
    )
    rules = schema.rule_rows()
    has = [(x.name, d) for x in schema.types.values() for d in (*x.relations, *x.permissions)]
    computed, arrows = [r[:3] for r in rules if not r[3]], [r for r in rules if r[3]]
    out = sets
    if computed:
        c = F.broadcast(spark.createDataFrame(computed, "ct string, permission string, name string"))
        objects = t.select("object_type", "object_id").union(t.select("subject_type", "subject_id")).distinct()
        out = out.unionByName(objects.join(c, F.col("object_type") == F.col("ct")).select(F.concat(_object("object_type", "object_id"), F.lit("#"), "permission").alias("src"), F.concat(_object("object_type", "object_id"), F.lit("#"), "name").alias("dst"), F.lit(1).alias("cost")))
    if arrows:
        defined = set(has)
        rows = [(ty, p, name, through, s.type) for ty, p, name, through in arrows for s in schema.types[ty].relations[through] if (s.type, name) in defined]
        a = F.broadcast(spark.createDataFrame(rows, "ct string, permission string, name string, through string, child string"))
        plain = t.where("subject_relation = ''")
        joined = plain.join(a, (F.col("object_type") == F.col("ct")) & (F.col("relation") == F.col("through")) & (F.col("subject_type") == F.col("child")))
        out = out.unionByName(joined.select(F.concat(_object("object_type", "object_id"), F.lit("#"), "permission").alias("src"), F.concat(_object("subject_type", "subject_id"), F.lit("#"), "name").alias("dst"), F.lit(1).alias("cost")))
    return out.groupBy("src", "dst").agg(F.min("cost").alias("cost"))


def direct(tuples: DataFrame) -> DataFrame:
    """(frame, subject) of tuples to plain subjects."""
    return tuples.where("subject_relation = ''").select(F.concat(_object("object_type", "object_id"), F.lit("#"), "relation").alias("frame"), _object("subject_type", "subject_id").alias("subject")).distinct()


def walk(edges: DataFrame, starts: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """((start, node, frames), (start) of walks that the limit cut): least number of frames on a path to each node.

    Many starts share what their first step leads to (documents of a folder): if fewer such frames than
    starts lead on, only those are walked, and each start's walk is put together from its first step and theirs.
    """
    e = stored(edges.toDF("src", "dst", "cost"))
    s = stored(starts.toDF("start").where("start is not null").distinct())
    first = stored(s.join(e, F.col("start") == F.col("src")).select("start", F.col("dst").alias("via"), "cost"))
    shared = stored(first.select("via").distinct())
    if shared.join(e, F.col("via") == F.col("src"), "left_semi").count() * 2 > s.count():
        return _walk(e, s, limit)
    ways, short = _walk(e, shared, limit)
    long = first.join(ways.toDF("w", "node", "f"), F.col("via") == F.col("w")).select("start", "node", (F.col("f") + F.col("cost")).alias("frames"))
    here = s.select("start", F.col("start").alias("node"), F.lit(1).alias("frames"))
    best = here.unionByName(long.where(F.col("frames") <= limit)).groupBy("start", "node").agg(F.min("frames").alias("frames"))
    # the limit can only cut walks from frames whose own walks come near it
    near = ways.groupBy("start").agg(F.max("frames").alias("f")).where(F.col("f") >= limit).select("start")
    near = short.unionByName(near).distinct().toDF("w")
    cut = first.join(near, F.col("via") == F.col("w"), "left_semi").join(ways.toDF("w2", "node", "f"), F.col("via") == F.col("w2"))
    within = (F.col("start") == F.col("bs")) & (F.col("node") == F.col("bn"))  # another first step comes there sooner
    cut = cut.where(F.col("f") + F.col("cost") > limit).select("start", "node").join(best.select(F.col("start").alias("bs"), F.col("node").alias("bn")), within, "left_anti")
    cut = cut.select("start").unionByName(first.join(short.toDF("w3"), F.col("via") == F.col("w3"), "left_semi").select("start"))
    return best, cut.distinct()


def _walk(e: DataFrame, starts: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Rounds of STEPS steps: what a step found is walked on at once, what the last found waits for the next round."""

    def step(rows: DataFrame) -> DataFrame:
        on = rows.select(F.col("start").alias("s"), F.col("node").alias("n"), F.col("frames").alias("f")).join(e, F.col("n") == F.col("src"))
        return on.groupBy("s", "dst").agg(F.min(F.col("f") + F.col("cost")).alias("frames")).toDF("start", "node", "frames")

    found = stored(starts.toDF("start").select("start", F.col("start").alias("node"), F.lit(1).alias("frames")))
    fresh, cut, rounds, pieces = found, None, 0, [found]
    while not fresh.isEmpty():
        rounds += 1
        one, both = fresh, None
        for k in range(1, STEPS + 1):
            one = step(one.where(F.col("frames") <= limit))
            own = one.withColumn("waits", F.lit(int(k == STEPS)))
            both = own if both is None else both.unionByName(own)
        both = both.groupBy("start", "node").agg(F.min(F.struct("frames", "waits")).alias("x")).select("start", "node", "x.frames", "x.waits")
        no_better = (F.col("start") == F.col("os")) & (F.col("node") == F.col("on")) & (F.col("of") <= F.col("frames"))
        better = stored(both.join(found.toDF("os", "on", "of"), no_better, "left_anti"))
        pieces.append(better)
        if STEPS * rounds >= limit:  # a round adds STEPS frames at most
            over = better.where(F.col("frames") > limit).select("start")
            cut = over if cut is None else cut.union(over)
        within = better.where(F.col("frames") <= limit)
        fresh = within.where("waits = 1").select("start", "node", "frames")
        found = found.unionByName(within.select("start", "node", "frames"))
        if rounds % 6 == 0:
            found = stored(found)
            pieces.append(found)
    best = stored(found.groupBy("start", "node").agg(F.min("frames").alias("frames")))
    cut = stored(cut.distinct()) if cut is not None else best.select("start").limit(0)
    forget(*pieces)
    return best, cut


def _expansion(schema: Schema, kind: str, name: str) -> dict[str, int]:
    """The names that a definition leads to on its own object by computed terms, itself at 0, with the least steps."""
    out, todo = {name: 0}, [name]
    for n in todo:  # grows; all steps cost 1, so names come in the order of their steps
        for term in schema.types[kind].permissions.get(n, ()) if kind in schema.types else ():
            if not term.through and term.name not in out:
                out[term.name] = out[n] + 1
                todo.append(term.name)
    return out


def _rules(schema: Schema, sets: list, definitions: set) -> list[tuple]:
    """(type, definition, relation, child's type, tuple's subject relation, child's definition, cost, tail) of every tuple that leads on.

    sets: (object_type, relation, subject_type, subject_relation) of the set tuples there are. Cost has the computed steps up to the
    tuple; tail is the most frames from the child on, itself included, on the child's own object.
    """
    best: dict[tuple, int] = {}
    for kind, definition in definitions:
        for n, k in _expansion(schema, kind, definition).items():
            found = [(r, st, sr, sr, k) for ot, r, st, sr in sets if (ot, r) == (kind, n)]
            for term in schema.types[kind].permissions.get(n, ()) if kind in schema.types else ():
                if term.through:
                    found += [(term.through, x.type, "", term.name, k + 1) for x in schema.types[kind].relations[term.through] if schema.types[x.type].has(term.name)]
            for *rest, cost in found:
                key = (kind, definition, *rest)
                best[key] = min(cost, best.get(key, cost))
    return [(*key, cost, 1 + max(_expansion(schema, key[3], key[5]).values())) for key, cost in sorted(best.items())]


def _steps(tuples: DataFrame, rules: list[tuple]) -> DataFrame:
    """(object, definition, child, cost, tail): what the rules make of the tuples; child is a frame. Rules are a few rows per type."""
    r = tuples.sparkSession.createDataFrame(rules or [("",) * 6 + (0, 0)], "rt string, definition string, rr string, rst string, rsr string, name string, cost int, tail int")
    own = tuples.where(F.col("object_type").isin([x[0] for x in rules]) & F.col("relation").isin([x[2] for x in rules]))
    match = (F.col("object_type") == F.col("rt")) & (F.col("relation") == F.col("rr")) & (F.col("subject_type") == F.col("rst")) & (F.col("subject_relation") == F.col("rsr"))
    return own.join(F.broadcast(r), match).select(_object("object_type", "object_id").alias("object"), "definition", F.concat(_object("subject_type", "subject_id"), F.lit("#"), "name").alias("child"), "cost", "tail")


def _holders(tuples: DataFrame, schema: Schema, definitions: set) -> DataFrame:
    """(object, definition, who, cost): plain subjects of the tuples that a definition comes to on its own object."""
    rows = [(kind, d, n, k) for kind, d in sorted(definitions) for n, k in _expansion(schema, kind, d).items()]
    r = tuples.sparkSession.createDataFrame(rows or [("", "", "", 0)], "rt string, definition string, rr string, cost int")
    own = tuples.where("subject_relation = ''").where(F.col("object_type").isin([x[0] for x in rows]) & F.col("relation").isin([x[2] for x in rows]))
    found = own.join(F.broadcast(r), (F.col("object_type") == F.col("rt")) & (F.col("relation") == F.col("rr")))
    return found.select(_object("object_type", "object_id").alias("object"), "definition", _object("subject_type", "subject_id").alias("who"), "cost")


def _heights(e: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """(id, values): the largest, over all walks from a node, of a walk's cost and the value at its end; limit + 1 where it is more.

    nodes: (id, values). With values of 1 that is the frames of the longest walk, and more than the limit before any cycle.
    """
    low = lambda c: F.least(c, F.lit(limit + 1)).cast("int")
    values = nodes.columns[1:]
    now, before, total = stored(nodes.select("id", *(low(F.col(v)).alias(v) for v in values))), None, None
    while before is None or total != before:
        wider = now
        for _ in range(STEPS):
            up = e.join(wider.withColumnRenamed("id", "n"), F.col("dst") == F.col("n")).select(F.col("src").alias("id"), *(low(F.col(v) + F.col("cost")).alias(v) for v in values))
            wider = wider.unionByName(up).groupBy("id").agg(*(F.max(v).alias(v) for v in values))
        wider = stored(wider)
        forget(now)
        now, before = wider, total
        total = now.agg(F.coalesce(F.sum(sum((F.col(v) for v in values), F.lit(0))), F.lit(0))).first()[0]
    return now


def _apart(schema: Schema, definitions: set) -> bool:
    """Whether no two definitions come to the same name on their own object, so a frame lies just behind one of them."""
    names = [(kind, n) for kind, d in definitions for n in _expansion(schema, kind, d)]
    return len(names) == len(set(names))


def _margins(e: DataFrame, nodes: DataFrame, heights: DataFrame, least: int, limit: int) -> DataFrame:
    """(id, lo, up) of the nodes with heights over least: the frames of the shortest path to what is farthest away lie between them.

    What such nodes come to over each other is exact, the rest lies in their heights. Walks start only where ways fork or may run
    in a cycle; a node with one way on is as far from all as the next node, and its step more.
    """
    own = stored(heights.where(F.col("u") > least).select(F.col("id").alias("m")))
    out = e.join(own, F.col("src") == F.col("m"), "left_semi").join(heights.where(F.col("u") <= least), F.col("dst") == F.col("id")).groupBy(F.col("src").alias("os")).agg(F.max(F.col("cost") + F.col("u")).alias("out"))
    base = nodes.join(own, F.col("id") == F.col("m"), "left_semi").join(out, F.col("id") == F.col("os"), "left")
    base = stored(base.select("id", F.col("tail").alias("lo"), F.greatest("tail", F.coalesce("out", "tail")).alias("up")))
    if own.isEmpty():
        return base
    among = stored(e.join(own, F.col("src") == F.col("m"), "left_semi").join(own, F.col("dst") == F.col("m"), "left_semi"))
    inward = _heights(among.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost"), own.select(F.col("m").alias("id"), F.lit(1).alias("u")), limit)
    anchors = inward.where(F.col("u") > limit).select("id").union(among.groupBy("src").agg(F.count("*").alias("n")).where("n > 1").select("src")).distinct()
    anchors = stored(anchors.toDF("anchor"))
    ways, cut = _walk(among, anchors, limit)
    far = ways.join(base, F.col("node") == F.col("id")).select("start", (F.col("frames") + F.col("lo") - 1).alias("lo"), (F.col("frames") + F.col("up") - 1).alias("up"))
    far = far.unionByName(cut.select("start", F.lit(limit + 1).alias("lo"), F.lit(limit + 1).alias("up")))
    known = far.groupBy(F.col("start").alias("id")).agg(F.max("lo").alias("lo"), F.max("up").alias("up"))
    ends = base.join(anchors, F.col("id") == F.col("anchor"), "left_anti").unionByName(known)
    found = _heights(among.join(anchors, F.col("src") == F.col("anchor"), "left_anti"), ends, limit)
    forget(own, base, among, inward, anchors, ways)
    return found


def _backward(vias: int, targets: int, nodes: int) -> bool:
    return targets < vias and vias * 8 > nodes


def _reached(e: DataFrame, nodes: DataFrame, targets: DataFrame, vias: DataFrame, least: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """((via, target, frames), (id, lo, up)): targets that vias reach, and bounds of how far all lies that they reach.

    Walks from the vias, or backward from the targets where vias are many and targets fewer. nodes: (id, tail). The frames of the
    shortest path to what is farthest from a via lie between lo and up. A via without a row has no path of more than least frames, and doesn't come to what others are far from.
    """
    if _backward(vias.count(), targets.count(), nodes.count()):
        back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost")
        ways, _ = _walk(back, targets, limit)
        found = stored(ways.toDF("target", "via", "frames").join(vias.toDF("v"), F.col("via") == F.col("v"), "left_semi"))
        forget(ways)
        heights = _heights(e, nodes.withColumnRenamed("tail", "u"), limit)
        margins = _margins(e, nodes, heights, least, limit)
        forget(heights)
        return found, margins
    ways, cut = _walk(e, vias, limit)
    ends = ways.join(nodes, F.col("node") == F.col("id")).select("start", (F.col("frames") + F.col("tail") - 1).alias("u"))
    ends = ends.unionByName(cut.select("start", F.lit(limit + 1).alias("u"))).groupBy("start").agg(F.max("u").alias("u"))
    margins = stored(ends.select(F.col("start").alias("id"), F.col("u").alias("lo"), F.col("u").alias("up")))
    return stored(ways.toDF("via", "target", "frames").join(targets.toDF("t"), F.col("target") == F.col("t"), "left_semi")), margins


def check(tuples: DataFrame, schema: Schema, questions: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(object, permission, subject, status): ALLOW, DENY, or DEPTH where the limit left it undecided.

    questions: (object, permission, subject), names as type:id. A type or definition that the schema lacks is a
    SchemaError; an object or subject that no tuple names is denied.

    Tuples of a question's own object answer it or lead on to frames that many objects share. Walks go only between those and the
    frames that hold a subject asked for, over numbers, and a question is joined with what holds its subject, not with all that
    its object reaches. Where no path can pass the limit, nothing is undecided; other starts are walked whole to tell.
    """
    asked = questions.toDF("object", "permission", "subject").distinct()
    kinds = _known(asked, schema)
    t = tuples.select(*TUPLE_COLUMNS)
    sets = sorted(map(tuple, t.where("subject_relation <> ''").select("object_type", "relation", "subject_type", "subject_relation").distinct().collect()))  # a row per allowed subject of the schema
    first = _rules(schema, sets, kinds)
    inner, todo = set(), {(x[3], x[5]) for x in first}
    while todo:
        inner |= todo
        todo = {(x[3], x[5]) for x in _rules(schema, sets, todo)} - inner
    near = _holders(t, schema, kinds).where(F.col("cost") < limit).select(F.col("object").alias("no"), F.col("definition").alias("np"), F.col("who").alias("nw"), F.lit(True).alias("hit")).distinct()
    q = asked.join(near, (F.col("object") == F.col("no")) & (F.col("permission") == F.col("np")) & (F.col("subject") == F.col("nw")), "left")
    q = stored(q.select("object", "permission", "subject", F.col("hit").isNotNull().alias("hit"), F.monotonically_increasing_id().alias("q")))
    whos = q.where("not hit").select(F.col("subject").alias("s")).distinct()
    held = _holders(t, schema, inner).join(whos, F.col("who") == F.col("s"), "left_semi").groupBy(F.concat("object", F.lit("#"), "definition").alias("node"), "who").agg(F.min("cost").alias("cost"))
    held = stored(held)
    ways = stored(_steps(t, _rules(schema, sets, inner)).groupBy(F.concat("object", F.lit("#"), "definition").alias("src"), F.col("child").alias("dst")).agg(F.min("cost").alias("cost"), F.max("tail").alias("tail")))
    tails = tuples.sparkSession.createDataFrame([(d, 1 + max(_expansion(schema, kind, d).values()), kind) for kind, d in sorted(inner)] or [("", 0, "")], "d string, tail int, kind string")
    names = ways.select(F.col("src").alias("name")).union(ways.select("dst")).union(held.select("node")).distinct()
    own = (F.substring_index("name", "#", -1) == F.col("d")) & (F.substring_index("name", ":", 1) == F.col("kind"))
    names = stored(names.join(F.broadcast(tails), own).select("name", "tail", F.monotonically_increasing_id().alias("id")))
    ids = names.select("name", "id")
    e = stored(ways.join(ids.toDF("sn", "s"), F.col("src") == F.col("sn")).join(ids.toDF("dn", "d"), F.col("dst") == F.col("dn")).select(F.col("s").alias("src"), F.col("d").alias("dst"), "cost"))
    h = stored(held.join(ids, F.col("node") == F.col("name")).select("who", F.col("id").alias("h"), F.col("cost").alias("more")))
    steps = _steps(t, first).join(ids, F.col("child") == F.col("name"), "left")
    steps = steps.select(F.col("object").alias("so"), F.col("definition").alias("sp"), F.col("id").alias("via"), "cost", (F.col("cost") + F.col("tail") > limit).alias("over"))
    steps = stored(steps.where("via is not null or over"))
    forget(held, ways)
    vias = stored(steps.where("via is not null").select("via").distinct())
    least = limit - max((x[6] for x in first), default=0)
    reached, margins = _reached(e, names.select("id", "tail"), h.select(F.col("h").alias("id")).distinct(), vias, least, limit)
    pairs = q.where("not hit").join(steps.where("via is not null"), (F.col("object") == F.col("so")) & (F.col("permission") == F.col("sp")))
    pairs = stored(pairs.select("q", "subject", "via", "cost"))
    long = steps.where("over").select(F.concat("so", F.lit("#"), "sp").alias("start"))
    deep = [kind for kind, d in kinds if 1 + max(_expansion(schema, kind, d).values()) > limit]
    long = stored(long.unionByName(q.where(F.substring_index("object", ":", 1).isin(deep)).select(F.concat("object", F.lit("#"), "permission").alias("start"))))
    forget(steps, vias, names, e)
    # a frame beyond the limit is told by one via's own bounds if nothing else on the way from the start comes to it
    alone = not kinds & inner and _apart(schema, kinds | inner)
    flags = pairs.join(margins, F.col("via") == F.col("id")).groupBy("q").agg((F.min("via") == F.max("via")).alias("one"), F.min(F.col("lo") + F.col("cost")).alias("lo"), F.max(F.col("up") + F.col("cost")).alias("up"))
    flags = stored(flags.where(F.col("up") > limit).select("q", (F.lit(alone) & F.col("one") & (F.col("lo") > limit)).alias("sure")))
    to = pairs.join(h, F.col("subject") == F.col("who")).select("q", F.col("via").alias("v"), "h", (F.col("cost") + F.col("more")).alias("more"))
    hits = to.join(reached, (F.col("v") == F.col("via")) & (F.col("h") == F.col("target")) & (F.col("frames") + F.col("more") <= limit)).select("q").distinct()
    hits = stored(hits)
    forget(pairs, h, reached, margins)
    marks = hits.withColumn("mark", F.lit(2)).unionByName(flags.where("sure").select("q", F.lit(1).alias("mark"))).groupBy(F.col("q").alias("mq")).agg(F.max("mark").alias("mark"))
    rest = q.where("not hit").join(marks, F.col("q") == F.col("mq"), "left")
    unsure = q.join(flags.where("not sure").withColumnRenamed("q", "fq"), F.col("q") == F.col("fq"), "left_semi").select(F.concat("object", F.lit("#"), "permission").alias("start"))
    long = stored(long.unionByName(unsure).distinct())
    cut = F.lit(False)
    if not long.isEmpty():
        _, beyond = _walk(stored(frame_edges(tuples, schema)), long, limit)
        rest = rest.withColumn("start", F.concat("object", F.lit("#"), "permission")).join(beyond.select(F.col("start").alias("cs"), F.lit(True).alias("cut")), F.col("start") == F.col("cs"), "left")
        cut = F.col("cut")
    status = F.when(F.col("mark") == 2, "ALLOW").when((F.col("mark") == 1) | cut, "DEPTH").otherwise("DENY")
    return q.where("hit").select("object", "permission", "subject", F.lit("ALLOW").alias("status")).unionByName(rest.select("object", "permission", "subject", status.alias("status")))


def _known(asked: DataFrame, schema: Schema) -> set[tuple[str, str]]:
    """(type, permission) of all questions. Every kind of question is held against the schema's own pairs; the first strange one is told."""
    spark = asked.sparkSession
    kind = lambda c: F.when(F.col(c).rlike("(?s)^[^:]+:.+"), F.substring_index(c, ":", 1))
    pairs = [(x.name, d) for x in schema.types.values() for d in (*x.relations, *x.permissions)]
    pairs = F.broadcast(spark.createDataFrame(pairs or [("", "")], "_type string, _name string"))
    types = F.broadcast(spark.createDataFrame([(x,) for x in schema.types] or [("",)], "_subject string"))
    kinds = asked.select(kind("object").alias("o"), "permission", kind("subject").alias("s")).distinct()
    found = kinds.join(pairs, (F.col("o") == F.col("_type")) & (F.col("permission") == F.col("_name")), "left").join(types, F.col("s") == F.col("_subject"), "left")
    strange = F.col("_type").isNull() | F.col("_subject").isNull()
    rows = found.select("o", "permission", "s", strange.alias("strange")).orderBy(F.desc("strange")).limit(1 + sum(len(x.relations) + len(x.permissions) for x in schema.types.values()) * len(schema.types)).collect()
    for r in rows[:1]:
        if r["strange"]:
            if r["o"] is None or r["s"] is None or r["permission"] is None:
                raise SchemaError("a question needs names of the form type:id")
            schema.define(r["o"], r["permission"])
            schema.type(r["s"])
    return {(r["o"], r["permission"]) for r in rows}


def _whole(cut: DataFrame, limit: int) -> None:
    """Raises if the limit cut a walk of a lookup, as the result would lack what lies beyond it."""
    for r in cut.limit(1).collect():
        raise CheckDepthError(f"the lookup from {r['start']} needs more than {limit} steps")


def lookup_subjects(tuples: DataFrame, schema: Schema, objects: DataFrame, permission: str, subject_type: str | None = None, limit: int = LIMIT, partial: bool = False) -> DataFrame:
    """(object, subject) of everyone who has the permission on each object (column object: type:id).

    Where something lies beyond limit frames, a CheckDepthError, or with partial the subjects within the limit.
    """
    starts = objects.toDF("object").distinct().select(F.concat("object", F.lit("#"), F.lit(permission)).alias("start"))
    reached, cut = walk(frame_edges(tuples, schema), starts, limit)
    if not partial:
        _whole(cut, limit)
    found = reached.join(direct(tuples), F.col("node") == F.col("frame")).select("start", "subject").distinct()
    if subject_type:
        found = found.where(F.startswith("subject", F.lit(subject_type + ":")))
    return found.select(F.expr(f"left(start, length(start) - {len(permission) + 1})").alias("object"), "subject")


def lookup_resources(tuples: DataFrame, schema: Schema, subjects: DataFrame, object_type: str, permission: str, limit: int = LIMIT, partial: bool = False) -> DataFrame:
    """(subject, object) of all objects of a type on which each subject (column subject) has the permission.

    Walks the frame graph backwards from the subjects' direct tuples, so the cost follows what they can reach.
    Where something lies beyond limit frames, a CheckDepthError, or with partial the objects within the limit.
    """
    schema.define(object_type, permission)
    back = frame_edges(tuples, schema).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost")
    own = subjects.toDF("s").distinct().join(direct(tuples), F.col("s") == F.col("subject")).select("subject", "frame")
    own = stored(own)
    reached, cut = walk(back, own.select("frame"), limit)
    if not partial:
        _whole(cut, limit)
    end = "#" + permission
    hit = reached.where(F.startswith("node", F.lit(object_type + ":")) & F.endswith("node", F.lit(end)))
    out = own.join(hit, F.col("frame") == F.col("start")).select("subject", F.expr(f"left(node, length(node) - {len(end)})").alias("object")).distinct()
    return out


#: Frames with so many direct subjects or more are counted by classes of subjects, smaller ones subject by subject.
BIG = 64


def _live(e: DataFrame, held: DataFrame) -> DataFrame:
    """The edges but those to frames that neither lead on nor are in held (frame, subject), so nothing is found by them."""
    ends = e.select(F.col("src").alias("f")).union(held.select("frame")).distinct()
    return e.join(ends, F.col("dst") == F.col("f"), "left_semi")


def _counted(tuples: DataFrame, schema: Schema, objects: DataFrame, permission: str, subjects, limit: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """((start, sig), (subject, class), (sig, class), (start, subject)): who has a permission, without a row for each pair.

    Objects whose first steps lead on to the same frames are walked once, and are of one sig if they come to the same big
    frames; subjects of the same big frames are one class. All of a class have the permission on all objects of a sig where
    (sig, class) is a row; the last table has the other pairs, which come from small frames. subjects: filter of (frame, subject).
    """
    held = stored(subjects(direct(tuples)))
    e = stored(_live(frame_edges(tuples, schema), held))
    big = stored(held.groupBy("frame").agg(F.count("*").alias("n")).where(F.col("n") >= BIG).select(F.col("frame").alias("big")))
    starts = stored(objects.toDF("object").where("object is not null").distinct().select(F.concat("object", F.lit("#"), F.lit(permission)).alias("start")))
    first = starts.join(e, F.col("start") == F.col("src")).select("start", F.col("dst").alias("via"), "cost")
    shared = e.select(F.col("src").alias("on")).union(big).distinct()
    first = stored(first.join(shared.withColumn("leads", F.lit(True)), F.col("via") == F.col("on"), "left").select("start", "via", "cost", F.col("leads").isNotNull().alias("leads")))
    ways = stored(first.where("leads").groupBy("start").agg(F.sort_array(F.collect_set(F.struct("via", "cost"))).alias("ways")))
    groups = stored(ways.groupBy("ways").agg(F.min("start").alias("group")))
    member = stored(ways.join(groups.toDF("w", "group"), F.col("ways") == F.col("w")).select("start", "group"))
    # one frame stands for all starts of a group; no name of an object begins like it
    own = groups.select(F.concat(F.lit("="), "group").alias("src"), F.explode("ways").alias("way")).select("src", "way.via", "way.cost").toDF("src", "dst", "cost")
    reached, cut = walk(e.unionByName(own), own.select("src"), limit)
    _whole(cut.select(F.expr("substring(start, 2)").alias("start")), limit)
    holding = held.select(F.col("frame").alias("f")).distinct()
    nodes = reached.join(holding, F.col("node") == F.col("f"), "left_semi").select(F.expr("substring(start, 2)").alias("group"), "node")
    nodes = stored(nodes.join(big.withColumn("is_big", F.lit(True)), F.col("node") == F.col("big"), "left").select("group", "node", F.col("is_big").isNotNull().alias("is_big")))
    sets = stored(nodes.where("is_big").groupBy("group").agg(F.sort_array(F.collect_set("node")).alias("frames")))
    sigs = stored(sets.groupBy("frames").agg(F.min("group").alias("sig")))
    sig_of = member.join(sets.join(sigs.toDF("fs", "sig"), F.col("frames") == F.col("fs")).select(F.col("group").alias("g"), "sig"), F.col("group") == F.col("g")).select("start", "sig")
    theirs = stored(held.join(big, F.col("frame") == F.col("big"), "left_semi").groupBy("subject").agg(F.sort_array(F.collect_set("frame")).alias("frames")))
    classes = stored(theirs.groupBy("frames").agg(F.min("subject").alias("class")))
    class_of = stored(theirs.join(classes.toDF("fs", "class"), F.col("frames") == F.col("fs")).select("subject", "class"))
    sig_of = stored(sig_of)
    cover = sigs.select("sig", F.explode("frames").alias("node")).join(classes.select("class", F.explode("frames").alias("frame")), F.col("node") == F.col("frame"))
    cover = stored(cover.select("sig", "class").distinct())
    near = starts.select("start", F.col("start").alias("node")).unionByName(first.where("not leads").select("start", F.col("via").alias("node")))
    far = member.join(nodes.where("not is_big").select(F.col("group").alias("g"), "node"), F.col("group") == F.col("g")).select("start", "node")
    pairs = near.unionByName(far).join(held, F.col("node") == F.col("frame")).select("start", "subject").distinct()
    pairs = pairs.join(sig_of.toDF("s", "sig"), F.col("start") == F.col("s"), "left").join(class_of.toDF("who", "class"), F.col("subject") == F.col("who"), "left")
    rest = pairs.join(cover.toDF("cs", "cc"), (F.col("sig") == F.col("cs")) & (F.col("class") == F.col("cc")), "left_anti").select("start", "subject")
    return sig_of, class_of, cover, rest


def count_subjects(tuples: DataFrame, schema: Schema, objects: DataFrame, permission: str, subject_type: str, limit: int = LIMIT) -> DataFrame:
    """(object, subjects): how many subjects lookup_subjects finds for each object that has any. The limit is 2 or more."""
    of_type = lambda d: d.where(F.startswith("subject", F.lit(subject_type + ":")))
    sig_of, class_of, cover, rest = _counted(tuples, schema, objects, permission, of_type, limit)
    sizes = class_of.groupBy(F.col("class").alias("c")).agg(F.count("*").alias("n"))
    whole = cover.join(sizes, F.col("class") == F.col("c")).groupBy(F.col("sig").alias("s")).agg(F.sum("n").alias("n"))
    both = sig_of.join(whole, F.col("sig") == F.col("s")).select("start", "n").unionByName(rest.groupBy("start").agg(F.count("*").alias("n")))
    return both.groupBy("start").agg(F.sum("n").alias("subjects")).select(F.expr(f"left(start, length(start) - {len(permission) + 1})").alias("object"), "subjects")


def count_resources(tuples: DataFrame, schema: Schema, subjects: DataFrame, object_type: str, permission: str, limit: int = LIMIT) -> DataFrame:
    """(subject, objects): how many objects lookup_resources finds for each subject that has any. The limit is 2 or more."""
    schema.define(object_type, permission)
    objects = tuples.where(F.col("object_type") == F.lit(object_type)).select(_object("object_type", "object_id").alias("object"))
    asked = subjects.toDF("asked").distinct()
    own = lambda d: d.join(asked, F.col("subject") == F.col("asked"), "left_semi")
    sig_of, class_of, cover, rest = _counted(tuples, schema, objects, permission, own, limit)
    sizes = sig_of.groupBy(F.col("sig").alias("s")).agg(F.count("*").alias("n"))
    whole = cover.join(sizes, F.col("sig") == F.col("s")).groupBy(F.col("class").alias("c")).agg(F.sum("n").alias("n"))
    both = class_of.join(whole, F.col("class") == F.col("c")).select("subject", "n").unionByName(rest.groupBy("subject").agg(F.count("*").alias("n")))
    return both.groupBy("subject").agg(F.sum("n").alias("objects"))


def access_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(object, permission, subject, allowed) of the answers that differ between two results of check."""
    b, a = before.select("object", "permission", "subject", (F.col("status") == "ALLOW").alias("was")), after.select(F.col("object").alias("o"), F.col("permission").alias("p"), F.col("subject").alias("s"), (F.col("status") == "ALLOW").alias("allowed"))
    both = b.join(a, (F.col("object") == F.col("o")) & (F.col("permission") == F.col("p")) & (F.col("subject") == F.col("s")), "full")
    return both.select(F.coalesce("object", "o").alias("object"), F.coalesce("permission", "p").alias("permission"), F.coalesce("subject", "s").alias("subject"), F.coalesce("was", F.lit(False)).alias("was"), F.coalesce("allowed", F.lit(False)).alias("allowed")).where("was <> allowed").drop("was")


def set_closure(tuples: DataFrame) -> DataFrame:
    """(src, dst): every set of subjects and the sets nested in it at any depth, as type:id#relation."""
    from ..plans.fixpoint import closure

    nested = tuples.where("subject_relation <> ''").select(F.concat(_object("object_type", "object_id"), F.lit("#"), "relation"), F.concat(_object("subject_type", "subject_id"), F.lit("#"), "subject_relation"))
    return closure(nested)


def subject(name: str, relation: str = "") -> Subject:
    return Subject(name, relation)


def empty(spark: SparkSession) -> DataFrame:
    from ..model import TUPLE

    return spark.createDataFrame([], TUPLE)
