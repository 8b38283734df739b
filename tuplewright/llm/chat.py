"""Chat formatting in Spark expressions only: turns to one training string with a loss mask, and back.

Template: each run of neighbouring turns of one role is a block  <s>ROLE[INST]TEXT[/INST]TEXT...</s>
The control strings are in CONTROLS. Inside roles and texts every control string gets a backslash after its first
character, and one that already has backslashes there gets one more, so that the step is reversible for any text
and a formatted string holds control strings only where the template put them.

The loss mask is a list of runs (chars, counts) in code points: the template and texts of other roles don't count,
texts of LOSS_ROLE do.

A conversation becomes one row, so its turns meet in one task; work and memory are linear in its own length.

Cases: null role and null text are empty; null turns come first; equal turns are ordered by role, then text;
rows that repeat count as turns of their own; a null conv_id is a conversation like any other; an empty table
gives an empty result.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
LOSS_ROLE = "assistant"
_BEGIN, _END, _OPEN, _NEXT = CONTROLS
_BODY = r"(/?s>|/?INST\])"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])(\\*)" + _BODY, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])\\(\\*)" + _BODY, "$1$2$3")


def blocks(turns: Column) -> Column:
    """Sorted turn structs (role, text) to structs (role, texts), one for each run of neighbours of one role."""
    last = F.size(turns)
    starts = F.filter(F.sequence(F.lit(0), last - 1), lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))
    return F.transform(
        starts,
        lambda s, k: F.struct(
            F.get(turns, s)["role"].alias("role"),
            F.transform(F.slice(turns, s + 1, F.coalesce(F.get(starts, k + 1), last) - s), lambda t: t["text"]).alias("texts"),
        ),
    )


def gather(rows: DataFrame) -> DataFrame:
    """conv_id and turns: escaped (role, text) structs in order."""
    own = rows.select(
        "conv_id",
        F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    turns = own.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return turns.select("conv_id", F.transform("turns", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text"))).alias("turns"))


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_runs of conversations given as rows (conv_id, turn, role, text)."""
    merged = gather(rows).select("conv_id", blocks(F.col("turns")).alias("blocks"))
    one = lambda b: F.concat(F.lit(_BEGIN), b["role"], F.lit(_OPEN), F.array_join(b["texts"], _NEXT), F.lit(_END))
    run = lambda chars, counts: F.struct(chars.cast("long").alias("chars"), counts.alias("counts"))
    fixed = lambda s: F.lit(len(s))

    def runs(b: Column) -> Column:
        head = run(fixed(_BEGIN) + F.length(b["role"]) + fixed(_OPEN), F.lit(False))
        body = F.flatten(F.transform(b["texts"], lambda t, k: F.array(run(F.when(k == 0, 0).otherwise(fixed(_NEXT)), F.lit(False)), run(F.length(t), b["role"] == LOSS_ROLE))))
        return F.concat(F.array(head), body, F.array(run(fixed(_END), F.lit(False))))

    return merged.select(
        "conv_id",
        F.array_join(F.transform("blocks", one), "").alias("formatted"),
        F.filter(F.flatten(F.transform("blocks", runs)), lambda r: r["chars"] > 0).alias("loss_runs"),
    )


def read_back(formatted: Column) -> Column:
    """The turns, as structs (role, text), that a formatted string was made of."""
    parts = F.split(formatted, "</s>", -1)
    own = F.slice(parts, 1, F.size(parts) - 1)

    def turns(block: Column) -> Column:
        role = F.substring_index(block, _OPEN, 1)
        texts = F.split(F.substr(block, F.length(role) + F.lit(len(_OPEN) + 1)), r"\[/INST\]", -1)
        return F.transform(texts, lambda t: F.struct(unescape(F.substr(role, F.lit(len(_BEGIN) + 1))).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(own, turns))


def _pieces(formatted: Column) -> Column:
    """The non-empty stretches that a formatted string is made of: controls with roles, and escaped texts."""
    parts = F.split(formatted, "</s>", -1)

    def of_block(block: Column) -> Column:
        head = F.concat(F.substring_index(block, _OPEN, 1), F.lit(_OPEN))
        texts = F.split(F.substr(block, F.length(head) + F.lit(1)), r"\[/INST\]", -1)
        return F.concat(F.array(head), F.flatten(F.transform(texts, lambda t, k: F.array(F.when(k == 0, "").otherwise(_NEXT), t))), F.array(F.lit(_END)))

    return F.filter(F.flatten(F.transform(F.slice(parts, 1, F.size(parts) - 1), of_block)), lambda p: F.length(p) > 0)


def under_mask(formatted: Column, loss_runs: Column) -> Column:
    """The unescaped text that the runs of the mask count, nothing between; null if the runs don't fall on the stretches
    of the formatted string, which then has another mask. Linear in the string."""
    cut = F.zip_with(_pieces(formatted), loss_runs, lambda p, r: F.struct(p.alias("piece"), r["chars"].alias("chars"), r["counts"].alias("counts")))
    fits = F.forall(cut, lambda x: F.coalesce(F.length(x["piece"]) == x["chars"], F.lit(False)))
    return F.when(fits, F.array_join(F.transform(F.filter(cut, lambda x: x["counts"]), lambda x: unescape(x["piece"])), ""))


def contract(conversations: DataFrame) -> DataFrame:
    """The digest columns, all read back from the formatted strings, for the table plus conversation -7."""
    spark = conversations.sparkSession
    own = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(LOSS_ROLE).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    done = format_chats(own.unionAll(probe))
    done = done.withColumn("turns", read_back(F.col("formatted")))
    done = done.withColumn("loss", under_mask(F.col("formatted"), F.col("loss_runs")))
    loss = F.col("loss")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) AS role_chars,
         length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) AS text_chars,
         coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) <> role, true) AS starts
  FROM r)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(text_chars + CASE WHEN starts THEN role_chars + 13 ELSE 7 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
