"""9. Chat formatting: multi-party perspective rotation.

Every participant of a dialogue is once the assistant: the other speakers become named users, and the mask covers what
that participant says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlace.operators.relabel import dense_ranks
from overlace.plans.lineage import stage

START, END = "<|im_start|>", "<|im_end|>"


def rotate(turns: DataFrame, system: str = "system", turns_at_once: int = 64, start: str = START, end: str = END) -> DataFrame:
    """One row per conversation, perspective and part: (conv_id, perspective, part, n_turns, text, mask_starts, mask_ends, n_mask_chars).

    turns: (conv_id, turn, role, text). Participants are the distinct roles but ``system``, which stays the system in every
    perspective and gets no perspective of its own. A turn is rendered as start, the header (assistant, system, or
    "user name=ROLE"), line feed, text, end, line feed; the mask holds character spans [start, end) of ``text``: each turn of
    the perspective's speaker with its end mark. Marks inside a turn's text are broken with a space, so no text can forge a turn.

    The turns of a conversation are counted in order of their number, role and text, and a part holds ``turns_at_once`` of them, so no
    task needs a whole dialogue, whatever its numbers are; a dialogue's text is its parts in order. Turns are counted over ranges of
    the sorted table, so a dialogue of any length is spread. A null text is empty, a null role the name "unknown", a null turn
    the number 0, and a null conv_id a conversation. Repeated rows are turns of their own. Conversations without participants give no rows.
    Other columns are dropped.
    """
    safe = lambda c: F.replace(F.replace(c, F.lit(start), F.lit(start[:1] + " " + start[1:])), F.lit(end), F.lit(end[:1] + " " + end[1:]))
    role = F.regexp_replace(safe(F.coalesce("role", F.lit("unknown"))), r"[\r\n]", " ")
    t = turns.select("conv_id", F.coalesce("turn", F.lit(0)).alias("turn"), role.alias("role"), safe(F.coalesce("text", F.lit(""))).alias("text"))
    t = t.withColumn("copy", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "role", "text", "copy"]
    # The beginning of a text tells the range, so that no long texts are sampled for the bounds.
    t = dense_ranks(t, order, "place", ["conv_id", "turn", "role", F.substring("text", 1, 32)]).drop("copy")
    first = stage(t.groupBy(F.col("conv_id").alias("c")).agg(F.min("place").alias("first")))
    cast = t.where(F.col("role") != system).select(F.col("conv_id").alias("c"), F.col("role").alias("perspective")).distinct()
    cast = stage(cast.join(first.withColumnRenamed("c", "d"), F.expr("c <=> d")).drop("d"))
    seen = t.join(cast, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    own = F.col("role") == F.col("perspective")
    header = F.when(own, "assistant").when(F.col("role") == system, system).otherwise(F.concat(F.lit("user name="), F.col("role")))
    head = F.concat(F.lit(start), header, F.lit("\n"))
    body = F.concat("text", F.lit(end))
    parts = seen.groupBy("conv_id", "perspective", F.floor((F.col("place") - F.col("first")) / turns_at_once).cast("long").alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("place", "role", "text", head.alias("head"), body.alias("body"), own.alias("own")))).alias("rows")
    )
    size = "length(x.head) + length(x.body) + 1"
    ends = f"aggregate(rows, array(0), (acc, x) -> concat(acc, array(element_at(acc, -1) + {size})))"
    parts = parts.withColumn("at", F.expr(ends)).withColumn("spans", F.expr("filter(transform(rows, (x, i) -> if(x.own, struct(at[i] + length(x.head) as s, at[i + 1] - 1 as e), null)), x -> x is not null)"))
    return parts.select(
        "conv_id",
        "perspective",
        "part",
        F.size("rows").cast("long").alias("n_turns"),
        F.array_join(F.transform("rows", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "").alias("text"),
        F.transform("spans", lambda x: x["s"]).alias("mask_starts"),
        F.transform("spans", lambda x: x["e"]).alias("mask_ends"),
        F.aggregate("spans", F.lit(0), lambda a, x: a + x["e"] - x["s"]).cast("long").alias("n_mask_chars"),
    )
