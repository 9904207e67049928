"""Perspective rotation of dialogues.

For each participant of a conversation the dialogue is rendered once, with that
speaker's turns as ``assistant``, everyone else's as named ``user`` turns and
system turns as they are.  A segment is one rendered turn.  Concatenated by
``start`` the segments of a perspective are the whole dialogue; the mask of a
segment covers the content and end mark of the assistant's turns, the only text
that a loss counts.  All offsets are code points.

A dialogue stays a set of rows, joined to its participants by conversation, so
a conversation with a third of all rows is never gathered into one task; its
offsets are running sums within blocks of ``BLOCK`` turns plus the blocks before;
turns without a number have blocks by their speaker and first characters.

Defined results: a null text is an empty turn.  A turn with a null or empty role
is a user's without a name, and no participant.  A null conv_id is a
conversation like any other.  Turns with equal numbers follow by role and text,
null turns come last; repeated rows stay repeated.  Conversations without
participants, and empty tables, give no rows.  Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

BLOCK = 256
SYSTEM = "system"
#: Marks of the rendered form: fixed values.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def perspectives(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", system: str = SYSTEM) -> DataFrame:
    """A row per conversation, participant and turn: role, name, segment, its start, and its mask (null: none)."""
    t = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.nullif(F.col(role), F.lit("")).alias("speaker"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    who = t.filter(F.col("speaker").isNotNull() & (F.col("speaker") != system)).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    both = t.join(who, F.col("conv_id").eqNullSafe(F.col("c")))
    own = F.coalesce(F.col("speaker") == F.col("perspective"), F.lit(False))
    as_role = F.when(own, "assistant").when(F.col("speaker") == system, system).otherwise("user")
    name = F.when((F.col("as_role") == "user"), F.col("speaker"))
    head = F.concat(F.lit(OPEN), F.col("as_role"), F.coalesce(F.concat(F.lit(" name="), F.col("name")), F.lit("")), F.lit("\n"))
    both = both.withColumn("as_role", as_role).withColumn("name", name).withColumn("head", F.length(head)).withColumn("segment", F.concat(head, F.col("content"), F.lit(CLOSE)))
    both = both.withColumn("n", F.length("segment").cast("long")).withColumn("late", F.col("turn").isNull())
    # Turns without a number are in blocks by speaker and the first characters, which is their order.
    both = both.withColumn("block", F.floor(F.col("turn") / BLOCK)).withColumn("spoken", F.when(F.col("late"), F.struct(F.col("speaker"), F.substring("content", 1, 4).alias("start"))))
    keys = ("conv_id", "perspective", "late", "block", "spoken")
    inside = W.partitionBy("conv_id", "perspective", "late", "block", "spoken").orderBy("turn", "speaker", "content").rowsBetween(W.unboundedPreceding, W.currentRow)
    blocks = both.groupBy("conv_id", "perspective", "late", "block", "spoken").agg(F.sum("n").alias("block_n"))
    earlier = W.partitionBy("conv_id", "perspective").orderBy("late", "block", "spoken").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("offset", F.coalesce(F.sum("block_n").over(earlier), F.lit(0)))
    blocks = blocks.select(*[F.col(k).alias(f"b_{k}") for k in keys], "offset")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"b_{k}"))
    run = both.withColumn("end", F.sum("n").over(inside)).join(blocks, same)
    mask = lambda at: F.when(F.col("as_role") == "assistant", at)
    start = F.col("offset") + F.col("end") - F.col("n")
    return run.select(
        "conv_id", "perspective", "turn", F.col("as_role").alias("role"), "name", "segment", start.alias("start"),
        mask(start + F.col("head")).alias("mask_start"), mask(start + F.col("n")).alias("mask_end"),
    )


SQL = f"""
WITH t AS (SELECT conv_id, turn, nullif(role, '') AS speaker, coalesce(text, '') AS content FROM conversations),
who AS (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM t WHERE speaker <> '{SYSTEM}'),
b AS (SELECT conv_id, perspective, turn, speaker, content, CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = '{SYSTEM}' THEN '{SYSTEM}' ELSE 'user' END AS role
  FROM t JOIN who ON conv_id IS NOT DISTINCT FROM c),
h AS (SELECT *, CASE WHEN role = 'user' THEN speaker END AS name, '{OPEN}' || role || CASE WHEN role = 'user' THEN coalesce(' name=' || speaker, '') ELSE '' END || chr(10) AS head FROM b),
s AS (SELECT *, head || content || '{CLOSE.strip()}' || chr(10) AS segment FROM h),
o AS (SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn IS NULL, turn, speaker NULLS FIRST, content ROWS UNBOUNDED PRECEDING) - length(segment) AS BIGINT) AS start FROM s)
SELECT conv_id, perspective, turn, role, name, segment, start, CASE WHEN role = 'assistant' THEN start + length(head) END AS mask_start,
  CASE WHEN role = 'assistant' THEN start + length(segment) END AS mask_end FROM o
"""
