"""Multi-party chats from every speaker's side, as one row for each turn and side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 256
BEGIN, END = "<|begin|>", "<|end|>"


def rotate_perspectives(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", system: str = "system", unknown: str = "unknown") -> DataFrame:
    """Each conversation once for every participant: that one is the assistant, the others are named users.

    Columns: conv_id, perspective, turn, role, name, segment, start, mask_start, mask_end.
    Concatenating a side's segments by (turn, name, text) gives its dialogue; `start` is
    a segment's place there and mask_start:mask_end, in code points, what a model is
    trained on: the assistant's words and the end mark (null for other turns). System
    turns stay system and are nobody's side, so a conversation of them alone gives no
    row. A null role is the participant `unknown`; null text is empty; a null turn comes
    first; repeated turns stand each for itself. Null conversation ids are one
    conversation. Other columns are ignored. Offsets are sums over blocks of turns first,
    so that a long conversation doesn't meet in one task.
    """
    t = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit(unknown)).alias("speaker"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sides = t.where(F.col("speaker") != system).select(F.col("conv_id").alias("side_conv"), F.col("speaker").alias("perspective")).distinct()
    t = t.join(sides, F.col("conv_id").eqNullSafe(F.col("side_conv"))).drop("side_conv")
    own = F.col("speaker") == F.col("perspective")
    role = F.when(F.col("speaker") == system, system).when(own, "assistant").otherwise("user")
    t = t.withColumn("role", role).withColumn("name", F.when(F.col("role") == "user", F.col("speaker")))
    head = F.concat(F.lit(BEGIN), F.col("role"), F.coalesce(F.concat(F.lit(" name="), F.col("name")), F.lit("")), F.lit("\n"))
    t = t.withColumn("head", F.char_length(head)).withColumn("segment", F.concat(head, F.col("text"), F.lit(END + "\n"))).withColumn("size", F.char_length("segment"))
    t = t.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))))
    keys = ["conv_id", "perspective"]
    before = F.coalesce(F.sum("size").over(W.partitionBy(*keys).orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = t.groupBy(*keys, "block").agg(F.sum("size").alias("size")).select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"), before.alias("before"))
    inside = F.coalesce(F.sum("size").over(W.partitionBy(*keys, "block").orderBy("turn", "name", "text").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    t = t.withColumn("inside", inside).join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("block") == F.col("b")))
    start = F.col("before") + F.col("inside")
    lo, hi = F.when(F.col("role") == "assistant", start + F.col("head")), F.when(F.col("role") == "assistant", start + F.col("size") - 1)
    return t.select("conv_id", "perspective", "turn", "role", "name", "segment", start.cast("long").alias("start"), lo.cast("long").alias("mask_start"), hi.cast("long").alias("mask_end"))


SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
sides AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
r AS (SELECT t.conv_id, perspective, turn, text,
        CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role,
        CASE WHEN speaker <> 'system' AND speaker <> perspective THEN speaker END AS name
      FROM t JOIN sides ON t.conv_id IS NOT DISTINCT FROM sides.conv_id),
h AS (SELECT *, '{BEGIN}' || role || coalesce(' name=' || name, '') || chr(10) AS head FROM r),
s AS (SELECT *, head || text || '{END}' || chr(10) AS segment FROM h),
o AS (SELECT *, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, name NULLS FIRST, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s)
SELECT conv_id, perspective, turn, role, name, segment, CAST(start AS BIGINT) AS start,
  CAST(CASE WHEN role = 'assistant' THEN start + length(head) END AS BIGINT) AS mask_start,
  CAST(CASE WHEN role = 'assistant' THEN start + length(segment) - 1 END AS BIGINT) AS mask_end
FROM o
"""
