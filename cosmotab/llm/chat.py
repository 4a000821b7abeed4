"""Chat formatting: every dialogue rendered once for each participant, with that participant as the assistant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Turns whose numbers share a multiple of BLOCK are put in order together; longer dialogues split over tasks.
BLOCK = 128
SYSTEM = "system"
UNNAMED = "unknown"
END = "<|end|>\n"


def perspectives(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each turn and each participant (perspective) of its conversation.

    Every speaker but `system` is a participant. For perspective p the dialogue is the turns in order, each rendered as
    `<|system|>`, `<|assistant|>` (spoken by p) or `<|user name=X|>` (spoken by X), a line feed, the text and `<|end|>`
    with a line feed. Columns: conv_id, perspective, turn, speaker, as_role, segment, seg_start and seg_end (the
    segment's place in the rendered dialogue, in characters, end exclusive), trained (true for p's own turns), mask_start
    and mask_end (the trained text with its end mark; null where nothing is trained).

    Turns order by number (nulls first), then speaker and text; equal rows are rendered each, one after the other. A null
    text is empty, a null speaker is `unknown`, a null conversation id is one conversation; a conversation of system
    turns alone has no participant and no row. `<|` in a text or name becomes `< |`, so no text can forge a mark. Texts of
    any length are kept whole; an empty table gives an empty result; other columns of turns, of any name, aren't read.

    A dialogue never meets in one row: places come from running sums inside blocks of BLOCK turn numbers plus the sums of
    the blocks before, so a conversation of numbered turns may hold any share of the rows. Turns of one conversation
    without a number, or with the same one, are ordered by one task, which sorts them and spills. The text is shuffled
    twice: to meet the participants, and with each of them for the order inside the blocks.
    """
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    t = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("bigint").alias("turn"),
        safe(F.coalesce(F.col(speaker_col).cast("string"), F.lit(UNNAMED))).alias("speaker"),
        safe(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"),
    ).withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))))

    def head(own: bool) -> F.Column:
        other = F.concat(F.lit("<|user name="), F.col("speaker"), F.lit("|>\n"))
        return F.when(F.col("speaker") == SYSTEM, F.lit("<|system|>\n")).otherwise(F.lit("<|assistant|>\n") if own else other)

    size = lambda own: F.length(head(own)) + F.length("text") + len(END)
    sizes = t.groupBy("conv_id", "block", "speaker").agg(F.sum(size(False)).alias("plain"), F.sum(size(True)).alias("own"))
    blocks = sizes.groupBy("conv_id", "block").agg(F.sum("plain").alias("plain"))
    people = sizes.filter(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    gain = sizes.select(F.col("conv_id").alias("gc"), F.col("block").alias("gb"), F.col("speaker").alias("gs"), (F.col("own") - F.col("plain")).alias("gain"))
    seats = blocks.join(people, F.col("conv_id").eqNullSafe(F.col("c"))).join(
        gain, F.col("conv_id").eqNullSafe(F.col("gc")) & (F.col("block") == F.col("gb")) & (F.col("perspective") == F.col("gs")), "left"
    )
    before = W.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    seats = seats.select(
        F.col("conv_id").alias("c"), F.col("block").alias("b"), "perspective", F.coalesce(F.sum(F.col("plain") + F.coalesce("gain", F.lit(0))).over(before), F.lit(0)).alias("base")
    )
    rows = t.join(seats, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    mine = F.col("speaker") == F.col("perspective")
    header = F.when(mine, head(True)).otherwise(head(False))
    rows = rows.withColumn("segment", F.concat(header, F.col("text"), F.lit(END))).withColumn("head_size", F.length(header))
    upto = W.partitionBy("conv_id", "perspective", "block").orderBy(F.col("turn").asc_nulls_first(), "speaker", "text").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("seg_end", F.col("base") + F.sum(F.length("segment")).over(upto)).withColumn("seg_start", F.col("seg_end") - F.length("segment"))
    role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(mine, "assistant").otherwise("user")
    return rows.select(
        "conv_id", "perspective", "turn", "speaker", role.alias("as_role"), "segment", "seg_start", "seg_end", mine.alias("trained"),
        F.when(mine, F.col("seg_start") + F.col("head_size")).alias("mask_start"), F.when(mine, F.col("seg_end")).alias("mask_end"),
    )


#: What the query computes, as SQL for DuckDB.
SQL = """
WITH t AS (
  SELECT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
r AS (
  SELECT t.conv_id, perspective, turn, speaker, text,
    CASE WHEN speaker = 'system' THEN '<|system|>' WHEN speaker = perspective THEN '<|assistant|>' ELSE '<|user name=' || speaker || '|>' END || chr(10) AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
s AS (
  SELECT *, head || text || '<|end|>' || chr(10) AS segment,
    sum(length(head || text || '<|end|>' || chr(10))) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS UNBOUNDED PRECEDING) AS seg_end
  FROM r)
SELECT conv_id, perspective, turn, speaker,
  CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS as_role,
  segment, CAST(seg_end - length(segment) AS BIGINT) AS seg_start, CAST(seg_end AS BIGINT) AS seg_end, speaker = perspective AS trained,
  CASE WHEN speaker = perspective THEN CAST(seg_end - length(segment) + length(head) AS BIGINT) END AS mask_start,
  CASE WHEN speaker = perspective THEN CAST(seg_end AS BIGINT) END AS mask_end
FROM s
"""
