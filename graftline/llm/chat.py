"""Chat formatting by multi-party perspective rotation, with DataFrame functions only.

For every participant of a conversation the dialogue is rendered once with that speaker as
``assistant`` and all others as named users; the mask marks what the speaker said (text and end
mark) as the part to train on. Turns of the role ``system`` belong to nobody: they stay system turns
in every rendering, are never masked in, and give no perspective of their own.

A dialogue comes in blocks of ``BLOCK`` consecutive turn numbers, one row each, so that a usual
conversation is one row and no task gathers a conversation of unbounded length; the blocks of a
perspective in order are the whole rendering. ``LAYER`` rows of a turn number share a part of its
block on average: a turn number with n rows is dealt over ceil(n / LAYER) parts, by a hash of role,
text and the row's place among its equals, so that neither crowded turn numbers nor repeated rows
gather in a task. With at most ``LAYER`` rows per turn number, all parts are 0. Every part is a row of
its own, and parts go by number within a block.

Edge cases: a null role is the participant ``unknown`` and a null text is empty; a null turn comes
first and counts as turn 0 of its block; equal turn numbers are ordered by role, then text; repeated
rows are repeated turns; rows with a null conv_id form one conversation; a conversation of system
turns alone has no participant and no row. Control marks inside texts and names are broken up, line
ends in names become blanks. A very long text is rendered whole, once per participant. An empty table
gives an empty result. Further columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

START, END = "<|im_start|>", "<|im_end|>"
#: Turn numbers per block, and rows of a turn number that share a part.
BLOCK = 64
LAYER = 4
SYSTEM = "system"


def _plain(c: Column) -> Column:
    """Text without working control marks."""
    return F.replace(F.coalesce(c, F.lit("")), F.lit("<|im_"), F.lit("<| im_"))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           block: int = BLOCK, layer: int = LAYER) -> DataFrame:
    """One row per conversation, perspective, block and part: conv_id, perspective, block, part,
    n_turns, n_own, n_chars, text, mask; mask: array of (start, end) character spans of ``text`` to
    train on."""
    role = F.translate(_plain(F.coalesce(F.col(role_col), F.lit("unknown"))), "\r\n", "  ")
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("bigint").alias("_turn"), role.alias("_role"), _plain(F.col(text_col)).alias("_text"))
    same = lambda a, b: a["conv_id"].eqNullSafe(b["_conv"])
    # Equal rows become one with their number, and are numbered again in two steps: a step's array
    # has the root of that number of items.
    counted = rows.groupBy("conv_id", "_turn", "_role", "_text").agg(F.count(F.lit(1)).alias("_copies"))
    step = F.ceil(F.sqrt("_copies"))
    none = F.lit(0).cast("bigint")
    counted = counted.select("*", step.alias("_step")).select("*", F.explode(F.sequence(none, F.floor((F.col("_copies") - 1) / F.col("_step")))).alias("_tens"))
    ones = F.sequence(F.col("_tens") * F.col("_step"), F.least((F.col("_tens") + 1) * F.col("_step"), F.col("_copies")) - 1)
    numbered = counted.select("conv_id", "_turn", "_role", "_text", F.explode(ones).alias("_nth"))
    per_turn = rows.groupBy("conv_id", "_turn").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > layer)
    per_turn = per_turn.select(F.col("conv_id").alias("_conv"), F.col("_turn").alias("_at"), F.ceil(F.col("_n") / layer).alias("_ways"))
    rows = numbered.join(per_turn, same(numbered, per_turn) & F.col("_turn").eqNullSafe(F.col("_at")), "left")
    deal = F.conv(F.substring(F.md5(F.concat_ws("\n", "_role", "_text", F.col("_nth").cast("string"))), 1, 8), 16, 10).cast("bigint") % F.col("_ways")
    rows = rows.select(
        "conv_id", F.floor(F.coalesce("_turn", none) / F.lit(block)).cast("bigint").alias("block"), F.coalesce(deal, none).alias("part"), "_turn", "_role", "_text")

    blocks = rows.groupBy("conv_id", "block", "part").agg(F.array_sort(F.collect_list(F.struct(
        F.coalesce("_turn", F.lit(-(1 << 63)).cast("bigint")).alias("turn"), F.col("_role").alias("role"), F.col("_text").alias("text")))).alias("_turns"))
    speakers = rows.where(F.col("_role") != SYSTEM).select(F.col("conv_id").alias("_conv"), F.col("_role").alias("perspective")).distinct()
    views = blocks.join(speakers, same(blocks, speakers)).drop("_conv")

    own = lambda t: t["role"] == F.col("perspective")
    head = lambda t: F.concat(
        F.lit(START), F.when(t["role"] == SYSTEM, F.lit("system")).when(own(t), F.lit("assistant")).otherwise(F.concat(F.lit("user name="), t["role"])), F.lit("\n"))
    segments = F.transform("_turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"), own(t).alias("own")))
    views = views.select("conv_id", "perspective", "block", "part", segments.alias("_segments"))
    size = lambda s: F.length(s["head"]) + F.length(s["body"]) + 1
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    walked = F.aggregate("_segments", start, lambda acc, s: F.struct(
        (acc["at"] + size(s)).alias("at"),
        F.when(s["own"], F.concat(acc["spans"], F.array(F.struct(
            (acc["at"] + F.length(s["head"])).alias("start"), (acc["at"] + size(s) - 1).alias("end"))))).otherwise(acc["spans"]).alias("spans")))
    text = F.array_join(F.transform("_segments", lambda s: F.concat(s["head"], s["body"], F.lit("\n"))), "")
    out = views.select("conv_id", "perspective", "block", "part", F.size("_segments").cast("bigint").alias("n_turns"), text.alias("text"), walked["spans"].alias("mask"))
    return out.select("conv_id", "perspective", "block", "part", "n_turns", F.size("mask").cast("bigint").alias("n_own"), F.length("text").cast("bigint").alias("n_chars"), "text", "mask")


def op1_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The renderings, the mask written as ``start-end`` spans joined by commas."""
    r = rotate(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["end"].cast("string"))), ",")
    return r.select("conv_id", "perspective", "block", "part", "n_turns", "n_own", "n_chars", "text", spans.alias("mask"))


ORACLE_SQL = r"""
WITH raw AS (
  SELECT conv_id, turn, translate(replace(coalesce(role, 'unknown'), '<|im_', '<| im_'), chr(13) || chr(10), '  ') AS role, replace(coalesce(text, ''), '<|im_', '<| im_') AS text FROM conversations),
nth AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn, role, text) - 1 AS j, ceil(count(*) OVER (PARTITION BY conv_id, turn) / 4.0) AS ways FROM raw),
t AS (
  SELECT conv_id, turn, CAST(floor(coalesce(turn, 0) / 64.0) AS BIGINT) AS block, role, text,
         CAST('0x' || substr(md5(role || chr(10) || text || chr(10) || j), 1, 8) AS BIGINT) % CAST(ways AS BIGINT) AS part FROM nth),
who AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
seg AS (
  SELECT t.conv_id, w.perspective, t.block, t.part, t.turn, t.role, t.text, t.role = w.perspective AS own,
         '<|im_start|>' || CASE WHEN t.role = 'system' THEN 'system' WHEN t.role = w.perspective THEN 'assistant' ELSE 'user name=' || t.role END || chr(10) AS head,
         t.text || '<|im_end|>' AS body
  FROM t JOIN who w ON t.conv_id IS NOT DISTINCT FROM w.conv_id),
placed AS (
  SELECT *, row_number() OVER w AS i, CAST(sum(length(head) + length(body) + 1) OVER w AS BIGINT) AS stop
  FROM seg WINDOW w AS (PARTITION BY conv_id, perspective, block, part ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, perspective, block, part, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_own, CAST(max(stop) AS BIGINT) AS n_chars,
       string_agg(head || body || chr(10), '' ORDER BY i) AS text,
       coalesce(string_agg(CASE WHEN own THEN CAST(stop - length(body) - 1 AS VARCHAR) || '-' || CAST(stop - 1 AS VARCHAR) END, ',' ORDER BY i), '') AS mask
FROM placed GROUP BY conv_id, perspective, block, part
"""
