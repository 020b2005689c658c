"""Chat formatting of logged conversations, without snapshots of longer ones; DataFrames only.

A log often holds a conversation again and again as it grows. A conversation whose turns are
the first turns of a longer one, or of an equal one with a smaller id, is a snapshot and is
left out; the others are rendered.

Prefixes are known by a rolling hash: the exclusive or of the turns' hashes, each of which covers the
turn's position, role and text, in two independent words. It is a running sum over blocks of
``BLOCK`` turn numbers and then inside a block, so no task needs a whole conversation. A conversation is a
snapshot when its own hash and length occur as a prefix of another, by an anti-join.

Rendering gives one row per block of turns (a single one for most conversations), so a row's text is
bounded by its block. Defined cases: turns are ordered by number, then role and text, nulls first; rows
that repeat a turn exactly count once; a null role is ``unknown`` and a null text empty. Rows
with a null conversation id are one conversation each and are left out, as nothing names them. Marks inside a text are broken up,
so that a text cannot forge a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.session import stored

BLOCK = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def rendered_turn(role: Column, text: Column) -> Column:
    """One turn between marks; marks in the role or text lose their bar."""

    def plain(c: Column) -> Column:
        return F.replace(c, F.lit("<|im_"), F.lit("<im_"))

    return F.concat(F.lit(OPEN), plain(role), F.lit("\n"), plain(text), F.lit(CLOSE + "\n"))


def positions(turns: DataFrame) -> DataFrame:
    """Distinct turns with their block and position in the conversation, from 1."""
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    block = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))).cast("bigint")
    rows = rows.distinct().withColumn("block", block)
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("place", F.row_number().over(inside))
    sizes = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("conv_id", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"))
    rows = rows.join(first, ["conv_id", "block"]).withColumn("position", F.col("first") + F.col("place"))
    return stored(rows.select("conv_id", "block", "position", "role", "text"), "turns")


def prefix_hashes(rows: DataFrame) -> DataFrame:
    """``(conv_id, position, h1, h2)``: the rolling hash of the first ``position`` turns."""
    hashed = rows.select(
        "conv_id",
        "block",
        "position",
        F.xxhash64(F.lit(1), "position", "role", "text").alias("a"),
        F.xxhash64(F.lit(2), "text", "position", "role").alias("b"),
    )
    totals = hashed.groupBy("conv_id", "block").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    totals = totals.select(
        "conv_id",
        "block",
        F.coalesce(F.bit_xor("a").over(earlier), zero).alias("before_a"),
        F.coalesce(F.bit_xor("b").over(earlier), zero).alias("before_b"),
    )
    running = Window.partitionBy("conv_id", "block").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    inside = hashed.withColumn("in_a", F.bit_xor("a").over(running)).withColumn("in_b", F.bit_xor("b").over(running))
    both = inside.join(totals, ["conv_id", "block"])
    return both.select(
        "conv_id",
        "position",
        F.col("before_a").bitwiseXOR(F.col("in_a")).alias("h1"),
        F.col("before_b").bitwiseXOR(F.col("in_b")).alias("h2"),
    )


def maximal_conversations(rows: DataFrame) -> DataFrame:
    """``(conv_id, n_turns)`` of the conversations that begin no other one.

    Equal conversations are first reduced to the one of smallest id, so that a prefix met by very
    many copies is one row on either side of the anti-join.
    """
    prefixes = prefix_hashes(rows)
    lengths = rows.groupBy("conv_id").agg(F.max("position").alias("n_turns"))
    marked = stored(prefixes.join(lengths, "conv_id"), "prefixes")
    whole = marked.where(F.col("position") == F.col("n_turns"))
    whole = whole.groupBy("h1", "h2", "n_turns").agg(F.min("conv_id").alias("conv_id"))
    proper = marked.where(F.col("position") < F.col("n_turns")).select("h1", "h2", F.col("position").alias("n_turns")).distinct()
    return whole.join(proper, ["h1", "h2", "n_turns"], "left_anti").select("conv_id", "n_turns")


def format_chats(turns: DataFrame) -> DataFrame:
    """Rendered maximal conversations of ``turns`` (``conv_id``, ``turn``, ``role``, ``text``).

    Returns ``conv_id, n_turns, piece, first_turn, chat``; pieces count from 0 and joined in order give the
    conversation.
    """
    rows = positions(turns)
    kept = maximal_conversations(rows)
    # Blocks by position, so that sparse turn numbers do not make many pieces.
    piece = F.floor((F.col("position") - 1) / BLOCK).cast("int").alias("piece")
    texts = rows.join(kept, "conv_id").select("conv_id", "n_turns", piece, "position", rendered_turn(F.col("role"), F.col("text")).alias("turn_text"))
    ordered = F.sort_array(F.collect_list(F.struct("position", "turn_text")))
    parts = texts.groupBy("conv_id", "n_turns", "piece").agg(F.min("position").alias("first_turn"), ordered.alias("turns"))
    return parts.select("conv_id", "n_turns", "piece", "first_turn", F.array_join(F.col("turns.turn_text"), "").alias("chat"))


SQL = """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS position FROM turns
), keyed AS (
  SELECT conv_id, position, count(*) OVER (PARTITION BY conv_id) AS n_turns,
    string_agg(length(role) || ':' || role || length(text) || ':' || text, '')
      OVER (PARTITION BY conv_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS prefix
  FROM placed
), whole AS (
  SELECT min(conv_id) AS conv_id, n_turns, prefix FROM keyed WHERE position = n_turns GROUP BY n_turns, prefix
), kept AS (
  SELECT conv_id, n_turns FROM whole w
  WHERE NOT EXISTS (SELECT 1 FROM keyed k WHERE k.position < k.n_turns AND k.position = w.n_turns AND k.prefix = w.prefix)
)
SELECT conv_id, n_turns, CAST(floor((position - 1) / 256) AS INTEGER) AS piece, min(position) AS first_turn,
  string_agg('<|im_start|>' || replace(role, '<|im_', '<im_') || chr(10) || replace(text, '<|im_', '<im_')
    || '<|im_end|>' || chr(10), '' ORDER BY position) AS chat
FROM placed JOIN kept USING (conv_id)
GROUP BY 1, 2, 3
"""
