"""Logged conversations: snapshots collapse into the longest, then rendering.

A chat that is logged after every turn leaves many rows that are prefixes of
later ones.  All steps are DataFrame operations:

1. Turns get their position in the conversation; positions and prefix hashes are
   summed up in two steps, over pieces of ``PIECE`` turns, so that one very long
   conversation is not a single task.
2. The hash of a prefix is the exclusive or of its turns' hashes, each taken with
   its position, in 128 bits.
3. One conversation of each group of equal ones is kept (the least conv_id);
   an anti-join drops those whose whole hash is the hash of a shorter prefix of
   another.  Hashes are made unique before the join, so no key is hot.
4. What is left is rendered in parts of at most ``PIECE`` turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.llm.common import saved

PIECE = 1024


def _turn_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "position", "role", "text")


def _positions(turns: DataFrame, piece: int) -> DataFrame:
    """Number the turns of each conversation from 1, and cut them into pieces.

    Equal turn numbers are ordered by role and text.  Pieces follow the given
    turn numbers; those with more rows than planned only make larger pieces.
    """
    group = turns.withColumn("piece", F.floor(F.coalesce("turn", F.lit(-1)) / piece).cast("bigint"))
    sizes = group.groupBy("conv_id", "piece").agg(F.count(F.lit(1)).alias("rows"))
    ahead = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("conv_id", "piece", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("conv_id", "piece").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    numbered = group.withColumn("place", F.row_number().over(inside)).join(sizes, ["conv_id", "piece"])
    return numbered.select("conv_id", "piece", (F.col("ahead") + F.col("place")).alias("position"), "role", "text")


def _prefixes(turns: DataFrame) -> DataFrame:
    """Rolling hashes (one, two) of the turns up to each position."""
    marks = turns.select("conv_id", "piece", "position", _turn_hash(11).alias("h1"), _turn_hash(23).alias("h2"))
    whole = marks.groupBy("conv_id", "piece").agg(F.bit_xor("h1").alias("p1"), F.bit_xor("h2").alias("p2"))
    ahead = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    whole = whole.select("conv_id", "piece", F.coalesce(F.bit_xor("p1").over(ahead), zero).alias("p1"), F.coalesce(F.bit_xor("p2").over(ahead), zero).alias("p2"))
    inside = Window.partitionBy("conv_id", "piece").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    rolled = marks.select("conv_id", "piece", "position", F.bit_xor("h1").over(inside).alias("h1"), F.bit_xor("h2").over(inside).alias("h2"))
    return rolled.join(whole, ["conv_id", "piece"]).select(
        "conv_id", "position", F.col("h1").bitwiseXOR(F.col("p1")).alias("one"), F.col("h2").bitwiseXOR(F.col("p2")).alias("two")
    )


def maximal_turns(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """The turns (conv_id, piece, position, role, text) of the conversations that
    are no prefix of another.

    conversations: conv_id, turn, role, text; other columns are ignored.  Turns
    go by ``turn`` (null first), then role, then text; repeated rows are turns of
    their own.  A null role or text differs from an empty one.  Of equal
    conversations the least conv_id stays.  Rows without conv_id are left out.
    """
    turns = conversations.filter("conv_id is not null").select("conv_id", "turn", "role", "text")
    turns = saved(_positions(turns, piece), "turns")
    prefixes = saved(_prefixes(turns), "prefixes")
    ends = prefixes.groupBy("conv_id").agg(F.max("position").alias("position"))
    whole = prefixes.join(ends, ["conv_id", "position"])
    one_each = whole.groupBy("position", "one", "two").agg(F.min("conv_id").alias("conv_id"))
    inner = prefixes.join(ends.select("conv_id", F.col("position").alias("last")), "conv_id").filter("position < last")
    kept = one_each.join(inner.select("position", "one", "two").distinct(), ["position", "one", "two"], "left_anti")
    return turns.join(kept.select("conv_id"), "conv_id", "left_semi")


def rendered(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """(conv_id, part, n_turns, text): the maximal conversations as chat markup.

    Each turn is ``<|im_start|>role\\ntext<|im_end|>\\n``; a null role is written
    ``unknown`` and a null text as nothing.  Parts follow the pieces of the turn
    numbers, from 1; a conversation's parts in order are its whole text.
    """
    turns = maximal_turns(conversations, piece)
    line = F.concat(
        F.lit("<|im_start|>"), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n")
    )
    lines = F.sort_array(F.collect_list(F.struct("position", line.alias("line"))))
    parts = turns.groupBy("conv_id", "piece").agg(F.count(F.lit(1)).alias("n_turns"), F.array_join(F.transform(lines, lambda x: x["line"]), "").alias("text"))
    part = F.row_number().over(Window.partitionBy("conv_id").orderBy("piece"))
    return parts.select("conv_id", part.cast("bigint").alias("part"), "n_turns", "text")
