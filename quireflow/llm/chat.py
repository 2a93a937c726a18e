"""Chat formatting with cumulative-snapshot collapse.

Logs often hold the same conversation many times, each snapshot a prefix of the next. Every turn gets rolling prefix
hashes: two running exclusive-ors of 64-bit hashes of (position, role, text), over the turns in order. A conversation whose
last hashes occur, at the same position, inside another one is a prefix of it: an anti-join leaves the maximal ones. Of
equal conversations the smallest conv_id stays. The distinct inner prefixes combine before the shuffle, so one very
common first turn is one row.

Turns are in order of (turn, role, text), nulls first. Null roles render as "unknown" and null texts as empty; a null text and an
empty one hash apart. Rows without conv_id count as one conversation. A repeated row is one more turn. Markers inside
texts are broken with a space, so that no text can open or close a turn. Empty tables give none. Very long conversations are one
row each, as a chat has to be. Columns other than conv_id, turn, role and text take no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireflow.llm.common import cut


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, role, text with pos (from 1), n (turns of the conversation) and the prefix hashes h1 and h2."""
    whole = Window.partitionBy("conv_id")
    order = whole.orderBy("turn", "role", "text")
    placed = turns.select("conv_id", "turn", "role", "text", F.row_number().over(order).alias("pos"), F.count("*").over(whole).alias("n"))
    so_far = whole.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    mark = lambda salt: F.xxhash64(F.lit(salt), "pos", F.col("role").isNull(), "role", F.col("text").isNull(), "text")
    return placed.select("conv_id", "role", "text", "pos", "n", F.bit_xor(mark(1)).over(so_far).alias("h1"), F.bit_xor(mark(2)).over(so_far).alias("h2"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id of each conversation that no other one continues, one for equal ones."""
    hashed = cut(prefix_hashes(turns).select("conv_id", "pos", "n", "h1", "h2"))  # texts end here: the two branches share a small table
    inner = hashed.where("pos < n").select("pos", "h1", "h2").distinct()
    ends = hashed.where("pos = n").groupBy(F.col("pos"), "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    return ends.join(inner, ["pos", "h1", "h2"], "left_anti").select("conv_id")


def rendered_turn(role: Column, text: Column) -> Column:
    safe = lambda c: F.regexp_replace(c, r"<\|im_", "< |im_")
    return F.concat(F.lit("<|im_start|>"), safe(F.coalesce(role, F.lit("unknown"))), F.lit("\n"), safe(F.coalesce(text, F.lit(""))), F.lit("<|im_end|>\n"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, rendered: one row per maximal conversation."""
    kept = maximal_conversations(turns).select(F.col("conv_id").alias("kept_id"))
    rows = turns.select("conv_id", "turn", "role", "text").join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id")), "left_semi")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda x: rendered_turn(x["role"], x["text"]))
    return rows.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_join(parts, "").alias("rendered"))
