"""Cumulative-snapshot collapse and rendering of logged conversations (DataFrame functions only).

A log often holds a conversation many times, each time with more turns. Every turn gets a rolling hash of the
turns up to it (two 64-bit xors of hashes of position, role and text); a conversation whose full hash equals a
proper-prefix hash of another one is a snapshot of it and goes by an anti-join, and of equal conversations the
one with the smallest id stays. Only the turns of maximal conversations are then rendered.

Turns are ordered by ``turn``, ties by role and text; null turn numbers come first. Fully repeated rows count
once. Null roles and texts are empty. Rows without ``conv_id`` belong to no conversation and are left out; other
columns are ignored; an empty table gives an empty result.

A conversation's positions and prefix hashes are made in two levels: per block of ``_BLOCK`` turn numbers, then
over the blocks' sums, so that one very long conversation is no single task. A first turn shared by very many
conversations only meets pre-aggregated prefix hashes. The rendered text of one conversation is one value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aeris.llm.common import stored

_BLOCK = 512
_OPEN, _CLOSE = "<|", "|>"


def turns_of(log: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text") -> DataFrame:
    """Distinct turns with their position in the conversation and the prefix hash up to them."""
    own = log.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # repeated rows: equal hashes of the same conversation and turn
    own = own.withColumn("h1", F.xxhash64("role", "text")).withColumn("h2", F.xxhash64("text", F.lit(7), "role"))
    distinct = own.groupBy("conv", "turn", "h1", "h2").agg(F.first("role").alias("role"), F.first("text").alias("text")) \
        .withColumn("block", F.coalesce(F.floor(F.col("turn") / _BLOCK), F.lit(-(1 << 60))))
    inside = Window.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = distinct.withColumn("at", F.row_number().over(inside))
    sizes = distinct.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("conv", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    pos = placed.join(offsets, ["conv", "block"]).withColumn("pos", F.col("offset") + F.col("at")).drop("offset", "at")
    pos = pos.withColumn("p1", F.xxhash64("pos", "h1")).withColumn("p2", F.xxhash64("h2", "pos"))
    sums = pos.groupBy("conv", "block").agg(F.bit_xor("p1").alias("s1"), F.bit_xor("p2").alias("s2"))
    starts = sums.select("conv", "block", F.coalesce(F.bit_xor("s1").over(before), F.lit(0)).alias("b1"),
                         F.coalesce(F.bit_xor("s2").over(before), F.lit(0)).alias("b2"))
    upto = Window.partitionBy("conv", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return pos.join(starts, ["conv", "block"]).select(
        "conv", "pos", "role", "text", F.col("b1").bitwiseXOR(F.bit_xor("p1").over(upto)).alias("x1"),
        F.col("b2").bitwiseXOR(F.bit_xor("p2").over(upto)).alias("x2"))


def conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: its number of turns and full hash."""
    return turns.groupBy("conv").agg(F.max(F.struct("pos", "x1", "x2")).alias("last")) \
        .select("conv", F.col("last.pos").alias("n"), F.col("last.x1").alias("x1"), F.col("last.x2").alias("x2"))


def collapse(log: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text") -> DataFrame:
    """``conv_id, n_turns, n_equal, rendered`` of every maximal conversation; ``n_equal`` counts the
    conversations equal to it (itself included)."""
    turns = stored(turns_of(log, conv_col, turn_col, role_col, text_col), "chat-turns")
    whole = stored(conversations(turns), "chat-whole")
    distinct = whole.groupBy("n", "x1", "x2").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_equal"))
    # prefix hashes of one conversation per distinct text: the last turn is no proper prefix
    ends = distinct.select("conv", F.col("n").alias("full"))
    proper = turns.select("conv", "pos", "x1", "x2").join(ends, "conv").where("pos < full") \
        .select(F.col("pos").alias("n"), "x1", "x2").distinct()
    kept = distinct.join(proper, ["n", "x1", "x2"], "left_anti").select("conv", "n", "n_equal")
    one = F.concat(F.lit(_OPEN), F.col("role"), F.lit(_CLOSE + "\n"), F.col("text"), F.lit("\n"))
    line = F.struct("pos", one.alias("line"))
    shown = turns.join(kept, "conv").groupBy("conv").agg(
        F.max("n").alias("n_turns"), F.max("n_equal").alias("n_equal"), F.sort_array(F.collect_list(line)).alias("lines"))
    return shown.select(F.col("conv").alias("conv_id"), "n_turns", "n_equal",
                        F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("rendered"))
