"""Chat formatting of logged conversations, after collapsing the snapshots that grow turn by turn.

A log may hold a conversation many times, each time with some more turns. The hash of a prefix is
rolled along the turns; a conversation whose whole hash is the hash of a prefix of a longer one is
dropped by an anti-join, and of equal ones the smallest id stays. What is left is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, written

PART = 1024
"""Turns that are rendered together at first, and turn numbers in a cut; a conversation's pieces are then joined."""


def _rows(turns: DataFrame) -> DataFrame:
    """``id, turn, role, text`` without nulls in all but ``turn``, and the ``cut`` of its number."""
    return turns.select(
        F.coalesce(F.col("conv_id").cast("bigint"), F.lit(NO_ID)).alias("id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("cut", F.floor(F.coalesce("turn", F.lit(NO_ID)) / PART))


def _cuts(rows: DataFrame) -> DataFrame:
    """``(id, cut, up, total)``: the turns before each cut and in the whole conversation."""
    own = Window.partitionBy("id")
    before = own.orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    return rows.groupBy("id", "cut").count().select(
        "id", "cut", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("up"), F.sum("count").over(own).alias("total")
    )


def rolled(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Per turn: ``id, pos, total`` and the hashes ``p1, p2`` of the conversation up to it.

    The prefix hash is the exclusive or of the turns' hashes, each of which covers its position, role
    and text, so it can be rolled within cuts and carried over from cut to cut. Turns are
    ordered by ``turn`` (nulls first), then role and text; positions count from 0 without gaps. Texts
    are shuffled only where some conversation repeats a turn's number, else their hashes are.
    """
    tied = rows.groupBy("id", "turn").count().where("count > 1").limit(1).count() > 0
    order = ["turn", "role", "text"] if tied else ["turn"]
    narrow = rows.select(
        "id", "cut", *order, F.xxhash64("role", "text").alias("t1"), F.xxhash64("text", "role").alias("t2")
    )
    within = Window.partitionBy("id", "cut").orderBy(*order)
    hashed = narrow.withColumn("n", F.row_number().over(within) - 1).join(cuts, ["id", "cut"]).withColumn(
        "pos", (F.col("n") + F.col("up")).cast("bigint")
    ).select("id", "cut", "pos", "total", F.xxhash64("pos", "t1").alias("h1"), F.xxhash64("t2", "pos").alias("h2"))
    before = Window.partitionBy("id").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    sums = hashed.groupBy("id", "cut").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    carried = sums.select("id", "cut", *[
        F.coalesce(F.bit_xor(x).over(before), F.lit(0)).alias(c) for x, c in (("x1", "c1"), ("x2", "c2"))
    ])
    running = Window.partitionBy("id", "cut").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return hashed.withColumns({"r1": F.bit_xor("h1").over(running), "r2": F.bit_xor("h2").over(running)}).join(
        carried, ["id", "cut"]
    ).select(
        "id", "pos", "total", F.col("r1").bitwiseXOR(F.col("c1")).alias("p1"), F.col("r2").bitwiseXOR(F.col("c2")).alias("p2"),
    )


def maximal(turns: DataFrame) -> DataFrame:
    """``(id, n_turns, n_copies)`` of the conversations which no other one continues; equal ones once."""
    is_last = F.col("pos") == F.col("total") - 1
    whole = turns.where(is_last).groupBy("pos", "p1", "p2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n_copies"))
    inner = turns.where(~is_last).select("pos", "p1", "p2").distinct()
    return whole.join(inner, ["pos", "p1", "p2"], "left_anti").select(
        "id", (F.col("pos") + 1).alias("n_turns"), "n_copies"
    )


def render(turns: DataFrame, parted: bool = False) -> DataFrame:
    """``conv_id, n_turns, n_copies, text`` for maximal conversations, a row each.

    A turn is rendered as ``<|role|>``, a line break, its text, a line break. ``n_copies`` counts the logged
    conversations equal to it. ``parted`` gives a row for each ``PART`` turns instead, numbered by a column ``part``; the
    texts of the parts in order are the conversation's. It is for conversations too long for one row.

    Texts are shuffled once, by conversation and cut; only what lies in several cuts or parts is put together
    from its pieces.

    Null role or text: empty. Null conv_id: all such turns are one conversation, below all ids. Null
    turn: before the others. Turns with one number are ordered by role and text, repeats are turns of
    their own. Empty table: empty result. Further columns are not read.
    """
    rows = _rows(turns)
    cuts = written(_cuts(rows), "cuts")
    kept = maximal(written(rolled(rows, cuts), "turns"))
    wanted = written(cuts.join(kept, "id").select("id", "cut", "up", "n_turns", "n_copies"), "conversations")
    within = Window.partitionBy("id", "cut").orderBy("turn", "role", "text")
    placed = rows.join(wanted, ["id", "cut"]).withColumn("pos", F.row_number().over(within) - 1 + F.col("up"))
    line = F.struct("pos", F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n")).alias("t"))

    def joined(column: str) -> Column:
        return F.array_join(F.transform(F.sort_array(F.collect_list(column)), lambda x: x["t"]), "")

    keys = ["id", "part", "n_turns", "n_copies"]
    pieces = placed.withColumn("part", F.floor(F.col("pos") / PART)).withColumn("line", line).groupBy("cut", *keys).agg(
        joined("line").alias("text"), F.count(F.lit(1)).alias("size"), F.min("pos").alias("start")
    )
    is_whole = F.col("size") == F.least(F.lit(PART), F.col("n_turns") - F.col("part") * PART)
    whole = pieces.where(is_whole).select(*keys, "text")
    split = pieces.where(~is_whole).withColumn("piece", F.struct("start", F.col("text").alias("t"))).groupBy(*keys).agg(
        joined("piece").alias("text")
    )
    parts = whole.unionByName(split)
    if not parted:
        one = parts.where(F.col("n_turns") <= PART).select("id", "n_turns", "n_copies", "text")
        piece = F.struct(F.col("part").alias("start"), F.col("text").alias("t"))
        more = parts.where(F.col("n_turns") > PART).withColumn("piece", piece).groupBy("id", "n_turns", "n_copies").agg(joined("piece").alias("text"))
        parts = one.unionByName(more)
    return parts.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("conv_id"), *(["part"] if parted else []), "n_turns", "n_copies", "text"
    )
