"""Chat formatting: logged snapshots of a growing conversation collapse into the longest one, which is rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetledger.session import written_once

_BLOCK = 1024  # turns whose sums are run over in one window group
_HALVES = ["a", "b", "c", "d"]


def _numbered(turns: DataFrame) -> DataFrame:
    """Turns with their dense place in the conversation, 1 at first, and the rolling hash of all turns up to them.

    The hash of a prefix is the sum of the hashes of its turns, each salted with its place: four sums of 32-bit halves, which do not
    overflow. Sums run within blocks of turns first and over the blocks then, so no window holds a whole long conversation.
    """
    block = F.floor(F.coalesce("turn", F.lit(0)) / _BLOCK)
    rows = turns.withColumn("block", block)
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    sizes = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    same = F.col("r.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("r.block") == F.col("s.block"))
    placed = rows.withColumn("i", F.row_number().over(inside)).alias("r").join(sizes.alias("s"), same)
    placed = placed.select("r.conv_id", "r.turn", "r.role", "r.text", (F.col("i") + F.col("ahead")).alias("place"))
    mark = [F.coalesce(c, F.lit("")) for c in ("role", "text")] + [F.col(c).isNull() for c in ("role", "text")]
    one, two = F.xxhash64("place", *mark), F.xxhash64(F.lit("second"), *mark, "place")
    low = F.lit((1 << 32) - 1)
    halves = [one.bitwiseAND(low), F.shiftrightunsigned(one, 32), two.bitwiseAND(low), F.shiftrightunsigned(two, 32)]
    hashed = placed.select("*", F.floor(F.col("place") / _BLOCK).alias("block"), *[h.alias(c) for c, h in zip(_HALVES, halves)])
    sums = hashed.groupBy("conv_id", "block").agg(*[F.sum(c).alias(f"s{c}") for c in _HALVES])
    sums = sums.select("conv_id", "block", *[F.coalesce(F.sum(f"s{c}").over(ahead), F.lit(0)).alias(f"s{c}") for c in _HALVES])
    run = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rolled = hashed.select("*", *[F.sum(c).over(run).alias(f"r{c}") for c in _HALVES])
    totals = [(F.col(f"r{c}") + F.col(f"s{c}")).alias(c) for c in _HALVES]
    return rolled.alias("r").join(sums.alias("s"), same).select("r.conv_id", "r.role", "r.text", "r.place", *totals)


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, role, text, place, n_turns, n_logged): the turns of each conversation that no longer one begins with.

    A conversation is dropped if all its turns are the first turns of a longer one; of equal conversations the one with the smallest
    id stays. ``n_logged`` counts the equal conversations. Turns are put in order by ``turn`` (null first), then role and text; a repeated row counts once. A null
    role or text differs from an empty one. A null conv_id is a conversation of its own.
    """
    columns = [F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"), F.col("text").cast("string")]
    turns = written_once(_numbered(conversations.select(*columns).distinct()), "turns")
    lengths = turns.groupBy("conv_id").agg(F.max_by(F.struct(*_HALVES), "place").alias("whole"), F.max("place").alias("n_turns"))
    # a hash stands for one prefix: of its depth and its turns
    ends = lengths.groupBy("n_turns", "whole").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_logged"))
    starts = turns.alias("t").join(lengths.alias("l"), F.col("t.conv_id").eqNullSafe(F.col("l.conv_id")) & (F.col("place") < F.col("n_turns")))
    starts = starts.select(F.col("place").alias("n_turns"), F.struct(*[F.col(f"t.{c}") for c in _HALVES]).alias("whole")).distinct()
    kept = ends.join(starts, ["n_turns", "whole"], "left_anti").select("conv_id", "n_turns", "n_logged")
    same = F.col("t.conv_id").eqNullSafe(F.col("k.conv_id"))
    return turns.alias("t").join(kept.alias("k"), same).select("t.conv_id", "role", "text", "place", "n_turns", "n_logged")


def render(turns: DataFrame, part_turns: int = 1024) -> DataFrame:
    """(conv_id, part, n_turns, n_logged, text): conversations as ChatML text.

    A conversation of up to ``part_turns`` turns is one row. A longer one continues in the next parts, whose texts follow one another without
    anything between, so no task builds an unbounded text. A null role is rendered as ``unknown``, a null text as an empty one.
    """
    role, text = F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit(""))
    line = F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))
    part = F.floor((F.col("place") - 1) / part_turns).cast("bigint")
    grouped = turns.withColumn("line", line).withColumn("part", part).groupBy("conv_id", "part", "n_turns", "n_logged")
    lines = F.array_sort(F.collect_list(F.struct("place", "line")))
    return grouped.agg(F.array_join(F.transform(lines, lambda x: x["line"]), "").alias("text")).select(
        "conv_id", "part", F.col("n_turns").cast("bigint").alias("n_turns"), "n_logged", "text"
    )
