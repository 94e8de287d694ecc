"""Nested spans: opening and closing markers matched by depth, without one task per key.

The depth after a marker is the running sum of +1 and -1, held at zero where a closing marker has nothing to close. Inside a block of
positions it needs two running values, the sum and its lowest point; a block hands on the same two numbers, so the depth that enters
each block comes from one small row per block. Markers of one depth take turns, opening and closing: an opening marker is
closed by the next closing one of its depth.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocked import block_of, carry_forward
from .shared import settle


def with_depth(marks: DataFrame, keys: Sequence[str], pos: str, step: str) -> DataFrame:
    """Add `level`: of an opening marker (step +1) the depth it opens, of a closing one (-1) the depth it closes, null if it closes nothing.

    `pos` is unique per key. One row per block and key goes through a window of the key.
    """
    cut = marks.withColumn("_blk", block_of(F.col(pos)))
    upto = Window.partitionBy(*keys, "_blk").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    above = Window.partitionBy(*keys, "_blk").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    summed = settle(cut.withColumn("_sum", F.sum(step).over(upto)), "depth-sums")
    low = summed.withColumn("_low", F.min("_sum").over(above))
    # What a block does to any depth that enters it: its own sum, and the lowest point on the way.
    blocks = summed.groupBy(*keys, "_blk").agg(F.sum(step).alias("_end"), F.min("_sum").alias("_least"))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    through = blocks.withColumn("_in", F.coalesce(F.sum("_end").over(before), F.lit(0)))
    through = through.withColumn("_floor", F.least(F.lit(0), F.coalesce(F.min(F.col("_in") + F.col("_least")).over(before), F.lit(0))))
    carried = through.select(*keys, "_blk", (F.col("_in") - F.col("_floor")).alias("_carry"))
    sums = low.join(carried, [*keys, "_blk"])
    now = F.col("_carry") + F.col("_sum")
    floor = F.least(F.lit(0), F.coalesce(F.col("_carry") + F.col("_low"), F.lit(0)))
    level = F.when(F.col(step) > 0, now - floor).when(now >= floor, now - floor + 1)
    return sums.select(*marks.columns, level.cast("int").alias("level"))


def matched(marks: DataFrame, keys: Sequence[str], pos: str, step: str) -> DataFrame:
    """The opening markers with `level` and `end`: the position of the marker that closes each, null if none does."""
    levels = with_depth(marks, keys, pos, step).filter(F.col("level").isNotNull())
    # Seen from the end, the last closing marker of a level is the next one below.
    turned = levels.withColumn("_back", -F.col(pos).cast("bigint"))
    ended = carry_forward(turned, [*keys, "level"], "_back", last={"end": F.when(F.col(step) < 0, F.col(pos).cast("bigint"))})
    return ended.filter(F.col(step) > 0).select(*marks.columns, "level", "end")


def with_parents(spans: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Add `depth` (1 for an outermost span) and `parent` (the start of the innermost span around it, null without one).

    Spans of a key nest: two of them share nothing, or one holds the other. `end` may be null for a span that never ends.
    """
    spans = settle(spans, "spans")
    opened = spans.select("*", F.col(start).cast("bigint").alias("_at"), F.lit(1).alias("_turn"))
    closed = spans.filter(F.col(end).isNotNull()).select(*keys, F.col(end).cast("bigint").alias("_at"), F.lit(-1).alias("_turn"))
    both = opened.unionByName(closed, allowMissingColumns=True)
    deep = carry_forward(both, keys, "_at", sums={"depth": F.col("_turn")}).filter(F.col("_turn") > 0)
    deep = settle(deep.drop("_turn").withColumn("depth", F.col("depth").cast("int")), "depths")
    # Each span asks, at the depth above its own, for the newest opening before it.
    asked = deep.select("*", (F.col("depth") - 1).alias("_level"), F.lit(None).cast("bigint").alias("_open"))
    offered = deep.select(*keys, "_at", F.col("depth").alias("_level"), F.col("_at").alias("_open"))
    found = carry_forward(asked.unionByName(offered, allowMissingColumns=True), [*keys, "_level"], "_at", last={"parent": F.col("_open")})
    return found.filter(F.col("_open").isNull()).select(*spans.columns, "depth", "parent")
