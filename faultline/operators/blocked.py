"""Ordered work inside a key without putting a whole key into one task.

A window over `log_id` puts one log on one core. Here every key is cut into blocks, the window runs inside a
block, and only one small row per block is carried across blocks. A key may then be as long as it likes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def block_of(pos: Column, size: int = BLOCK) -> Column:
    """Block number of a position. Never null, so that a join on it adds no filter and equal scans stay equal."""
    return F.coalesce(F.floor(pos / F.lit(size)).cast("bigint"), F.lit(0))


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column, name: str, start: int = 0
) -> DataFrame:
    """Running number inside each key; `slice_by` must rise with `order` and bounds the size of one sort."""
    cut = df.withColumn("_slice", slice_by)
    sizes = cut.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    return (
        cut.join(offsets, [*keys, "_slice"])
        .withColumn(name, (F.col("_off") + F.row_number().over(inside) - 1 + start).cast("bigint"))
        .drop("_slice", "_off")
    )


def carry_forward(
    df: DataFrame, keys: Sequence[str], pos: str, last: Mapping[str, Column] | None = None,
    sums: Mapping[str, Column] | None = None, block: Column | None = None, inclusive: bool = True,
) -> DataFrame:
    """Add running values by key and position: `last` non-null value, and `sums`, up to the row.

    With `inclusive=False` the row itself does not count.
    """
    last, sums = dict(last or {}), dict(sums or {})
    block = block_of(F.col(pos)) if block is None else block
    cut = df.select("*", block.alias("_blk"), *[v.alias(f"_v_{n}") for n, v in {**last, **sums}.items()])
    ends = cut.groupBy(*keys, "_blk").agg(
        *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(pos))).alias(f"_e_{n}") for n in last],
        *[F.sum(f"_v_{n}").alias(f"_e_{n}") for n in sums],
    )
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(
        *keys, "_blk",
        *[F.last(f"_e_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in last],
        *[F.sum(f"_e_{n}").over(before).alias(f"_c_{n}") for n in sums],
    )
    inside = Window.partitionBy(*keys, "_blk").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    zero = F.lit(0)
    return cut.join(carry, [*keys, "_blk"], "left").select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(inside), F.col(f"_c_{n}")).alias(n) for n in last],
        *[
            (F.coalesce(F.sum(f"_v_{n}").over(inside), zero) + F.coalesce(F.col(f"_c_{n}"), zero)).alias(n)
            for n in sums
        ],
    )


def attach_last(df: DataFrame, states: DataFrame, keys: Sequence[str], pos: str, name: str) -> DataFrame:
    """Add the newest state at or before the row, by key and position: an as-of join with one shuffle of the rows.

    `states(keys, pos, name)` is usually much smaller than `df`; only it is summed up per block.
    """
    block = block_of(F.col(pos))
    rows = df.withColumn(name, F.lit(None).cast(states.schema[name].dataType)).withColumn("_own", F.lit(1))
    marks = states.select(*keys, pos, name).withColumn("_own", F.lit(0))
    both = rows.unionByName(marks, allowMissingColumns=True).withColumn("_blk", block)
    ends = states.groupBy(*keys, block.alias("_blk")).agg(F.max_by(name, pos).alias("_e"))
    blocks = df.select(*keys, block.alias("_blk")).distinct()
    carry = _carried(blocks, ends, keys)
    inside = Window.partitionBy(*keys, "_blk").orderBy(pos, "_own").rowsBetween(Window.unboundedPreceding, 0)
    return (
        both.join(carry, [*keys, "_blk"], "left")
        .withColumn(name, F.coalesce(F.last(name, ignorenulls=True).over(inside), F.col("_c")))
        .filter(F.col("_own") == 1).select(*df.columns, name)
    )


def _carried(blocks: DataFrame, ends: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For every block the state carried into it from the blocks before."""
    marked = blocks.withColumn("_e", F.lit(None).cast(ends.schema["_e"].dataType)).unionByName(ends)
    merged = marked.groupBy(*keys, "_blk").agg(F.first("_e", ignorenulls=True).alias("_e"))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    return merged.select(*keys, "_blk", F.last("_e", ignorenulls=True).over(before).alias("_c")).filter(F.col("_c").isNotNull())


def with_halo(df: DataFrame, pos: str, reach: int, size: int = BLOCK) -> DataFrame:
    """Copy rows near a block edge into the neighbour block, so a window of `reach` rows never leaves its block.

    Adds `_blk` and `_core` (true on the one copy that belongs to the block).
    """
    p = F.col(pos)
    blocks = F.sequence(block_of(F.greatest(p - reach, F.lit(0)), size), block_of(p + reach, size))
    return df.withColumn("_blk", F.explode(blocks)).withColumn("_core", F.col("_blk") == block_of(p, size))


def spans_to_blocks(spans: DataFrame, start: str, end: str, size: int = BLOCK) -> DataFrame:
    """One row per block that the closed range [start, end] touches, for an equi-join instead of a range join."""
    s, e = F.col(start), F.col(end)
    return spans.filter(e >= s).withColumn("_blk", F.explode(F.sequence(block_of(s, size), block_of(e, size))))


def last_rows(df: DataFrame, keys: Sequence[str], pos: str, count: int) -> DataFrame:
    """The last `count` rows of each key by position. Only blocks that can hold such rows are sorted, each by itself."""
    cut = df.withColumn("_blk", block_of(F.col(pos)))
    sizes = cut.groupBy(*keys, "_blk").agg(F.count("*").alias("_n"))
    after = Window.partitionBy(*keys).orderBy(F.desc("_blk")).rowsBetween(Window.unboundedPreceding, -1)
    held = sizes.select(*keys, "_blk", F.coalesce(F.sum("_n").over(after), F.lit(0)).alias("_above")).filter(F.col("_above") < count)
    inside = Window.partitionBy(*keys, "_blk").orderBy(F.desc(pos))
    ranked = cut.join(held, [*keys, "_blk"]).withColumn("_r", F.col("_above") + F.row_number().over(inside))
    return ranked.filter(F.col("_r") <= count).select(*df.columns)
