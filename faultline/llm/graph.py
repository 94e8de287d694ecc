"""Connected components of an edge table, as joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.shared import settle
from .tables import with_group


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """`edges(a, b)` -> (node, root): every node of an edge with the smallest node of its component.

    Each round ties all larger neighbours of a node to its smallest neighbour, then the smaller ones too; the edges become stars
    after a number of rounds that grows with the logarithm of the longest path. A node may have a third of all edges: smallest
    neighbours are found per (node, salt) first and go back to the edges by both. Rounds are written to the shared folder, so
    lost executors cost one round. Only counts reach the driver.
    """
    now = settle(edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")

    def sign(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())

    last = sign(now)
    for _ in range(most_rounds):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        near = with_group(both, "u", "v", F.col("v")).withColumn("m", F.least("u", "_first"))
        large = near.filter("v > u and v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = with_group(settle(large, "edges"), "hi", "lo", F.col("lo"))
        # Each neighbour but the smallest is tied to the smallest; the smallest carries the node itself.
        upper = F.when(F.col("lo") == F.col("_first"), F.col("hi")).otherwise(F.col("lo"))
        now = settle(low.select(upper.alias("hi"), F.col("_first").alias("lo")).distinct(), "edges")
        seen = sign(now)
        if seen == last:
            break
        last = seen
    else:
        raise RuntimeError("components did not settle")
    nodes = now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
