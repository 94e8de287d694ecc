"""Labels, folds and joins shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 64


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)).cast("int")


def held_out(doc_id: Column, folds: int, remainder: int) -> Column:
    return F.coalesce(fold(doc_id, folds) == remainder, F.lit(False))


def learning_labels(labels: DataFrame, column: str, folds: int, remainder: int) -> DataFrame:
    """(doc_id, y) with one row per labelled document outside the held-out fold; an id labelled both ways counts as 1."""
    rows = labels.select(F.col("doc_id").alias("doc_id"), F.col(column).cast("double").alias("y")).dropna()
    return rows.filter(~held_out(F.col("doc_id"), folds, remainder)).groupBy("doc_id").agg(F.max("y").alias("y"))


def with_group(rows: DataFrame, key: str, row_id: str, first: Column, salts: int = SALTS) -> DataFrame:
    """Add to each row the smallest `first` of its group, as `_first`, and the group's size, as `_size`.

    A group may hold a third of all rows: counts are summed per (key, salt), then per key, and the sums go back to the rows
    by (key, salt), so that no task gets more of a group than a 64th of it.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(row_id), F.lit(salts)).cast("int"))
    parts = salted.groupBy(key, "_salt").agg(F.min(first).alias("_first"), F.count(F.lit(1)).alias("_size"))
    sums = parts.groupBy(key).agg(
        F.min("_first").alias("_first"), F.sum("_size").alias("_size"), F.collect_list("_salt").alias("_salts")
    )
    return salted.join(sums.select(key, "_first", "_size", F.explode("_salts").alias("_salt")), [key, "_salt"]).drop("_salt")
