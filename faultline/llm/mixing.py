"""Mixing sources to target weights: nested hash thresholds found on histograms, without sorting documents.

Each document has a 40-bit hash of its id. Sizes are summed by source and the first ten bits of the hash; the bucket in which a
source's budget ends is split by the next ten bits, and so on four times. A document is taken if its hash lies below its
source's threshold. Only DataFrame operations are used; the driver sees nothing of the data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.shared import settle
from .exact import with_plain_spaces

BITS = 40
STEP = 10


@dataclass(frozen=True)
class Mix:
    """Weights go round over the sources by code point, null last. `share`: the size of the mix against that of all documents;
    `most`: how often a document may be taken at most."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.5
    most: int = 2


def word_count(docs: DataFrame, out: str = "size") -> DataFrame:
    """Add the number of runs of characters outside space, tab, newline, vertical tab, form feed and carriage return."""
    words = F.trim(F.col("_spaced"))
    count = F.octet_length(words) - F.octet_length(F.replace(words, F.lit(" "), F.lit(""))) + 1
    sized = with_plain_spaces(docs, "text", "_spaced")
    return sized.withColumn(out, F.when(words == "", F.lit(0)).otherwise(count).cast("long")).drop("_spaced")


def spot(doc_id: Column, text: Column) -> Column:
    """The first 40 bits of the md5 of the id; of the text where the id is null."""
    key = F.coalesce(doc_id.cast("string"), text, F.lit(""))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """`sizes(source, source_size)`, one row per source -> source, source_size, target.

    Water filling: target = min(most x size, level x weight) with the level at which the targets add up. Capped sources pass their
    excess on by weight until none is above; the level is the largest that follows from capping the k lowest ratios.
    """
    names = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, mix.weights)), (F.row_number().over(names) - 1) % len(mix.weights) + 1)
    whole = Window.partitionBy()
    rows = sizes.withColumn("weight", weight).withColumn("cap", mix.most * F.col("source_size"))
    rows = rows.withColumn("goal", mix.share * F.sum("source_size").over(whole)).withColumn("all", F.sum("weight").over(whole))
    ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    # The level if all sources before this one are capped; the first row caps none.
    capped, taken = F.coalesce(F.sum("cap").over(ratio), F.lit(0)), F.coalesce(F.sum("weight").over(ratio), F.lit(0.0))
    rows = rows.withColumn("level", (F.col("goal") - capped) / (F.col("all") - taken))
    rows = rows.withColumn("level", F.max("level").over(whole))
    return rows.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def thresholds(rows: DataFrame, mix: Mix) -> DataFrame:
    """`rows(source, size, spot)` -> per source: source_size, target, copies (whole copies of every document), edge (hashes below it
    get one more), tie (whether the hash at the edge gets one more)."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    state = targets(sizes, mix).withColumn(
        "copies", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(mix.most))).otherwise(0)
    )
    state = state.withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")).withColumn("edge", F.lit(0).cast("long"))
    state = settle(state, "mix-level")
    for left in range(BITS - STEP, -1, -STEP):
        fine = rows.select(F.col("source").alias("_source"), "size", F.shiftright("spot", left).alias("_at"))
        same = F.col("source").eqNullSafe(F.col("_source")) & (F.shiftright("_at", STEP) == F.col("edge"))
        bars = state.join(fine, same).groupBy("source", "rest", F.col("_at").alias("at")).agg(F.sum("size").alias("bar"))
        upto = F.sum("bar").over(Window.partitionBy("source").orderBy("at"))
        bars = bars.withColumn("upto", upto).filter(F.col("upto") > F.col("rest"))
        # The first bar that goes beyond the budget is split next.
        ends = bars.groupBy(F.col("source").alias("_source")).agg(F.min(F.struct("at", "upto", "bar")).alias("end"))
        state = state.join(ends, F.col("source").eqNullSafe(F.col("_source")), "left").select(
            "source", "source_size", "target", "copies",
            F.when(F.col("end").isNull(), F.col("rest")).otherwise(F.col("rest") - F.col("end.upto") + F.col("end.bar")).alias("rest"),
            F.coalesce(F.col("end.at"), F.lit(0).cast("long")).alias("edge"), F.col("end.bar").alias("bar"),
        )
        state = settle(state, "mix-level")
    # All documents with the hash at the edge go one way: the one that ends nearer to the target.
    return state.withColumn("tie", F.coalesce(2 * F.col("rest") > F.col("bar"), F.lit(False)))


def _placed(rows: DataFrame, sizes: DataFrame, mix: Mix) -> DataFrame:
    """Add source_size, target and `_copies` to `rows(source, spot, ...)`; `sizes(source, size, spot)` has the same documents.

    Few sources are broadcast by their size on disk, many are joined; a hot source is then split by the adaptive skew join.
    """
    limits = settle(thresholds(sizes, mix), "mix-thresholds")
    limits = limits.select(F.col("source").alias("_source"), "source_size", "target", "copies", "edge", "tie")
    more = (F.col("spot") < F.col("edge")) | ((F.col("spot") == F.col("edge")) & F.col("tie"))
    times = F.col("copies") + F.when((F.col("copies") < mix.most) & more, 1).otherwise(0)
    return rows.join(limits, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_copies", times)


def take(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """How much of each document the mix takes -> (doc_id, size, source_size, target, taken).

    size: words of the text (null: 0). taken: size times 0, 1 or 2. Every source's sum of taken differs from its target by at most
    half the size of the documents that share one hash (one document, as a rule). The choice depends on ids alone, so reruns
    agree; rows with a null id go by their text, repeated ids go together, a null source is a source. Sources without words
    have target 0. An empty table gives no rows; other columns are not read.
    """
    rows = word_count(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text"))
    rows = settle(rows.select("doc_id", "source", "size", spot(F.col("doc_id"), F.col("text")).alias("spot")), "mix-sizes")
    return _placed(rows, rows.select("source", "size", "spot"), mix).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("_copies")).alias("taken"))


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it, with all columns of `docs`."""
    source = F.col("source").cast("string")
    rows = word_count(docs.select(F.struct("*").alias("_doc"), "doc_id", source.alias("source"), "text"))
    rows = rows.select("_doc", "source", "size", spot(F.col("doc_id"), F.col("text")).alias("spot"))
    small = settle(rows.select("source", "size", "spot"), "mix-sizes")
    placed = _placed(rows, small, mix).filter("_copies > 0")
    return placed.select("_doc", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_doc.*")
