"""Nearest stored vectors for many query vectors, exact, without forming all pairs as rows.

Stored vectors are put into the cell of their nearest pivot; a query goes to every cell that can hold a vector within
the wanted distance. Cells are cut into a grid of bounded blocks, and each block pair is one matrix product that
returns only its best k. Equal stored vectors are folded together first, so copies cost nothing.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import settle

# Executors get these functions with the task; the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FEWEST_PIVOTS, MOST_PIVOTS = 16, 4096
BLOCK_ROWS = 4096
ROWS_AT_ONCE = 512
_SLACK = 1e-6


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1.0, norm)


def _matrix(column: pd.Series, cosine: bool) -> np.ndarray:
    m = np.array(column.tolist(), dtype=np.float64)
    return _unit(m) if cosine else m


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0.0)


def _reach(min_similarity: float, metric: str) -> float:
    return float(np.sqrt(max((2.0 if metric == "cosine" else 1.0) * (1.0 - min_similarity), 0.0))) + _SLACK


def choose_pivots(items: DataFrame, metric: str = "l2sq", pivots: int | None = None) -> np.ndarray:
    """Vectors of `items(embedding)` by hash, about as many as the square root of the rows. At most MOST_PIVOTS reach the driver."""
    if pivots is None:
        pivots = min(max(int(items.count() ** 0.5), FEWEST_PIVOTS), MOST_PIVOTS)
    vector = F.col("embedding").cast("array<double>")
    sample = items.filter(F.size("embedding") > 0).select(vector.alias("vec")).distinct().orderBy(F.xxhash64("vec")).limit(pivots)
    centres = np.array([r["vec"] for r in sample.collect()], dtype=np.float64)
    return _unit(centres) if metric == "cosine" and len(centres) else centres


def place(rows: DataFrame, centres: np.ndarray, metric: str) -> DataFrame:
    """Add `cell`, the number of the nearest pivot, to rows with a vector `vec`."""
    cosine = metric == "cosine"

    def to_cell(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), ROWS_AT_ONCE):
                part = pdf.iloc[at : at + ROWS_AT_ONCE]
                yield part.assign(cell=_squared(_matrix(part["vec"], cosine), centres).argmin(1).astype("int64"))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "cell bigint"])
    return rows.mapInPandas(to_cell, schema)


def route(vectors: DataFrame, centres: np.ndarray, reach: float, metric: str) -> DataFrame:
    """(vec, cell): each query vector with every cell that can hold a vector within reach."""
    cosine = metric == "cosine"
    gaps = np.sqrt(_squared(centres, centres)) if len(centres) else np.zeros((0, 0))

    def to_cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf) if len(centres) else 0, ROWS_AT_ONCE):
                asked = pdf["vec"].iloc[at : at + ROWS_AT_ONCE].reset_index(drop=True)
                d2 = _squared(_matrix(asked, cosine), centres)
                own = d2.argmin(1)
                width = gaps[own]
                # Distance of the query to the half space of another cell.
                beyond = (d2 - d2[np.arange(len(own)), own][:, None]) / np.where(width == 0, 1.0, 2 * width)
                yield pd.DataFrame({"vec": asked, "cell": pd.Series([np.flatnonzero(b <= reach) for b in beyond], dtype=object)})

    return vectors.mapInPandas(to_cells, "vec array<double>, cell array<bigint>").select("vec", F.explode("cell").alias("cell"))


def fold(rows: DataFrame, k: int, *keys: str) -> DataFrame:
    """Equal vectors of `rows(item_id, vec, keys)` as one row with their k smallest ids."""
    copies = Window.partitionBy("vec").orderBy("item_id")
    kept = rows.withColumn("_r", F.row_number().over(copies)).filter(F.col("_r") <= k)
    return kept.groupBy("vec", *keys).agg(F.array_sort(F.collect_list("item_id")).alias("ids"))


def compare(
    queries: DataFrame, placed: DataFrame, routed: DataFrame, k: int, min_similarity: float, strict: bool, metric: str, id_type: str,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The best k of `placed(vec, ids, cell)` for each of `queries(query_id, embedding)`, whose vectors `routed(vec, cell)` sends to cells.

    Vectors stay where they are compared: matches and ranks carry two hashes of the query vector (96 bits) in its place.
    """
    cosine, reach = metric == "cosine", _reach(min_similarity, metric)

    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias(name))

    # One row per cell: never more than MOST_PIVOTS rows.
    grid = F.broadcast(blocks(placed, "_ni").join(blocks(routed, "_nq"), "cell"))

    def own_block(total: str):
        return F.pmod(F.xxhash64("vec"), F.col(total)).cast("int")

    def every_block(total: str):
        return F.explode(F.sequence(F.lit(0), F.col(total) - 1))

    left = routed.join(grid, "cell").withColumn("qb", own_block("_nq")).withColumn("ib", every_block("_ni"))
    right = placed.join(grid, "cell").withColumn("ib", own_block("_ni")).withColumn("qb", every_block("_nq"))

    def best(q: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        h, g, found, near_by = [], [], [], []
        if len(q) and len(i):
            stored, asked = _matrix(i["vec"], cosine), _matrix(q["vec"], cosine)
            ids, copies = np.array([x for row in i["ids"] for x in row], dtype=object), np.array([len(row) for row in i["ids"]])
            order = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
            for at in range(0, len(q), ROWS_AT_ONCE):
                near = _squared(asked[at : at + ROWS_AT_ONCE], stored)
                top = min(k, len(i)) - 1
                edge = np.minimum(np.partition(near, top, axis=1)[:, top], reach * reach) + _SLACK
                # All close pairs of the block at once; their distances are reckoned again without cancellation.
                row, pick = np.nonzero(near <= edge[:, None])
                d2 = ((stored[pick] - asked[at + row]) ** 2).sum(1)
                first = np.concatenate([[0], np.cumsum(copies)])[pick]
                times = copies[pick]
                one = np.repeat(first - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
                row, sim = np.repeat(row, times), np.repeat(1.0 - (d2 / 2 if cosine else d2), times)
                by = np.lexsort((order[one], -sim, row))
                row, sim, one = row[by], sim[by], one[by]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                row, sim, one = row[rank < k], sim[rank < k], one[rank < k]
                h.append(q["h"].to_numpy()[at + row])
                g.append(q["g"].to_numpy()[at + row])
                found.extend(ids[one])
                near_by.append(sim)
        return pd.DataFrame(
            {
                "h": np.concatenate(h or [np.zeros(0)]).astype("int64"), "g": np.concatenate(g or [np.zeros(0)]).astype("int32"),
                "item_id": pd.Series(found, dtype=object), "similarity": np.concatenate(near_by or [np.zeros(0)]),
            }
        )

    names = (F.xxhash64("vec").alias("h"), F.hash("vec").alias("g"))
    scored = left.select("vec", *names, "cell", "qb", "ib").groupBy("cell", "qb", "ib").cogroup(
        right.select("vec", "ids", "cell", "qb", "ib").groupBy("cell", "qb", "ib")
    ).applyInPandas(best, f"h long, g int, item_id {id_type}, similarity double")
    bound = F.col("similarity") > min_similarity if strict else F.col("similarity") >= min_similarity
    order = Window.partitionBy("h", "g").orderBy(F.desc("similarity"), "item_id")
    ranked = scored.filter(bound).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("vec")).select("query_id", *names)
    return asked.join(ranked, ["h", "g"]).select("query_id", "item_id", "similarity", "rank")


def _vectors(rows: DataFrame, *names: str) -> DataFrame:
    return rows.filter(F.size("embedding") > 0).select(*names, F.col("embedding").cast("array<double>").alias("vec"))


def nearest(
    queries: DataFrame, items: DataFrame, k: int, min_similarity: float, strict: bool = False, metric: str = "l2sq",
    pivots: int | None = None, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """`queries(query_id, embedding)` x `items(item_id, embedding)` -> (query_id, item_id, similarity, rank).

    Similarity is 1 - squared distance ('l2sq') or the cosine. Only matches at or above (`strict`: above) the minimum
    are returned; rank counts among all items, ties go to the smaller id. `VectorIndex` keeps the items in their cells for many calls.
    """
    centres = choose_pivots(items, metric, pivots)
    placed = settle(place(fold(_vectors(items, "item_id"), k), centres, metric), "placed")
    routed = settle(route(_vectors(queries).distinct(), centres, _reach(min_similarity, metric), metric), "routed")
    return compare(queries, placed, routed, k, min_similarity, strict, metric, items.schema["item_id"].dataType.simpleString(), block_rows)


class VectorIndex:
    """A store of vectors under `location`, in the cells of fixed pivots, with any other columns beside them.

    Rows are a table partitioned by batch and cell. A search reads the cells its queries reach and no others; an insert
    places only its own rows. Ids are unique over all batches.
    """

    def __init__(self, spark: SparkSession, location: str):
        self.spark, self.location = spark, location.rstrip("/")
        head = spark.read.parquet(f"{self.location}/pivots").orderBy("cell").collect()
        self.metric = head[0]["metric"]
        self.centres = np.array([r["vec"] for r in head if r["vec"] is not None], dtype=np.float64)

    @classmethod
    def create(cls, items: DataFrame, location: str, metric: str = "l2sq", pivots: int | None = None) -> VectorIndex:
        """Choose pivots from `items(item_id, embedding, ..)` and store the items as the first batch. Fails if the location is in use."""
        spark, centres = items.sparkSession, choose_pivots(items, metric, pivots)
        rows = [(n, metric, [float(x) for x in c]) for n, c in enumerate(centres)] or [(0, metric, None)]
        spark.createDataFrame(rows, "cell bigint, metric string, vec array<double>").coalesce(1).write.parquet(f"{location.rstrip('/')}/pivots")
        index = cls(spark, location)
        index.insert(items, "first")
        return index

    def insert(self, items: DataFrame, batch: str) -> None:
        """Add rows with the columns of the first batch; the same batch again takes the place of its earlier write."""
        if not len(self.centres):
            raise ValueError("the index was made without vectors")
        placed = place(_vectors(items, *(c for c in items.columns if c != "embedding")), self.centres, self.metric)
        # A full cell spreads over files, small cells share tasks.
        placed.hint("rebalance", "cell").write.partitionBy("cell").mode("overwrite").parquet(f"{self.location}/rows/batch={batch}")

    def rows(self, cells: Sequence[int] | None = None) -> DataFrame:
        """The stored rows, of the given cells only."""
        stored = self.spark.read.parquet(f"{self.location}/rows").withColumn("cell", F.col("cell").cast("bigint"))
        return stored if cells is None else stored.filter(F.col("cell").isin([int(c) for c in cells]))

    def search(self, queries: DataFrame, k: int, min_similarity: float, strict: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
        """As `nearest`, with the other stored columns of each match."""
        routed = settle(route(_vectors(queries).distinct(), self.centres, _reach(min_similarity, self.metric), self.metric), "routed")
        # Cell numbers: never more than MOST_PIVOTS.
        near = self.rows([r["cell"] for r in routed.select("cell").distinct().collect()])
        placed = settle(fold(near.select("item_id", "vec", "cell"), k, "cell"), "placed")
        kind = near.schema["item_id"].dataType.simpleString()
        found = compare(queries, placed, routed, k, min_similarity, strict, self.metric, kind, block_rows)
        return found.join(near.drop("vec", "cell", "batch"), "item_id")
