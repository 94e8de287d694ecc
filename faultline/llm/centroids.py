"""Clustering of vectors around centroids, the nearest centroid found by the threshold algorithm.

Each dimension keeps its centroids sorted by their value there. From a vector's own value the lists are walked outward, in all
dimensions at once: step by step each list names the centroid next nearest in its dimension, and every centroid named for the first time has its
distance reckoned exactly. A centroid no list has named is at least as far in each dimension as that list's frontier, so the
sum of squared frontier distances bounds it from below. The walk ends when that sum strictly exceeds the best exact distance:
equal ones go on, since a tie goes to the smaller number.

All values are integers, so sums do not depend on how rows lie in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.shared import settle

DIMENSIONS = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
SEED = "3:"
# Squared distances of 64-dimensional vectors within this bound, and sums of their components in a task, fit into 64 bits.
LARGEST = 1 << 27
_ROWS = 4096


class Lists:
    """The centroids, sorted in each dimension."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable")
        self.values = np.take_along_axis(centroids, self.order, axis=0)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number of the nearest centroid, squared distance, exact distances reckoned) of integer vectors."""
        n, dims = vectors.shape
        k = len(self.centroids)
        best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, k, dtype=np.int64)
        seen = np.zeros((n, k), dtype=bool)
        # The list entries next below and next above each value that have not been walked yet.
        above = (self.values[None, :, :] < vectors[:, None, :]).sum(axis=1)
        below = above - 1
        column = np.broadcast_to(np.arange(dims), (n, dims))
        rows, reckoned, far = np.arange(n), 0, np.iinfo(np.int64).max
        for _ in range(k):
            own = vectors[rows]
            down = np.where(below >= 0, own - self.values[np.maximum(below, 0), column[rows]], far)
            up = np.where(above < k, self.values[np.minimum(above, k - 1), column[rows]] - own, far)
            lower = down <= up
            named = self.order[np.where(lower, below, above), column[rows]]
            below, above = below - lower, above + ~lower
            new = np.zeros((len(rows), k), dtype=bool)
            new[np.arange(len(rows))[:, None], named] = True
            new &= ~seen[rows]
            seen[rows] |= new
            row, centroid = np.nonzero(new)
            reckoned += len(row)
            for lo in range(0, len(row), _ROWS):
                at, c = rows[row[lo : lo + _ROWS]], centroid[lo : lo + _ROWS]
                gap = vectors[at] - self.centroids[c]
                distance = np.einsum("ij,ij->i", gap, gap)
                order = np.lexsort((c, distance, at))
                at, c, distance = at[order], c[order], distance[order]
                first = np.append(True, at[1:] != at[:-1])
                at, c, distance = at[first], c[first], distance[first]
                better = (distance < best[at]) | ((distance == best[at]) & (c < number[at]))
                best[at[better]], number[at[better]] = distance[better], c[better]
            frontier = np.minimum(down, up)
            on = np.einsum("ij,ij->i", frontier, frontier) <= best[rows]
            if not on.any():
                break
            rows, below, above = rows[on], below[on], above[on]
        return number, best, reckoned


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("v"))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dims)


def _parts(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, _ROWS):
            part = batch.slice(lo, _ROWS)
            yield part, _matrix(part, dims)


def _sums(rows: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Of each cluster with members their number and componentwise sums. One row per cluster and task is shuffled."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, counts, sums = Lists(centroids), np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=np.int64)
        for _, vectors in _parts(batches, dims):
            number = lists.nearest(vectors)[0]
            counts += np.bincount(number, minlength=k)
            np.add.at(sums, number, vectors)
        full = np.flatnonzero(counts)
        columns = [pa.array(full), pa.array(counts[full]), *(pa.array(sums[full, i]) for i in range(dims))]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", *(f"s{i}" for i in range(dims))])

    names = ["n", *(f"s{i}" for i in range(dims))]
    parts = rows.select("v").mapInArrow(run, ", ".join(["cluster long", *(f"{c} long" for c in names)]))
    # At most k rows: their number does not grow with the data.
    found = parts.groupBy("cluster").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in names)).collect()
    return {r["cluster"]: (int(r["n"]), [int(r[f"s{i}"]) for i in range(dims)]) for r in found}


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """`rows(row, v)` with the number of the nearest centroid and the squared distance to it."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(centroids)
        for batch, vectors in _parts(batches, dims):
            number, distance, _ = lists.nearest(vectors)
            columns = [batch.column(0), pa.array(number.astype(np.int32)), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "cluster", "distance"])

    schema = f"row {rows.schema['row'].dataType.simpleString()}, cluster int, distance long"
    return rows.select("row", "v").mapInArrow(run, schema)


def scaled(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", dims: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(row, v): vectors of exactly `dims` components, none null or non-finite, each turned into floor(scale * x).

    Fails if a component leaves +-2^27, from where on squared distances do not fit into 64 bits.
    """
    x = F.col(column).cast("array<double>")
    rows = vectors.select(F.col(id_column).alias("row"), x.alias("v")).filter(F.size("v") == dims)
    rows = rows.filter(F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))) & ~F.isnan(c)))
    refused = F.raise_error(F.lit(f"a component is beyond {LARGEST // scale}")).cast("long")
    return rows.select("row", F.transform("v", lambda c: F.when(F.abs(c) * scale < LARGEST, F.floor(c * scale)).otherwise(refused)).alias("v"))


def seeds(rows: DataFrame, k: int = CLUSTERS, seed: str = SEED) -> np.ndarray:
    """The vectors of the k ids whose sha256 after `seed` is smallest, in that order; equal ids by components."""
    key = F.sha2(F.concat(F.lit(seed), F.col("row").cast("string")), 256)
    first = rows.select(key.alias("key"), "v").filter("key is not null").orderBy("key", "v").limit(k).collect()
    return np.array([r.v for r in first], dtype=np.int64)


def moved(centroids: np.ndarray, sums: dict[int, tuple[int, list[int]]]) -> np.ndarray:
    """Each centroid with members goes to the floor of their mean."""
    out = centroids.copy()
    for number, (n, total) in sums.items():
        out[number] = [s // n for s in total]
    return out


def cluster(
    vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS,
    dims: int = DIMENSIONS, scale: int = SCALE, seed: str = SEED,
) -> tuple[DataFrame, np.ndarray]:
    """((row, cluster, distance) per kept vector, final centroids).

    `row` is the id. Kept are vectors of exactly `dims` components, none null or non-finite; other rows are left out. Rows with
    equal ids are vectors of their own; null ids never start a centroid. With fewer than k ids there are fewer centroids, without any the result is
    empty. Distances are squared and exact; ties go to the smaller number; a centroid without members stays where it is.
    Only centroids (k x dims numbers) and their sums reach the driver. Columns but the two named are not read.
    """
    rows = settle(scaled(vectors, id_column, column, dims, scale), "scaled-vectors")
    centroids = seeds(rows, k, seed)
    if not len(centroids):
        return rows.select("row", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), np.zeros((0, dims), dtype=np.int64)
    for _ in range(rounds):
        after = moved(centroids, _sums(rows, centroids))
        if np.array_equal(after, centroids):
            break  # every later round would do the same
        centroids = after
    return assigned(rows, centroids), centroids


def report(vectors: DataFrame) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row per kept vector of `vectors(vec_id, embedding)`."""
    found, centroids = cluster(vectors)
    rows = settle(found, "assigned-vectors")
    # One sum per cluster.
    sums = dict(rows.groupBy("cluster").agg(F.sum("distance")).collect())
    per_cluster = F.array(*(F.lit(sums.get(c, 0)).cast("long") for c in range(len(centroids)))).cast("array<long>")
    digests = F.array(*(F.sha2(F.lit(",".join(map(str, c))), 256) for c in centroids.tolist())).cast("array<string>")
    return rows.select(
        F.col("row").cast("long").alias("vec_id"), "cluster", "distance", F.get(per_cluster, "cluster").alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"), F.get(digests, "cluster").alias("centroid_sha256"),
    )
