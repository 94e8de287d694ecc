"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

1. One pass over all texts turns each into about twenty statistics (stored, a few dozen bytes a document).
2. Each partition of the labelled rows sums its part of the normal equations; parts are summed per matrix row.
3. A third of the labelled rows is kept for calibration: counts per score bin, then pooled to a rising curve.
4. One pass over the stored statistics gives the scores.

Nothing that reaches the driver grows with the data: sums per statistic, a matrix of FEATURES x FEATURES, counts per bin.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.shared import settle
from .stats import RATIOS, measure
from .tables import held_out, learning_labels
from .words import texts_of

FEATURES = 256
RIDGE = 1e-5
LEAST_RIDGE = 0.1
BINS = 4096
SEED = 7


@dataclass
class Kernel:
    """cos(xW + b): inner products approximate a Gaussian kernel of the standardised statistics."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phases: np.ndarray

    def map(self, x: np.ndarray) -> np.ndarray:
        # Statistics beyond six deviations say no more than six.
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2.0 / len(self.phases)) * np.cos(z @ self.weights + self.phases), np.ones((len(x), 1))])


def make_kernel(mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, seed: int = SEED) -> Kernel:
    rng = np.random.default_rng(seed)
    width = np.sqrt(len(mean))
    return Kernel(mean, scale, rng.normal(size=(len(mean), features)) / width, rng.uniform(0, 2 * np.pi, features))


@dataclass
class Model:
    kernel: Kernel
    weights: np.ndarray
    points: np.ndarray
    levels: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.kernel.map(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """The calibrated probability; a thousandth of the raw score keeps the order inside level stretches."""
        raw = self.raw(x)
        return np.clip(0.999 * np.interp(raw, self.points, self.levels) + 0.001 * np.clip(raw, 0, 1), 0.0, 1.0)


def statistics(docs: DataFrame) -> DataFrame:
    """`docs(doc_id, text)` -> (doc_id, x): the statistics of every whole text, also of empty and null ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in texts_of(batches):
            _, ratios = measure(texts)
            # Shares crowd near zero; their roots spread them.
            x = np.column_stack([v if name == "log_words" else np.sqrt(np.maximum(v, 0)) for name, v in ratios.items()]).astype(np.float32)
            offsets = np.arange(0, x.size + 1, len(RATIOS), dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [texts.batch.column(0).slice(texts.lo, texts.count), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))],
                names=["doc_id", "x"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<float>")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("x"))
    return np.asarray(column.flatten(), dtype=np.float64).reshape(batch.num_rows, -1)


def _labels(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column(batch.schema.get_field_index("y")), dtype=np.float64)


def _moments(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean and deviation of each statistic, from sums per partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares = 0, np.zeros(width), np.zeros(width)
        for batch in batches:
            x = _matrix(batch)
            n, total, squares = n + len(x), total + x.sum(0), squares + (x * x).sum(0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width)), pa.array(np.full(width, n)), pa.array(total), pa.array(squares)],
            names=["k", "n", "total", "squares"],
        )

    parts = rows.mapInArrow(run, "k long, n long, total double, squares double")
    sums = parts.groupBy("k").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"))
    got = sorted(sums.collect())
    if not got or not got[0].n:
        return np.zeros(width), np.ones(width), 0
    n = got[0].n
    mean = np.array([r.total / n for r in got])
    spread = np.sqrt(np.maximum(np.array([r.squares / n for r in got]) - mean**2, 0))
    return mean, np.where(spread > 1e-9, spread, 1.0), n


def _normal_equations(rows: DataFrame, kernel: Kernel) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y: one row of the matrix per output row, summed over the partitions."""
    width = len(kernel.phases) + 1

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width + 1))
        for batch in batches:
            x, y = _matrix(batch), _labels(batch)
            for at in range(0, len(x), 2048):
                z = kernel.map(x[at : at + 2048])
                total += z.T @ np.column_stack([z, y[at : at + 2048]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width)), pa.array([row.tobytes() for row in total], pa.binary())], names=["k", "sums"]
        )

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width + 1)
        for raw in group["sums"]:
            total += np.frombuffer(raw)
        return pd.DataFrame({"k": [group["k"].iloc[0]], "sums": [total.tobytes()]})

    parts = rows.mapInArrow(part, "k long, sums binary")
    got = sorted(parts.groupBy("k").applyInPandas(merge, "k long, sums binary").collect(), key=lambda r: r.k)
    full = np.array([np.frombuffer(bytes(r.sums)) for r in got])
    return full[:, :-1], full[:, -1]


def _bins(rows: DataFrame, kernel: Kernel, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Middle, rows and labels of each score bin that has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, ones = np.zeros(BINS, dtype=np.int64), np.zeros(BINS)
        for batch in batches:
            raw = kernel.map(_matrix(batch)) @ weights
            at = np.clip(((raw + 0.5) * (BINS / 2)).astype(np.int64), 0, BINS - 1)
            n += np.bincount(at, minlength=BINS)
            ones += np.bincount(at, weights=_labels(batch), minlength=BINS)
        k = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n[k]), pa.array(ones[k])], names=["k", "n", "ones"])

    parts = rows.mapInArrow(run, "k long, n long, ones double")
    got = sorted(parts.groupBy("k").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).collect())
    return np.array([(r.k + 0.5) / (BINS / 2) - 0.5 for r in got]), np.array([r.n for r in got], float), np.array([r.ones for r in got])


def pool(points: np.ndarray, n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression: neighbouring bins are pooled until their shares rise. Returns each pool's centre and share."""
    pools: list[list[float]] = []
    for x, count, positive in zip(points, n, ones, strict=True):
        pools.append([x * count, count, positive])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    # Half a row of doubt keeps a pure pool away from exactly 0 and 1.
    return np.array([p[0] / p[1] for p in pools]), np.array([(p[2] + 0.25) / (p[1] + 0.5) for p in pools])


def fit(rows: DataFrame, features: int = FEATURES, ridge: float = RIDGE) -> Model:
    """`rows(doc_id, x, y)`: statistics with labels 0 and 1. Without rows every score is 0.5."""
    width = len(RATIOS)
    mean, scale, n = _moments(rows, width)
    kernel = make_kernel(mean, scale, features)
    if not n:
        return Model(kernel, np.zeros(features + 1), np.array([0.0]), np.array([0.5]))
    third = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    a, b = _normal_equations(rows.filter(third != 0), kernel)
    weights = np.linalg.solve(a + max(ridge * a[-1, -1], LEAST_RIDGE) * np.eye(len(a)), b)
    points, count, ones = _bins(rows.filter(third == 0), kernel, weights)
    if not len(points):
        return Model(kernel, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return Model(kernel, weights, *pool(points, count, ones))


def apply(rows: DataFrame, model: Model) -> DataFrame:
    """`rows(doc_id, x)` -> (doc_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch)))], names=["doc_id", "score"])

    return rows.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 4, remainder: int = 2, threshold: float = 0.7) -> DataFrame:
    """Quality of each document -> (doc_id, held_out, score, predicted).

    Labels are learned only from documents outside the held-out fold. One row out per row in, with repeated rows and null ids
    too; null and empty texts are scored by their (zero) statistics; an empty table gives no rows; other columns of `docs` are
    not read. Labels null in id or value are left out; without labels every score is 0.5.
    """
    rows = settle(statistics(docs), "quality-statistics")
    known = learning_labels(labels, "quality", folds, remainder)
    distinct = rows.dropDuplicates(["doc_id"])
    model = fit(settle(distinct.join(known, "doc_id"), "quality-learning"))
    scored = apply(rows, model)
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), folds, remainder).alias("held_out"), "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"),
    )
