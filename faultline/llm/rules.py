"""Quality rules: an ordered list of threshold conjunctions, learned by sequential covering, given out as Spark conditions.

A rule is grown one threshold at a time by information gain on two thirds of the rows it may see, cut back on the last third
while that helps, and kept if it is precise enough; the rows it covers leave, and the next rule is learned from the rest.
The list is learned on the driver from at most SAMPLE labelled rows of about twenty numbers each; the statistics and the
verdicts cover every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.shared import settle
from .stats import BASE, RATIOS, measure
from .words import texts_of

SAMPLE = 60_000
CUTS = 48
PRECISION = 0.9
LEAST = 8
MOST_RULES = 24
MOST_CONDITIONS = 4


@dataclass(frozen=True)
class Condition:
    column: str
    above: bool
    cut: float

    def holds(self, x: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
        values = x[:, names.index(self.column)]
        return values >= self.cut if self.above else values < self.cut

    def expression(self) -> Column:
        return F.col(self.column) >= F.lit(self.cut) if self.above else F.col(self.column) < F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.column} {'>=' if self.above else '<'} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def counts(docs: DataFrame) -> DataFrame:
    """`docs(doc_id, text)` -> doc_id, the five base counts (long) and the ratios (double) of every whole text."""
    fields = ", ".join([f"{n} long" for n in BASE] + [f"{n} double" for n in RATIOS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in texts_of(batches):
            base, ratios = measure(texts)
            columns = [pa.array(base[n].astype(np.int64)) for n in BASE] + [pa.array(ratios[n].astype(np.float64)) for n in RATIOS]
            yield pa.RecordBatch.from_arrays(
                [texts.batch.column(0).slice(texts.lo, texts.count), *columns], names=["doc_id", *BASE, *RATIOS]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {fields}")


def _gain(p: np.ndarray, n: np.ndarray, p0: float, n0: float) -> np.ndarray:
    """Rows won times the rise of the log share of positives (information gain of one more condition)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -np.inf)


def _grow(x: np.ndarray, y: np.ndarray, names: tuple[str, ...], cuts: list[np.ndarray]) -> Rule:
    rule: list[Condition] = []
    live = np.ones(len(y), dtype=bool)
    while len(rule) < MOST_CONDITIONS and (~y[live]).any():
        p0, n0 = float(y[live].sum()), float((~y[live]).sum())
        best, found = 1e-9, None
        for k, name in enumerate(names):
            if not len(cuts[k]):
                continue
            place = np.searchsorted(cuts[k], x[live, k], side="right")
            pos = np.bincount(place[y[live]], minlength=len(cuts[k]) + 1).astype(float)
            neg = np.bincount(place[~y[live]], minlength=len(cuts[k]) + 1).astype(float)
            under_p, under_n = np.cumsum(pos)[:-1], np.cumsum(neg)[:-1]
            for above, p, n in ((True, p0 - under_p, n0 - under_n), (False, under_p, under_n)):
                gain = _gain(p, n, p0, n0)
                at = int(np.argmax(gain))
                if gain[at] > best:
                    best, found = float(gain[at]), Condition(name, above, float(cuts[k][at]))
        if found is None:
            break
        rule.append(found)
        live &= found.holds(x, names)
    return tuple(rule)


def _covers(rule: Rule, x: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
    hit = np.ones(len(x), dtype=bool)
    for c in rule:
        hit &= c.holds(x, names)
    return hit


def _worth(rule: Rule, x: np.ndarray, y: np.ndarray, names: tuple[str, ...]) -> float:
    hit = _covers(rule, x, names)
    p, n = float(y[hit].sum()), float((~y[hit]).sum())
    return (p - n) / (p + n) if p + n else -1.0


def _prune(rule: Rule, x: np.ndarray, y: np.ndarray, names: tuple[str, ...]) -> Rule:
    best, worth = rule, _worth(rule, x, y, names)
    for length in range(len(rule) - 1, 0, -1):
        if (w := _worth(rule[:length], x, y, names)) >= worth:
            best, worth = rule[:length], w
    return best


def learn(x: np.ndarray, bad: np.ndarray, names: tuple[str, ...], precision: float = PRECISION, seed: int = 5) -> list[Rule]:
    """Rules for the rows flagged `bad`, in order. Cuts are quantiles of the bad and of all rows."""
    rules: list[Rule] = []
    rng = np.random.default_rng(seed)
    shares = np.linspace(0, 1, CUTS + 1)
    x, bad = x.astype(np.float64), bad.astype(bool)
    while bad.sum() >= LEAST and len(rules) < MOST_RULES:
        cuts = [
            np.unique(np.concatenate([np.quantile(x[:, k], shares), np.quantile(x[bad, k], shares)])) for k in range(len(names))
        ]
        grow = rng.random(len(x)) < 2 / 3
        if not bad[grow].any() or not bad[~grow].any():
            break
        rule = _prune(_grow(x[grow], bad[grow], names, cuts), x[~grow], bad[~grow], names)
        hit = _covers(rule, x, names) if rule else np.zeros(len(x), dtype=bool)
        p, n = int(bad[hit].sum()), int((~bad[hit]).sum())
        if p < LEAST or p / (p + n) < precision:
            break
        rules.append(rule)
        x, bad = x[~hit], bad[~hit]
    return rules


def expression(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1, or null: one ordered Spark conditional expression."""
    out = F.lit(None).cast("int")
    for number in range(len(rules), 0, -1):
        held = F.lit(True)
        for condition in rules[number - 1]:
            held = held & condition.expression()
        out = F.when(held, F.lit(number)).otherwise(out)
    return out


def learn_from(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Learn from at most `sample` labelled rows: those whose id hashes lowest."""
    names = (*BASE, *RATIOS)
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chance = min(1.0, 1.1 * sample / max(known.count(), 1))
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    chosen = known.filter(spot < int(chance * (1 << 30))).orderBy(spot, "doc_id").limit(sample)
    rows = stats.dropDuplicates(["doc_id"]).join(chosen, "doc_id").select("quality", *names).collect()
    if not rows:
        return []
    table = np.array(sorted(tuple(r) for r in rows), dtype=np.float64)
    return learn(table[:, 1:], table[:, 0] == 0, names)


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, list[Rule]]:
    """Base counts, base verdict and the learned verdict of each document, and the rules.

    Columns: doc_id, the five counts, base_failed, rule (number of the first learned rule that holds, else null), kept.
    base_failed: under 10 words, or more than 20 % of the words in repeated windows. kept: neither base_failed nor caught by a rule.
    One row out per row in; null and empty texts count zero words and so fail; ids may be null or repeated; an empty table
    gives no rows. Without labels there are no rules.
    """
    stats = settle(counts(docs), "rule-counts")
    rules = learn_from(stats, labels, sample)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = stats.withColumn("base_failed", failed).withColumn("rule", expression(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()).select("doc_id", *BASE, "base_failed", "rule", "kept"), rules
