"""Language-model scoring on Spark: token counts of the whole corpus, the recurrent model of `gru`, and exact unigram scores.

1. Words of all training documents are counted (hashes, summed inside each task first) and stored.
2. The most frequent words, KEPT at most, go to the tasks with their counts; VOCABULARY of them are the model's words.
3. The rounds share out the training documents, each in one round. In a round the documents' word numbers are dealt to trainers, whose
   number follows the number of tokens alone, not the files or tasks; their models are averaged by the number of tokens.
4. One pass scores all documents; counts of words beyond the kept ones come from a join on the word's hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.shared import settle
from . import gru
from .tables import held_out
from .words import LOWER, Texts, hashes_of, mix, texts_of, words_of

KEPT = 1 << 18
ROUNDS = 2
TRAINER_TOKENS = 8_000_000
LEARNED = 1_000_000
MERGED = 32
POOL = 4_000_000
PENDING = 2_000_000
PART = 1 << 14
CELL_BITS = 20
END = np.uint64(0xE7D0)
# The tail class of a word by its last byte and, as the lower part, the byte before.
TAIL_OF = (mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(gru.TAILS)).astype(np.int64)


def _tokens(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and tail classes of the tokens of all texts, and where each text's begin. Each text ends with the end token."""
    data = LOWER[texts.data]
    words = words_of(data, texts.offsets)
    n_words = np.bincount(words.docs, minlength=texts.count)
    edges = np.concatenate([[0], np.cumsum(n_words + 1)])
    place = np.arange(len(words.docs)) + words.docs
    hashes = np.full(edges[-1], END, dtype=np.uint64)
    hashes[place] = hashes_of(data, words)
    tails = np.zeros(edges[-1], dtype=np.int64)
    if len(words.docs):
        last = data[words.ends - 1].astype(np.int64)
        before = np.where(words.ends - words.starts > 1, data[np.maximum(words.ends - 2, 0)], 0)
        tails[place] = TAIL_OF[last * 256 + before]
    return hashes, tails, edges


def _summed(hashes: np.ndarray, tails: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(hashes):
        return hashes, tails, counts
    order = np.argsort(hashes)
    ordered = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[first], tails[order[first]], np.add.reduceat(counts[order], first)


def token_counts(docs: DataFrame) -> DataFrame:
    """`docs(text)` -> (hash, tail, n): how often each token stands in all texts, the end token included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        waiting: list[tuple[np.ndarray, ...]] = []
        for texts in texts_of(batches):
            hashes, tails, _ = _tokens(texts)
            waiting.append(_summed(hashes, tails, np.ones(len(hashes), dtype=np.int64)))
            if sum(len(w[0]) for w in waiting) > PENDING // 4:
                sums = _summed(*(np.concatenate([sums[k], *(w[k] for w in waiting)]) for k in range(3)))
                waiting = []
                if len(sums[0]) > PENDING:
                    yield emit(sums)
                    sums = tuple(a[:0] for a in sums)
        if waiting or len(sums[0]):
            yield emit(_summed(*(np.concatenate([sums[k], *(w[k] for w in waiting)]) for k in range(3))))

    def emit(sums: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(sums[0].view(np.int64)), pa.array(sums[1].astype(np.int32)), pa.array(sums[2])], names=["hash", "tail", "n"]
        )

    parts = docs.select("text").mapInArrow(run, "hash long, tail int, n long")
    return parts.groupBy("hash").agg(F.min("tail").alias("tail"), F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """hashes (sorted), counts, and tail classes of the kept words; word: the model's number of a kept word or -1. tail_total: words and
    different words of each tail class. total, different: of all training tokens."""

    hashes: np.ndarray
    counts: np.ndarray
    word: np.ndarray
    word_counts: np.ndarray
    tail_words: np.ndarray
    tail_different: np.ndarray
    total: int
    different: int
    _cells: np.ndarray | None = None

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        """The place of the first kept hash that is not smaller, or the last place: from where its upper bits begin, step by step."""
        if self._cells is None:
            edges = np.arange(1 << CELL_BITS, dtype=np.uint64) << np.uint64(64 - CELL_BITS)
            self._cells = np.minimum(np.searchsorted(self.hashes, edges), len(self.hashes) - 1).astype(np.int32)
        at = self._cells[hashes >> np.uint64(64 - CELL_BITS)]
        low = np.flatnonzero(self.hashes[at] < hashes)
        while len(low):
            at[low] += 1
            low = low[at[low] < len(self.hashes) - 1]
            low = low[self.hashes[at[low]] < hashes[low]]
        return np.minimum(at, len(self.hashes) - 1)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (-1 for words that are not kept) and model number (-1 for words that the model lacks) of each token."""
        if not len(self.hashes):
            return np.full(len(hashes), -1), np.where(hashes == END, 0, -1)
        at = self._places(hashes)
        known = self.hashes[at] == hashes
        return np.where(known, self.counts[at], -1), np.where(known, self.word[at], np.where(hashes == END, 0, -1))


def vocabulary(counts: DataFrame, kept: int = KEPT) -> tuple[Vocabulary, int]:
    """The kept words are all words with at least some count; that count is the lowest for which they are at most `kept`.

    Returned with it. Counts are gathered per value below 1,024 and per 64th of a doubling above, so a few thousand rows
    decide.
    """
    level = F.when(F.col("n") < 1024, F.col("n")).otherwise(1024 + F.floor((F.log2("n") - 10) * 64)).cast("long")
    levels = counts.groupBy(level.alias("level")).agg(
        F.count(F.lit(1)).alias("words"), F.sum("n").alias("total"), F.min("n").alias("least")
    )
    rows = sorted(levels.collect(), reverse=True)
    total, different = sum(r.total for r in rows), sum(r.words for r in rows)
    running, least = 0, 1 << 62
    for r in rows:
        running += r.words
        if running > kept:
            break
        least = r.least
    frequent = counts.filter(F.col("n") >= least).toArrow()
    hashes = frequent["hash"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    hashes, number, tail = hashes[order], frequent["n"].to_numpy()[order].astype(np.int64), frequent["tail"].to_numpy()[order].astype(np.int64)
    word = np.full(len(hashes), -1, dtype=np.int64)
    word_counts = np.zeros(gru.VOCABULARY, dtype=np.int64)
    is_end = hashes == END
    best = np.lexsort((hashes, -np.where(is_end, np.iinfo(np.int64).max, number)))[: gru.VOCABULARY]
    if not is_end.any():  # number 0 is the end token also where nothing was learned
        best = best[: gru.VOCABULARY - 1]
    places = np.arange(len(best)) + (0 if is_end.any() else 1)
    word[best], word_counts[places] = places, number[best]
    tails = {r.tail: r for r in counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect()}
    tail_words = np.array([tails[k].n if k in tails else 0 for k in range(gru.TAILS)], dtype=np.int64)
    tail_different = np.array([tails[k].words if k in tails else 0 for k in range(gru.TAILS)], dtype=np.int64)
    tail_words -= np.bincount(tail[best], weights=number[best], minlength=gru.TAILS).astype(np.int64)
    tail_different -= np.bincount(tail[best], minlength=gru.TAILS)
    return Vocabulary(hashes, number, word, word_counts, tail_words, tail_different, int(total), int(different)), int(least)


def _model_tokens(vocabulary: Vocabulary, hashes: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts, word = vocabulary.find(hashes)
    return counts, np.where(word >= 0, word, gru.VOCABULARY + tails).astype(np.int32)


def _dealt(docs: DataFrame, vocabulary, trainers: int) -> DataFrame:
    """`docs(text)` -> (trainer, spot, tokens): the word numbers of each document as 16-bit numbers.

    A hash of the document's place deals, so that copies are spread; `spot` is a hash of its words, so that a trainer's order does
    not follow the files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place = vocabulary.value, TaskContext.get().partitionId() << 33
        for texts in texts_of(batches):
            hashes, tails, edges = _tokens(texts)
            tokens = _model_tokens(known, hashes, tails)[1].astype("<i2")
            at = (np.arange(len(hashes)) - np.repeat(edges[:-1], np.diff(edges))).astype(np.uint64)
            spots = mix(np.add.reduceat(hashes * (at + at + np.uint64(1)), edges[:-1]))
            mine = (mix(np.arange(place, place + texts.count, dtype=np.uint64)) >> np.uint64(16)) % np.uint64(trainers)
            place += texts.count
            cuts = pa.py_buffer((2 * edges).astype(np.int64))
            raw = pa.Array.from_buffers(pa.large_binary(), texts.count, [None, cuts, pa.py_buffer(tokens)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(mine.astype(np.int32)), pa.array(spots.view(np.int64)), raw.cast(pa.binary())], names=["trainer", "spot", "tokens"]
            )

    return docs.select("text").mapInArrow(run, "trainer int, spot long, tokens binary")


def train_round(docs: DataFrame, vocabulary, start: gru.Parameters) -> gru.Parameters:
    """Train on `docs(text)`: one trainer for TRAINER_TOKENS training tokens of the whole corpus, all from the same start. Their models are
    averaged by their tokens, MERGED at a time."""
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(start.flat())
    words, tail_words = start.embed.shape[0], vocabulary.value.tail_words
    first = vocabulary.value.word_counts
    trainers = max(1, -(-vocabulary.value.total // TRAINER_TOKENS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, trainer, seen, held, size = None, None, 0, [], 0

        def learn() -> None:
            nonlocal seen, held, size
            trainer.learn(np.concatenate(held).astype(np.int32), np.concatenate([[0], np.cumsum([len(t) for t in held])]))
            seen, held, size = seen + size, [], 0

        def done() -> pa.RecordBatch:
            if held:
                learn()
            flat = trainer.p.flat().astype(np.float64) * seen
            parts = [flat[a : a + PART].tobytes() for a in range(0, len(flat), PART)]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(parts), now, dtype=np.int32)), pa.array(np.arange(len(parts))), pa.array(np.full(len(parts), seen)),
                 pa.array(parts, pa.binary())],
                names=["trainer", "part", "tokens", "sums"],
            )

        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if name != now:
                    if trainer is not None:
                        yield done()
                    now, trainer, seen = name, gru.Trainer(gru.initial(first, tail_words).filled(sent.value.copy())), 0
                held.append(np.frombuffer(raw.as_buffer(), dtype="<i2").copy())
                size += len(held[-1])
                if size >= LEARNED:
                    learn()
        if trainer is not None:
            yield done()

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(raw) for raw in group.sort_values("trainer")["sums"])
        one = {"trainer": [group["above"].iloc[0]], "part": [group["part"].iloc[0]], "tokens": [group["tokens"].sum()]}
        return pd.DataFrame(one | {"sums": [total.tobytes()]})

    assert words == gru.START + 1
    schema = "trainer int, part long, tokens long, sums binary"
    dealt = _dealt(docs, vocabulary, trainers).repartitionById(trainers, F.col("trainer")).sortWithinPartitions("trainer", "spot")
    models = dealt.mapInArrow(run, schema)
    while trainers > 1:
        trainers = -(-trainers // MERGED)
        above = F.floor(F.col("trainer") / MERGED).cast("int")
        models = models.withColumn("above", above).groupBy("part", "above").applyInPandas(merge, schema)
    got = sorted(models.collect(), key=lambda r: r.part)
    if not got:
        return start
    return start.filled(np.concatenate([np.frombuffer(bytes(r.sums)) / r.tokens for r in got]))


def _documents(docs: DataFrame, vocabulary, model) -> DataFrame:
    """One row per document: row, doc_id, n_tokens, n_known and base_sum of the kept words, model_sum, and the hashes and numbers of
    its other words."""
    log10 = np.log(10.0)
    shape = gru.initial(vocabulary.value.word_counts, vocabulary.value.tail_words)

    def finish(pool: list[tuple], words: gru.Parameters) -> Iterator[pa.RecordBatch]:
        tokens = np.concatenate([p[1] for p in pool])
        cuts = np.concatenate([[0], *(p[2][1:] + base for p, base in zip(pool, np.cumsum([0, *(len(p[1]) for p in pool[:-1])]), strict=True))])
        scores = gru.score(words, tokens, cuts) / log10
        at = 0
        for row, _, edges, columns in pool:
            n = len(edges) - 1
            # One Arrow batch per slice, with the model's part added.
            columns = dict(columns)
            columns["model_sum"] = pa.array(columns["model_sum"] + scores[at : at + n])
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
            at += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, words = vocabulary.value, shape.filled(model.value)
        inside = -np.log10(known.tail_words + known.tail_different + 1.0)
        number = TaskContext.get().partitionId() << 33
        pool: list[tuple] = []
        for texts in texts_of(batches):
            hashes, tails, edges = _tokens(texts)
            counts, tokens = _model_tokens(known, hashes, tails)
            docs = np.repeat(np.arange(texts.count), np.diff(edges))
            kept, open_ = counts >= 0, tokens >= gru.VOCABULARY
            logs = np.where(kept, np.log10(np.maximum(counts, 0) + 1.0), 0.0)
            base = np.bincount(docs, weights=logs, minlength=texts.count)
            tail = np.where(open_, logs + inside[tails], 0.0)
            rare = np.flatnonzero(~kept)
            pairs, first, n = np.unique(mix(hashes[rare]) ^ mix(docs[rare].astype(np.uint64)), return_index=True, return_counts=True)
            order = np.argsort(docs[rare[first]], kind="stable")
            first, n = rare[first[order]], n[order]
            offsets = np.searchsorted(docs[first], np.arange(texts.count + 1)).astype(np.int32)
            columns = {
                "row": pa.array(number + np.arange(texts.count)), "doc_id": texts.batch.column(0).slice(texts.lo, texts.count),
                "n_tokens": pa.array(np.diff(edges)), "n_known": pa.array(np.bincount(docs[counts > 0], minlength=texts.count)),
                "base_sum": pa.array(base), "model_sum": np.bincount(docs, weights=tail, minlength=texts.count),
                "rare": pa.ListArray.from_arrays(offsets, pa.array(hashes[first].view(np.int64))),
                "times": pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int64))),
            }
            number += texts.count
            pool.append((None, tokens, edges, columns))
            if sum(len(p[1]) for p in pool) >= POOL:
                yield from finish(pool, words)
                pool = []
        if pool:
            yield from finish(pool, words)

    schema = (
        "row long, doc_id long, n_tokens long, n_known long, base_sum double, model_sum double, rare array<long>, times array<long>"
    )
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def score(docs: DataFrame, folds: int = 7, remainder: int = 2, kept: int = KEPT, rounds: int = ROUNDS) -> DataFrame:
    """Score each document -> (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Tokens: words of the text with A-Z lower-cased, then one end. Counts cover every training document (those outside the
    held-out fold, with null ids too), and the model trains on every one of them once: a hash of the id says in which round.
    base_score: sum of log10((c + 1) / (N + V + 1)). score: log10 probability under the model. Words that training lacks
    share the open slot of their tail class, as all unseen words share one slot in the base score. One row out per row in; null and
    empty texts are one end token; an empty table gives no rows; other columns are not read.
    """
    context = docs.sparkSession.sparkContext
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    training = docs.filter(~held_out(F.col("doc_id"), folds, remainder))
    counts = settle(token_counts(training), "token-counts")
    known, least = vocabulary(counts, kept)
    sent = context.broadcast(known)
    model = gru.initial(known.word_counts, known.tail_words)
    spot = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(rounds))
    for turn in range(rounds):
        model = train_round(training.filter(spot == turn), sent, model)
    rows = settle(_documents(docs, sent, context.broadcast(model.flat())), "scored-documents")
    words = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("word"))
    words = words.select("row", F.col("word.rare").alias("hash"), F.col("word.times").alias("times"))
    found = words.join(counts.filter(F.col("n") < least).select("hash", "n"), "hash").groupBy(F.col("row").alias("_row")).agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum("times").alias("more_known")
    )
    both = rows.drop("rare", "times").join(found, F.col("row") == F.col("_row"), "left")
    more = F.coalesce("more", F.lit(0.0))
    return both.select(
        "doc_id", held_out(F.col("doc_id"), folds, remainder).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(known.total).cast("long").alias("train_tokens"),
        (F.col("base_sum") + more - F.col("n_tokens") * float(np.log10(known.total + known.different + 1))).alias("base_score"),
        (F.col("model_sum") + more).alias("score"),
    )
