"""Periodic runs of words, found online by catchers over blocks of powers of two.

A stretch of places i at which word i equals word i + q is a run of period q if it is long enough. Every stretch that can give a run holds
a whole block of a dyadic grid, so each completed block keeps a catcher: the hash of its words and the shifts it waits for. As words are
appended, the suffix that ends with each of them is compared with the catchers in reach; one that answers has caught a square, or
the beginning of one. Its stretch is followed to both sides, and stays open while it touches the end of the words, so that squares
reported later merge into the same run.

Words come in portions of any size; all comparisons of a portion are done at once. A run of a small period hides the multiples of
its period from larger blocks, so repetitive texts cost no more than others.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import hashes_of, mix, texts_of, words_of, worker_store

LEAST = 12
PORTION = 1 << 18
_PRIMES = (np.uint64(2**31 - 1), np.uint64(2**31 - 19))
_BASES = (1_402_473_817, 1_893_250_411)
_NOWHERE = np.uint64(1 << 63)


class Found(NamedTuple):
    """Runs: first word, word after the last, smallest period."""

    start: np.ndarray
    end: np.ndarray
    period: np.ndarray


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each prime the first n powers, at least, of its base and of the base's inverse; small tables stay with the worker."""
    store = worker_store()
    kept = getattr(store, "prime_powers", None)
    if kept is not None and len(kept[0][0]) >= n:
        return kept
    size = 1 << max(PORTION, n - 1).bit_length() if n <= 4 * PORTION else n
    tables = []
    for prime, base in zip(_PRIMES, _BASES, strict=True):
        both = []
        for b in (base, pow(base, -1, int(prime))):
            out = np.ones(1, dtype=np.uint64)
            while len(out) < size:
                step = np.uint64(pow(b, len(out), int(prime)))
                out = np.concatenate([out, out[: size - len(out)] * step % prime])
            both.append(out)
        tables.append((both[0], both[1]))
    if n <= 4 * PORTION:
        store.prime_powers = tables
    return tables


def _block(period: int, least: int) -> int:
    """The largest power of two of which any stretch of this period that gives a run holds a whole aligned block."""
    return 1 << ((max(period, least - period) + 1) // 2).bit_length() - 1


def shifts(least: int, longest: int) -> Iterator[tuple[int, int, int]]:
    """(block size, first period, last period) by rising periods, up to half of the longest sequence."""
    period, last = 1, longest // 2
    while period <= last:
        block = _block(period, least)
        end = period
        if period >= least:
            end = 4 * block - 2
        else:
            while end + 1 < least and _block(end + 1, least) == block:
                end += 1
        yield block, period, min(end, last)
        period = end + 1


class Catchers:
    """Runs of a growing sequence of 64-bit word hashes: of length `least` or more, and of two periods or more."""

    def __init__(self, least: int = LEAST, expected: int = 0):
        self.least = max(2, least)
        self.n = 0
        none = np.zeros(0, dtype=np.int64)
        self._open, self._closed = Found(none, none, none), [Found(none, none, none)]
        self._reserve(expected)

    def append(self, values: np.ndarray, longest: int | None = None) -> None:
        """Add words; `longest`: no run will ever be longer than so many words (not bounded by default)."""
        before, self.n = self.n, self.n + len(values)
        if self.n >= len(self._sums[0]):
            self._reserve(2 * self.n)
        for sums, prime, (power, _) in zip(self._sums, _PRIMES, self._powers, strict=True):
            np.cumsum(values % prime * power[before : self.n] % prime, out=sums[before + 1 : self.n + 1])
            sums[before + 1 : self.n + 1] += sums[before]
        self._advance(before)
        known = self._open
        # A period that is too long for two turns so far may get them later.
        for block, first, last in shifts(self.least, 2 * self.n if longest is None else min(longest, 2 * self.n)):
            self._catch(before, block, first, last, known)
        live = self._open.end == self.n
        done = ~live & (self._open.end - self._open.start >= np.maximum(self.least, 2 * self._open.period))
        self._closed.append(Found(*(x[done] for x in self._open)))
        self._open = Found(*(x[live] for x in self._open))

    def runs(self) -> Found:
        """All runs so far by start and period, with smallest periods; those still open end with the words."""
        start, end, period = (np.concatenate(x) for x in zip(*self._closed, self._open, strict=True))
        long = end - start >= np.maximum(self.least, 2 * period)
        start, end, period = start[long], end[long], period[long]
        order = np.lexsort((period, end, start))
        start, end, period = start[order], end[order], period[order]
        new = np.ones(len(start), dtype=bool)
        # A stretch of a multiple of the smallest period has the same ends.
        new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        start, end, period = start[new], end[new], period[new]
        order = np.lexsort((period, start))
        return Found(start[order], end[order], period[order])

    def _reserve(self, n: int) -> None:
        """Make room for n words."""
        old = getattr(self, "_sums", None)
        self._sums, self._powers = [np.zeros(n + 1, dtype=np.uint64) for _ in _PRIMES], _powers(n + 1)
        for new, held in zip(self._sums, old or [], strict=False):
            new[: len(held)] = held

    def _key(self, prime: int, at: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        """Hashes of the `size` words from each place on."""
        sums, (_, inverse) = self._sums[prime], self._powers[prime]
        return (sums[at + size] - sums[at]) % _PRIMES[prime] * inverse[at] % _PRIMES[prime]

    def _same(self, at: np.ndarray, period: np.ndarray, size: np.ndarray) -> np.ndarray:
        equal = self._key(0, at, size) == self._key(0, at + period, size)
        return equal & (self._key(1, at, size) == self._key(1, at + period, size))

    def _forward(self, at: np.ndarray, period: np.ndarray, sure: np.ndarray) -> np.ndarray:
        """How many places from `at` on equal those a period later; `sure` of them are known to."""
        lo, hi = sure.copy(), self.n - at - period
        while len(open_ := np.flatnonzero(lo < hi)):
            half = (lo[open_] + hi[open_] + 1) // 2
            equal = self._same(at[open_], period[open_], half)
            lo[open_[equal]] = half[equal]
            hi[open_[~equal]] = half[~equal] - 1
        return lo

    def _backward(self, at: np.ndarray, period: np.ndarray, block: int) -> np.ndarray:
        """The first place of each stretch, less than a block before `at`."""
        at, step = at.copy(), block // 2
        while step:
            room = np.flatnonzero(at >= step)
            back = room[self._same(at[room] - step, period[room], np.full(len(room), step))]
            at[back] -= step
            step //= 2
        return at

    def _advance(self, before: int) -> None:
        """Follow the stretches that touched the end of the earlier words."""
        start, _, period = self._open
        self._open = Found(start, before + self._forward(before - period, period, np.zeros(len(period), dtype=np.int64)), period)

    def _catch(self, before: int, block: int, first: int, last: int, known: Found) -> None:
        """Compare the suffixes that end in this portion with the catchers of one size and hold on to the new stretches."""
        low, high = max(0, before - block + 1), self.n - block
        begin = max(0, low - last) // block * block
        blocks = np.arange(begin, high - first + 1, block)
        if not len(blocks):
            return
        width = last - first + 1
        window = np.full((len(blocks) - 1) * block + width, _NOWHERE)
        a, b = max(low, begin + first), min(high + 1, begin + first + len(window))
        window[a - begin - first : b - begin - first] = self._key(0, np.arange(a, b), block)
        seen = np.lib.stride_tricks.as_strided(window, (len(blocks), width), (block * 8, 8), writeable=False)
        hits = seen == self._key(0, blocks, block)[:, None]
        if not hits.any():
            return
        until = self._covered(blocks, block)
        if until is not None:
            hits &= np.arange(first, last + 1)[None, :] > (until - blocks - block)[:, None]
        hits[1:] &= ~hits[:-1].copy()
        row, column = np.nonzero(hits)
        at, period = blocks[row], column + first
        if len(known.period):
            # Of each period one stretch at most was open; its catchers have nothing new to say.
            order = np.argsort(known.period)
            same = order[np.minimum(np.searchsorted(known.period[order], period), len(order) - 1)]
            new = (known.period[same] != period) | (at + period >= known.end[same])
            at, period = at[new], period[new]
        true = self._same(at, period, np.full(len(at), block))
        at, period = at[true], period[true]
        if not len(at):
            return
        end = at + period + self._forward(at, period, np.full(len(at), block))
        start = self._backward(at, period, block)
        self._open = Found(*(np.concatenate([x, y]) for x, y in zip(self._open, (start, end, period), strict=True)))

    def _covered(self, blocks: np.ndarray, block: int) -> np.ndarray | None:
        """The end of the run of a period of half a block at most that covers each block; 0 without one."""
        found = [Found(*(x[(f.period * 2 <= block) & (f.end - f.start >= block) & (f.end > blocks[0])] for x in f)) for f in (*self._closed, self._open)]
        start, end = np.concatenate([f.start for f in found]), np.concatenate([f.end for f in found])
        if not len(start):
            return None
        until = np.zeros(len(blocks), dtype=np.int64)
        i = np.maximum(0, -((blocks[0] - start) // block))
        n = np.maximum(0, np.minimum(len(blocks), (end - blocks[0]) // block) - i)
        where = np.repeat(i - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        until[where] = np.repeat(end, n)
        return until


def _gaps(runs: Found, begin: int, n: int) -> np.ndarray:
    """Which of the n words from `begin` on stay: a run keeps its first period."""
    turns = np.zeros(n + 1, dtype=np.int64)
    np.add.at(turns, runs.start + runs.period - begin, 1)
    np.add.at(turns, runs.end - begin, -1)
    return np.cumsum(turns[:-1]) == 0


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kept: np.ndarray) -> bytes:
    """The kept words with one space between them."""
    at = np.flatnonzero(kept)
    if not len(at):
        return b""
    cuts = np.flatnonzero(np.diff(at) != 1) + 1
    first, last = at[np.concatenate([[0], cuts])], at[np.append(cuts - 1, len(at) - 1)]
    # bytes.split() cuts at the same six characters as `words_of`.
    parts = (data[a:b].tobytes().split() for a, b in zip(starts[first].tolist(), ends[last].tolist(), strict=True))
    return b" ".join(b" ".join(p) for p in parts)


def find(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Periodic runs of words in each whole text of `docs(doc_id, text)` -> (doc_id, n_words, runs, collapsed), one row per row.

    runs: array of structs (start, length, period) by start, then period. A run is a stretch of consecutive words, numbered from
    0, with smallest period q (words q apart are identical) and at least max(least, 2 * q) long, that no neighbouring word extends.
    collapsed: the words no run contains after its first q words, joined by one space. Words are stretches without
    space, tab, line feed, vertical tab, form feed and carriage return.

    Null, empty and blank texts have no words, no runs and an empty collapsed text. Ids may be null or repeated; each row is
    judged by itself; an empty table gives no rows; other columns are not read. Words are compared by 64-bit hashes, stretches by
    62-bit hashes of those. A task holds about a megabyte of texts at once, or one longer text (some 20 times its size).
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in texts_of(batches):
            words = words_of(texts.data, texts.offsets)
            counts = np.bincount(words.docs, minlength=texts.count)
            # Each text ends with a word that stands nowhere else, so no run goes beyond it.
            begins = np.concatenate([[0], np.cumsum(counts + 1)])
            values = np.empty(int(begins[-1]), dtype=np.uint64)
            values[begins[1:] - 1] = mix(np.arange(texts.count, dtype=np.uint64) + np.uint64(0xC0FFEE))
            values[np.arange(len(words.docs)) + words.docs] = hashes_of(texts.data, words)
            catchers = Catchers(least, len(values))
            for lo in range(0, len(values), PORTION):
                catchers.append(values[lo : lo + PORTION], int(counts.max()))
            found = catchers.runs()
            edges = np.searchsorted(found.start, begins)
            lists, collapsed = [], []
            for k in range(texts.count):
                own = Found(*(x[edges[k] : edges[k + 1]] for x in found))
                begin, n = int(begins[k]), int(counts[k])
                columns = ((own.start - begin).tolist(), (own.end - own.start).tolist(), own.period.tolist())
                lists.append([{"start": s, "length": e, "period": q} for s, e, q in zip(*columns, strict=True)])
                mine = slice(begin - k, begin - k + n)
                kept = _gaps(own, begin, n) if len(own.start) else np.ones(n, dtype=bool)
                collapsed.append(_joined(texts.data, words.starts[mine], words.ends[mine], kept).decode())
            ids = texts.batch.column(0).slice(texts.lo, texts.count)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(counts.astype(np.int64)), pa.array(lists, kind), pa.array(collapsed, pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def planted(docs: DataFrame) -> DataFrame:
    """`docs(doc_id, text)` with a periodic tail in the texts that the hash of their id picks (about one in ten).

    h is the crc32 of the id as text, g = floor(h / 10). If h % 10 = 0 and the text has n > 0 words, each word i >= a becomes word
    a + (i - a) % p, where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)); such a text is given as its words with one space
    between them. Other texts, and those with a null id, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    words = "filter(split(text, '[ \t\n\x0b\f\r]+'), w -> w <> '')"
    rows = docs.select("doc_id", "text", h.alias("h")).withColumn("g", F.floor(F.col("h") / 10))
    rows = rows.withColumn("w", F.when(F.col("h") % 10 == 0, F.expr(words)))
    rows = rows.withColumn("n", F.size("w").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    tail = F.expr("concat_ws(' ', transform(w, (x, i) -> if(i < a, x, w[cast(a + (i - a) % p as int)])))")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), tail).otherwise(F.col("text")).alias("text"))


def digest(docs: DataFrame) -> DataFrame:
    """Runs of the planted texts: their number, the longest (ties: smallest start, then period) and digests of all of them.

    One row per row of `docs(doc_id, text)`; without a run start, length, period and exponent_milli are null, and the digests are those
    of no lines and of all words.
    """
    best = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))")
    lines = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')))")
    rows = find(planted(docs.select("doc_id", "text"))).withColumn("best", best)
    length, period = F.col("best.length"), -F.col("best.period")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
