"""Words, lines and shingles of many texts at once, as numpy arrays over the bytes of an Arrow text column.

A word is a maximal run of bytes outside space, tab, newline, vertical tab, form feed and carriage return. Runs are told
apart by 64-bit hashes: a sum of random values per byte times powers of an odd number, cut out of a running sum.
No Python object is made per word or character.
"""

from __future__ import annotations

import gc
import sys
from collections.abc import Iterator
from types import ModuleType
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_CHUNK = 1 << 18
_ODD = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_ODD, -1, 1 << 64)


class Texts(NamedTuple):
    """The texts lo..hi of a batch: their bytes and the byte offset of each, with one more at the end."""

    batch: pa.RecordBatch
    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def count(self) -> int:
        return self.hi - self.lo


class Runs(NamedTuple):
    starts: np.ndarray
    ends: np.ndarray
    docs: np.ndarray


def _flags(wanted: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(wanted)] = True
    return table


SPACE = _flags(b" \t\n\x0b\x0c\r")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_VALUES = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)
SHINGLE_FACTORS = np.random.default_rng(21).integers(0, 1 << 63, 5, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _let_go() -> None:
    """Give freed memory back, also what Arrow's pool holds for later."""
    gc.collect()
    pa.default_memory_pool().release_unused()


def texts_of(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """Cut each batch into runs of rows of about `limit` bytes of text (one row at least). Null counts as empty."""
    # What the worker's last task left in reference cycles (functions that came by value, with their arrays) goes first.
    _let_go()
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
            yield Texts(batch, lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            lo = hi
        del texts, offsets, raw, data
    # A worker waits for its next task, maybe one of another stage, with nothing but what it keeps on purpose.
    _let_go()


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text have the flag."""
    running = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=running[1:])
    return running[offsets[1:]] - running[offsets[:-1]]


def runs_of(inside: np.ndarray, offsets: np.ndarray) -> Runs:
    """Maximal runs of flagged bytes; a run never crosses the end of a text."""
    n = len(inside)
    first, last = inside.copy(), inside.copy()
    if n:
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        first[1:] &= ~inside[:-1] | edge[1:n]
        last[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    return Runs(starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, side="right") - 1)


def words_of(data: np.ndarray, offsets: np.ndarray) -> Runs:
    return runs_of(~SPACE[data], offsets)


def lines_of(data: np.ndarray, offsets: np.ndarray) -> Runs:
    """The \\n-split lines that have a word; spaces around the words belong to the line."""
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    docs = np.searchsorted(offsets, starts, side="right") - 1
    breaks = np.append(breaks, len(data))
    ends = np.minimum(breaks[np.searchsorted(breaks, starts)], offsets[docs + 1])
    running = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(~SPACE[data], out=running[1:])
    full = running[ends] > running[starts]
    return Runs(starts[full], ends[full], docs[full])


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def worker_store() -> ModuleType:
    """A place that lives as long as the Python worker, from task to task."""
    return sys.modules.setdefault("_faultline_worker", ModuleType("_faultline_worker"))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, at least, of the odd number and of its inverse."""
    store = worker_store()
    kept = getattr(store, "powers", None)
    if kept is not None and len(kept[0]) >= n:
        return kept
    both = []
    for base in (_ODD, _INVERSE):
        p = np.full(max(n, _CHUNK), base, dtype=np.uint64)
        p[0] = 1
        both.append(np.multiply.accumulate(p))
    if n <= _CHUNK:
        store.powers = (both[0], both[1])
    return both[0], both[1]


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, stops: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of the stretches from `starts` to each of `stops`, none of which goes beyond the run's end."""
    out = [np.empty(len(starts), dtype=np.uint64) for _ in stops]
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + _CHUNK, side="right")))
        part = data[lo : int(ends[j - 1])]
        power, inverse = powers(len(part))
        running = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUES[part] * power[: len(part)], out=running[1:])
        at = starts[i:j] - lo
        for found, stop in zip(out, stops, strict=True):
            found[i:j] = (running[stop[i:j] - lo] - running[at]) * inverse[at]
        i = j
    for found, stop in zip(out, stops, strict=True):
        found ^= (stop - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return [mix(found) for found in out]


def hashes_of(data: np.ndarray, runs: Runs) -> np.ndarray:
    """A 64-bit hash of the bytes of each run."""
    return _hashes(data, runs.starts, runs.ends, [runs.ends])[0]


def stem_hashes_of(data: np.ndarray, runs: Runs, lengths: tuple[int, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The hash of each run, and of its first k bytes for each k (of the run itself where it is shorter)."""
    stops = [np.minimum(runs.starts + k, runs.ends) for k in lengths]
    whole, *stems = _hashes(data, runs.starts, runs.ends, [runs.ends, *stops])
    return whole, stems


def hash_words(words: list[str]) -> np.ndarray:
    """The hashes `hashes_of` gives to these strings."""
    raw = [w.encode() for w in words]
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    return hashes_of(data, Runs(offsets[:-1], offsets[1:], np.arange(len(raw))))


def shingles_of(words: np.ndarray, docs: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of `size` words within a text, and the position of each window's first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(docs[:n] == docs[size - 1 :])
    total = np.zeros(len(at), dtype=np.uint64)
    for k in range(size):
        total += words[at + k] * SHINGLE_FACTORS[k]
    return mix(total), at


def salted(hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Make hashes of different texts differ, so that one sort serves all texts of a batch."""
    return mix(hashes ^ mix(docs.astype(np.uint64) + np.uint64(0x51)))


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where the same value stands elsewhere too."""
    if not len(keys):
        return np.zeros(0, dtype=bool)
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(keys), dtype=bool)
    return twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys


def distinct_per_text(hashes: np.ndarray, docs: np.ndarray, count: int) -> np.ndarray:
    """How many different hashes each text has."""
    _, first = np.unique(salted(hashes, docs), return_index=True)
    return np.bincount(docs[first], minlength=count)
