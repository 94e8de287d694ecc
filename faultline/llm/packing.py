"""Packing token pieces into sequences: shortest-pack-first over the histogram of lengths.

1. One pass tokenizes every text, cuts its ids into pieces of at most LENGTH, and numbers the pieces of each length inside a task.
2. The histogram of lengths (at most LENGTH rows) goes to the driver, which builds packing patterns and their counts from it:
   lengths are placed longest first, each into the patterns with the most room left.
3. The pieces' numbers within their length, made global by sums per task and length, say which slot of which pattern is theirs.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.shared import settle
from .words import LOWER, Texts, hash_words, hashes_of, texts_of, words_of, worker_store

LENGTH = 2048
END = 1
KEPT_WORDS = 1_500_000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
TAIL = b".,;:!?*#$%&"


class WordIds:
    """Token ids of words, kept as sorted word hashes with stretches of one array of ids.

    A word is what stands between ASCII white space. The tokenizer drops white space and never joins over it, so a text's ids
    are its words' ids. Marks that end a word are tokenized apart from its letters, so they are looked up apart.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(definition)
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.starts = np.zeros(0, dtype=np.int64)
        self.sizes = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.uint32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash stands, and whether it does."""
        if not len(self.keys):
            return np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes), dtype=bool)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return at, self.keys[at] == hashes

    def add(self, hashes: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        starts = len(self.flat) + np.cumsum(sizes) - sizes
        self.flat = np.concatenate([self.flat, ids.astype(np.uint32)])
        order = np.argsort(hashes)
        at = np.searchsorted(self.keys, hashes[order])
        self.keys = np.insert(self.keys, at, hashes[order])
        self.starts = np.insert(self.starts, at, starts[order])
        self.sizes = np.insert(self.sizes, at, sizes[order])

    def spell(self, at: np.ndarray) -> np.ndarray:
        """The ids of the words at these places, one after the other."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(total)]

    def learn(self, words: list[bytes], hashes: np.ndarray) -> None:
        """Tokenize new words."""
        cores, tails, split = [], [], []
        for n, word in enumerate(words):
            core = word.rstrip(TAIL)
            if core and len(core) < len(word) and b"<|" not in word and core.decode()[-1].isalpha():
                cores.append(core)
                tails.append(word[len(core) :])
                split.append(n)
        whole = set(words)
        whole.difference_update(words[n] for n in split)
        whole.update(cores, tails)
        parts = [w.decode() for w in sorted(whole)]
        if parts:
            keys = hash_words(parts)
            lacking = np.flatnonzero(~self.find(keys)[1])
            found = [e.ids for e in self.tokenizer.encode_batch_fast([parts[n] for n in lacking], add_special_tokens=False)]
            sizes = np.array([len(ids) for ids in found], dtype=np.int64)
            self.add(keys[lacking], sizes, np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=int(sizes.sum())))
        if split:
            core_at, _ = self.find(hash_words([c.decode() for c in cores]))
            tail_at, _ = self.find(hash_words([t.decode() for t in tails]))
            ids = self.spell(np.column_stack([core_at, tail_at]).ravel())
            self.add(hashes[split], self.sizes[core_at] + self.sizes[tail_at], ids)

    def ids(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's ids begin, with one more at the end."""
        data = texts.data
        raw = data.tobytes()
        # Case is folded by the tokenizer; folding first saves words, but special tokens and combining marks must be left alone.
        if b"<|" not in raw and b"\xcc" not in raw:
            data = LOWER[data]
            raw = data.tobytes()
        words = words_of(data, texts.offsets)
        keys, first, back = np.unique(hashes_of(data, words), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > KEPT_WORDS:
            self.forget()
        new = np.flatnonzero(~self.find(keys)[1])
        starts, ends = words.starts[first[new]].tolist(), words.ends[first[new]].tolist()
        self.learn([raw[a:b] for a, b in zip(starts, ends, strict=True)], keys[new])
        at = self.find(keys)[0][back]
        counts = np.bincount(words.docs, weights=self.sizes[at], minlength=texts.count).astype(np.int64)
        return self.spell(at), np.concatenate([[0], np.cumsum(counts)])


def _word_ids(definition: str) -> WordIds:
    """The worker's word ids, kept from task to task as long as the worker lives."""
    kept = worker_store()
    if getattr(kept, "definition", None) != definition:
        kept.words, kept.definition = WordIds(definition), definition
    return kept.words


def _tokenized(docs: DataFrame, tokenizer: str, length: int, end: int) -> DataFrame:
    """`docs(doc_id, text)` -> PIECE, task, nth (number among the task's pieces of that length)."""
    with open(tokenizer, encoding="utf-8") as file:
        definition = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_ids(definition.value)
        task = TaskContext.get().partitionId()
        seen = np.zeros(length + 1, dtype=np.int64)
        last = np.array([end], dtype="<u4").tobytes()
        for texts in texts_of(batches):
            ids, cut = words.ids(texts)
            raw, cut = ids.astype("<u4").tobytes(), cut.tolist()
            columns: list[list[int]] = [[], [], [], [], [], []]
            for row in range(texts.count):
                own = raw[4 * cut[row] : 4 * cut[row + 1]] + last
                total = len(own) // 4
                for start in range(0, total, length):
                    size = min(length, total - start)
                    values = (row, start, size, zlib.crc32(own[4 * start : 4 * (start + size)]), total, int(seen[size]))
                    seen[size] += 1
                    for column, value in zip(columns, values, strict=True):
                        column.append(value)
            ids_of_rows = texts.batch.column(0).slice(texts.lo, texts.count).take(pa.array(columns[0], pa.int64()))
            numbers = [pa.array(c, pa.int64()) for c in columns[1:]]
            tasks = pa.array(np.full(len(columns[0]), task, dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [ids_of_rows, *numbers[:4], tasks, numbers[4]],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "nth"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, f"{PIECE}, task long, nth long")


Pattern = tuple[tuple[int, int], ...]


def patterns(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[Pattern, int]]:
    """Packing patterns ((length, times), ...) and how many sequences follow each.

    Lengths are placed longest first into the patterns with the most room (the shortest packs). If more packs share a pattern than
    pieces are left, the pattern is split. Packs of equal pattern are always counted together.
    """
    packs: dict[int, dict[Pattern, int]] = {}
    room: list[int] = []

    def put(space: int, pattern: Pattern, count: int) -> None:
        same = packs.setdefault(space, {})
        if not same:
            heapq.heappush(room, -space)
        same[pattern] = same.get(pattern, 0) + count

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            while room and not packs[-room[0]]:
                heapq.heappop(room)
            space = -room[0] if room else 0
            if space >= size:
                pattern, count = packs[space].popitem()
                used = min(count, left)
                if count > used:
                    packs[space][pattern] = count - used
            else:
                space, pattern, used = length, (), -(-left * size // length) if size <= length // 2 else left
            times = dict(pattern)
            times[size] = times.get(size, 0) + 1
            put(space - size, tuple(sorted(times.items(), reverse=True)), used)
            left -= used
    out = [(pattern, count) for same in packs.values() for pattern, count in same.items()]
    return sorted(out, reverse=True)


class Slots:
    """Where the n-th piece of a length goes: patterns laid out one after the other, as sorted arrays."""

    def __init__(self, packed: list[tuple[Pattern, int]]):
        used: dict[int, int] = {}
        rows = []
        first = 0
        for pattern, count in packed:
            offset = 0
            for size, times in pattern:
                rows.append(((size << 44) + used.get(size, 0), first, times, offset))
                used[size] = used.get(size, 0) + times * count
                offset += size * times
            first += count
        table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
        self.keys, self.first, self.times, self.offset = table.T.copy()

    def place(self, size: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset."""
        key = (size << 44) + nth
        at = np.searchsorted(self.keys, key, side="right") - 1
        inside = key - self.keys[at]
        return self.first[at] + inside // self.times[at], self.offset[at] + (inside % self.times[at]) * size


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """Pack all of `docs(doc_id, text)` into sequences of at most `length` tokens, one row per piece of a document.

    Columns: doc_id, start (the document's ids before the piece), length, ids_crc32 (of the ids as unsigned little-endian 32-bit
    numbers), doc_tokens (with the end id), sequence_id, offset. Every document gets the id `end` at its end, so null and empty
    texts make a piece of length 1. Documents beyond `length` are cut into full pieces and a rest. Repeated rows are
    packed as often as they come; ids may be null; an empty table gives no rows; other columns are not read.
    """
    pieces = settle(_tokenized(docs, tokenizer, length, end), "pieces")
    sums = settle(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r.length: r.n for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = Slots(patterns(histogram, length))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(
        F.col("length").alias("_length"), F.col("task").alias("_task"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base")
    )
    ranked = pieces.join(bases, (F.col("length") == F.col("_length")) & (F.col("task") == F.col("_task")))
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_base") + F.col("nth")).alias("nth"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sequence, offset = slots.place(np.asarray(batch.column(2)), np.asarray(batch.column(5)))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"]
                )

    return ranked.mapInArrow(run, f"{PIECE}, sequence_id long, offset long")
