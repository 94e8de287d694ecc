"""N-gram Jaccard self-join with Bayesian candidate pruning.

1. Texts of equal words are one representative; each gets SIGNATURE one-byte MinHash values of its 5-word shingles.
2. Representatives that agree in a band of values are compared value by value, a few at a time; a pair is dropped as soon as
   the posterior probability that its similarity reaches the threshold falls below TOLERANCE. What is left connects candidates.
3. Inside each connected candidate set all pairs are pruned the same way and the rest verified on the exact shingle sets.

Pairs are never rows: tasks compare blocks of bounded size and give back edges of a spanning forest and sums of links.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.shared import settle
from .graph import components
from .tables import with_group
from .words import Texts, hashes_of, mix, powers, shingles_of, texts_of, words_of

SIZE = 5
THRESHOLD = 0.8
SIGNATURE = 192
STEP = 32
BAND = 6
TOLERANCE = 1e-6
BLOCK = 2048
BLOCK_BYTES = 8 << 20
_rng = np.random.default_rng(11)
_XOR = _rng.integers(0, 1 << 32, SIGNATURE, dtype=np.uint32)
_MULTIPLY = _rng.integers(0, 1 << 31, SIGNATURE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> list[int]:
    """For 32, 64, ... compared values: fewer matches than this mean P(similarity >= threshold | matches) < tolerance.

    One-byte values agree by chance once in 256; the similarity is uniform beforehand.
    """
    grid = (np.arange(4000) + 0.5) / 4000
    p = grid + (1 - grid) / 256
    out = []
    for n in range(STEP, SIGNATURE + 1, STEP):
        for m in range(n + 1):
            weight = np.exp(lgamma(n + 1) - lgamma(m + 1) - lgamma(n - m + 1) + m * np.log(p) + (n - m) * np.log1p(-p))
            if weight[grid >= threshold].sum() >= tolerance * weight.sum():
                out.append(m)
                break
    return out


def surviving(sig: np.ndarray, left: np.ndarray, right: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that no comparison of the next STEP values rules out."""
    matches = np.zeros(len(left), dtype=np.int32)
    for step, bound in enumerate(least):
        part = sig[:, step * STEP : (step + 1) * STEP]
        matches += (part[left] == part[right]).sum(1, dtype=np.int32)
        keep = matches >= bound
        left, right, matches = left[keep], right[keep], matches[keep]
    return left, right


def all_pairs(sig: np.ndarray, blocks: np.ndarray | None, least: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Surviving pairs, some rows at a time: all of them, or with `blocks` those across two blocks (none if one has no rows)."""
    n = len(sig)
    two = blocks is not None
    first = np.flatnonzero(blocks == blocks.min()) if two else np.arange(n)
    second = np.flatnonzero(blocks != blocks.min()) if two else np.arange(n)
    rows = max(1, (1 << 16) // max(len(second), 1))
    for at in range(0, len(first), rows):
        own = first[at : at + rows]
        left, right = np.repeat(own, len(second)), np.tile(second, len(own))
        if not two:
            left, right = left[left < right], right[left < right]
        if len(left):
            yield surviving(sig, left, right, least)


class Forest:
    """Union by smallest root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def tie(self, left: np.ndarray, right: np.ndarray) -> None:
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            a, b = self.root(a), self.root(b)
            if a != b:
                self.up[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        return np.array([self.root(x) for x in range(len(self.up))], dtype=np.int64)


def _shingled(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text, the edges between texts, words per text, and 128-bit keys of the word sequences.

    A text with fewer words than a shingle has one shingle: all of them. A text without words has none.
    """
    words = words_of(texts.data, texts.offsets)
    hashes = hashes_of(texts.data, words)
    n_words = np.bincount(words.docs, minlength=texts.count)
    edges = np.concatenate([[0], np.cumsum(n_words)])
    power, inverse = powers(len(hashes) + 1)
    key = np.empty((texts.count, 2), dtype=np.uint64)
    for k, salt in enumerate((0x1B873593, 0xE6546B64)):
        running = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(mix(hashes ^ np.uint64(salt)) * power[: len(hashes)], out=running[1:])
        key[:, k] = mix((running[edges[1:]] - running[edges[:-1]]) * inverse[edges[:-1]] + n_words.astype(np.uint64))
    shingles, at = shingles_of(hashes, words.docs, SIZE)
    docs = words.docs[at]
    short = np.flatnonzero((n_words > 0) & (n_words < SIZE))
    if len(short):
        order = np.argsort(np.concatenate([docs, short]), kind="stable")
        shingles = np.concatenate([shingles, key[short, 0]])[order]
        docs = np.concatenate([docs, short])[order]
    return shingles, np.searchsorted(docs, np.arange(texts.count + 1)), n_words, key


def _signatures(shingles: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """One byte per hash function and text (zeros for a text without shingles)."""
    out = np.zeros((len(edges) - 1, SIGNATURE), dtype=np.uint8)
    full = np.flatnonzero(edges[1:] > edges[:-1])
    if len(full):
        base = (shingles >> np.uint64(32)).astype(np.uint32)
        starts = edges[:-1][full]
        for k in range(SIGNATURE):
            least = np.minimum.reduceat((base ^ _XOR[k]) * _MULTIPLY[k], starts)
            out[full, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(24)
    return out


def _binary(values: np.ndarray) -> pa.Array:
    """Rows of bytes as an Arrow column."""
    n, width = values.shape
    offsets = np.arange(0, (n + 1) * width, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _bytes_of(column: pa.Array, width: int) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].reshape(len(column), width)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def signatures(docs: DataFrame) -> DataFrame:
    """`docs(doc_id, text)` -> (doc_id, key, n_words, n_bytes, sig)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in texts_of(batches):
            shingles, edges, n_words, key = _shingled(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    texts.batch.column(0).slice(texts.lo, texts.count), _binary(key.view(np.uint8)), pa.array(n_words),
                    pa.array(np.diff(texts.offsets)), _binary(_signatures(shingles, edges)),
                ],
                names=["doc_id", "key", "n_words", "n_bytes", "sig"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, key binary, n_words long, n_bytes long, sig binary")


def _with_key(docs: DataFrame, carried: str, once: bool) -> DataFrame:
    """`docs(carried, text)` -> (carried, key); `once`: a task gives each key only the first time."""
    kind = docs.schema[carried].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for texts in texts_of(batches):
            key = _shingled(texts)[3]
            rows = pa.RecordBatch.from_arrays(
                [_column(texts.batch, carried).slice(texts.lo, texts.count), _binary(key.view(np.uint8))], names=[carried, "key"]
            )
            if once:
                new = []
                for n, value in enumerate(key.view("V16").ravel().tolist()):
                    if value not in seen:
                        seen.add(value)
                        new.append(n)
                rows = rows.take(pa.array(new, pa.int64()))
            yield rows

    columns = [carried] if carried == "text" else [carried, "text"]
    return docs.select(*columns).mapInArrow(run, f"`{carried}` {kind}, key binary")


def _groups(keys: list[np.ndarray]) -> np.ndarray:
    """Where the value of any of the sorted columns changes, with 0 and the end."""
    n = len(keys[0])
    change = np.zeros(n, dtype=bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(change), n)


def candidate_edges(reps: DataFrame, threshold: float) -> DataFrame:
    """`reps(key, sig)` -> (a, b): a spanning forest of the surviving pairs of each band bucket.

    A bucket beyond BLOCK members is cut into blocks by hash, and each pair of blocks is compared in a group of its own.
    """
    bands = SIGNATURE // BAND
    spread = F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.substring(F.col("sig"), b * BAND + 1, F.lit(BAND)))
    )
    rows = reps.select("key", F.explode(spread).alias("bucket"))
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = rows.join(counts, "bucket").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    members = members.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    members = members.select("key", "bucket", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    members = members.select("key", "bucket", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    tiles = members.join(reps.select("key", "sig"), "key").select("bucket", "i", "j", "block", "key", "sig")
    least = least_matches(threshold)

    def compare(key: np.ndarray, sig: np.ndarray, inside: np.ndarray, blocks: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`inside`: whether the tile of each row is that of one block."""
        sizes = np.diff(edges)
        two = edges[:-1][sizes == 2]
        two = two[inside[two] | (blocks[two] != blocks[two + 1])]
        left, right = surviving(sig, two, two + 1, least)
        lefts, rights = [left], [right]
        for a, b in zip(edges[:-1][sizes > 2].tolist(), edges[1:][sizes > 2].tolist(), strict=True):
            forest = Forest(b - a)
            for left, right in all_pairs(sig[a:b], None if inside[a] else blocks[a:b], least):
                forest.tie(left, right)
            roots = forest.roots()
            tied = np.flatnonzero(roots != np.arange(b - a))
            lefts.append(tied + a)
            rights.append(roots[tied] + a)
        return key[np.concatenate(lefts)], key[np.concatenate(rights)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.collect()
        held: tuple[np.ndarray, ...] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = (
                *(np.asarray(_column(batch, c)) for c in ("bucket", "i", "j", "block")),
                _bytes_of(_column(batch, "key"), 16), _bytes_of(_column(batch, "sig"), SIGNATURE),
            )
            held = now if held is None else tuple(np.concatenate([a, b]) for a, b in zip(held, now, strict=True))
            edges = _groups(list(held[:3]))
            if len(edges) > 2:
                cut = int(edges[-2])
                left, right = compare(held[4][:cut], held[5][:cut], (held[1] == held[2])[:cut], held[3][:cut], edges[:-1])
                held = tuple(a[cut:].copy() for a in held)
                yield pa.RecordBatch.from_arrays([_binary(left), _binary(right)], names=["a", "b"])
        if held is not None:
            left, right = compare(held[4], held[5], held[1] == held[2], held[3], np.array([0, len(held[0])]))
            yield pa.RecordBatch.from_arrays([_binary(left), _binary(right)], names=["a", "b"])

    ordered = tiles.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return ordered.mapInArrow(run, "a binary, b binary").filter("a <> b").distinct()


def _exact(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the Jaccard similarity of each pair of shingle sets reaches the threshold.

    Many pairs over few sets are counted by products of 0/1 matrices over the shingles that two sets or more have.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    if len(left) <= 2 * len(sets):
        shared = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left.tolist(), right.tolist(), strict=True)])
    else:
        names, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
        keep = often[column] > 1
        row, column = row[keep], (np.cumsum(often > 1) - 1)[column[keep]]
        counts = np.zeros((len(sets), len(sets)), dtype=np.float32)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for lo in range(0, int((often > 1).sum()), 2048):
            a, b = np.searchsorted(column, [lo, lo + 2048])
            matrix = np.zeros((len(sets), 2048), dtype=np.float32)
            matrix[row[a:b], column[a:b] - lo] = 1
            counts += matrix @ matrix.T
        shared = counts[left, right].astype(np.float64)
    return shared >= threshold * (sizes[left] + sizes[right] - shared) - 1e-9


def by_tile(rows: Iterable[tuple[tuple, bytes, Callable[[], tuple]]]) -> Iterator[tuple[tuple, dict[bytes, tuple]]]:
    """(tile, key, how to make the row) in order of tiles -> each tile with one row per key; copies of a key are not made."""
    current, held = None, {}
    for tile, key, make in rows:
        if tile != current:
            if held:
                yield current, held
            current, held = tile, {}
        if key not in held:
            held[key] = make()
    if held:
        yield current, held


def links(reps: DataFrame, texts: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Verified links inside each candidate set -> (key, root, links): partners counted with their copies, per tile, and the key of
    the tile's connected part.

    `nodes(node, root)`: candidate sets. `texts(text, key)`. A set beyond BLOCK members or BLOCK_BYTES of text is cut into blocks
    by hash; each pair of blocks is a group of its own.
    """
    sized = nodes.select(F.col("node").alias("key"), F.col("root").alias("part")).join(reps.select("key", "copies", "n_bytes"), "key")
    sums = sized.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("bytes"))
    sums = sums.withColumn("blocks", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES), F.lit(1)).cast("int"))
    placed = sized.join(sums.select("part", "blocks"), "part")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    tiles = texts.join(placed, "key").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tiles = tiles.select("part", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "copies", "text")
    least = least_matches(threshold)

    def verify(tile: tuple[bytes, int, int], once: dict[bytes, tuple]) -> pa.RecordBatch | None:
        rows = [once[k] for k in sorted(once)]
        if len(rows) < 2:
            return None
        sets, copies = [r[1] for r in rows], np.array([r[2] for r in rows], dtype=np.int64)
        sig, blocks = np.vstack([r[4] for r in rows]), np.array([r[3] for r in rows])
        pairs = list(all_pairs(sig, None if tile[1] == tile[2] else blocks, least))
        left = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, dtype=np.int64)
        right = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, dtype=np.int64)
        if not len(left):
            return None
        good = _exact(sets, left, right, threshold)
        left, right = left[good], right[good]
        n = np.bincount(left, weights=copies[right], minlength=len(rows)) + np.bincount(right, weights=copies[left], minlength=len(rows))
        forest = Forest(len(rows))
        forest.tie(left, right)
        roots = forest.roots()
        linked = np.flatnonzero(n > 0)
        if not len(linked):
            return None
        key = np.frombuffer(b"".join(r[0] for r in rows), dtype=np.uint8).reshape(-1, 16)
        return pa.RecordBatch.from_arrays(
            [_binary(key[linked]), _binary(key[roots[linked]]), pa.array(n[linked].astype(np.int64))], names=["key", "root", "links"]
        )

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes, Callable[[], tuple]]]:
        for part in texts_of(batches):
            shingles, edges, _, _ = _shingled(part)
            sig = _signatures(shingles, edges)
            names = ("part", "i", "j", "block", "key", "copies")
            columns = [_column(part.batch, c).slice(part.lo, part.count).to_pylist() for c in names]
            for n, (group, i, j, block, key, copies) in enumerate(zip(*columns, strict=True)):

                def make(n=n, key=key, copies=copies, block=block) -> tuple:
                    return key, np.unique(shingles[edges[n] : edges[n + 1]]), copies, block, sig[n].copy()

                yield (group, i, j), key, make

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile, held in by_tile(members(batches)):
            if (out := verify(tile, held)) is not None:
                yield out

    ordered = tiles.repartition("part", "i", "j").sortWithinPartitions("part", "i", "j")
    return ordered.mapInArrow(run, "key binary, root binary, links long")


def _classes(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Per document (doc_id, key), and per representative (key, rep_id, copies, root, links)."""
    members = settle(signatures(docs), "shingle-signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id")).alias("first")
    reps = members.groupBy("key").agg(
        first, F.count(F.lit(1)).alias("copies"), F.max("n_words").alias("n_words"), F.max("n_bytes").alias("n_bytes"), F.first("sig").alias("sig")
    )
    reps = settle(reps.select("key", F.col("first.doc_id").alias("rep_id"), "copies", "n_words", "n_bytes", "sig"), "shingle-representatives")
    edges = settle(candidate_edges(reps.filter("n_words > 0"), threshold), "candidate-edges")
    nodes = settle(components(edges), "candidate-sets")
    found = settle(links(reps, _with_key(docs.select("text"), "text", once=True), nodes, threshold), "links")
    # A set in one tile is connected already; the others are put together here.
    roots = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("key").agg(F.sum("links").alias("links")).join(roots.withColumnRenamed("node", "key"), "key", "left")
    out = reps.select("key", "rep_id", "copies").join(sums, "key", "left")
    out = out.select("key", "rep_id", "copies", F.coalesce("root", "key").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    return members.select("doc_id", "key"), settle(out, "link-sums")


def join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Near-duplicate classes of `docs(doc_id, text)` -> (doc_id, class_id, n_links), one row out per row in.

    Two documents are linked if the Jaccard similarity of their sets of 5-word shingles (words between white space, as written)
    is at least the threshold. class_id: the smallest id in the connected class (null only if all are null). n_links: other
    documents linked to this one, copies included. Documents without words are copies of each other and of nothing else;
    those with fewer than five words have one shingle, all their words. Ids may be null or repeated; an empty table gives no
    rows; other columns are not read.

    Pairs meet through bands of MinHash values; at similarity 0.8 a pair meets in none with a chance of 6e-5, above 0.85 of 3e-7.
    """
    members, reps = _classes(docs.select("doc_id", "text"), threshold)
    first = F.struct(F.col("rep_id").isNull().alias("last"), "rep_id")
    classed = with_group(reps, "root", "key", first).select(
        "key", F.col("_first.rep_id").alias("class_id"), (F.col("copies") - 1 + F.col("links")).alias("n_links")
    )
    # Copies may hold a third of the documents: their join is split by the adaptive skew join.
    return members.join(classed, "key").select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` without near duplicates: of each class the row with the smallest id stays, with all its columns."""
    _, reps = _classes(docs.select("doc_id", "text"), threshold)
    order = F.struct(F.col("rep_id").isNull().alias("last"), "rep_id", "key")
    kept = with_group(reps, "root", "key", order).filter("key = _first.key")
    kept = settle(kept.select("key", F.coalesce(F.col("rep_id").cast("string"), F.lit("")).alias("_own")), "kept-keys")
    # Met by key and id: copies of one text, which may be a third of the rows, spread over the tasks by their ids.
    whole = _with_key(docs.select(F.struct("*").alias("_doc"), "text"), "_doc", once=False)
    whole = whole.withColumn("_own", F.coalesce(F.col("_doc.doc_id").cast("long").cast("string"), F.lit("")))
    # What is left of a key has one id; rows that repeat it are already in one place.
    one = Window.partitionBy("key", "_own").orderBy("key")
    rows = whole.join(kept, ["key", "_own"], "left_semi").withColumn("_rank", F.row_number().over(one)).filter("_rank = 1")
    return rows.select("_doc.*")
