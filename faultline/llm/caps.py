"""Near copies of vectors through spherical-cap filters.

A filter is a direction on the sphere; a vector passes it if their inner product reaches `alpha`. Near vectors pass common filters,
others hardly ever do. The directions are products: after a random rotation (signs and Walsh-Hadamard sums) the components are cut into
blocks, each block has a few random codewords, and every choice of one codeword per block is a direction. So a vector's list of
directions is decoded block by block, dropping choices whose best completion stays below alpha, without trying all of them.

All numbers of the decoding are whole, so that a vector's list is the same in every task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.shared import settle
from .graph import components
from .tables import SALTS

THRESHOLD = 0.93
# Expected number of common directions of two vectors at the threshold.
SHARED = 16
# Vectors of one label expected in a filter, and the largest share of them.
CROWD, WIDEST = 8, 0.02
ROTATIONS = 64
WORDS = 640
BLOCK = 2048
_VECTOR_BITS, _WORD_BITS = 16, 14
_CHUNK = 1024


class Plan(NamedTuple):
    """dims: of the vectors; room: the power of two they are rotated in; rotations x words ^ blocks directions."""

    dims: int
    room: int
    rotations: int
    blocks: int
    words: int
    alpha: float


def _caps(room: int, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a grid of alphas: the shares of the sphere within alpha of one point, and of two points at this cosine."""
    x = (np.arange(2000) + 0.5) / 2000
    alphas = np.arange(0, 990, 5) / 1000
    density = np.log1p(-x * x) * (room - 3) / 2
    weight = np.exp(density)
    cap = np.array([weight[x >= a].sum() for a in alphas]) / (2 * weight.sum())
    # The two points span a plane; the sphere's shadow on it has this density.
    u = (np.arange(-800, 800) + 0.5) / 800
    first, second = np.meshgrid(u, u, indexing="ij")
    inside = 1 - first**2 - second**2
    weight = np.where(inside > 0, np.exp(np.log(np.maximum(inside, 1e-300)) * (room - 4) / 2), 0.0)
    reach = np.minimum(first, cosine * first + math.sqrt(1 - cosine**2) * second)
    wedge = np.array([weight[reach >= a].sum() for a in alphas]) / weight.sum()
    return alphas, cap, wedge


def plan(members: int, dims: int, threshold: float) -> Plan:
    """Filters for `members` vectors of one label: each holds a few of them, however many there are, and two vectors at the threshold
    share as many filters as in a small table."""
    room = 1 << max(3, (dims - 1).bit_length())
    alphas, cap, wedge = _caps(room, threshold)
    usable = np.flatnonzero(wedge > 0)
    at = min(int(np.searchsorted(-cap, -min(WIDEST, CROWD / max(1, members)))), int(usable[-1]))
    wanted = SHARED / wedge[at] / ROTATIONS
    blocks = 2
    while wanted ** (1 / blocks) > WORDS and blocks < room // 4:
        blocks += 1
    return Plan(dims, room, ROTATIONS, blocks, max(2, math.ceil(wanted ** (1 / blocks))), float(alphas[at]))


class Code:
    """The directions of a plan; their numbers count rotations first, then the codeword of each block."""

    def __init__(self, chosen: Plan):
        self.plan, self.alpha = chosen, chosen.alpha
        rng = np.random.default_rng([chosen.room, chosen.rotations, chosen.blocks, chosen.words])
        self.signs = rng.choice([-1.0, 1.0], (chosen.rotations, 2, chosen.room))
        edges = np.linspace(0, chosen.room, chosen.blocks + 1).astype(int)
        self.cuts = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        self.codewords = []
        for _ in range(chosen.rotations):
            own = []
            for a, b in self.cuts:
                w = rng.standard_normal((chosen.words, b - a))
                w *= math.sqrt((b - a) / chosen.room) / np.linalg.norm(w, axis=1, keepdims=True)
                own.append(np.rint(w * (1 << _WORD_BITS)))
            self.codewords.append(own)
        # A vector comes as multiples of 2^-16, is rotated without the factor 1 / room, and meets codewords in multiples of 2^-14.
        self.limit = math.ceil(chosen.alpha * chosen.room * (1 << _VECTOR_BITS) * (1 << _WORD_BITS))

    def _rotated(self, whole: np.ndarray, number: int) -> np.ndarray:
        n, room = whole.shape
        for signs in self.signs[number]:
            whole = whole * signs
            step = 1
            while step < room:
                pairs = whole.reshape(n, room // (2 * step), 2, step)
                whole = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, room)
                step *= 2
        return whole

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, direction) for all directions that the unit vectors pass."""
        rows, directions = [], []
        for lo in range(0, len(unit), _CHUNK):
            part = unit[lo : lo + _CHUNK]
            whole = np.zeros((len(part), self.plan.room))
            whole[:, : self.plan.dims] = np.rint(part * (1 << _VECTOR_BITS))
            for number in range(self.plan.rotations):
                turned = self._rotated(whole, number)
                # Sums of whole numbers below 2^53: exact in any order.
                scores = [turned[:, a:b] @ w.T for (a, b), w in zip(self.cuts, self.codewords[number], strict=True)]
                best = np.cumsum([s.max(axis=1) for s in scores[::-1]], axis=0)[::-1]
                row, total, name = np.arange(len(part)), np.zeros(len(part)), np.full(len(part), number, dtype=np.int64)
                for k, score in enumerate(scores):
                    least = self.limit - total - (best[k + 1][row] if k + 1 < len(scores) else 0)
                    at, word = np.nonzero(score[row] >= least[:, None])
                    total, name, row = total[at] + score[row[at], word], name[at] * self.plan.words + word, row[at]
                rows.append(row + lo)
                directions.append(name)
        row, direction = np.concatenate(rows or [np.zeros(0, dtype=np.int64)]), np.concatenate(directions or [np.zeros(0, dtype=np.int64)])
        order = np.lexsort((direction, row))
        return row[order], direction[order]

    def directions(self) -> np.ndarray:
        """All directions in the space of the vectors, for tests of small codes."""
        out, room = [], self.plan.room
        for number in range(self.plan.rotations):
            turn = self._rotated(np.eye(room), number) / room
            words = np.zeros((1, 0))
            for w in self.codewords[number]:
                words = np.hstack([np.repeat(words, len(w), axis=0), np.tile(w / (1 << _WORD_BITS), (len(words), 1))])
            out.append((words @ turn.T)[:, : self.plan.dims])
        return np.vstack(out)


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("v"))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    # Scaled first: squares of very small or large components stay within range.
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def decoded(reps: DataFrame, plans: dict[int, Plan], carried: list[str]) -> DataFrame:
    """`reps(dims, v, ..)` -> the carried columns and `direction`, one row per direction a vector passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, Code] = {}
        for whole in batches:
            dims = whole.column(whole.schema.get_field_index("dims")).to_numpy()
            for d in np.unique(dims).tolist():
                own = whole.filter(pa.array(dims == d))
                if d not in codes:
                    codes[d] = Code(plans[d])
                for lo in range(0, own.num_rows, _CHUNK):
                    part = own.slice(lo, _CHUNK)
                    row, direction = codes[d].decode(_unit(_vectors(part)))
                    for k in range(0, len(row), 8 * _CHUNK):
                        taken = part.select(carried).take(pa.array(row[k : k + 8 * _CHUNK]))
                        yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(direction[k : k + 8 * _CHUNK])], names=[*carried, "direction"])

    schema = ", ".join([*(f"`{c}` {reps.schema[c].dataType.simpleString()}" for c in carried), "direction long"])
    return reps.mapInArrow(run, schema)


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest row that each row is tied to."""
    own = np.arange(n)
    while True:
        low = np.minimum(own[left], own[right])
        before = own.copy()
        np.minimum.at(own, left, low)
        np.minimum.at(own, right, low)
        own = own[own]
        if np.array_equal(own, before):
            return own


class _Tiles:
    """Rows of whole tiles: compares the vectors that share a tile."""

    def __init__(self, plans: dict[int, Plan], threshold: float):
        self.plans, self.threshold, self.codes = plans, threshold, {}

    def _elsewhere(self, unit: np.ndarray, rows: np.ndarray, left: np.ndarray, right: np.ndarray, direction: np.ndarray) -> np.ndarray:
        """Which pairs share a direction of a smaller number, where they are counted instead."""
        dims = unit.shape[1]
        if dims not in self.codes:
            self.codes[dims] = Code(self.plans[dims])
        at, passed = self.codes[dims].decode(unit[rows])
        lower = passed < direction[rows[at]]
        at, passed = at[lower], passed[lower]
        _, column, often = np.unique(passed, return_inverse=True, return_counts=True)
        at, column = at[often[column] > 1], (np.cumsum(often > 1) - 1)[column[often[column] > 1]]
        a, b = np.searchsorted(rows, left), np.searchsorted(rows, right)
        found = np.zeros(len(left), dtype=bool)
        for lo in range(0, int((often > 1).sum()), 4096):
            here = (column >= lo) & (column < lo + 4096)
            bits = np.zeros((len(rows), 4096), dtype=bool)
            bits[at[here], column[here] - lo] = True
            # Only bytes that some row uses are compared.
            packed = np.packbits(bits[:, : int(column[here].max(initial=lo)) - lo + 1], axis=1)
            for k in range(0, len(left), 1 << 14):
                part = slice(k, k + (1 << 14))
                found[part] |= (packed[a[part]] & packed[b[part]]).any(axis=1)
        return found

    def links(self, vectors: np.ndarray, group: np.ndarray, direction: np.ndarray, block: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Linked pairs within each group, each in one of the groups it has in common.

        group: rising numbers. two: the tile joins two blocks, and only pairs across them count."""
        unit = _unit(vectors)
        lefts, rights = [], []
        here = np.arange(len(group))
        for step in range(1, len(group)):
            here = here[here >= step]
            here = here[group[here] == group[here - step]]
            if not len(here):
                break
            one = here - step
            cross = ~two[here] | (block[here] != block[one])
            right, left = here[cross], one[cross]
            near = np.einsum("ij,ij->i", unit[left], unit[right]) >= self.threshold
            lefts.append(left[near])
            rights.append(right[near])
        left = np.concatenate(lefts) if lefts else np.zeros(0, dtype=np.int64)
        right = np.concatenate(rights) if rights else np.zeros(0, dtype=np.int64)
        if len(left):
            new = ~self._elsewhere(unit, np.unique(np.concatenate([left, right])), left, right, direction)
            left, right = left[new], right[new]
        return left, right


def linked(tiles: DataFrame, plans: dict[int, Plan], threshold: float) -> DataFrame:
    """(node, root, links) of the vectors of each tile: partners, counted with their copies, and the smallest row they are tied to here."""
    place = ["label", "dims", "direction", "i", "j"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
        """Rows of whole tiles, some thousands at once, all of one length, with a number per tile."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 4 * _CHUNK:
                ready, numbers = _numbered(held, place)
                last = int(np.searchsorted(numbers, numbers[-1]))
                if last:
                    yield ready.slice(0, last), numbers[:last]
                held = ready.slice(last).to_batches()
        if held and sum(b.num_rows for b in held):
            yield _numbered(held, place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = _Tiles(plans, threshold)
        for table, numbers in whole(batches):
            dims = table.column("dims").to_numpy()
            for d in np.unique(dims).tolist():
                own = table.filter(pa.array(dims == d)).combine_chunks()
                batch = own.to_batches()[0]
                two = batch.column("i").to_numpy() != batch.column("j").to_numpy()
                left, right = work.links(_vectors(batch), numbers[dims == d], batch.column("direction").to_numpy(), batch.column("block").to_numpy(), two)
                if not len(left):
                    continue
                copies = batch.column("copies").to_numpy()
                n = np.zeros(batch.num_rows, dtype=np.int64)
                np.add.at(n, left, copies[right])
                np.add.at(n, right, copies[left])
                full = np.flatnonzero(n)
                node = batch.column("node")
                roots = _roots(batch.num_rows, left, right)[full]
                yield pa.RecordBatch.from_arrays([node.take(pa.array(full)), node.take(pa.array(roots)), pa.array(n[full])], names=["node", "root", "links"])

    ordered = tiles.repartition(*place).sortWithinPartitions(*place, "node")
    return ordered.mapInArrow(run, "node string, root string, links long")


def _numbered(batches: list[pa.RecordBatch], place: list[str]) -> tuple[pa.Table, np.ndarray]:
    """The rows as one table, and a number that rises where the place changes."""
    table = pa.Table.from_batches(batches).combine_chunks()
    turn = np.zeros(table.num_rows, dtype=bool)
    for name in place:
        codes = table.column(name).combine_chunks()
        codes = codes.dictionary_encode().indices.to_numpy() if not pa.types.is_integer(codes.type) else codes.to_numpy()
        turn[1:] |= codes[1:] != codes[:-1]
    return table, np.cumsum(turn)


def _usable(v: Column) -> Column:
    good = F.forall(v, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))) & ~F.isnan(c))
    return F.coalesce(F.col("label").isNotNull() & good & F.exists(v, lambda c: c != 0), F.lit(False))


def near_copies(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Near copies among `vectors(vec_id, embedding, label)` -> (vec_id, n_links, component_id, kept), one row per row in.

    Two rows are linked if their labels are equal and the cosine of their vectors, of one length, is at least the threshold (in double
    precision). n_links: other rows linked directly. component_id: the smallest id reachable by links, the own one included. kept: the id is the
    component's; false for a null id in a component that has another. Vectors that are null, empty or zero, have null or non-finite components,
    or a null label, link with nothing. Equal rows are copies of each other; ids may be null or repeated; an empty table gives
    no rows; other columns are not read.

    No pair below the threshold is linked. Of pairs exactly at the threshold 0.02 % are missed among 100,000 vectors of a label, 0.6 % among
    10^9 (measured), of nearer ones less. Equal vectors are compared once. A filter with more than BLOCK vectors is cut into blocks by hash, and each two blocks meet in a tile of their
    own; in a task pairs are compared, never made rows.
    """
    v = F.col("embedding").cast("array<double>")
    named = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), F.col("label").cast("string").alias("label"), _usable(v).alias("usable"))
    key = F.md5(F.concat_ws(",", "label", F.col("v").cast("array<string>")))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    rows = settle(named.select("vec_id", "label", F.when(F.col("usable"), F.col("v")).alias("v"), F.when(F.col("usable"), key).alias("node"), salt.alias("salt")), "vectors")
    good, rest = rows.filter("node is not null"), rows.filter("node is null")
    parts = good.groupBy("node", "salt").agg(
        F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first"), F.any_value("label").alias("label"), F.any_value("v").alias("v"))
    reps = parts.groupBy("node").agg(
        F.sum("copies").alias("copies"), F.min("first").alias("first"), F.collect_list("salt").alias("salts"),
        F.any_value("label").alias("label"), F.any_value("v").alias("v"))
    reps = settle(reps.withColumn("dims", F.size("v")), "different-vectors")
    # One row per length of vectors.
    largest = reps.groupBy("dims", "label").count().groupBy("dims").agg(F.max("count")).collect()
    plans = {d: plan(n, d, threshold) for d, n in largest}
    place = ["label", "dims", "direction"]
    crowds = decoded(reps.select("label", "dims", "v"), plans, ["label", "dims"]).groupBy(*place).agg(F.count(F.lit(1)).alias("n"))
    large = settle(crowds.filter(F.col("n") > BLOCK).select(*place, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "large-filters")
    passed = decoded(reps.select("node", "copies", "label", "dims", "v"), plans, ["node", "copies", "label", "dims", "v"])
    tiles = passed.join(large, place, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    tiles = tiles.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    tiles = tiles.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tiles = tiles.select(*place, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "copies", "v")
    found = settle(linked(tiles, plans, threshold), "vector-links")
    tied = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    # The smallest id of a component: components have keys, ids may be null or repeated.
    tied = tied.join(reps.select("node", "first"), "node")
    least = tied.groupBy("root").agg(F.min("first").alias("component_id"))
    tied = settle(tied.join(least, "root").select("node", "component_id"), "vector-components")
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = reps.select("node", "copies", "first", "salts").join(sums, "node", "left").join(tied, "node", "left")
    known = known.select(
        "node", F.explode("salts").alias("salt"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component_id", "first").alias("component_id"))
    out = good.select("vec_id", "node", "salt").join(known, ["node", "salt"]).select("vec_id", "n_links", "component_id")
    alone = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
