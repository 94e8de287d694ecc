"""Toxicity: a weighted finite-state grammar over clauses.

Five small transducers (insult, threat, target, negation, reported speech) are composed into one automaton whose arcs carry the
sum of their weights. A clause is read from left to right; what its arcs add up to is its evidence, so "you are a ..." counts
for more than "they said he is not a ...". Insults, as words or as stems, and their weights are learned from labels; a document's
summed clause evidence is turned into a probability by a logistic curve fitted on labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.shared import settle
from .tables import held_out, learning_labels
from .words import LOWER, Runs, Texts, hash_words, hashes_of, mix, runs_of, salted, shingles_of, stem_hashes_of, texts_of

SAMPLE = 40_000
SUPPORT = 3
DOUBT = 0.02
SKETCH = 16
# Lengths of stems in bytes: many insults of one language begin alike.
STEMS = (4, 5, 6, 7, 8)
# Most words and stems that are weighed against clean documents, those of the most toxic documents, and most that the lexicon is chosen from.
CANDIDATES = 150_000
STRONG = 2_000
RATIO = 6.0
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "insult", "threat", "target", "negation", "report", "other"
SYMBOLS = (OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT)
# What a clause's context adds to the weight of its insult, and what a complete threat is worth.
TARGETED, NEGATED, REPORTED, THREATENED = 0.7, -2.5, -1.0, 4.0
SCOPE = 3

# Closed word classes in the four languages of the corpus.
WORDS = {
    THREAT: "kill murder hurt shoot stab strangle destroy beat burn töten umbringen erschießen verprügeln zerstören tuer "
    "assassiner frapper étrangler détruire matar asesinar golpear estrangular destruir",
    TARGET: "you your yours yourself he she him her they them everyone people du dich dir dein deine ihr euch ihn ihnen leute tu "
    "toi ton ta vous votre ils elles eux gens tú ti tuyo usted ustedes ellos ellas gente",
    NEGATION: "not no never isn't aren't wasn't don't without nicht kein keine keinen nie niemals ohne ne pas jamais non sans no "
    "nunca jamás sin",
    REPORT: "said says say claimed claims wrote reported called quoted allegedly sagte sagt behauptete schrieb angeblich dit "
    "déclaré prétend écrit dijo dice afirmó escribió supuestamente",
}

Arc = tuple[int, float, bool]


@dataclass(frozen=True)
class Transducer:
    """arcs[state][symbol] = (next state, weight, whether the word's own weight is added). State 0 is the start."""

    arcs: tuple[dict[str, Arc], ...]

    def compose(self, other: Transducer) -> Transducer:
        """Both read the same symbols; weights add up. States are the reachable pairs."""
        places = {(0, 0): 0}
        order = [(0, 0)]
        arcs: list[dict[str, Arc]] = []
        for a, b in order:
            row = {}
            for symbol in SYMBOLS:
                to_a, weight_a, word_a = self.arcs[a][symbol]
                to_b, weight_b, word_b = other.arcs[b][symbol]
                if (to_a, to_b) not in places:
                    places[to_a, to_b] = len(order)
                    order.append((to_a, to_b))
                row[symbol] = (places[to_a, to_b], weight_a + weight_b, word_a or word_b)
            arcs.append(row)
        return Transducer(tuple(arcs))


def _machine(states: int, moves: dict[tuple[int, str], Arc], rest: dict[int, int] | None = None) -> Transducer:
    """Moves not named lead to `rest[state]` (the same state if not named) without weight."""
    rest = rest or {}
    arcs = [{s: (rest.get(state, state), 0.0, False) for s in SYMBOLS} for state in range(states)]
    for (state, symbol), arc in moves.items():
        arcs[state][symbol] = arc
    return Transducer(tuple(arcs))


def grammar() -> Transducer:
    insult = _machine(1, {(0, INSULT): (0, 0.0, True)})
    # A threat is complete once both the verb and a target stand in the clause, in either order.
    threat = _machine(4, {
        (0, THREAT): (1, 0.0, False), (0, TARGET): (2, 0.0, False), (1, TARGET): (3, THREATENED, False),
        (2, THREAT): (3, THREATENED, False),
    })
    target = _machine(4, {
        (0, TARGET): (1, 0.0, False), (0, INSULT): (2, 0.0, False), (1, INSULT): (3, TARGETED, False), (2, TARGET): (3, TARGETED, False),
    })
    # After a negation the next SCOPE words are in its scope.
    scope: dict[tuple[int, str], Arc] = {(state, NEGATION): (SCOPE, 0.0, False) for state in range(SCOPE + 1)}
    for state, symbol in product(range(1, SCOPE + 1), (INSULT, THREAT)):
        scope[state, symbol] = (0, NEGATED, False)
    negation = _machine(SCOPE + 1, scope, {state: max(state - 1, 0) for state in range(SCOPE + 1)})
    reported = _machine(3, {(0, REPORT): (1, 0.0, False), (1, INSULT): (2, REPORTED, False), (1, THREAT): (2, REPORTED, False)})
    out = insult
    for part in (threat, target, negation, reported):
        out = out.compose(part)
    return out


_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LETTER[39] = True
_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(b".;!?,:\n()")] = True


def letter_runs(texts: Texts) -> tuple[np.ndarray, Runs]:
    """Runs of letters, lower-cased. Typographic marks beyond ASCII and outer apostrophes are not letters."""
    data = LOWER[texts.data]
    inside = _LETTER[data]
    if len(data) > 1:
        marks = np.flatnonzero((data[:-1] == 0xE2) & (data[1:] == 0x80))
        for k in range(3):
            inside[np.minimum(marks + k, len(data) - 1)] = False
        signs = np.flatnonzero(data[:-1] == 0xC2)
        inside[signs] = inside[signs + 1] = False
        quotes = np.flatnonzero(data == 39)
        inner = (quotes > 0) & (quotes < len(data) - 1)
        near = inside[np.maximum(quotes - 1, 0)] & inside[np.minimum(quotes + 1, len(data) - 1)]
        inside[quotes[~(inner & near)]] = False
    return data, runs_of(inside, texts.offsets)


def word_forms(data: np.ndarray, runs: Runs) -> list[np.ndarray]:
    """Hashes of each word and of its stems; a stem's hash differs from that of the equal word."""
    whole, stems = stem_hashes_of(data, runs, STEMS)
    return [whole, *(mix(stem ^ np.uint64(0x57E4)) for stem in stems)]


class Lexicon:
    """Symbol and weight of each known word or stem, as sorted hashes; `insults`: hash -> weight."""

    def __init__(self, insults: dict[int, float]):
        rows = {int(h): (SYMBOLS.index(INSULT), w) for h, w in insults.items()}
        for kind in WORDS:
            rows |= {int(h): (SYMBOLS.index(kind), 0.0) for h in hash_words(WORDS[kind].split())}
        self.hashes = np.array(sorted(rows), dtype=np.uint64)
        self.symbols = np.array([rows[int(h)][0] for h in self.hashes])
        self.weights = np.array([rows[int(h)][1] for h in self.hashes])
        # Most words fall through this table and need no search.
        self.may = np.zeros(1 << 16, dtype=bool)
        self.may[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def look_up(self, forms: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and weight per word: its own entry, or the weightiest of its own and its stems' as an insult."""
        symbols = np.zeros(len(forms[0]), dtype=np.int64)
        weights = np.zeros(len(forms[0]))
        for hashes in forms:
            open_ = np.flatnonzero(self.may[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.hashes, hashes[open_]), len(self.hashes) - 1)
            known = self.hashes[at] == hashes[open_]
            open_, at = open_[known], at[known]
            better = (symbols[open_] == 0) | (self.weights[at] > weights[open_])
            open_, at = open_[better], at[better]
            symbols[open_], weights[open_] = self.symbols[at], self.weights[at]
        return symbols, weights


def evidence(texts: Texts, lexicon: Lexicon, machine: Transducer) -> tuple[np.ndarray, np.ndarray]:
    """Summed evidence of the matched clauses of each text (nan without any), and its number of words. A clause that a text repeats
    word for word counts once."""
    out = np.full(texts.count, np.nan)
    data, runs = letter_runs(texts)
    forms = word_forms(data, runs)
    sizes = np.bincount(runs.docs, minlength=texts.count)
    symbols, weights = lexicon.look_up(forms)
    anchors = np.flatnonzero((symbols == SYMBOLS.index(INSULT)) | (symbols == SYMBOLS.index(THREAT)))
    if not len(anchors):
        return out, sizes
    breaks = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(_BREAK[data], out=breaks[1:])
    opens = np.ones(len(symbols), dtype=bool)
    opens[1:] = (runs.docs[1:] != runs.docs[:-1]) | (breaks[runs.starts[1:]] > breaks[runs.ends[:-1]])
    first = np.flatnonzero(opens)
    clauses = np.unique(np.searchsorted(first, anchors, side="right") - 1)
    stops = np.append(first, len(symbols))
    sums = np.append(np.uint64(0), np.cumsum(forms[0]))
    seen: set[tuple[int, int]] = set()
    for a, b in zip(first[clauses].tolist(), stops[clauses + 1].tolist(), strict=True):
        doc = int(runs.docs[a])
        key = (doc, int(sums[b]) - int(sums[a]))
        if key in seen:
            continue
        seen.add(key)
        state, total, matched = 0, 0.0, False
        for symbol, weight in zip(symbols[a:b].tolist(), weights[a:b].tolist(), strict=True):
            state, add, own = machine.arcs[state][SYMBOLS[symbol]]
            total += add + (weight if own else 0.0)
            matched |= own or add > 0
        if matched:
            out[doc] = np.nansum([out[doc], total])
    return out, sizes


@dataclass
class Model:
    lexicon: Lexicon
    machine: Transducer
    curve: np.ndarray
    rest: float

    def score(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Probability per evidence and length; documents without a matched clause get the share of toxic ones among such documents."""
        seen = ~np.isnan(x)
        return np.where(seen, _logistic(_points(np.where(seen, x, 0.0), sizes) @ self.curve), self.rest)


def _points(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.column_stack([np.clip(x, -20, 40), np.log1p(sizes), np.ones(len(x))])


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sample(docs: DataFrame, known: DataFrame, sample: int) -> DataFrame:
    """At most `sample` labelled documents, those whose id hashes lowest -> (text, y), one per id: of rows that repeat an id the least
    text. The chosen ids are broadcast: their number is bounded by `sample`."""
    chance = min(1.0, 1.1 * sample / max(known.count(), 1))
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    chosen = settle(known.filter(spot < int(chance * (1 << 30))).orderBy(spot, "doc_id").limit(sample), "toxicity-ids")
    # Texts are shuffled only for ids that repeat.
    counts = docs.select("doc_id").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.count(F.lit(1)).alias("n"))
    counts = settle(counts, "toxicity-ids")
    rows = docs.select("doc_id", "text").join(F.broadcast(counts), "doc_id")
    once = rows.filter("n = 1").select("text", "y")
    if counts.filter("n > 1").isEmpty():
        return once
    repeated = rows.filter("n > 1").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    return once.unionByName(repeated.select("text", "y"))


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _labels(texts: Texts) -> np.ndarray:
    return np.asarray(_column(texts.batch, "y").slice(texts.lo, texts.count)) > 0.5


def _distinct(hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Places of the first of equal hashes of each document."""
    return np.unique(salted(hashes, docs), return_index=True)[1]


def _toxic_forms(rows: DataFrame) -> DataFrame:
    """(hash, form, toxic): words and stems of the toxic documents of the sample and how many hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in texts_of(batches):
            data, runs = letter_runs(texts)
            raw = data.tobytes()
            for hashes, length in zip(word_forms(data, runs), (1 << 20, *STEMS), strict=True):
                long = np.flatnonzero((runs.ends - runs.starts >= length) | (length == 1 << 20))
                first = long[_distinct(hashes[long], runs.docs[long])]
                keys, at, n = np.unique(hashes[first], return_index=True, return_counts=True)
                begin = runs.starts[first[at]].tolist()
                end = np.minimum(runs.ends[first[at]], runs.starts[first[at]] + length).tolist()
                forms = [raw[a:b] for a, b in zip(begin, end, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(forms, pa.binary()), pa.array(np.full(len(keys), length < 1 << 20)), pa.array(n)],
                    names=["hash", "form", "stem", "toxic"],
                )

    parts = rows.filter("y > 0.5").mapInArrow(run, "hash long, form binary, stem boolean, toxic long")
    return parts.groupBy("hash").agg(F.min("form").alias("form"), F.min("stem").alias("stem"), F.sum("toxic").alias("toxic"))


def _held(texts: Texts, ordered: np.ndarray, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, place in `ordered`) for each form that a text holds, once per document."""
    data, runs = letter_runs(texts)
    docs, places = [], []
    for hashes in word_forms(data, runs):
        at = np.minimum(np.searchsorted(ordered, hashes), len(ordered) - 1)
        hit = ordered[at] == hashes
        if only is not None:
            hit &= only[runs.docs]
        docs.append(runs.docs[hit])
        places.append(at[hit])
    pairs = np.unique(np.concatenate(docs) * len(ordered) + np.concatenate(places))
    return pairs // len(ordered), pairs % len(ordered)


def _clean_counts(rows: DataFrame, ordered: np.ndarray) -> np.ndarray:
    """How many clean documents of the sample hold each form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ordered), dtype=np.int64)
        for texts in texts_of(batches):
            total += np.bincount(_held(texts, ordered, ~_labels(texts))[1], minlength=len(ordered))
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], names=["k", "n"])

    out = np.zeros(len(ordered), dtype=np.int64)
    for r in rows.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[r.k] = r.n
    return out


Holder = tuple[bool, list[int], list[int]]


def _holders(rows: DataFrame, ordered: np.ndarray) -> list[Holder]:
    """For each sampled document with any of the forms: its label, the SKETCH smallest hashes of its 3-word shingles, and the forms'
    places. As many rows as the sample at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in texts_of(batches):
            found: dict[int, list[int]] = {}
            for doc, place in zip(*(a.tolist() for a in _held(texts, ordered)), strict=True):
                found.setdefault(doc, []).append(place)
            data, runs = letter_runs(texts)
            shingles, place = shingles_of(hashes_of(data, runs), runs.docs, 3)
            edges = np.searchsorted(runs.docs[place], np.arange(texts.count + 1))
            sketches = [np.unique(shingles[edges[d] : edges[d + 1]])[:SKETCH].view(np.int64).tolist() for d in found]
            toxic = _labels(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([bool(toxic[d]) for d in found], pa.bool_()), pa.array(sketches, pa.list_(pa.int64())),
                    pa.array(list(found.values()), pa.list_(pa.int32())),
                ],
                names=["toxic", "sketch", "forms"],
            )

    return [(r.toxic, r.sketch, r.forms) for r in rows.mapInArrow(run, "toxic boolean, sketch array<long>, forms array<int>").collect()]


def _merged(holders: list[Holder]) -> list[tuple[bool, set[int]]]:
    """Label and forms of each document, near copies (a quarter of the sketch in common with an earlier document) taken as one."""
    out: list[tuple[bool, set[int]]] = []
    holding: dict[tuple[bool, int], list[int]] = {}
    for toxic, sketch, found in sorted(holders):
        shared: dict[int, int] = {}
        for value in sketch:
            for group in holding.get((toxic, value), ()):
                shared[group] = shared.get(group, 0) + 1
        best = max(shared, key=lambda g: shared[g], default=None)
        if best is not None and 4 * shared[best] >= len(sketch):
            out[best][1].update(found)
        else:
            best = len(out)
            out.append((toxic, set(found)))
        for value in sketch:
            if best not in holding.setdefault((toxic, value), []):
                holding[toxic, value].append(best)
    return out


def _doubt(t: int, c: int, share: float) -> float:
    """Chance that t or more of t + c holders are toxic if being toxic has nothing to do with the form."""
    return sum(exp(lgamma(t + c + 1) - lgamma(k + 1) - lgamma(t + c - k + 1) + k * log(share) + (t + c - k) * log1p(-share)) for k in range(t, t + c + 1))


def choose(forms: list[tuple[bytes, bool]], holders: list[Holder], n_toxic: int, n_clean: int, rivals: np.ndarray) -> dict[int, float]:
    """Places of the insults among `forms` with their weights (log ratio of the shares of toxic and clean documents that hold them).

    Near copies count once. A form enters if it is RATIO times as frequent in toxic documents and if so many toxic holders by
    chance would be unlikely even among all forms as frequent (`rivals[n]`: forms held by at least n documents). The most
    telling forms come first; what begins with an accepted stem enters only if it tells more than the stem does.
    """
    held = np.zeros((2, len(forms)), dtype=np.int64)
    for toxic, found in _merged(holders):
        held[int(toxic), sorted(found)] += 1
    share = min(max(n_toxic / (n_toxic + n_clean), 1e-6), 1 - 1e-6)
    ratios = np.log((held[1] + 0.5) / (n_toxic + 1)) - np.log((held[0] + 0.5) / (n_clean + 1))
    order = sorted(range(len(forms)), key=lambda n: (-held[1, n] * ratios[n], -len(forms[n][0]), forms[n][0]))
    out: dict[int, float] = {}
    stems: list[tuple[bytes, float]] = []
    for n in order:
        t, c = int(held[1, n]), int(held[0, n])
        if not t or ratios[n] < log(RATIO) or _doubt(t, c, share) * rivals[min(t + c, len(rivals) - 1)] >= DOUBT:
            continue
        form, stem = forms[n]
        if all(ratios[n] > weight + 0.5 for known, weight in stems if form.startswith(known)):
            out[n] = float(ratios[n])
            if stem:
                stems.append((form, float(ratios[n])))
    return out


def _curve(rows: DataFrame, lexicon: Lexicon, machine: Transducer) -> tuple[np.ndarray, float]:
    """Logistic curve over evidence and length, and the toxic share of documents without evidence. One small row per sampled document
    that has any, and the counts of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in texts_of(batches):
            x, sizes = evidence(texts, lexicon, machine)
            y = _labels(texts)
            seen = np.flatnonzero(~np.isnan(x))
            bare = np.isnan(x)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.append(x[seen], np.nan)), pa.array(np.append(sizes[seen], 0)),
                    pa.array(np.append(y[seen].astype(np.int64), (bare & y).sum())), pa.array(np.append(np.ones(len(seen), np.int64), bare.sum())),
                ],
                names=["x", "size", "ones", "n"],
            )

    got = sorted(tuple(r) for r in rows.mapInArrow(run, "x double, size long, ones long, n long").collect())
    bare = [r for r in got if np.isnan(r[0])]
    rest = (sum(r[2] for r in bare) + 0.1) / (sum(r[3] for r in bare) + 4.0)
    # A few rows of doubt on either side keep the curve finite where evidence and labels agree throughout.
    data = np.array([(r[0], r[1], r[2]) for r in got if not np.isnan(r[0])], dtype=np.float64).reshape(-1, 3)
    z = np.vstack([_points(data[:, 0], data[:, 1]), _points(np.array([-1.0, 0.0, 7.0, 9.0]), np.full(4, 300.0))])
    y = np.concatenate([data[:, 2], [0.0, 0.05, 0.95, 1.0]])
    w = np.array([1.0, 0.0, -3.0])
    penalty = np.array([0.01, 0.1, 0.01])

    def loss(w: np.ndarray) -> float:
        t = z @ w
        return float((np.logaddexp(0, t) - y * t).sum() + 0.5 * (penalty * w * w).sum())

    for _ in range(60):
        p = _logistic(z @ w)
        gradient = z.T @ (p - y) + penalty * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), gradient)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
    w[0] = max(w[0], 0.05)
    return w, rest


def fit(docs: DataFrame, known: DataFrame, sample: int = SAMPLE, candidates: int = CANDIDATES, strong: int = STRONG) -> Model:
    """Learn from at most `sample` labelled documents. Without labels the lexicon is empty and only threats are found.

    `candidates` bounds the words and stems that are weighed: those that most toxic documents of the sample hold. `strong` bounds those
    the lexicon is chosen from: the ones that tell most about toxic documents.
    """
    machine = grammar()
    rows = settle(_sample(docs, known, sample), "toxicity-sample")
    totals = rows.agg(F.sum("y").alias("toxic"), F.count(F.lit(1)).alias("n")).first()
    n_toxic, n_clean = int(totals.toxic or 0), int(totals.n - (totals.toxic or 0))
    insults: dict[int, float] = {}
    if n_toxic and n_clean:
        common = _toxic_forms(rows).filter(F.col("toxic") >= SUPPORT).orderBy(F.col("toxic").desc(), "hash").limit(candidates)
        closed = {w.encode() for kind in WORDS for w in WORDS[kind].split()}
        found = [r for r in common.collect() if bytes(r.form) not in closed]
        found.sort(key=lambda r: r.hash % (1 << 64))
        ordered = np.array([r.hash % (1 << 64) for r in found], dtype=np.uint64)
        if len(ordered):
            toxic, clean = np.array([r.toxic for r in found]), _clean_counts(rows, ordered)
            rivals = np.cumsum(np.bincount(np.minimum(toxic + clean, 256), minlength=257)[::-1])[::-1]
            ratios = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
            telling = np.flatnonzero(ratios >= log(RATIO))
            telling = np.sort(telling[np.argsort(-(toxic * ratios)[telling], kind="stable")[:strong]])
            if len(telling):
                forms = [(bytes(found[n].form), bool(found[n].stem)) for n in telling]
                chosen = choose(forms, _holders(rows, ordered[telling]), n_toxic, n_clean, rivals)
                insults = {int(ordered[telling[n]]): weight for n, weight in chosen.items()}
    lexicon = Lexicon(insults)
    curve, rest = _curve(rows, lexicon, machine)
    return Model(lexicon, machine, curve, rest)


def _scored(docs: DataFrame, model: Model, carried: str) -> DataFrame:
    """Add `_score` to the column that `docs` has beside `text`; only that column comes out."""
    kind = docs.schema[carried].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in texts_of(batches):
            score = model.score(*evidence(texts, model.lexicon, model.machine))
            own = _column(texts.batch, carried).slice(texts.lo, texts.count)
            yield pa.RecordBatch.from_arrays([own, pa.array(score)], names=[carried, "_score"])

    return docs.select(carried, "text").mapInArrow(run, f"`{carried}` {kind.simpleString()}, _score double")


def score(
    docs: DataFrame, labels: DataFrame, folds: int = 5, remainder: int = 0, threshold: float = 0.5, sample: int = SAMPLE,
    candidates: int = CANDIDATES, strong: int = STRONG,
) -> DataFrame:
    """Toxicity of each document -> (doc_id, held_out, score, predicted).

    Labels are learned only from documents outside the held-out fold; without labels only threats count. One row out per row in; null
    and empty texts have no clause and get the share of toxic documents among those without a match; ids may be null (never learned from) or repeated; an
    empty table gives no rows; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(docs, learning_labels(labels, "toxic", folds, remainder), sample, candidates, strong)
    return _scored(docs, model, "doc_id").select(
        "doc_id", held_out(F.col("doc_id"), folds, remainder).alias("held_out"), F.col("_score").alias("score"),
        F.when(F.col("_score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"),
    )


def clean(docs: DataFrame, labels: DataFrame, folds: int = 5, remainder: int = 0, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` that are not toxic, with all columns of `docs`, scored as `score` does.

    Null and empty texts have no clause and stay unless most documents without one are toxic; rows that repeat an id are judged each by
    its own text; without labels only threats go; an empty table gives no rows.
    """
    model = fit(docs.select("doc_id", "text"), learning_labels(labels, "toxic", folds, remainder))
    whole = docs.select(F.struct("*").alias("_doc"), "text")
    return _scored(whole, model, "_doc").filter(F.col("_score") < threshold).select("_doc.*")
