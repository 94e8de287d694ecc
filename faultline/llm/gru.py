"""Gated recurrent language model in numpy: training by truncated backpropagation through time, and scoring of whole documents.

Words are predicted in two steps: a softmax over classes, then one over the words of the class. Frequent words stand in CLASSES
classes of equal size; all others stand in TAILS open classes by their last letters, inside which a word has the share
(count + 1) / (words + different words + 1) that its training count gives it. States go on from window to window, so a document's score is that
of the whole document.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, fields

import numpy as np

CLASSES = 64
PER_CLASS = 64
VOCABULARY = CLASSES * PER_CLASS
TAILS = 64
HIDDEN = 32
START = VOCABULARY + TAILS
LEAST_STREAMS, TRAIN_STREAMS, TRAIN_WINDOW = 64, 512, 16
STEPS = 128
SCORE_STREAMS, SCORE_WINDOW = 384, 32
RATE = 0.2
SHORT = 8
ABSENT = -30.0
SAFE = 60.0


@dataclass
class Parameters:
    """embed: the gates' input for each word, tail class and document start. recur: from state to gates. top, top_bias: classes.
    words, word_bias: the words of each class."""

    embed: np.ndarray
    recur: np.ndarray
    top: np.ndarray
    top_bias: np.ndarray
    words: np.ndarray
    word_bias: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, f.name).ravel() for f in fields(self)]).astype(np.float32)

    def filled(self, flat: np.ndarray) -> Parameters:
        out, at = [], 0
        for f in fields(self):
            own = getattr(self, f.name)
            out.append(flat[at : at + own.size].reshape(own.shape).astype(np.float32))
            at += own.size
        return Parameters(*out)


def initial(word_counts: np.ndarray, tail_counts: np.ndarray, seed: int = 3) -> Parameters:
    """Small random weights; the biases are the logarithms of the training counts, so the untrained model is a unigram model."""
    rng = np.random.default_rng(seed)

    def small(*shape: int) -> np.ndarray:
        return (rng.normal(size=shape) * 0.1).astype(np.float32)

    by_class = word_counts.reshape(CLASSES, PER_CLASS).astype(np.float64)
    top = np.log(np.concatenate([by_class.sum(1), tail_counts]) + 1.0)
    inside = np.where(by_class > 0, np.log(by_class + 1.0), ABSENT)
    inside[0, 0] = np.log(by_class[0, 0] + 1.0)
    return Parameters(
        small(START + 1, 3 * HIDDEN), small(HIDDEN, 3 * HIDDEN), small(HIDDEN, CLASSES + TAILS), (top - top.max()).astype(np.float32),
        small(CLASSES, HIDDEN, PER_CLASS), (inside - inside.max(1, keepdims=True)).astype(np.float32),
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _step(p: Parameters, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step from state h on inputs x: gates z and r, candidate n, what r gates, and the new state."""
    given, kept = p.embed[x], h @ p.recur
    gates = _sigmoid(given[:, : 2 * HIDDEN] + kept[:, : 2 * HIDDEN])
    z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
    past = kept[:, 2 * HIDDEN :]
    n = np.tanh(given[:, 2 * HIDDEN :] + r * past)
    return z, r, n, past, n + z * (h - n)


def _sigmoid_into(x: np.ndarray) -> None:
    """sigmoid(-x) in place; exp() takes half the time of tanh()."""
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += np.float32(1)
    np.divide(np.float32(1), x, out=x)


def _tanh_into(x: np.ndarray) -> None:
    """tanh(-x / 2) in place."""
    _sigmoid_into(x)
    x += x
    x -= np.float32(1)


def _wide(p: Parameters, size: float = 1.0) -> tuple[tuple[np.ndarray, bool], tuple[np.ndarray, bool]]:
    return _widened(p.top, p.top_bias, size), _widened(p.words, p.word_bias, size)


def _widened(weights: np.ndarray, bias: np.ndarray, size: float = 1.0) -> tuple[np.ndarray, bool]:
    """Weights with the bias as one more row, shifted so that exp() of every largest value stays within range; and whether that is
    sure for states with components up to `size`. A softmax doesn't change if all its values are shifted."""
    reach = np.abs(weights).sum(-2) * np.float32(size)
    high, low = (bias + reach).max(-1, keepdims=True), (bias - reach).max(-1, keepdims=True)
    wide = np.concatenate([weights, (bias - (high + low) * np.float32(0.5))[..., None, :]], axis=-2)
    return wide, bool(((high - low) < 2 * SAFE).all())


def _with_one(states: np.ndarray) -> np.ndarray:
    out = np.ones((len(states), states.shape[1] + 1), dtype=np.float32)
    out[:, :-1] = states
    return out


def _row_sums(x: np.ndarray, parts: list[tuple[int, int, int]] | None) -> np.ndarray:
    """Part by part where there are parts: how a product rounds can follow from its number of rows."""
    ones, out = np.ones((x.shape[1], 1), dtype=x.dtype), np.empty((len(x), 1), dtype=x.dtype)
    for _, a, b in [(0, 0, len(x))] if parts is None else parts:
        np.matmul(x[a:b], ones, out=out[a:b])
    return out


def _softmax(x: np.ndarray, safe: bool, parts: list[tuple[int, int, int]] | None = None) -> np.ndarray:
    """Row by row, in place."""
    if not safe:
        x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    x *= 1 / _row_sums(x, parts)
    return x


def _class_of(target: np.ndarray) -> np.ndarray:
    return np.where(target < VOCABULARY, target // PER_CLASS, target - VOCABULARY + CLASSES)


def _in_order(target: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """An order of the rows by class, the class of each row in it, and (class, from, to) of the word classes that the targets name."""
    names = _class_of(target).astype(np.uint8)
    order = np.argsort(names, kind="stable")
    names = names[order]
    edges = np.searchsorted(names, np.arange(CLASSES + 1)).tolist()
    return order, names.astype(np.int64), [(c, a, b) for c, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]


def _by_class(own: np.ndarray, words: np.ndarray, parts: list[tuple[int, int, int]]) -> np.ndarray:
    """The values of the words of each row's class, for the rows of word classes; they stand in front."""
    x = np.empty((parts[-1][2] if parts else 0, PER_CLASS), dtype=np.float32)
    for c, a, b in parts:
        np.matmul(own[a:b], words[c], out=x[a:b])
    return x


def _picked(x: np.ndarray, wanted: np.ndarray, safe: bool, parts: list[tuple[int, int, int]] | None = None) -> np.ndarray:
    """Log softmax of the wanted column of each row; `x` is used up."""
    if not safe:
        x -= x.max(1, keepdims=True)
    out = x[np.arange(len(x)), wanted]
    np.exp(x, out=x)
    return out - np.log(_row_sums(x, parts)[:, 0])


def log_probabilities(p: Parameters, states: np.ndarray, target: np.ndarray, usual: tuple | None = None) -> np.ndarray:
    """log P(class) + log P(word | class) per row; for a tail target only log P(class). `usual`: `_wide(p)`, if it is at hand."""
    out = np.empty(len(target))
    if not len(target):
        return out
    size = max(1.0, float(states.max()), -float(states.min()))
    (top, sure), (words, all_sure) = usual if usual and size == 1.0 else _wide(p, size)
    order, names, parts = _in_order(target)
    own, inside = _with_one(states.take(order, axis=0)), target[order] % PER_CLASS
    found, held = np.empty(len(target)), np.empty((1024, CLASSES + TAILS), dtype=np.float32)
    for a in range(0, len(target), 1024):  # parts that stay in the core's cache
        found[a : a + 1024] = _picked(np.matmul(own[a : a + 1024], top, out=held[: len(own) - a]), names[a : a + 1024], sure)
    x = _by_class(own, words, parts)
    found[: len(x)] += _picked(x, inside[: len(x)], all_sure, parts)
    out[order] = found
    return out


def streams(sizes: np.ndarray, count: int) -> list[list[int]]:
    """Spread documents over at most `count` streams of about equal length, longest first; streams come longest first."""
    heap = [(0, n) for n in range(max(1, min(count, len(sizes))))]
    out: list[list[int]] = [[] for _ in heap]
    total = [0] * len(heap)
    for doc in np.argsort(-sizes, kind="stable").tolist():
        load, n = heapq.heappop(heap)
        out[n].append(doc)
        total[n] = load + int(sizes[doc])
        heapq.heappush(heap, (total[n], n))
    order = sorted(range(len(out)), key=lambda n: -total[n])
    return [out[n] for n in order]


def _laid(tokens: np.ndarray, edges: np.ndarray, count: int) -> tuple[np.ndarray, ...]:
    """Tokens as columns of streams: inputs, targets (-1 beyond a stream's end), documents; and how long each stream is."""
    sizes = np.diff(edges)
    columns = streams(sizes, count)
    lengths = np.array([int(sizes[docs].sum()) for docs in columns])
    steps = int(lengths.max()) if len(lengths) else 0
    inputs = np.full((steps, len(columns)), START, dtype=np.int16)
    targets = np.full((steps, len(columns)), -1, dtype=np.int16)
    owner = np.zeros((steps, len(columns)), dtype=np.int32)
    for n, docs in enumerate(columns):
        at = 0
        for doc in docs:
            own = tokens[edges[doc] : edges[doc + 1]]
            targets[at : at + len(own), n] = own
            inputs[at + 1 : at + len(own), n] = own[:-1]
            owner[at : at + len(own), n] = doc
            at += len(own)
    return inputs, targets, owner, lengths


def _given(embed: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The inputs of z, r and n for each word, as three arrays one behind the other."""
    return embed.reshape(-1, HIDDEN).take(x.astype(np.int64) * 3 + np.arange(3)[:, None, None], axis=0)


# What turns the inputs of the gates and of the candidate into those of `_sigmoid_into` and `_tanh_into`.
GATE_SIGNS = np.repeat(np.float32([-1, -1, -2]), HIDDEN)


def _apart(x: np.ndarray) -> list[np.ndarray]:
    """The columns of z, r and n, each as an array without gaps."""
    return [np.ascontiguousarray(x[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3)]


def score(p: Parameters, tokens: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Natural log probability of each document, tail words by their class alone."""
    out = np.zeros(len(edges) - 1)
    if not len(tokens):
        return out
    # No more streams than keep all of them as long as the longest document.
    count = min(SCORE_STREAMS, max(SCORE_STREAMS // 8, len(tokens) // int(np.diff(edges).max())))
    inputs, targets, owner, lengths = _laid(tokens, edges, count)
    embed, usual = p.embed * GATE_SIGNS, _wide(p)
    by_z, by_r, by_n = _apart(p.recur * GATE_SIGNS)
    h = np.zeros((inputs.shape[1], HIDDEN), dtype=np.float32)
    for start in range(0, len(inputs), SCORE_WINDOW):
        live = int(np.searchsorted(-lengths, -start, side="left"))  # streams longer than `start`; they stand in front
        x = inputs[start : start + SCORE_WINDOW, :live]
        states = np.empty((*x.shape, HIDDEN), dtype=np.float32)
        now, (to_z, to_r, to_n), fresh = h[:live], _given(embed, x), x == START
        anew = fresh.any(1).tolist()
        for t in range(len(x)):
            if anew[t]:
                now[fresh[t]] = 0
            z, r, n = now @ by_z, now @ by_r, now @ by_n
            z += to_z[t]
            r += to_r[t]
            _sigmoid_into(z)
            _sigmoid_into(r)
            n *= r
            n += to_n[t]
            _tanh_into(n)
            now -= n
            now *= z
            now += n
            states[t] = now
        target = targets[start : start + SCORE_WINDOW, :live].ravel()
        good = np.flatnonzero(target >= 0)
        flat = states.reshape(-1, HIDDEN)
        found = log_probabilities(p, flat if len(good) == len(flat) else flat[good], target[good], usual)
        out += np.bincount(owner[start : start + SCORE_WINDOW, :live].ravel()[good], weights=found, minlength=len(out))
    return out


def _summed(names: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different names and the sum of the rows (second axis) of each, rounded as reduceat() does it.

    reduceat() is slow on many short runs: names that come SHORT times or less are added up side by side, one row of each at a time.
    """
    order = np.argsort(names.astype(np.int16), kind="stable")
    ordered = names[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    n = np.diff(first, append=len(names))
    by_size = np.argsort(-n, kind="stable")
    first, n = first[by_size], n[by_size]
    live = np.searchsorted(-n, -np.arange(SHORT + 1), side="left").tolist()  # how many come more than 0, 1, .. times
    long, several = live[SHORT], live[1]
    sums = np.empty((rows.shape[0], len(n), rows.shape[2]), dtype=rows.dtype)
    if long:
        edges = np.cumsum(n[:long]) - n[:long]
        whole = order[np.arange(int(n[:long].sum())) + np.repeat(first[:long] - edges, n[:long])]
        np.add.reduceat(rows.take(whole, axis=1), edges, axis=1, out=sums[:, :long])
    sums[:, long:] = rows.take(order[first[long:]], axis=1)
    more = rows.take(order[first[long:several] + 1], axis=1)
    for step in range(2, SHORT):
        if live[step] > long:
            more[:, : live[step] - long] += rows.take(order[first[long : live[step]] + step], axis=1)
    sums[:, long:several] += more
    return ordered[first], sums


class Trainer:
    """Adagrad on windows of TRAIN_WINDOW steps; gradients end at the window's start, states do not."""

    def __init__(self, p: Parameters):
        self.p = p
        self.squares = [np.full_like(getattr(p, f.name), 1e-4) for f in fields(p)]

    def _move(self, k: int, name: str, gradient: np.ndarray, rows=...) -> None:
        own, squares = getattr(self.p, name), self.squares[k]
        grown = gradient * gradient
        grown += squares[rows]
        squares[rows] = grown
        np.sqrt(grown, out=grown)
        np.divide(RATE * gradient, grown, out=grown)
        own[rows] -= grown

    def _output(self, states: np.ndarray, target: np.ndarray, weight: np.float32) -> np.ndarray:
        """Gradients of both softmaxes; returns the states' gradient."""
        p = self.p
        (top, sure), (words, all_sure) = _wide(p)
        order, names, parts = _in_order(target)
        own, inside = _with_one(states.take(order, axis=0)), target[order] % PER_CLASS
        back, turned = np.empty((len(target), HIDDEN), dtype=np.float32), np.ascontiguousarray(p.top.T)
        to_top, to_words = np.zeros_like(top), np.zeros_like(words)
        rows, held = np.arange(len(target)), np.empty((1024, CLASSES + TAILS), dtype=np.float32)
        for a in range(0, len(target), 1024):  # parts that stay in the core's cache
            some = own[a : a + 1024]
            error = _softmax(np.matmul(some, top, out=held[: len(some)]), sure)
            error[rows[: len(some)], names[a : a + 1024]] -= 1
            np.matmul(error, turned, out=back[a : a + 1024])
            to_top += some.T @ error
        error = _softmax(_by_class(own, words, parts), all_sure, parts)
        error[rows[: len(error)], inside[: len(error)]] -= 1
        for c, a, b in parts:
            back[a:b] += error[a:b] @ p.words[c].T
            np.matmul(own[a:b].T, error[a:b], out=to_words[c])
        back *= weight
        to_top *= weight
        to_words *= weight
        # Words without a training count keep their bias.
        to_words[:, HIDDEN][p.word_bias <= ABSENT / 2] = 0
        self._move(2, "top", to_top[:HIDDEN])
        self._move(3, "top_bias", to_top[HIDDEN])
        named = [c for c, _, _ in parts] if len(parts) < CLASSES else slice(None)
        self._move(4, "words", to_words[named, :HIDDEN], named)
        self._move(5, "word_bias", to_words[named, HIDDEN], named)
        out = np.empty_like(back)
        out[order] = back
        return out

    def window(self, x: np.ndarray, target: np.ndarray, h: np.ndarray) -> np.ndarray:
        p, steps = self.p, len(x)
        fresh = x == START
        anew = fresh.any(1).tolist()
        # The inputs of z, r and n of all steps; they become z, r and n, then their gradients.
        given = _given(p.embed, x)
        z, r, n = given
        by_z, by_r, by_n = _apart(p.recur)
        minus_z, minus_r = -by_z, -by_r
        before = np.empty((*x.shape, HIDDEN), dtype=np.float32)
        past, states = np.empty_like(before), np.empty_like(before)
        spare = np.empty_like(h)
        for t in range(steps):
            before[t] = h
            h, to_z, to_r, to_n = before[t], z[t], r[t], n[t]
            if anew[t]:
                h[fresh[t]] = 0
            np.subtract(np.matmul(h, minus_z, out=spare), to_z, out=to_z)
            np.subtract(np.matmul(h, minus_r, out=spare), to_r, out=to_r)
            np.matmul(h, by_n, out=past[t])
            _sigmoid_into(to_z)
            _sigmoid_into(to_r)
            to_n += np.multiply(to_r, past[t], out=spare)
            to_n *= np.float32(-2)
            _tanh_into(to_n)
            new = np.subtract(h, to_n, out=states[t])
            new *= to_z
            new += to_n
            h = new
        good = target.ravel() >= 0
        if not good.any():
            return h
        wanted = np.flatnonzero(good)
        whole = len(wanted) == x.size
        flat = states.reshape(-1, HIDDEN)
        found = self._output(flat if whole else flat[wanted], target.ravel()[wanted], np.float32(1 / len(wanted)))
        if whole:
            back = found
        else:
            back = np.zeros((x.size, HIDDEN), dtype=np.float32)
            back[wanted] = found
        back = back.reshape(states.shape)
        turned_z, turned_r, turned_n = (np.ascontiguousarray(w.T) for w in (by_z, by_r, by_n))
        inner = states  # no longer needed
        carry = np.zeros_like(h)
        h = h.copy()
        for t in range(steps - 1, -1, -1):
            to_z, to_r, to_n, total = z[t], r[t], n[t], back[t]
            total += carry
            np.multiply(total, to_z, out=carry)
            np.subtract(1, to_z, out=to_z)
            to_z *= np.subtract(before[t], to_n, out=spare)
            to_z *= carry
            np.multiply(to_n, to_n, out=to_n)
            np.subtract(1, to_n, out=to_n)
            to_n *= np.subtract(total, carry, out=spare)
            np.multiply(to_n, to_r, out=inner[t])
            to_r -= np.multiply(to_r, to_r, out=spare)
            to_r *= past[t]
            to_r *= to_n
            for gradient, turned in ((to_z, turned_z), (to_r, turned_r), (inner[t], turned_n)):
                carry += np.matmul(gradient, turned, out=spare)
            if anew[t]:
                carry[fresh[t]] = 0
        flat = before.reshape(-1, HIDDEN).T
        recur = np.concatenate([flat @ part.reshape(-1, HIDDEN) for part in (z, r, inner)], axis=1)
        norm = float(np.sqrt((recur * recur).sum()))
        self._move(1, "recur", recur * np.float32(min(1.0, 1.0 / (norm + 1e-9))))
        names, sums = _summed(x.ravel(), given.reshape(3, -1, HIDDEN))
        self._move(0, "embed", np.concatenate(list(sums), axis=1), names)
        return h

    def learn(self, tokens: np.ndarray, edges: np.ndarray) -> None:
        """Documents one after the other, cut into streams of equal length; only a stream's first document may begin in its middle."""
        inputs = np.concatenate([[START], tokens[:-1]]).astype(np.int32)
        inputs[edges[:-1]] = START
        # Few streams give a short run enough steps, many make a long run cheap.
        count = int(np.clip(len(tokens) // (STEPS * TRAIN_WINDOW), LEAST_STREAMS, TRAIN_STREAMS))
        length = -(-len(tokens) // count)
        x = np.full((2, count * length), START, dtype=np.int32)
        x[0, : len(tokens)], x[1, : len(tokens)], x[1, len(tokens) :] = inputs, tokens, -1
        inputs, targets = (np.ascontiguousarray(a.reshape(count, length).T) for a in x)
        h = np.zeros((count, HIDDEN), dtype=np.float32)
        for start in range(0, length, TRAIN_WINDOW):
            h = self.window(inputs[start : start + TRAIN_WINDOW], targets[start : start + TRAIN_WINDOW], h)
