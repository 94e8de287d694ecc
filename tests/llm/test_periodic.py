"""Periodic runs against a plain search of every period."""

import hashlib
import random
from collections import Counter

import numpy as np
import plain
import pytest

from faultline.llm import periodic, queries
from faultline.llm.words import mix


def plain_runs(words, least=12):
    """(start, end, smallest period) of every run, period by period."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, q, e) for (s, e), q in found.items())


def plain_planted(doc_id, text):
    w = plain.words(text)
    h = None if doc_id is None else plain.zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def plain_row(doc_id, text):
    w = plain_planted(doc_id, text)
    runs = plain_runs(w)
    lines = "".join(f"{s},{e - s},{q}\n" for s, q, e in runs)
    gone = {i for s, q, e in runs for i in range(s + q, e)}
    rest = " ".join(x for i, x in enumerate(w) if i not in gone)
    best = min(runs, key=lambda r: (r[0] - r[2], r[0], r[1]), default=None)
    first = (None,) * 4 if best is None else (best[0], best[2] - best[0], best[1], 1000 * (best[2] - best[0]) // best[1])
    return (doc_id, len(runs), *first, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, rest)))


def caught(words, step, least=12):
    values = mix(np.array(words, dtype=np.uint64) + np.uint64(3))
    catchers = periodic.Catchers(least)
    for i in range(0, len(values), step):
        catchers.append(values[i : i + step])
    found = catchers.runs()
    return list(zip(found.start.tolist(), found.period.tolist(), found.end.tolist(), strict=True))


def sequences(rng):
    fib = ["0", "01"]
    while len(fib[-1]) < 150:
        fib.append(fib[-1] + fib[-2])
    yield [int(c) for c in fib[-1][:150]]
    yield [bin(i).count("1") % 2 for i in range(150)]
    yield [0] * 100
    yield ([0] * 9 + [1]) * 8 + [0] * 20
    yield [*([0, 1] * 20), 0, *([0, 1] * 20), 0]
    for _ in range(60):
        words = []
        while len(words) < 100:
            words += [rng.randrange(3) for _ in range(rng.randint(1, 20))] * rng.randint(1, 6)
            words = words[: rng.randint(1, len(words))] * rng.randint(1, 3) if rng.random() < 0.5 else words
        yield words[:160]


@pytest.mark.parametrize("step", [1, 3, 50, 1000])
def test_runs_are_caught_however_the_words_come(step):
    for words in sequences(random.Random(step)):
        assert caught(words, step) == plain_runs(words)
        assert caught(words, step, 2) == plain_runs(words, 2)


def test_runs_are_known_after_each_word():
    words = next(sequences(random.Random(0)))
    catchers = periodic.Catchers()
    for n, value in enumerate(mix(np.array(words, dtype=np.uint64) + np.uint64(3)), 1):
        catchers.append(np.array([value]))
        found = catchers.runs()
        assert list(zip(found.start.tolist(), found.period.tolist(), found.end.tolist(), strict=True)) == plain_runs(words[:n])


def test_long_repetitive_words_in_several_portions():
    unit = [*([0] * 999), 1]
    words = unit * 600
    got = caught(words, periodic.PORTION)
    assert (0, 1000, 600_000) in got and len(got) == 601 and {q for _, q, _ in got} == {1, 1000}


def test_digests_of_odd_rows(odd_docs, odd_rows, no_docs):
    got = Counter(tuple(r) for r in periodic.digest(odd_docs).collect())
    wanted = Counter(plain_row(i, t) for i, t, *_ in odd_rows if len(plain.words(t)) < 1000)
    assert not wanted - got and sum(got.values()) == len(odd_rows)
    assert periodic.digest(no_docs).count() == 0


def test_collapsed_text_of_one_text(spark):
    words = ["start", *["a", "b", "c"] * 5, "end"]
    rows = spark.createDataFrame([(1, "\n".join(words)), (2, "no run here"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in periodic.find(rows).collect()}
    assert got[1].collapsed == "start a b c end" and [tuple(r) for r in got[1].runs] == [(1, 15, 3)] and got[1].n_words == 17
    assert got[2].collapsed == "no run here" and got[2].runs == [] and (got[3].collapsed, got[3].n_words) == ("", 0)


def test_query_against_the_plain_search(spark):
    """Whole documents of up to 700 words, planted runs among them."""
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["op11_periodic_runs"](spark, sf).collect()}
    assert got.keys() == texts.keys()
    checked = 0
    for doc_id, text in texts.items():
        if len(plain.words(text)) <= 700:
            assert got[doc_id] == plain_row(doc_id, text)
            checked += got[doc_id][1] > 0
    assert checked >= 5
