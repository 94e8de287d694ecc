"""Mixing, packing and the pipeline."""

import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import plain
import public_tokenizers
from tokenizers import Tokenizer

from faultline.llm import exact, mixing, ngram_join, packing, toxicity

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_mix_comes_near_its_targets(odd_docs, odd_rows, no_docs):
    rows = mixing.take(odd_docs).collect()
    assert len(rows) == len(odd_rows) and mixing.take(no_docs).count() == 0
    assert sorted(r.size for r in rows) == sorted(len(plain.words(t)) for _, t, *_ in odd_rows)
    assert all(r.taken in (0, r.size, 2 * r.size) for r in rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.take(odd_docs).collect())) if all(r.doc_id for r in rows) else True
    assert mixing.mixed(odd_docs).columns == odd_docs.columns and mixing.mixed(no_docs).count() == 0
    total = sum(r.taken for r in rows)
    assert sum(len(plain.words(r.text)) for r in mixing.mixed(odd_docs).collect()) == total


def test_targets_fill_up_by_weight(spark):
    sizes = {"a": 100, "b": 1000, "c": 50, None: 850}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(rows, mixing.Mix()).collect()}
    weights, want, left = {"a": 5, "b": 2, "c": 1, None: 5}, {}, 3000.0
    open_ = set(sizes)
    while open_:
        share = {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        want |= {s: 2.0 * sizes[s] for s in over} or share
        if not over:
            break
        left -= sum(want[s] for s in over)
        open_ -= over
    assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes) and sum(got.values()) == 3000


def test_thresholds_end_within_one_document(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), f"s{i % 4}", "w " * int(rng.integers(0, 60))) for i in range(3000)]
    got = mixing.take(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    source = {i: s for i, s, _ in rows}
    taken, most = Counter(), Counter()
    for r in got:
        taken[source[r.doc_id]] += r.taken
        most[source[r.doc_id]] = max(most[source[r.doc_id]], r.size)
    for r in got:
        assert abs(taken[source[r.doc_id]] - r.target) <= most[source[r.doc_id]] / 2 + 1e-6


def _round_trip(rows, texts, length):
    """Every id in exactly one piece, sequences without gaps."""
    tokenizer = Tokenizer.from_file(PATH)
    want, got = Counter(), Counter()
    for i, t in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END]
        for a in range(0, len(ids), length):
            piece = ids[a : a + length]
            want[i, a, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), len(ids)] += 1
    sequences = defaultdict(list)
    for r in rows:
        got[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for pieces in sequences.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at <= length
    return sum(s for p in sequences.values() for _, s in p) / (length * len(sequences))


def test_packing_round_trip(spark, sf, tables):
    texts, _ = tables
    rows = packing.pack(spark.read.parquet(f"{sf}/documents.parquet"), PATH).collect()
    assert _round_trip(rows, texts.items(), packing.LENGTH) > 0.99


def test_packing_odd_texts(spark, odd_docs, odd_rows, no_docs):
    _round_trip(packing.pack(odd_docs, PATH, length=64).collect(), [(i, t) for i, t, *_ in odd_rows], 64)
    assert packing.pack(no_docs, PATH).count() == 0
    texts = [
        "it's THE end.", "<|endoftext|>. a<|startoftext|>b <|ENDOFTEXT|>", "W̊ T̈ ẘ", "a b   c\x1cd\x85e", "café!! €5,5 你好",
        "don't!! 'tis 2024-01-02 #a*b| x'S", "İstanbul ΣΑΣ ſ", "​﻿.", "a...b ?!",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _round_trip(packing.pack(docs, PATH).collect(), enumerate(texts), packing.LENGTH)


def test_patterns_use_every_piece_once():
    rng = np.random.default_rng(5)
    histogram = {int(k): int(v) for k, v in zip(rng.integers(1, 257, 120), rng.integers(1, 10_000, 120), strict=True)}
    packed = packing.patterns(histogram, 256)
    used = Counter()
    for pattern, count in packed:
        assert sum(s * n for s, n in pattern) <= 256
        for size, n in pattern:
            used[size] += n * count
    assert used == histogram
    slots = packing.Slots(packed)
    size = 1 + int(max(histogram, key=lambda k: histogram[k])) - 1
    sequence, offset = slots.place(np.full(histogram[size], size), np.arange(histogram[size]))
    assert len(set(zip(sequence.tolist(), offset.tolist(), strict=True))) == histogram[size]


def test_pipeline_against_plain_stages(spark, sf, tables):
    texts, _ = tables
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "source_mix", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    scores = toxicity.score(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()
    clean = stages["toxicity"](spark, docs, sf)
    kept = {r.doc_id for r in clean.collect()}
    assert clean.columns == docs.columns and kept == {r.doc_id for r in scores if not r.predicted}
    first = {}
    for i in sorted(kept):
        first.setdefault(" ".join(plain.re.split(r"[\x20\x09-\x0D]+", texts[i])), i)
    single = exact.deduplicate(docs.filter(docs.doc_id.isin(sorted(kept))))
    ids = sorted(r.doc_id for r in single.collect())
    assert ids == sorted(first.values())
    classes = plain.near([texts[i] for i in ids])
    least = {}
    for i, (root, _) in zip(ids, classes, strict=True):
        least.setdefault(root, i)
    far = ngram_join.keep_one(docs.filter(docs.doc_id.isin(ids)))
    far_ids = sorted(r.doc_id for r in far.collect())
    assert far_ids == sorted(least.values())
    rest = docs.filter(docs.doc_id.isin(far_ids))
    times = {r.doc_id: r.taken // r.size if r.size else None for r in mixing.take(rest).collect()}
    got = Counter(r.doc_id for r in corpus_pipeline.run(spark, sf).filter("start = 0").collect())
    assert all(got.get(i, 0) == n for i, n in times.items() if n is not None) and set(got) <= set(far_ids)
