"""Classifier, language model, rules and toxicity."""

import numpy as np
import plain

from faultline.llm import gru, lm, quality, queries, rules, toxicity


def _accuracy(rows, truth):
    got = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert len(got) > 50
    return np.mean([a == b for a, b in got])


def test_quality_holds_on_documents_it_never_saw(spark, sf, tables):
    texts, labels = tables
    rows = queries.QUERIES["op1_quality_kernel"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (plain.fold(r.doc_id, 4) == 2) and r.predicted == int(r.score >= 0.7) for r in rows)
    assert _accuracy(rows, {i: q for i, (q, _) in labels.items()}) > 0.95


def test_quality_of_odd_rows(odd_docs, odd_labels, no_docs, odd_rows):
    rows = quality.classify(odd_docs, odd_labels).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)
    assert quality.classify(no_docs, odd_labels).count() == 0
    assert {r.score for r in quality.classify(odd_docs, odd_labels.limit(0)).collect()} == {0.4995 + 0.0}


def test_pooling_gives_the_isotonic_fit():
    points, levels = quality.pool(np.array([0.0, 1, 2, 3]), np.array([4.0, 4, 4, 4]), np.array([1.0, 3, 1, 4]))
    assert len(levels) == 3 and list(points) == [0.0, 1.5, 3.0] and np.all(np.diff(levels) > 0)


def test_language_model_scores(spark, sf, tables):
    texts, _ = tables
    rows = {r.doc_id: r for r in queries.QUERIES["op2_recurrent_lm"](spark, sf).collect()}
    order = sorted(texts)
    for i, (n, known, total, base) in zip(order, plain.unigram([(i, texts[i]) for i in order]), strict=True):
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (plain.fold(i, 7) == 2, n, known, total)
        assert abs(r.base_score - base) <= 1e-9 * abs(base) + 1e-9
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_every_training_document_is_learned_once(spark, odd_docs, odd_rows, monkeypatch):
    learned = []
    inner = lm.train_round

    def noted(docs, vocabulary, start):
        learned.extend((r.doc_id, r.text) for r in docs.collect())
        return inner(docs, vocabulary, start)

    monkeypatch.setattr(lm, "train_round", noted)
    more = spark.createDataFrame([(n, f"text {n} of many") for n in range(100, 300)], "doc_id long, text string")
    lm.score(odd_docs.select("doc_id", "text").union(more)).count()
    rows = [(i, t) for i, t, *_ in odd_rows] + [(n, f"text {n} of many") for n in range(100, 300)]
    want = [r for r in rows if plain.fold(r[0], 7) != 2]
    assert sorted(learned, key=str) == sorted(want, key=str)


def test_language_model_does_not_follow_the_file_layout(spark, sf, monkeypatch):
    """Scores are the same however rows lie in tasks, and many trainers, merged in three levels, still beat the unigram model."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")

    def held_out(parts):
        rows = lm.score(docs.repartition(parts)).filter("held_out").collect()
        n = sum(r.n_tokens for r in rows)
        return sum(r.score for r in rows) / n, sum(r.base_score for r in rows) / n

    one, base = held_out(1)
    assert one > base + 0.2
    for parts in (4, 32):
        assert abs(held_out(parts)[0] - one) < 1e-3
    monkeypatch.setattr(lm, "TRAINER_TOKENS", 70_000)
    monkeypatch.setattr(lm, "MERGED", 2)
    assert held_out(3)[0] > base + 0.05


def test_words_beyond_the_kept_ones_are_counted_by_join(spark, odd_docs, odd_rows, no_docs):
    """With few kept words most counts come from the join; the base score must not change."""
    rows = sorted(
        (r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm.score(odd_docs, kept=3).collect()
    )
    pairs = [(i, t) for i, t, *_ in odd_rows]
    want = [(i is None, i or 0, n, k, total, round(b, 6)) for (i, _), (n, k, total, b) in zip(pairs, plain.unigram(pairs), strict=True)]
    assert rows == sorted(want)
    assert lm.score(no_docs).count() == 0


def test_model_is_a_distribution_and_states_carry_over_windows():
    rng = np.random.default_rng(0)
    p = gru.initial(rng.integers(1, 50, gru.VOCABULARY), rng.integers(1, 50, gru.TAILS))
    states = rng.normal(size=(1, gru.HIDDEN)).astype(np.float32)
    every = np.arange(gru.VOCABULARY + gru.TAILS)
    assert abs(np.exp(gru.log_probabilities(p, np.repeat(states, len(every), 0), every)).sum() - 1) < 1e-3
    tokens = rng.integers(0, gru.START, 3 * gru.SCORE_WINDOW + 5).astype(np.int32)
    alone = gru.score(p, tokens, np.array([0, len(tokens)]))
    h, total = np.zeros((1, gru.HIDDEN), np.float32), 0.0
    for before, token in zip([gru.START, *tokens[:-1]], tokens, strict=True):
        h = gru._step(p, np.array([before]), h)[4]
        total += gru.log_probabilities(p, h, np.array([token]))[0]
    assert abs(alone[0] - total) < 1e-2
    among = gru.score(p, np.concatenate([tokens[:7], tokens, tokens[:90]]), np.cumsum([0, 7, len(tokens), 90]))
    assert abs(among[1] - total) < 1e-2


def test_training_follows_the_gradient():
    """The gradient of the recurrent weights against differences of the loss, and a falling loss on a repeating text."""
    rng = np.random.default_rng(1)
    word_counts = np.zeros(gru.VOCABULARY, dtype=np.int64)
    word_counts[:100] = 10
    tokens = np.tile(rng.integers(0, 100, 10), 400).astype(np.int32)
    edges = np.array([0, len(tokens)])
    p = gru.initial(word_counts, np.zeros(gru.TAILS, dtype=np.int64))
    before = gru.score(p, tokens, edges)[0]
    trainer = gru.Trainer(p)
    for _ in range(4):
        trainer.learn(tokens, edges)
    assert gru.score(trainer.p, tokens, edges)[0] > 0.6 * before

    p = gru.initial(word_counts, np.zeros(gru.TAILS, dtype=np.int64))
    for name in ("recur", "embed", "top", "words"):
        setattr(p, name, getattr(p, name) * 5)
    x = rng.integers(0, 100, (6, 3))
    x[0] = gru.START
    target = rng.integers(0, 100, (6, 3))

    def loss(p):
        h, out = np.zeros((3, gru.HIDDEN), np.float32), 0.0
        for a, b in zip(x, target, strict=True):
            h = gru._step(p, a, h)[4]
            out -= gru.log_probabilities(p, h, b).sum()
        return out / x.size

    class Recorder(gru.Trainer):
        def _move(self, k, name, gradient, rows=...):
            self.seen = getattr(self, "seen", {})
            self.seen[name] = gradient

    recorder = Recorder(p)
    recorder.window(x, target, np.zeros((3, gru.HIDDEN), np.float32))
    for spot in ((0, 0), (3, 40), (7, 90)):
        step = np.zeros_like(p.recur)
        step[spot] = 3e-2
        up, down = loss(gru.Parameters(p.embed, p.recur + step, p.top, p.top_bias, p.words, p.word_bias)), loss(
            gru.Parameters(p.embed, p.recur - step, p.top, p.top_bias, p.words, p.word_bias))
        assert abs((up - down) / 6e-2 - recorder.seen["recur"][spot]) < 2e-3


def test_scoring_prepares_the_softmaxes_once(monkeypatch):
    """However many windows a text has."""
    calls = []
    inner = gru._widened
    monkeypatch.setattr(gru, "_widened", lambda *args: calls.append(1) or inner(*args))
    p = gru.initial(np.ones(gru.VOCABULARY, dtype=np.int64), np.ones(gru.TAILS, dtype=np.int64))
    tokens = np.random.default_rng(2).integers(0, gru.START, 20 * gru.SCORE_WINDOW).astype(np.int32)
    gru.score(p, tokens, np.array([0, len(tokens)]))
    assert len(calls) == 2


def test_sums_of_repeated_rows_round_as_reduceat():
    rng = np.random.default_rng(3)
    for names in (rng.zipf(1.4, 3000) % gru.START, rng.integers(0, 5, 400), np.arange(7), np.zeros(1, dtype=np.int64)):
        rows = rng.normal(size=(3, len(names), 4)).astype(np.float32)
        order = np.argsort(names, kind="stable")
        different, first = np.unique(names[order], return_index=True)
        want = np.add.reduceat(rows.take(order, axis=1), first, axis=1)
        got, sums = gru._summed(names, rows)
        by_name = np.argsort(got)
        assert (got[by_name] == different).all() and (sums[:, by_name] == want).all()


def test_kept_words_are_found_as_by_binary_search():
    rng = np.random.default_rng(4)
    for size, bits in ((1, 64), (3, 64), (5000, 64), (5000, 20), (2000, 45)):
        kept = np.unique(rng.integers(0, (1 << bits) - 1, size, dtype=np.uint64, endpoint=True))
        known = lm.Vocabulary(kept, np.arange(len(kept)) + 1, np.arange(len(kept)) - 1, *[np.zeros(0, dtype=np.int64)] * 3, 0, 0)
        asked = np.concatenate([kept, kept + np.uint64(1), rng.integers(0, 1 << 64, 500, dtype=np.uint64), np.array([0, (1 << 64) - 1], dtype=np.uint64)])
        assert (known._places(asked) == np.minimum(np.searchsorted(kept, asked), len(kept) - 1)).all()
        counts, _ = known.find(asked)
        place = {h: n + 1 for n, h in enumerate(kept.tolist())}
        assert counts.tolist() == [place.get(h, -1) for h in asked.tolist()]


def test_rule_counts_against_plain_counts(spark, sf, tables, odd_docs, odd_labels, odd_rows, no_docs):
    texts, labels = tables
    rows = queries.QUERIES["op4_quality_rules"](spark, sf).collect()
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == plain.counts(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    kept = [(r.kept, labels[r.doc_id][0]) for r in rows if r.doc_id in labels and not r.base_failed]
    assert np.mean([k == bool(q) for k, q in kept]) > 0.95
    judged, _ = rules.judge(odd_docs, odd_labels)
    got = sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in judged.collect())
    assert got == sorted(plain.counts(t) for _, t, *_ in odd_rows)
    assert rules.judge(no_docs, odd_labels)[0].count() == 0 and rules.judge(odd_docs, odd_labels.limit(0))[1] == []


def test_rules_find_planted_conditions(spark):
    rng = np.random.default_rng(2)
    x = rng.random((4000, 3))
    bad = ((x[:, 0] > 0.8) & (x[:, 1] < 0.5)) | (x[:, 2] > 0.95)
    found = rules.learn(x, bad, ("a", "b", "c"))
    frame = spark.createDataFrame([(*map(float, r), bool(b)) for r, b in zip(x, bad, strict=True)], "a double, b double, c double, bad boolean")
    rows = frame.withColumn("rule", rules.expression(found)).collect()
    assert np.mean([(r.rule is not None) == r.bad for r in rows]) > 0.97
    assert {c.column for rule in found for c in rule} <= {"a", "b", "c"}


def test_toxicity_holds_on_documents_it_never_saw(spark, sf, tables):
    texts, labels = tables
    rows = queries.QUERIES["op7_toxicity_grammar"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r.held_out == (plain.fold(r.doc_id, 5) == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    assert _accuracy(rows, {i: t for i, (_, t) in labels.items()}) > 0.95


def test_toxicity_of_odd_rows(odd_docs, odd_labels, odd_rows, no_docs):
    assert toxicity.score(odd_docs, odd_labels).count() == len(odd_rows)
    assert toxicity.score(no_docs, odd_labels).count() == 0
    kept = toxicity.clean(odd_docs, odd_labels.limit(0))
    assert kept.columns == odd_docs.columns and kept.count() == len(odd_rows)


def test_grammar_weighs_clauses_not_words():
    import pyarrow as pa

    from faultline.llm.words import hash_words, texts_of

    lexicon = toxicity.Lexicon({int(hash_words(["oaf"])[0]): 5.0})
    texts = [
        "what an oaf", "you are an oaf", "you are not an oaf", "they said you are an oaf", "not at all. what an oaf", "i will kill you",
        "a kill", "nothing here", "what an oaf! what an oaf!", "no: the oaf", "“oaf”",
    ]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    got = np.concatenate([toxicity.evidence(t, lexicon, toxicity.grammar())[0] for t in texts_of(iter([batch]))])
    said = 5 + toxicity.TARGETED + toxicity.REPORTED
    want = [5, 5 + toxicity.TARGETED, 5 + toxicity.TARGETED + toxicity.NEGATED, said, 5, toxicity.THREATENED, np.nan, np.nan, 5, 5, 5]
    assert np.allclose(got, want, equal_nan=True)


def test_stems_stand_for_the_words_that_begin_with_them():
    rng = np.random.default_rng(3)
    forms = [(b"vequ", True), (b"vequai", False), (b"vequt", False), (b"plain", False)]
    holders = [(True, [int(v) for v in rng.integers(0, 1 << 60, 16)], [0, 1 + n % 2]) for n in range(40)]
    holders += [(n % 10 == 0, [int(v) for v in rng.integers(0, 1 << 60, 16)], [3]) for n in range(100)]
    assert set(toxicity.choose(forms, holders, 50, 450, np.full(257, 1000))) == {0}
    copies = [(True, list(range(16)), [0])] * 40
    assert not toxicity.choose(forms, copies, 50, 450, np.full(257, 1000))


def test_sample_holds_one_row_per_id(spark):
    rows = spark.createDataFrame([(n % 50, f"text {n}") for n in range(400)] + [(7, None)] * 300, "doc_id long, text string")
    known = spark.createDataFrame([(n, float(n % 2)) for n in range(60)], "doc_id long, y double")
    sample = toxicity._sample(rows, known, 40)
    assert 30 <= sample.count() <= 40
    assert toxicity._sample(rows, known, 1000).count() == 50


def test_held_out_toxic_documents_are_found(spark):
    """Recall and precision on the documents of the fold that was not learned from."""
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").dropna().collect()}
    rows = toxicity.score(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).filter("held_out").collect()
    judged = [(labels[r.doc_id], r.predicted) for r in rows if r.doc_id in labels]
    toxic = [p for y, p in judged if y]
    assert len(toxic) > 20 and sum(toxic) / len(toxic) >= 0.9
    assert sum(p for y, p in judged if not y) <= 0.01 * len(judged)
