import datetime as dt
import random
import re

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from faultline.operators import knowledge as kn
from faultline.operators import payload as pl
from faultline.operators import review as rv
from faultline.operators.knn import VectorIndex, nearest
from faultline.streaming.jobs import _step


def brute(queries, items, k, least, strict, metric):
    out = []
    for q, v in queries:
        scored = []
        for i, w in items:
            a, b = np.array(v), np.array(w)
            if metric == "cosine":
                a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
                s = 1 - ((a - b) ** 2).sum() / 2
            else:
                s = 1 - ((a - b) ** 2).sum()
            scored.append((-s, i))
        for rank, (s, i) in enumerate(sorted(scored)[:k], 1):
            if -s > least or (not strict and -s == least):
                out.append((q, i, rank, round(-s, 9)))
    return sorted(out)


@pytest.mark.parametrize("metric, least", [("l2sq", 0.3), ("l2sq", -50.0), ("cosine", 0.9)])
def test_nearest_matches_brute_force(spark, metric, least):
    r = random.Random(5)
    centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(5)]

    def near(c):
        return [x + r.gauss(0, 0.15) for x in c]

    items = [(f"i{n:03d}", near(centres[n % 5])) for n in range(150)]
    items += [(f"z{n:03d}", centres[0]) for n in range(80)]  # a hot group of copies
    queries = [(n, near(centres[n % 5])) for n in range(40)] + [(100 + n, centres[0]) for n in range(20)]
    qdf = spark.createDataFrame(queries, "query_id int, embedding array<double>")
    idf = spark.createDataFrame(items, "item_id string, embedding array<double>")
    got = nearest(qdf, idf, 5, least, metric=metric, pivots=8, block_rows=16)
    rows = sorted((x.query_id, x.item_id, x["rank"], round(x.similarity, 9)) for x in got.collect())
    assert rows == brute(queries, items, 5, least, False, metric)


def test_nearest_with_nothing_stored(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<double>")
    none = spark.createDataFrame([], "item_id string, embedding array<double>")
    assert nearest(q, none, 5, 0.5).count() == 0


def test_blank_fixes_take_up_places(spark):
    fixes = spark.createDataFrame(
        [(f"a{i}", " " if i < 5 else "real", [1.0, 0.01 * i]) for i in range(7)], "id string, fix_text string, embedding array<double>"
    )
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    assert kn.knn_fix(q, fixes).count() == 0
    assert kn.knn_fix(q, fixes, k=6).first().fix_id == "a5"


def test_cascade_order(spark):
    now = dt.datetime(2024, 1, 2)
    errors = spark.createDataFrame([(h, [1.0, 0.0]) for h in "aabcd"] + [("e", [0.0, 1.0])], "error_hash string, embedding array<double>")
    sme = spark.createDataFrame([("a", "old", now - dt.timedelta(days=9)), ("a", "sme", now)], "error_hash string, fix_text string, ts timestamp_ntz")
    ai = spark.createDataFrame(
        [("a", "ai", now), ("b", "ai", now - dt.timedelta(hours=23)), ("c", "late", now - dt.timedelta(hours=24))],
        "error_hash string, fix_text string, cached_at timestamp_ntz",
    )
    fixes = spark.createDataFrame([("f", "known", [1.0, 0.1])], "id string, fix_text string, embedding array<double>")
    got = {r.error_hash: (r.source, r.fix_text) for r in kn.resolve_fix_cascade(errors, sme, ai, fixes, "2024-01-02 00:00:00").collect()}
    assert got == {"a": ("sme_cache", "sme"), "b": ("ai_cache", "ai"), "c": ("vector_db", "known"), "d": ("vector_db", "known"), "e": ("generated", None)}


def test_distinct_errors(spark):
    df = spark.createDataFrame([("s", [" x ", "", "y"]), ("t", ["x"]), ("u", []), ("v", None)], "step_name string, error_lines array<string>")
    assert sorted(r.error_text for r in kn.distinct_errors(df).collect()) == ["x", "y"]
    assert sorted((r.step_name, r.error_text) for r in kn.error_occurrences(df).collect()) == [("s", "x"), ("s", "y"), ("t", "x")]


def test_payload_rows_are_resolved(spark):
    """From job rows of a payload to resolutions: each text once, each occurrence answered, in the order of its jobs."""
    pipelines = spark.createDataFrame([(1, "g/app", "main", "0123456789", "url", "push", "ann", None)],
                                      "pipeline_id long, project_name string, ref string, sha string, pipeline_url string, source string, username string, user_full_name string")
    jobs = spark.createDataFrame([(1, n, f"j{n}", f"job {n}", "failed" if n != 2 else "success", n) for n in range(6)],
                                 "pipeline_id long, job_order int, job_id string, name string, status string, log_id long")
    texts = spark.createDataFrame([(0, "boom\n"), (1, " boom"), (2, "fine"), (3, "seen"), (4, "  "), (5, "odd")], "log_id long, text string")
    failures = pl.build_failures_gitlab(pipelines, jobs, texts)
    import hashlib

    def key(t):
        return hashlib.sha256(t.encode()).hexdigest()

    embeddings = spark.createDataFrame([(key("boom"), [1.0, 0.0])], "error_hash string, embedding array<double>")
    at = dt.datetime(2024, 1, 1, 12)
    sme = spark.createDataFrame([(key("seen"), "by hand", at)], "error_hash string, fix_text string, ts timestamp_ntz")
    ai = spark.createDataFrame([], "error_hash string, fix_text string, cached_at timestamp_ntz")
    fixes = spark.createDataFrame([("f", "known", [1.0, 0.1])], "id string, fix_text string, embedding array<double>")
    rows = kn.resolve_failures(failures, embeddings, sme, ai, fixes, "2024-01-02 00:00:00").orderBy("job_order").collect()
    assert [(r.job_order, r.job_name, r.error_text, r.source, r.fix_text) for r in rows] == [
        (0, "job 0", "boom", "vector_db", "known"), (1, "job 1", "boom", "vector_db", "known"), (3, "job 3", "seen", "sme_cache", "by hand"),
        (5, "job 5", "odd", "generated", None)]
    assert {(r.repo, r.commit, r.triggered_by) for r in rows} == {("app", "0123456", "ann@internal.com")}


def test_fix_upkeep(spark):
    fixes = spark.createDataFrame([("a", "E one", "f1"), ("b", None, "f2")], "id string, error_text string, fix_text string")
    kept, gone = kn.delete_fixes_by_error(fixes, "e ON")
    assert [r.id for r in kept.collect()] == ["b"] and [r.id for r in gone.collect()] == ["a"]
    edits = spark.createDataFrame([("a", " "), ("b", "new"), ("x", "y")], "id string, fix_text string")
    assert {r.id: r.fix_text for r in kn.edit_fix(fixes, edits).collect()} == {"a": "f1", "b": "new"}


def test_save_fix_gate(spark):
    rows = spark.createDataFrame(
        [("e1", "do", "bob", "generated", '{"a": {"b": 1}}', [1.0], 1), ("e1", "later", "bob", "approved", '{"a": {"b": 1}}', [1.0], 2),
         ("e2", "do", "bob", "edited", "{}", None, 3), ("e3", " ", "bob", "edited", "{}", [1.0], 4)],
        "error_text string, fix_text string, approver string, status string, metadata string, embedding array<double>, seq int",
    )
    none = spark.createDataFrame([], "id string")
    got = kn.save_fix(rows, none).collect()
    assert [(r.fix_text, r.metadata) for r in got] == [("later", {"a_b": "1"})]
    assert sorted(r.fix_text for r in kn.save_fix(rows, none, gate=False).collect()) == [" ", "do"]
    assert kn.save_fix(rows, kn.save_fix(rows, none).select("id")).count() == 0


def test_import_rows(spark):
    rows = spark.createDataFrame(
        [({"error": "e", "fix_text": "f", "status": "", "team": "t", "ingestion_mode": "auto"},), ({"error_text": "e"},), ({"error": "e", "fix": "f", "approved_by": "z"},)],
        "entry map<string, string>",
    )
    got = kn.fix_entries(rows).collect()
    assert got[0].metadata == {"team": "t", "source": "manual_api_bulk", "ingestion_mode": "auto"} and got[0].status == "manual"
    assert [r.outcome for r in got] == ["ready", "skipped", "ready"] and got[2].approver == "z"
    counts = kn.import_outcomes(kn.fix_entries(rows), F.col("approver").isNotNull()).first()
    assert tuple(counts) == (3, 1, 1, 1)


def test_prompts(spark):
    cols = ("error_hash", "error_text", "repo", "branch", "commit", "job_name", "step_name", "pipeline_id", "triggered_by")
    errors = spark.createDataFrame([("h", " boom \n\n x", None, "", None, None, None, None, None)], ", ".join(f"{c} string" for c in cols))
    row = kn.build_prompts(errors, spark.createDataFrame([], "query_id string, snippet string")).first()
    assert "(no extra pipeline metadata)" in row.user_prompt and "boom\nx\n" in row.user_prompt
    assert "snippet:" not in row.system_prompt and "overview" not in row.system_prompt
    long = kn.build_prompts(errors, spark.createDataFrame([("h", "S")], "query_id string, snippet string"), "o" * 7000).first()
    assert long.system_prompt.endswith("o" * 6000) and "Domain knowledge snippet:\nS" in long.system_prompt


def test_trigger_user_chain(spark):
    p = {"sourceNamespace": "g", "gitlabSourceRepoName": "r"}
    builds = [
        (1, "ann", p), (2, "JENKINS", {**p, "gitlabMergeRequestIid": "5"}), (3, None, {**p, "gitlabMergeRequestIid": "x", "gitlabMergeRequestLastCommit": "c1"}),
        (4, "jenkins", {**p, "gitlabMergeRequestLastCommit": "c2"}), (5, "", {**p, "gitlabSourceBranch": "main", "gitlabMergeRequestLastCommit": "unknown"}),
        (6, None, {"gitlabSourceRepoName": "r"}), (7, None, {**p, "gitlabSourceRepoName": "none"}), (8, None, {**p, "gitlabSourceBranch": "unknown"}),
    ]
    got = pl.resolve_trigger_user(
        spark.createDataFrame(builds, "build_id int, user_id string, parameters map<string, string>"),
        spark.createDataFrame([("g", "r", 9)], "namespace string, repo string, project_id bigint"),
        spark.createDataFrame([(9, 5, "mia")], "project_id bigint, iid bigint, username string"),
        spark.createDataFrame([(9, "c1", "cy@x.org", "C"), (9, "c2", "", "Cee Two"), (9, "c3", "hd@x.org", None)], "project_id bigint, sha string, author_email string, author_name string"),
        spark.createDataFrame([(9, "main", "c3")], "project_id bigint, name string, head_sha string"),
    )
    users = {r.build_id: r.triggered_by.removesuffix("@internal.com") for r in got.collect()}
    assert users == {1: "ann", 2: "mia", 3: "cy", 4: "Cee Two", 5: "hd", 6: "jenkins", 7: "jenkins", 8: "jenkins"}


def test_gitlab_payload_rows(spark):
    pipes = spark.createDataFrame(
        [(1, "u1", "a/b/app", "main", "0123456789", None, "Bo", "push"), (2, "u2", "solo", None, None, None, None, "push")],
        "pipeline_id int, pipeline_url string, project_name string, ref string, sha string, username string, user_full_name string, source string",
    )
    rows = [(1, f"j{i}", i, f"n{i}", "failed" if i % 2 else "success", "L") for i in range(5000)] + [(2, "k", 0, "only", "failed", "none")]
    jobs = spark.createDataFrame(rows, "pipeline_id int, job_id string, job_order int, name string, status string, log_id string")
    texts = spark.createDataFrame([("L", "Line 1: bad")], "log_id string, text string")
    failures = pl.build_failures_gitlab(pipes, jobs, texts)
    one = failures.filter("pipeline_id = 'u1'").orderBy("job_order").collect()
    assert [(r.job_name, r.failed, r.error_lines) for r in one] == [(f"n{i}", i % 2 == 1, ["Line 1: bad"] if i % 2 else []) for i in range(5000)]
    assert {(r.repo, r.commit, r.triggered_by) for r in one} == {("app", "0123456", "Bo@internal.com")}
    whole = pl.one_payload(failures, "u1").first()
    assert whole.job_name == ",".join(f"n{i}" for i in range(5000))
    assert [s.step_name for s in whole.failed_steps] == [f"n{i}" for i in range(1, 5000, 2)]
    two = pl.one_payload(failures, "u2").first()
    assert (two.repo, two.branch, two.commit, two.triggered_by) == ("solo", "unknown", "unknown", "push")
    assert [(s.step_name, s.error_lines) for s in two.failed_steps] == [("only", [])]


def test_match_users(spark):
    users = spark.createDataFrame(
        [("U1", 0, "a@x", "Ann Lee", "annl"), ("U2", 1, None, "Joann", None), ("U3", 2, "ann", "annl", "z")],
        "id string, pos int, email string, real_name string, name string",
    )
    people = spark.createDataFrame([("a@x",), ("ANN",), ("annl",), ("oan",), ("q@x",), ("z",)], "person string")
    exact = {r.person: r.user_id for r in pl.match_user_exact(people, users).collect()}
    fuzzy = {r.person: r.user_id for r in pl.match_user_fuzzy(people, users).collect()}
    assert exact == {"a@x": "U1", "ANN": None, "annl": "U1", "oan": None, "q@x": None, "z": "U3"}
    assert fuzzy == {"a@x": "U1", "ANN": "U1", "annl": "U1", "oan": "U2", "q@x": None, "z": "U3"}


def test_review_matches_step_by_step(spark):
    r = random.Random(11)
    records = [(e, f"err {e}" if e != 3 else "", f"fix {e}", "c", f"m{e}") for e in range(12)]
    actions = []
    for e in range(14):
        for s in range(25):
            kind = r.choice(["button", "reply", "reply"])
            act = r.choices(["approve", "edit", "discard", "other"], [3, 6, 0.3, 0.5])[0] if kind == "button" else None
            thread = r.choice([f"m{e}", f"m{e}", "x", None]) if kind == "reply" else None
            actions.append((e, s, kind, act, r.choice(["u", "v"]), r.choice(["c", "c", "c", "d"]), thread, f" t{s} "))
    want = {}
    known = {x[0]: x for x in records}
    for e in range(14):
        state = {}
        if e in known:
            _, err, fix, ch, ts = known[e]
            state.update(error=err, fix=fix, channel=ch, thread=ts)
        for a in actions:
            if a[0] == e:
                want[e, a[1]] = _step(state, dict(zip(("error_id", "seq", "kind", "action", "user_id", "channel_id", "thread_ts", "text"), a)))
    adf = spark.createDataFrame(actions, "error_id bigint, seq bigint, kind string, action string, user_id string, channel_id string, thread_ts string, text string")
    rdf = spark.createDataFrame(records, "error_id bigint, error string, fix string, channel_id string, message_ts string")
    out = rv.review_outcomes(adf, rdf)
    got = {(x.error_id, x.seq): (x.outcome, x.saved_fix) for x in out.collect()}
    assert got == want and len({o for o, _ in got.values()}) >= 8
    final = {x.error_id: x for x in rv.review_state(out, rdf).collect()}
    assert len(final) == 12 and final[3].source == "unchanged"


def test_lookup_record_and_thread(spark):
    records = spark.createDataFrame(
        [("1", "boom", "a", "ai", 1), ("2", "boom", "b", "ai", 2), ("1", "boom", "a2", "approved", 3)], "error_id string, error string, fix string, source string, ts int"
    )
    keys = spark.createDataFrame([("1",), ("2",), ("boom",), ("none",)], "key string")
    assert {r.key: r.fix for r in kn.lookup_fix_record(keys, records).collect()} == {"1": "a2", "2": "b", "boom": "a2", "none": None}


def test_index_reads_only_cells_in_reach(spark, tmp_path):
    """Equal to brute force after inserts and a repeated insert; a search near one place leaves other cells unread."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 8)) * 3
    points = centres[rng.integers(0, 30, 900)] + rng.normal(size=(900, 8)) * 0.1
    points[500:520] = points[0]
    rows = [(f"i{n:04}", f"text {n}", p.tolist()) for n, p in enumerate(points)] + [("none", "x", None), ("empty", "x", [])]
    schema = "item_id string, note string, embedding array<double>"
    index = VectorIndex.create(spark.createDataFrame(rows[:400], schema), str(tmp_path / "index"), pivots=30)
    for name, part in (("b", rows[400:700]), ("c", rows[700:]), ("b", rows[400:700])):
        index.insert(spark.createDataFrame(part, schema), name)
    index = VectorIndex(spark, index.location)
    assert index.rows().count() == 900
    asked = [(f"q{n}", (points[n] + 0.01).tolist()) for n in (0, 5, 800)] + [("far", [99.0] * 8), ("nothing", None)]
    queries = spark.createDataFrame(asked, "query_id string, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.item_id, r.note, round(r.similarity, 9)) for r in index.search(queries, 7, 0.5).collect()}
    want = {}
    for name, q in asked:
        near = sorted((round(-1 + float(((p - np.array(q)) ** 2).sum()), 9), f"i{n:04}", n) for n, p in enumerate(points)) if q else []
        for rank, (s, i, n) in enumerate(near[:7], 1):
            if -s >= 0.5:
                want[name, rank] = (i, f"text {n}", -s)
    assert got == want and len(got) > 15
    # The plan names the cells; files of the others are not opened.
    cells = index.rows([3, 4])
    assert re.search(r"PartitionFilters: \[cell#\d+ IN \(3,4\)\], PushedFilters: \[\]", cells._jdf.queryExecution().toString())
    assert cells.count() == index.rows().filter("cell in (3, 4)").count() < 200
    with pytest.raises(AnalysisException):
        VectorIndex.create(spark.createDataFrame(rows[:40], schema), str(tmp_path / "index"))
