import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faultline.functions import fixed, text
from faultline.operators import lines as ln
from faultline.operators import sections as sec


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("", ""), (None, ""), ("  \t x \x1f", "x"), ("\x1b[31mException\x1b[0m: bad", "Exception: bad"),
        ("2025-01-01 12:34:56.789 boom", "boom"), ("[12:34:56] boom", "boom"), ("a ✗ b", "a b"), ("a😀b", "a b"),
        ("a\t b   c", "a\t b c"), ("y" * 1001, "y" * 1000 + "..."), ("y" * 1000, "y" * 1000),
    ],
)
def test_clean_line(spark, raw, clean):
    assert one(spark, text.clean_line(F.col("raw")), raw=raw) == clean


def test_clean_line_limit(spark):
    assert one(spark, text.clean_line(F.col("raw"), 50), raw="x" * 111) == "x" * 50 + "..."


def test_explode_lines_keeps_trailing_empty_line(logs):
    rows = logs({"a": "x\ny\n", "b": "", "c": None}).orderBy("line_no").collect()
    assert [(r.log_id, r.line_no, r.raw) for r in rows] == [("a", 0, "x"), ("a", 1, "y"), ("a", 2, "")]


def errors_of(df):
    return sorted((r.log_id, r.line_no) for r in df.collect())


def test_error_lines_and_ignore_list(logs):
    body = "ok\nERROR: tag v1\nException: bad\nbare exception\nTRACEBACK\nsending interrupt signal to process\n[ FAIL ] error: x"
    assert errors_of(ln.error_lines(logs({"a": body}))) == [("a", 2), ("a", 4), ("a", 5)]
    assert errors_of(ln.error_lines(logs({"a": body}), ignore=())) == [("a", 1), ("a", 2), ("a", 4), ("a", 5), ("a", 6)]
    assert errors_of(ln.error_lines(logs({"a": body}), patterns=("bare",), ignore=("EXC",))) == []


def test_patterns_with_quotes(logs):
    assert errors_of(ln.error_lines(logs({"a": "it's bad\\x"}), patterns=("it's", "bad\\x"), ignore=())) == [("a", 0)]


def test_line_samples(logs):
    many = "\n".join("Traceback" if (i + 1) % 10 == 0 else "-" for i in range(100))
    rows = {r.log_id: r for r in ln.error_line_samples(logs({"a": many, "b": "traceback\nx\ntraceback"})).collect()}
    assert rows["a"].sample == "10,20,30,40,50 ... 100 (10 total)"
    assert rows["b"].sample == "1,3 (2 total)" and rows["b"].lines == 2


def test_close_and_far_errors_with_fixed_context(logs):
    close = "\n".join(["l"] * 3 + ["exception: a", "l", "exception: b"] + ["l"] * 3)
    far = "\n".join(["exception: a"] + ["l"] * 20 + ["exception: b"])
    got = sorted((r.log_id, r.start_line, r.end_line, r.errors) for r in sec.fixed_context(logs({"c": close, "f": far}), 2, 2).collect())
    assert got == [("c", 1, 8, 2), ("f", 0, 3, 1), ("f", 19, 22, 1)]


def test_sections_text(logs):
    body = "\n".join(["one", "exception: a", "two", "", "three", "four", "five", "exception: b", "six"])
    plan = sec.context_plan(buckets=((5, 1, 1),), mode="buckets")
    row = sec.format_sections(logs({"a": body}), plan).first()
    assert row.text == (
        "Line 1: one\nLine 2: exception: a\nLine 3: two\n\n--- Next Error Section ---\n\n"
        "Line 7: five\nLine 8: exception: b\nLine 9: six"
    )


def test_no_sections_without_errors(logs):
    assert sec.format_sections(logs({"a": "fine\nall good"})).count() == 0


def test_context_plan_modes():
    assert sec.context_plan().cap == 300
    assert sec.context_plan(before=3).cap is None
    assert sec.context_plan(adaptive=False).cap is None
    assert sec.parse_buckets("10:10:5, 5:50:10,") == ((5, 50, 10), (10, 10, 5))
    assert sec.parse_buckets("") == fixed.CONTEXT_BUCKETS
    for wrong in ("5:1", "0:1:1", "5:-1:0", "5:1:1,5:2:2", "a:1:1"):
        with pytest.raises(ValueError):
            sec.parse_buckets(wrong)
    with pytest.raises(ValueError):
        sec.format_sections(None, sec.context_plan(1, 1))


def scan(errors, total, plan):
    """The rule as a plain scan from the last line to the first."""
    picks, at = [], total - 1
    hits = set(errors)
    while at >= 0:
        if at not in hits:
            at -= 1
            continue
        if plan.cap is not None and len(picks) >= plan.cap:
            break
        before = plan.before
        if plan.buckets:
            seen = 0
            for count, size, _ in plan.buckets:
                seen += count
                if len(picks) < seen:
                    before = size
                    break
        picks.append(at)
        at = max(0, at - before) - 1
    return picks[::-1]


def picks_of(spark, cases, plan):
    rows = [(str(i), line) for i, errors in enumerate(cases) for line in errors]
    df = spark.createDataFrame(rows, "log_id string, line_no int")
    out = {}
    for r in sec.pick_errors(df, plan).orderBy("section_no").collect():
        out.setdefault(r.log_id, []).append(r.error_line)
    return [out.get(str(i), []) for i in range(len(cases))]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sets(st.integers(0, 3000), max_size=60), min_size=5, max_size=15), st.integers(0, 40))
def test_picks_match_scan(spark, cases, before):
    cases = [sorted(c) for c in cases if c]
    if not cases:
        return
    for plan in (sec.context_plan(before, 1, mode="fixed"), sec.context_plan(buckets=((2, before, 1), (3, 2, 1), (4, 0, 0)), mode="buckets")):
        assert picks_of(spark, cases, plan) == [scan(c, 3001, plan) for c in cases]


@pytest.mark.parametrize("before", [0, 1, 50])
def test_dense_logs_cross_blocks(spark, before):
    cases = [
        list(range(0, 5000)), list(range(1000, 4100)), list(range(0, 9000, 7)), [i for i in range(6000) if i % 97 > 2],
        [0], [1023, 1024], list(range(1000, 1100)) + list(range(2040, 2060)),
    ]
    plan = sec.context_plan(before, 1, mode="fixed")
    assert picks_of(spark, cases, plan) == [scan(c, 9000, plan) for c in cases]


def test_dense_log_crosses_groups_of_blocks(spark):
    plan = sec.context_plan(50, 1, mode="fixed")
    cases = [list(range(500, 40000)), [i for i in range(30000) if i % 500 > 60]]
    rows = [(str(i), n) for i, c in enumerate(cases) for n in c]
    df = spark.createDataFrame(rows, "log_id string, line_no int")
    got = {}
    for r in sec._uncapped_picks(df, plan, group=4).orderBy("section_no").collect():
        got.setdefault(r.log_id, []).append(r.error_line)
    assert [got[str(i)] for i in range(len(cases))] == [scan(c, 40000, plan) for c in cases]


def test_capped_picks_use_default_buckets(spark):
    plan = sec.context_plan()
    cases = [list(range(0, 20000)), list(range(0, 60000, 60))]
    assert picks_of(spark, cases, plan) == [scan(c, 60001, plan) for c in cases]


def test_tail_head_hybrid(spark):
    text5 = "\n".join(str(i) for i in range(5))
    df = spark.createDataFrame([("a", text5), ("b", "x\nTraceback\n" + "\n".join("y" * 9)), ("c", "x\nTraceback")], "log_id string, content string")
    tails = {r.log_id: r.t for r in df.select("log_id", ln.tail_lines(F.col("content"), 2).alias("t")).collect()}
    assert tails == {"a": "3\n4", "b": "y\ny", "c": "x\nTraceback"}
    heads = {r.log_id: (r.content, r.truncated, r.total_lines) for r in ln.head_cap(df, 5).collect()}
    assert heads["a"] == (text5, True, 5) and heads["c"][1:] == (False, 2)
    mixed = {r.log_id: (r.method, r.total_lines, r.truncated) for r in ln.hybrid_log(df, 3, 5).collect()}
    assert mixed == {"a": ("streaming", 5, True), "b": ("streaming", 5, True), "c": ("tail", 2, False)}


def test_grep_context_across_blocks(logs):
    body = "\n".join("hit" if i in (9, 10, 31) else "-" for i in range(50))
    near = ln.grep_context(logs({"a": body}), F.col("raw") == "hit", 2, block=10)
    assert sorted(r.line_no for r in near.collect()) == [7, 8, 9, 10, 11, 12, 29, 30, 31, 32, 33]


@pytest.mark.parametrize("plan", [sec.context_plan(buckets=((2, 3, 1), (9, 1, 0)), mode="buckets"), sec.context_plan()])
def test_whole_log_form_equals_line_form(spark, logs, plan):
    import random

    r = random.Random(2)
    texts = {str(i): "\n".join(r.choice(["", "ok", " \x1b[1mmake: *** x", "error: tag 1", "é ok"]) for _ in range(r.randint(1, 90))) for i in range(25)}
    texts["none"], texts["empty"] = "fine", ""
    whole = spark.createDataFrame(list(texts.items()), "log_id string, content string")
    got = {r.log_id: r.text for r in sec.extract_error_sections(whole, plan).collect()}
    want = {r.log_id: r.text for r in sec.format_sections(logs(texts), plan).collect()}
    assert {k: v for k, v in got.items() if v is not None} == want and got["none"] is None and got["empty"] is None
