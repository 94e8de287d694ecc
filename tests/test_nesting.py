"""Nested markers against a plain stack."""

import random

from pyspark.sql import functions as F

from faultline.operators import nesting
from faultline.operators import stages as st


def plain(steps):
    """(pos, level, end) of each opening marker; closing markers that close nothing are passed over."""
    stack, out = [], {}
    for pos, step in steps:
        if step > 0:
            stack.append(pos)
            out[pos] = [len(stack), None]
        elif stack:
            out[stack.pop()][1] = pos
    return {(pos, level, end) for pos, (level, end) in out.items()}


def test_markers_close_by_depth(spark):
    rng, rows, want = random.Random(8), [], set()
    for key in range(40):
        pos, steps = 0, []
        for _ in range(rng.randint(1, 60)):
            pos += rng.choice((1, 5, 900, 5000))  # over the edges of many blocks
            steps.append((pos, rng.choice((1, 1, -1) if key % 2 else (1, -1, -1))))
        rows += [(key, *s) for s in steps]
        want |= {(key, *p) for p in plain(steps)}
    marks = spark.createDataFrame(rows, "k int, pos long, step int").repartition(5)
    got = {tuple(r) for r in nesting.matched(marks, ["k"], "pos", "step").select("k", "pos", "level", "end").collect()}
    assert got == want
    spans = spark.createDataFrame(sorted(want, key=str), "k int, pos long, level int, end long")
    around = {}
    for k, pos, _, _end in want:
        outer = [p for kk, p, _, e in want if kk == k and p < pos and (e is None or e > pos)]
        around[k, pos] = (len(outer) + 1, max(outer, default=None))
    found = {(r.k, r.pos): (r.depth, r.parent) for r in nesting.with_parents(spans, ["k"], "pos", "end").collect()}
    assert found == around


def _log():
    """Three levels over the edges of two blocks of 4,096 lines."""
    marks = {
        3: "[Pipeline] stage", 4: "[Pipeline] { (Outer)", 10: "[Pipeline] parallel", 11: "[Pipeline] { (Branch: left)",
        4000: "[Pipeline] stage (Inner)", 4090: "[Pipeline] stage (Innermost)", 4100: "[Pipeline] // stage", 4200: "[Pipeline] // stage",
        4300: "[Pipeline] }", 4301: "[Pipeline] { (right)", 8500: "[Pipeline] }", 8501: "[Pipeline] // parallel", 8600: "[Pipeline] }",
        8601: "[Pipeline] // stage", 8602: "[Pipeline] // stage", 8700: "[Pipeline] stage (outer)", 8705: "[Pipeline] stage (cut)",
    }
    return "\n".join(marks.get(n, f"line {n}") for n in range(9000))


def test_three_levels_over_a_block_edge(logs):
    lines = logs({"a": _log(), "b": "no marker"})
    got = {(r.kind, r.name, r.start_line): (r.end_line, r.closed, r.depth, r.parent) for r in st.nested_spans(lines).collect()}
    assert got == {
        ("stage", "Outer", 3): (8601, True, 1, None), ("block", "left", 11): (4300, True, 2, 3), ("block", "right", 4301): (8500, True, 2, 3),
        ("stage", "Inner", 4000): (4200, True, 3, 11), ("stage", "Innermost", 4090): (4100, True, 4, 4000),
        ("stage", "outer", 8700): (9000, False, 1, None), ("stage", "cut", 8705): (9000, False, 2, 8700),
    }


def test_tree_and_texts_of_nested_stages(spark, logs):
    lines = logs({"a": _log()})
    node = "array<struct<name: string, status: string, duration_ms: long>>"
    rows = [
        ("a", 0, "OUTER", "FAILED", 9, [("left", "SUCCESS", 1), ("right", "FAILED", 2), ("gone", "FAILED", 3)]), ("a", 1, "Inner", "SUCCESS", 5, []),
        ("a", 2, "missing", "FAILED", 5, None), ("a", 3, "innermost", "SUCCESS", 5, [("x", "SUCCESS", 1)]),
    ]
    stages = spark.createDataFrame(rows, f"log_id string, stage_pos int, name string, status string, duration_ms long, nodes {node}")
    stages = stages.withColumn("nodes", F.coalesce("nodes", F.array().cast(node)))
    tree = {(r.stage_pos, r.part_name): (r.start_line, r.end_line, r.closed, r.lines) for r in st.stage_tree(stages, lines, nested=True).collect()}
    assert tree == {
        (0, "left"): (11, 4300, True, 4288), (0, "right"): (4301, 8500, True, 4198), (0, "gone"): (None, None, None, 0),
        (1, "Inner"): (4000, 4200, True, 199), (2, "missing"): (None, None, None, 0), (3, "innermost"): (4090, 4100, True, 9),
    }
    texts = {}
    for r in st.stage_texts(stages, lines, nested=True).orderBy("part").collect():
        texts.setdefault(r.part_name, []).append((r.part, r.text.split("\n")))
    assert [part for part, _ in texts["left"]] == [0, 1] and sum(len(t) for _, t in texts["left"]) == 4288
    whole = _log().split("\n")
    assert [x for _, t in texts["Inner"] for x in t] == whole[4001:4200] and [x for _, t in texts["innermost"] for x in t] == whole[4091:4100]
    assert set(texts) == {"left", "right", "Inner", "innermost"}
    # Without nesting the first closing marker ends a stage, as it always did.
    flat = {r.part_name: r.lines for r in st.stage_tree(stages, lines).collect()}
    assert flat["Inner"] == 99 and flat["innermost"] == 9
