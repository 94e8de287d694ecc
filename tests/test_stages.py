from pyspark.sql import functions as F

from faultline.operators import sections as sec
from faultline.operators import stages as st

CONSOLE = "\n".join([
    "Started", "[Pipeline] stage (Build)", "b1", "[Pipeline] parallel", "[Pipeline] { (Unit)", "u1", "u2", "[Pipeline] { (Lint)", "l1",
    "[Pipeline] // parallel", "b2", "[Pipeline] { (plain)", "[Pipeline] stage (Test)", "t1", "[Pipeline] parallel", "[Pipeline] { (Lost)", "x1",
])


def by_group(df, *keys):
    out = {}
    for r in df.orderBy("line_no").collect():
        out.setdefault(tuple(r[k] for k in keys), []).append(r.raw)
    return out


def test_segments(logs):
    lines = logs({"a": CONSOLE})
    assert by_group(st.segment_stages(lines), "stage_no", "stage_name") == {
        (1, "Build"): ["b1", "b2", "[Pipeline] { (plain)"], (2, "Test"): ["t1"],
    }
    assert by_group(st.segment_parallel(lines), "stage_no", "block_name") == {(1, "Unit"): ["u1", "u2"], (1, "Lint"): ["l1"]}


def test_stage_header_closes_open_block(logs):
    body = "[Pipeline] stage (A)\n[Pipeline] parallel\n[Pipeline] { (X)\nx\n[Pipeline] stage (B)\nb\n[Pipeline] { (Y)"
    lines = logs({"a": body})
    assert by_group(st.segment_parallel(lines), "stage_name", "block_name") == {("A", "X"): ["x"]}
    assert by_group(st.segment_stages(lines), "stage_name") == {("B",): ["b", "[Pipeline] { (Y)"]}


def wanted(spark, *names):
    return spark.createDataFrame([("a", n) for n in names], "log_id string, name string")


def test_slices(spark, logs):
    body = "\n".join([
        "x stage (Build (x86))", "1", "STAGE (build (X86))", "2", "[Pipeline] // stage", "3", "{ (Test-unit)", "4", "Branch: Te", "[Pipeline] }", "5",
    ])
    lines = logs({"a": body})
    assert by_group(st.slice_stage(lines, wanted(spark, "build (x86)", "none")), "name") == {("build (x86)",): ["1", "2"]}
    assert by_group(st.slice_step(lines, wanted(spark, "Test")), "name") == {("Test",): ["4", "Branch: Te"]}
    assert by_group(st.slice_block(lines, wanted(spark, "Test-unit", "T")), "name") == {("Test-unit",): ["4", "Branch: Te"]}


def test_two_line_slice(spark, logs):
    body = "\n".join(["[Pipeline] stage", "[Pipeline] { (Build )", "1", "[pipeline] // STAGE", "2", "[Pipeline] stage", "[Pipeline] { (Test)", "3"])
    got = by_group(st.slice_stage_two_line(logs({"a": body}), wanted(spark, "build", "Test", "No")), "name")
    assert got == {("build",): body.split("\n")[:4], ("Test",): body.split("\n")[5:]}


def test_real_failures(spark):
    rows = [("a", 0, "n0", "FAILED"), ("a", 1, "n1", "SUCCESS"), ("a", 2, "n2", "FAILURE"), ("a", 3, "n3", "FAILED"),
            ("b", 0, "m0", "FAILED"), ("b", 1, "m1", "SKIPPED"), ("c", 0, "k", "SUCCESS")]
    df = spark.createDataFrame(rows, "s string, node_pos int, name string, status string")
    got = {r.s: (r.step_name, r.total_failed, r.handled) for r in st.real_failures(df, ["s"]).collect()}
    assert got == {"a": ("n3", 3, 1), "b": (None, 1, 1)}


def test_hybrid_lines(logs):
    lines = logs({"a": "x\ny\nTraceback\nz", "b": "Traceback\n" + "\n".join("y" * 9)})
    got = by_group(st.hybrid_lines(lines, tail=2, head=4), "log_id")
    assert got == {("a",): ["Traceback", "z"], ("b",): ["Traceback", "y", "y", "y"]}


def test_stage_log_choice(spark, logs):
    console = "\n".join([
        "[Pipeline] stage", "[Pipeline] { (One)", "fine", "[Pipeline] // stage", "[Pipeline] { (stepB)", "in step", "[Pipeline] }", "exception: end",
    ])
    failed = spark.createDataFrame(
        [("a", "Own", None), ("a", "One", None), ("a", "Stepped", "stepB"), ("a", "Missing", None), ("a", "Gone", "nothing")],
        "log_id string, name string, step_name string",
    )
    own = spark.createDataFrame([("a", "Own", 0, "own text"), ("a", "Else", 0, "no")], "log_id string, name string, line_no int, raw string")
    plan = sec.context_plan(buckets=((2, 1, 0),), mode="buckets")
    far = "\n".join(["[Pipeline] { (stepB)", "found", "[Pipeline] }", *(f"line {n}" for n in range(9000))])
    above = st.stage_log_choice(failed.filter("name = 'Stepped'"), own, logs({"a": far}), plan).collect()
    assert [(r.choice, r.text) for r in above] == [("step", "found")]
    parts = st.stage_log_choice(failed.filter("name = 'One'"), own, logs({"a": far}), plan).orderBy("part").collect()
    assert [r.choice for r in parts] == ["console"] * 3 and "\n".join(r.text for r in parts) == far
    got = {r.name: (r.choice, r.text) for r in st.stage_log_choice(failed, own, logs({"a": console}), plan).collect()}
    tail = "Line 7: [Pipeline] }\nLine 8: exception: end"
    assert got == {
        "Own": ("stage log", "own text"), "One": ("stage slice", "\n".join(console.split("\n")[:4])),
        "Stepped": ("step", "in step"), "Missing": ("console sections", tail), "Gone": ("console sections", tail),
    }


def test_stage_tree(spark, logs):
    nodes = "array<struct<name: string, status: string, duration_ms: bigint>>"
    stages = spark.createDataFrame(
        [("a", 0, "Build", "FAILED", 5, [("Unit", "FAILED", 1), ("Lint", "SUCCESS", 2)]), ("a", 1, "Test", "SUCCESS", 6, [("t", "SUCCESS", 1)])],
        f"log_id string, stage_pos int, name string, status string, duration_ms bigint, nodes {nodes}",
    )
    got = {(r.stage_name, r.part_name): (r.is_parallel, r.lines) for r in st.stage_tree(stages, logs({"a": CONSOLE})).collect()}
    assert got == {("Build", "Unit"): (True, 4), ("Build", "Lint"): (True, 1), ("Test", "Test"): (False, 4)}
    assert st.stage_tree(stages.filter(F.lit(False)), logs({"a": CONSOLE})).count() == 0


def scan_segments(rows):
    """The rule as a plain scan: (stage_no, stage) -> lines, and (stage_no, block start, block) -> lines."""
    stages, blocks = {}, {}
    no, name, parallel, block, open_lines = 0, None, False, None, []

    def close():
        nonlocal block, open_lines
        if block is not None and no:
            blocks[(no, *block)] = open_lines
        block, open_lines = None, []

    for i, line in enumerate(rows):
        if line.startswith("[Pipeline] stage ("):
            close()
            no, name, parallel = no + 1, line[18:-1], False
        elif line == "[Pipeline] parallel":
            parallel = True
        elif line.startswith("[Pipeline] { (") and parallel:
            close()
            block = (i, line[14:-1])
        elif line == "[Pipeline] // parallel":
            close()
            parallel = False
        elif block is not None:
            open_lines.append(line)
        elif no:
            stages.setdefault((no, name), []).append(line)
    return stages, {k: v for k, v in blocks.items() if v}


def test_long_console_equals_plain_scan(spark, logs):
    import random

    r = random.Random(4)
    kinds = ["[Pipeline] stage (S{})", "[Pipeline] parallel", "[Pipeline] {{ (B{})", "[Pipeline] // parallel", "[Pipeline] // stage"]
    rows = [r.choice(kinds).format(r.randint(0, 40)) if r.random() < 0.004 else f"l{i}" for i in range(13000)]
    lines = logs({"a": "\n".join(rows), "b": "x\n[Pipeline] stage (Only)\ny"})
    want_stages, want_blocks = scan_segments(rows)
    mine = lines.filter("log_id = 'a'")
    assert by_group(st.segment_stages(lines).filter("log_id = 'a'"), "stage_no", "stage_name") == want_stages
    assert by_group(st.segment_parallel(mine), "stage_no", "block_start", "block_name") == want_blocks
    names = [f"S{i}" for i in range(41)]
    want = {}
    for name in names:
        inside, kept = False, []
        for line in rows:
            if f"stage ({name})".lower() in line.lower():
                inside = True
            elif inside and "// stage" in line:
                break
            elif inside:
                kept.append(line)
        if kept:
            want[(name,)] = kept
    assert by_group(st.slice_stage(mine, wanted(spark, *names)), "name") == want
