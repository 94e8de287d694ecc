import datetime as dt
import json

from pyspark.sql import functions as F

from faultline.operators.shared import new_path, settle, shared_dir
from faultline.sources import events as se
from faultline.sources import files as fl
from faultline.sources import logs as lg
from faultline.sources import sinks


def write(path, body):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(body, encoding="utf-8")


def test_log_tree_on_disk(spark, tmp_path):
    root = tmp_path / "store"
    write(root / "my_app_12/pipeline_7/job_3_unit_test.log", "l1\nl2")
    write(root / "my_app_12/pipeline_7/metadata.json", json.dumps({"project_id": 12, "pipeline_id": 7, "jobs": {"3": {"job_id": 3}}}, indent=2))
    write(root / "my_app_12/pipeline_8/metadata.json", "{broken")
    write(root / "jenkins-builds/j1/5/stage_Build.log", "s")
    write(root / "jenkins-builds/j1/5/console.log", "c")
    rows = {r.path.split("/")[-1]: r for r in lg.read_log_store(spark, str(root)).collect()}
    job, stage, console = rows["job_3_unit_test.log"], rows["stage_Build.log"], rows["console.log"]
    assert (job.source, job.project_dir, job.project_id, job.pipeline_id, job.job_id, job.job_name, job.content) == (
        "gitlab", "my_app_12", 12, 7, "3", "unit_test", "l1\nl2")
    assert (stage.source, stage.job_name, stage.build_number, stage.stage) == ("jenkins", "j1", 5, "Build")
    assert console.stage is None and console.build_number == 5
    metadata = lg.read_metadata_json(spark, str(root)).filter("pipeline_id is not null").collect()
    assert [(r.project_id, r.pipeline_id, list(r.jobs)) for r in metadata] == [(12, 7, ["3"])]
    stats = lg.storage_stats(lg.list_artefacts(spark, str(root))).first()
    assert (stats.projects, stats.pipelines, stats.build_jobs, stats.builds, stats.log_files, stats.total_bytes) == (1, 1, 1, 1, 3, 7)
    assert lg.largest_logs(lg.list_artefacts(spark, str(root)), 1).first().size == 5


def test_expiry(spark):
    old, new = dt.datetime(2024, 1, 1), dt.datetime(2024, 5, 1)
    rows = [("/d/a_1/pipeline_1/x.log", 5, old), ("/d/a_1/pipeline_1/y.log", 6, old), ("/d/a_1/pipeline_2/x.log", 7, new),
            ("/d/b_2/pipeline_3/x.log", 8, old), ("/d/jenkins-builds/j/9/console.log", 9, old), ("/d/jenkins-builds/j/notes/x", 1, old)]
    plan = lg.expire_artefacts(spark.createDataFrame(rows, "path string, size bigint, mtime timestamp_ntz"), "2024-05-02 00:00:00", 90)
    got = {r.directory: (r.source, r.bytes, r.expired, r.parent_empty) for r in plan.collect()}
    assert got == {
        "/d/a_1/pipeline_1": ("gitlab", 11, True, False), "/d/a_1/pipeline_2": ("gitlab", 7, False, False),
        "/d/b_2/pipeline_3": ("gitlab", 8, True, True), "/d/jenkins-builds/j/9": ("jenkins", 9, True, True),
    }
    assert {r.source: (r.directories, r.bytes_freed) for r in lg.expiry_summary(plan).collect()} == {"gitlab": (2, 19), "jenkins": (1, 9)}
    edge = spark.createDataFrame([("daily", dt.datetime(2024, 4, 24)), ("daily", dt.datetime(2024, 4, 25)), ("keep", old)], "tier string, mtime timestamp_ntz")
    assert [r.expired for r in lg.expire_snapshots(edge, "2024-05-02 12:00:00").orderBy("mtime").collect()] == [False, True, False]


def test_fix_files(spark, tmp_path):
    for i, body in enumerate(['[{"error": "e", "n": 1}]', '{"entries": [{"error": "e"}, {"error": "f"}]}', '{"items": []}', '{"error": "g"}']):
        write(tmp_path / f"json/{i}.json", body)
    entries = se.fix_import_json(se.read_json_files(spark, str(tmp_path / "json")))
    assert sorted(json.dumps(r.entry) for r in entries.collect()) == sorted(
        ['{"error": "e"}', '{"error": "e", "n": "1"}', '{"error": "f"}', '{"error": "g"}'])
    write(tmp_path / "fixes.csv", 'error,fix,team\n"a, ""b""\nc",f,\n')
    assert se.fix_import_csv(spark, str(tmp_path / "fixes.csv")).first().entry == {"error": 'a, "b"\nc', "fix": "f"}


def test_domain_and_registry_files(spark):
    df = spark.createDataFrame([('{"IT": [{"failure": "f", "solution": "s"}, {"failure": " "}], "Devops": [{"failure": "g"}]}',)], "body string")
    assert sorted((r.category, r.failure, r.solution) for r in se.domain_patterns(df).collect()) == [("Devops", "g", ""), ("IT", "f", "s")]
    reg = spark.createDataFrame([(json.dumps({"instances": [{"jenkins_url": "https://A/", "jenkins_user": "x"}, {"jenkins_url": "https://a", "jenkins_user": "y", "jenkins_api_token": "no"}]}),)], "body string")
    rows = se.ci_instances(reg).collect()
    assert [(r.jenkins_url, r.jenkins_user) for r in rows] == [("https://a", "y")] and "no" not in str(rows)


LOG = """2025-12-30 10:20:15.456 | INFO  | src.a    | a1b2c3d4 | Webhook received | event_type=Pipeline Hook project_name=my app
2025-12-30 10:20:16.456 | ERROR | src.b    | a1b2c3d4 | a | b
Traceback (most recent call last)
  File "x"
2025-12-30 11:20:16.456 | INFO  | src.a    | ffff0000 | done | processing_time=5.1 processing_time=6.2
"""


def test_app_log(spark, tmp_path):
    write(tmp_path / "application.log", "orphan\n" + LOG)
    lines = lg.read_lines(spark, str(tmp_path / "application.log"))
    rows = lg.app_log(lines).orderBy("record_line").collect()
    assert [(r.level, r.logger, r.request_id, r.message, r.trace_lines) for r in rows] == [
        ("INFO", "src.a", "a1b2c3d4", "Webhook received", 0), ("ERROR", "src.b", "a1b2c3d4", "a | b", 2), ("INFO", "src.a", "ffff0000", "done", 0)]
    assert rows[0].ctx == {"event_type": "Pipeline Hook", "project_name": "my app"} and rows[1].ctx is None
    assert [(r.record_line, r.raw) for r in lg.app_log_traces(lines).orderBy("line_no").collect()] == [
        (2, "Traceback (most recent call last)"), (2, '  File "x"')]
    records = lg.app_log(lines)
    assert [r.step_ms for r in lg.request_trace(records).orderBy("ts").collect()] == [None, 1000, None]
    assert lg.search_app_log(records, request_id="a1b2c3d4", levels=["ERROR"]).count() == 1
    assert lg.search_app_log(records, contains={"project_name": "my app"}, logger="src.a").count() == 1
    assert lg.slowest_steps(records).first().processing_time == 6.2
    assert lg.daily_project_requests(records, "my app", "2025-12-30").first().lines == 1


def test_api_log(spark):
    lines = [
        "[2025-12-30 10:20:20] PIPELINE_ID=123456 PROJECT_ID=789 URL=http://x:8000/api STATUS=200 DURATION=1250ms RESPONSE={\"a\": 1}",
        "[2025-12-30 10:20:21] PIPELINE_ID=1 PROJECT_ID=2 URL=u STATUS=ERROR DURATION=5ms ERROR=timed out RESPONSE=", "junk",
    ]
    rows = lg.api_calls(spark.createDataFrame([(x,) for x in lines], "raw string")).orderBy("ts").collect()
    assert [(r.pipeline_id, r.status, r.duration_ms, r.error, r.response) for r in rows] == [
        (123456, "200", 1250, None, '{"a": 1}'), (1, "ERROR", 5, "timed out", "")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), 'a "q", b\nc'), (2, dt.datetime(2024, 1, 2), None)], "id int, timestamp timestamp_ntz, note string")
    out = str(tmp_path / "csv")
    assert sinks.requests_csv(rows, out, "2024-01-09 00:00:00", 24) is None
    assert sinks.requests_csv(rows, out) == out
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(out).collect()
    assert [(r.id, r.note) for r in back] == [("2", None), ("1", 'a "q", b\nc')]
    tree = str(tmp_path / "tree")
    logs = spark.createDataFrame([("gitlab", "p1", "x"), ("gitlab", "p2", "y")], "source string, project_dir string, content string")
    sinks.log_tree(logs, tree)
    sinks.log_tree(logs.filter("project_dir = 'p2'").withColumn("content", F.lit("z")), tree)
    assert sorted(r.content for r in spark.read.parquet(tree).collect()) == ["x", "z"]


def test_merge_keeps_fields_the_new_record_lacks(spark):
    old = spark.createDataFrame([(1, 1, "a", "x"), (2, 1, "b", "y")], "k int, version int, s string, t string")
    new = spark.createDataFrame([(1, 2, None), (1, 3, "c"), (3, 2, "d")], "k int, version int, s string")
    got = {r.k: (r.s, r.t, r.last_updated) for r in sinks.merge_latest(old, new, ["k"]).collect()}
    assert got == {1: ("c", "x", 3), 2: ("b", "y", 1), 3: ("d", None, 2)}


def test_files_are_read_in_ranges(spark, tmp_path):
    folder = tmp_path / "app_7" / "pipeline_3"
    folder.mkdir(parents=True)
    texts = {"job_1_a.log": "".join(f"line {n}\r\n" for n in range(3000)), "job_2_b.log": "one\n\nthree", "job_3_c.log": "", "x.txt": "no"}
    for name, content in texts.items():
        (folder / name).write_bytes(content.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        rows = lg.read_log_lines(spark, str(tmp_path)).orderBy("job_id", "line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.job_id, r.line_no, r.raw) for r in rows if r.job_id != "1"] == [("2", 0, "one"), ("2", 1, ""), ("2", 2, "three")]
    assert [(r.line_no, r.raw) for r in rows if r.job_id == "1"] == [(n, f"line {n}\r") for n in range(3000)]
    assert {(r.project_id, r.pipeline_id) for r in rows} == {(7, 3)}


def test_sweep_deletes_what_was_written(spark, tmp_path, monkeypatch):
    from faultline.operators import shared

    monkeypatch.setattr(shared, "_written", {})
    kept = shared.settle(spark.range(3), "kept")
    assert kept.count() == 3 and shared.sweep(spark) == 1 and shared.sweep(spark) == 0


def test_merge_latest(spark):
    old = spark.createDataFrame([(1, 1, "a", "x"), (2, 1, "b", "y")], "k int, version int, s string, t string")
    new = spark.createDataFrame([(1, 2, "c", None)], "k int, version int, s string, t string")
    got = {r.k: (r.s, r.t, r.last_updated) for r in sinks.merge_latest(old, new, ["k"]).collect()}
    assert got == {1: ("c", None, 2), 2: ("b", "y", 1)}


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert new_path(spark, "x").startswith(shared_dir(spark)) and new_path(spark, "x") != new_path(spark, "x")
    df = spark.range(5)
    assert settle(df, "five").count() == 5


def test_job_entries_are_merged_one_by_one(spark):
    """A write of job 11 leaves job 10; a newer entry for job 10 replaces the whole old one, an older one does not."""
    entry = "struct<job_name: string, status: string>"
    schema = f"p long, version int, status string, jobs map<string, {entry}>"
    old = spark.createDataFrame([(1, 1, "running", {"10": ("a", "failed")}), (2, 1, "running", None), (3, 1, "x", {}), (4, 1, "y", {"7": ("q", None)})], schema)
    new = spark.createDataFrame([
        (1, 2, None, {"11": ("b", "success")}), (1, 4, "failed", {"10": ("a2", None)}), (1, 3, None, {"10": ("mid", "x")}),
        (2, 2, None, {"5": ("n", "ok")}), (3, 2, None, None), (5, 2, "new", {"1": ("z", "z")})], schema)
    got = {r.p: (r.status, r.jobs and {k: tuple(v) for k, v in r.jobs.items()}, r.last_updated) for r in sinks.merge_latest(old, new, ["p"]).collect()}
    assert got == {
        1: ("failed", {"10": ("a2", None), "11": ("b", "success")}, 4), 2: (None, {"5": ("n", "ok")}, 2), 3: (None, {}, 2),
        4: ("y", {"7": ("q", None)}, 1), 5: ("new", {"1": ("z", "z")}, 2),
    }
    without = sinks.merge_latest(old, new.drop("jobs"), ["p"])
    assert {r.p: len(r.jobs or ()) for r in without.collect()} == {1: 1, 2: 0, 3: 0, 4: 1, 5: 0}


def test_ends_of_files_are_read_without_the_rest(spark, tmp_path, monkeypatch):
    long = "".join(f"line {n} {'x' * (n % 50)}\n" for n in range(40_000))
    texts = {"a b/long.log": long, "short.log": "one\ntwo", "empty.log": "", "nul.log": None, "exact.log": "1\n2\n3", "bytes.log": "é" * 400}
    rows = spark.createDataFrame(list(texts.items()), "path string, content string")
    written = fl.write_files(rows, str(tmp_path)).collect()
    assert {r.path.removeprefix(f"{tmp_path}/"): r.size for r in written} == {k: len((v or "").encode()) for k, v in texts.items()}
    assert not [p for p in tmp_path.rglob("*") if p.name.endswith(".part")]
    # A listing by Spark leaves empty files out.
    assert lg.list_artefacts(spark, str(tmp_path)).count() == len(texts) - 2
    files = spark.createDataFrame(written)

    def by_name(df):
        return {r.path.rpartition("/")[2]: r for r in df.collect()}

    tails = by_name(fl.file_tail_bytes(files, 3))
    assert all(r.bytes_read == min(r.size, 450) == len(r.content) for r in tails.values()) and bytes(tails["long.log"].content) == long.encode()[-450:]
    for n in (1, 3, 5000):
        lines = by_name(fl.file_tail_lines(files, n))
        assert {k: r.content for k, r in lines.items()} == {k.rpartition("/")[2]: "\n".join((v or "").split("\n")[-n:]) for k, v in texts.items()}
        heads = by_name(fl.file_head_cap(files, n))
        for k, v in texts.items():
            parts, r = (v or "").split("\n"), heads[k.rpartition("/")[2]]
            assert (r.content, r.total_lines, r.truncated) == ("\n".join(parts[:n]), min(n, len(parts)), len(parts) >= n)
    assert by_name(fl.file_tail_lines(files, 3))["long.log"].bytes_read == fl.CHUNK
    assert by_name(fl.file_head_cap(files, 3))["long.log"].bytes_read == fl.CHUNK
    got = by_name(fl.file_hybrid_log(files, 1, 2, ("two",), ()))
    assert (got["short.log"].method, got["short.log"].content, got["short.log"].total_lines, got["short.log"].truncated) == ("tail", "two", 1, False)
    assert (got["exact.log"].method, got["exact.log"].content, got["exact.log"].truncated) == ("streaming", "1\n2", True)
    # A chunk border inside a line, a break or a character changes nothing.
    monkeypatch.setattr(fl, "CHUNK", 7)
    small = by_name(fl.file_tail_lines(files.filter("path not like '%long.log'"), 2))
    assert small["exact.log"].content == "2\n3" and small["bytes.log"].content == texts["bytes.log"]


def test_paths_with_blanks_and_signs(spark, tmp_path):
    rows = spark.createDataFrame([("te am+1%_7/pipeline_3/job_5_unit tests+a%20b.log", "x\ny")], "path string, content string")
    assert fl.write_files(rows, str(tmp_path)).count() == 1
    got = lg.read_log_store(spark, str(tmp_path)).first()
    assert (got.project_dir, got.job_name, got.content) == ("te am+1%_7", "unit tests+a%20b", "x\ny")
    assert [(r.job_name, r.line_no, r.raw) for r in lg.read_log_lines(spark, str(tmp_path)).orderBy("line_no").collect()] == [
        ("unit tests+a%20b", 0, "x"), ("unit tests+a%20b", 1, "y")]
