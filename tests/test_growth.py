"""Work that must grow no faster than its input: texts move once, files are listed and read in tasks."""

import os

from pyspark.sql import functions as F

from faultline.operators import payload as pl
from faultline.operators import postings, shared
from faultline.plans import stream_queries as sq
from faultline.plans import views
from faultline.sources import files as fl
from faultline.sources import logs as lg
from faultline.sources import sinks


def test_attached_texts_are_named_once(spark):
    jobs = spark.createDataFrame([(n,) for n in range(1, 7)], "job_id int")
    logs = spark.createDataFrame([(1, 200, 7, None), (2, 200, 7, None), (3, 200, 8, None), (4, 200, 7, "timeout"), (5, 404, 7, None)],
                                 "job_id int, fetch_status int, text_id long, fetch_error string")
    texts = spark.createDataFrame([(7, "seven"), (8, None)], "text_id long, content string")
    got = {r.job_id: r.log for r in pl.attach_logs(jobs, logs, texts).collect()}
    gone = {n: f"[Log not available for job {n}]" for n in (3, 5, 6)}
    assert got == {1: "seven", 2: "seven", 4: "[Error fetching log: timeout]", **gone}
    whole = logs.join(texts, "text_id", "left").drop("text_id").withColumn("fetch_status", F.when(F.col("content").isNull(), 404).otherwise(F.col("fetch_status")))
    assert got == {r.job_id: r.log for r in pl.attach_logs(jobs, whole).collect()}


def test_log_tree_stores_a_text_once(spark, tmp_path):
    tree, keys = str(tmp_path / "tree"), "source string, project_dir string, job_id int"
    logs = spark.createDataFrame([("gitlab", "p1", 1, 7), ("gitlab", "p1", 2, 7), ("gitlab", "p2", 3, 7), ("gitlab", "p2", 4, 8), ("gitlab", "p2", 5, 9)],
                                 f"{keys}, text_id int")
    texts = spark.createDataFrame([(7, "x"), (8, "x"), (9, None), (10, "unused")], "text_id int, content string")
    sinks.log_tree(logs, tree, texts)
    back = sinks.read_log_tree(spark, tree, keys)
    assert sorted((r.project_dir, r.job_id, r.content) for r in back.collect()) == [("p1", 1, "x"), ("p1", 2, "x"), ("p2", 3, "x"), ("p2", 4, "x"), ("p2", 5, None)]
    sinks.log_tree(logs.filter("job_id in (3, 4)"), tree, texts.withColumn("content", F.when(F.col("text_id") == 7, "y").otherwise(F.col("content"))))
    back = sinks.read_log_tree(spark, tree, keys)
    assert sorted((r.project_dir, r.job_id, r.content) for r in back.collect()) == [("p1", 1, "x"), ("p1", 2, "x"), ("p2", 3, "y"), ("p2", 4, "x")]
    assert sorted(r.content for r in spark.read.parquet(f"{tree}/_texts").collect()) == ["x", "y"]


def test_first_name_that_holds_a_text(spark):
    rows = [(1, ["anna b", "anna.b"]), (2, ["joanna", "joanna"]), (3, ["", "x" * 40]), (4, ["bob", ""]), (None, ["zed", "zed"])]
    wanted = ["anna", "anna", "a", "b", "joanna", "joannas", ".b", "", None, "x" * 40, "x" * 41, "zed"]
    texts = spark.createDataFrame(rows, "pos int, texts array<string>")
    needles = spark.createDataFrame([(w,) for w in wanted], "needle string")
    got = {r.needle: r.pos for r in postings.first_containing(needles, texts).collect()}
    places = {w: [p for p, names in rows if any(w in n for n in names)] for w in wanted if w}
    assert got == {w: min((p for p in held if p is not None), default=None) for w, held in places.items() if held}
    assert postings.first_containing(needles, texts.limit(0)).count() == 0


def test_tree_is_listed_and_read_in_tasks(spark, tmp_path):
    kept = {"a/metadata.json": '{"pipeline_id": 1,\n "status": "ok"}', "b/c/metadata.json": '[{"pipeline_id": 2}, {"pipeline_id": 3}]',
            "d=1/_x=2/metadata.json": '{"pipeline_id": 4}', "bad/metadata.json": '{"pipeline_id": 9, "sta', "bad2/metadata.json": '{"pipeline_id": "nine"}'}
    left = {"a/notes.json": '{"pipeline_id": 9}', "_tmp/metadata.json": '{"pipeline_id": 9}', ".h/metadata.json": '{"pipeline_id": 9}', "e/metadata.json": ""}
    for name, body in {**kept, **left}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    listed = {r.path.split(str(tmp_path))[1][1:]: r.size for r in fl.list_files(spark, str(tmp_path), "metadata.json").collect()}
    assert listed == {name: len(body) for name, body in kept.items()}
    old = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path))
    seen = old.select("path", F.col("length").alias("size"), F.col("modificationTime").cast("timestamp_ntz").alias("mtime")).filter("size > 0")
    assert sorted(lg.list_artefacts(spark, str(tmp_path)).collect()) == sorted(seen.collect())
    assert sorted(r.pipeline_id for r in lg.read_metadata_json(spark, str(tmp_path)).collect()) == [1, 2, 3, 4]


def test_lines_of_files_in_ranges(spark, tmp_path):
    bodies = {"a": b"one\ntwo\r\n\nfour", "b": b"\n\n\n", "c": b"x", "d": b"\xef\xbb\xbfmark\nnext\n", "e": b"long line of text\n" * 9}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    files = fl.list_files(spark, str(tmp_path)).select("path", "size")
    want = []
    for name, body in bodies.items():
        lines = body.removeprefix(b"\xef\xbb\xbf").decode().split("\n")
        want += [(name, n, line) for n, line in enumerate(lines if lines[-1] else lines[:-1])]
    for size in (1, 2, 3, 5, 7, 64, 1 << 20):
        got = [(r.path.rsplit("/", 1)[1], r.line_no, r.raw) for r in fl.read_text_lines(files, size).collect()]
        assert sorted(got) == sorted(want), size


def test_lines_become_files_in_order(spark, tmp_path):
    rows = [(f"f{n % 3}/x.log", n, f"line {n}" if n % 4 else None) for n in range(50)]
    lines = spark.createDataFrame(rows, "path string, line_no int, raw string")
    written = {r.path: r.lines for r in fl.write_line_files(lines, str(tmp_path)).collect()}
    assert written == {f"{tmp_path}/f{k}/x.log": len(range(k, 50, 3)) for k in range(3)}
    for k in range(3):
        assert (tmp_path / f"f{k}/x.log").read_text() == "".join(f"{raw or ''}\n" for p, _, raw in rows if p.startswith(f"f{k}"))


def test_context_of_a_log_line_is_cut_once(spark):
    raw = "2024-01-01 00:00:00.000 | INFO | m | r1 | done | more | a=1 b=2 a=3"
    records = lg.app_log(spark.createDataFrame([(1, 0, raw)], "file int, line_no long, raw string"))
    assert lg.slowest_steps(records.withColumn("ctx", F.create_map(F.lit("processing_time"), F.col("ctx")["a"]))).first().processing_time == 3.0
    plan = lg.slowest_steps(records)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(raw") == 1 and plan.count("(?=") == 1


def test_texts_of_failures_come_last(spark, tmp_path):
    pipelines = spark.createDataFrame([(1, "u1", "g/r", "main", "a" * 40, "push", "ann", None)],
                                      "pipeline_id int, pipeline_url string, project_name string, ref string, sha string, source string, username string, user_full_name string")
    jobs = spark.createDataFrame([(1, 2, "j2", "build", "failed", 7), (1, 1, "j1", "lint", "success", 7), (1, 3, "j3", None, None, 8), (2, 1, "k", "x", "failed", 7)],
                                 "pipeline_id int, job_order int, job_id string, name string, status string, log_id int")
    failures = pl.build_failures_gitlab(pipelines, jobs, spark.createDataFrame([(7, "boom")], "log_id int, text string"), numbered=True)
    got = [(r.pipeline_id, r.job_no, r.job_id, r.job_name, r.failed, r.error_lines) for r in failures.orderBy("job_order").collect()]
    assert got == [("u1", 1, "j1", "lint", False, []), ("u1", 2, "j2", "build", True, ["boom"]), ("u1", 3, "j3", "unknown", False, [])]
    out = sinks.failures_json(failures, str(tmp_path / "out"), "job_no")
    names = [p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("part-")]
    assert names and all(n.endswith(".json.gz") for n in names)
    assert sorted(spark.read.schema(failures.schema).json(out).collect()) == sorted(failures.collect())


def test_stream_files_grow_in_number(spark, monkeypatch):
    monkeypatch.setattr(sq, "ROWS_PER_FILE", 10)
    for rows, files in ((40, 4), (400, 40)):
        source = sq._stream(spark, spark.range(rows), "grown", 4)
        assert source.isStreaming
        assert len([f for f in os.listdir(shared._written[spark.sparkContext.applicationId][-1]) if f.startswith("part-")]) == files


def _look_ups(spark):
    p = {"sourceNamespace": "g", "gitlabSourceRepoName": "r"}
    rows = [
        (1, "ann", p), (2, None, {**p, "gitlabMergeRequestLastCommit": "c1"}), (2, None, {**p, "gitlabMergeRequestIid": "5"}), (None, "", {**p, "gitlabSourceBranch": "b"}),
        (4, None, {"gitlabSourceRepoName": "q"}), (5, None, {**p, "gitlabMergeRequestLastCommit": "unknown"}), (6, None, {}), (7, None, None),
    ]
    builds = spark.createDataFrame([(k, u, m, f"job{k}", f"url{k}") for k, u, m in rows],
                                   "build_id int, user_id string, parameters map<string, string>, job_name string, build_url string")
    return builds, (
        spark.createDataFrame([("g", "r", 9)], "namespace string, repo string, project_id bigint"),
        spark.createDataFrame([(9, 5, "mia"), (9, 5, "moe"), (None, 5, "x")], "project_id bigint, iid bigint, username string"),
        spark.createDataFrame([(9, "c1", "cy@x", "C"), (9, "c1", None, None), (9, "c3", "hd@x", None), (9, None, "no@x", None)],
                              "project_id bigint, sha string, author_email string, author_name string"),
        spark.createDataFrame([(9, "b", "c3"), (None, "b", "c3")], "project_id bigint, name string, head_sha string"),
    )


def test_builds_of_failures_travel_without_parameters(spark):
    builds, tables = _look_ups(spark)
    own = builds.select("*", F.lit("kept").alias("sha"), F.lit("own").alias("namespace"))
    users = sorted((r.build_id or 0, r.triggered_by[:-13], r.sha, r.namespace) for r in pl.resolve_trigger_user(own, *tables).collect())
    assert users == [(k, u, "kept", "own") for k, u in
                     [(0, "hd"), (1, "ann"), (2, "cy"), (2, "jenkins"), (2, "mia"), (2, "moe"), (4, "jenkins"), (5, "jenkins"), (6, "jenkins"), (7, "jenkins")]]
    stages = spark.createDataFrame([(2, 1, "s", "FAILED", ""), (2, 2, None, "ERROR", "x"), (4, 1, "t", "FAILED", "boom"), (4, 2, "ok", "SUCCESS", "y"), (None, 1, "z", "FAILED", "z")],
                                   "build_id int, stage_pos int, name string, status string, log_content string")
    headed = pl.resolve_trigger_user(pl.jenkins_headers(builds), *tables).drop("parameters")
    found = pl.build_failures_jenkins(headed, stages)
    assert sorted(map(str, found.collect())) == sorted(map(str, pl.build_failures_jenkins(pl.resolve_trigger_user(builds, *tables), stages).collect()))
    steps = {(r.pipeline_id, r.repo, r.commit, r.stage_pos, r.step_name, str(r.error_lines)) for r in found.filter("job_name in ('job1', 'job4')").collect()}
    assert steps == {("url1", "r", "unknown", None, None, "None"), ("url4", "q", "unknown", 1, "t", "['boom']")}
    assert found.filter("pipeline_id = 'url2' and step_name = 's'").first().error_lines[0].startswith("Stage 's' failed")
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(old, ("false", "-1"), strict=True):
            spark.conf.set(k, v)
        big = [t.repartition(2) for t in tables]
        plan = pl.build_failures_jenkins(pl.resolve_trigger_user(pl.jenkins_headers(builds), *big).drop("parameters"), stages)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert "ReusedExchange [_key" in plan  # commits: for builds and for heads of branches


def test_jobs_are_read_without_a_copy(spark, tmp_path):
    line = "1L l_orderkey, 2L l_partkey, 3L l_suppkey, 1 l_linenumber, date'2024-01-02' l_shipdate, 'R' l_returnflag, 'F' l_linestatus, 1.0 l_quantity"
    spark.sql(f"select {line}").write.parquet(str(tmp_path / "lineitem.parquet"))
    job = views.jobs(spark, str(tmp_path)).first()
    assert (job.pipeline_id, job.job_id, job.status, job.log_id) == (1, "1-1-2-3-20240102", "failed", 2)
    assert not any("/jobs-" in path for path in shared._written.get(spark.sparkContext.applicationId, []))
