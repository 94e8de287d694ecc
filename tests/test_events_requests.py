import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from faultline.operators import events as ev
from faultline.operators import requests as rq
from faultline.sources import events as se


def bodies(spark, *docs):
    return spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "no int, body string")


def test_gitlab_event_types_and_defaults(spark):
    base = {"object_kind": "pipeline", "project": {"id": 5, "name": "g/app"}}
    docs = [
        {**base, "object_attributes": {"id": 1, "source": "push", "created_at": "2024-01-01 10:00:00 UTC", "finished_at": "2024-01-01T10:05:00Z"}},
        {**base, "object_attributes": {"id": 2, "source": "parent_pipeline"}},
        {**base, "object_attributes": {"id": 3, "source": "push"}, "merge_request": {"iid": 4}},
        {**base, "object_attributes": {"id": 4, "source": "api"}, "merge_request": {}},
        {"builds": [{"id": 9, "name": "j", "status": "failed"}]},
    ]
    rows = se.gitlab_events(bodies(spark, *docs)).orderBy("no").collect()
    assert [r.pipeline_type for r in rows] == ["main", "child", "merge_request", "main", "unknown"]
    assert rows[0].created_at == dt.datetime(2024, 1, 1, 10) and rows[0].finished_at == dt.datetime(2024, 1, 1, 10, 5)
    last = rows[4]
    assert last.event_type == "unknown" and last.pipeline_id is None and last.stages == [] and last.variables == []
    job = ev.project_jobs(se.gitlab_events(bodies(spark, docs[4]))).first()
    assert (job.job_id, job.name, job.allow_failure, job.runner) == (9, "j", False, None)


def test_offsets_and_broken_bodies(spark):
    from faultline.functions.text import parse_moment

    stamps = ["2024-01-01T10:00:00+02:00", "2024-01-01 10:00:00.5 -0130", "2024-01-01T10:00:00Z", "2024-01-01 10:00:00 UTC", "2024-01-01", "soon", None]
    got = [r.m for r in spark.createDataFrame([(s,) for s in stamps], "s string").select(parse_moment(F.col("s")).alias("m")).collect()]
    ten = dt.datetime(2024, 1, 1, 10)
    assert got == [ten.replace(hour=8), dt.datetime(2024, 1, 1, 11, 30, 0, 500_000), ten, ten, dt.datetime(2024, 1, 1), None, None]
    rows = spark.createDataFrame([(1, '{"object_kind": "pipeline"}'), (2, "not json"), (3, None), (4, "{}")], "no int, body string")
    good, bad = se.readable(rows)
    assert sorted(r.no for r in good.collect()) == [1, 4] and sorted(r.no for r in bad.collect()) == [2, 3]
    assert sorted(r.no for r in se.gitlab_events(rows).collect()) == [1, 4]


def test_jenkins_layouts(spark):
    docs = [
        {"job_name": "j", "build_number": "7", "jenkins_url": "https://ci/"},
        {"job": {"name": "bob", "url": "https://jenkins.bob.example.com/job/bob"}, "build": {"number": 3, "status": "FAILURE"}},
        {"name": "n", "build": {"number": 4, "url": "u"}},
        {"name": "f", "number": 5},
        {"name": "f"},
        {"job_name": "j", "build_number": "x"},
    ]
    good, bad = se.jenkins_events(bodies(spark, *docs))
    rows = {r.no: r for r in good.collect()}
    assert {n: (r.layout, r.job_name, r.build_number) for n, r in rows.items()} == {
        0: ("custom", "j", 7), 1: ("generic", "bob", 3), 2: ("notification", "n", 4), 3: ("fallback", "f", 5),
    }
    assert rows[1].jenkins_url == "https://jenkins.bob.example.com" and rows[2].jenkins_url == "" and rows[0].status == "UNKNOWN"
    assert sorted(r.no for r in bad.collect()) == [4, 5]


def test_build_params_and_user(spark):
    doc = {"duration": 12, "result": None, "actions": [
        {}, {"_class": "hudson.model.CauseAction", "causes": [{"_class": "hudson.model.Cause$UserIdCause", "userId": "ann"}]},
        {"_class": "hudson.model.ParametersAction", "parameters": [{"name": "a", "value": "1"}, {"name": "b", "value": "2"}]},
        {"_class": "hudson.model.ParametersAction", "parameters": [{"name": "a", "value": "3"}]},
    ]}
    row = se.build_params(bodies(spark, doc).withColumn("status", F.lit("FAILURE"))).first()
    assert row.parameters == {"a": "3", "b": "2"} and row.result == "FAILURE" and row.user_id == "ann" and row.duration_ms == 12
    none = se.build_params(bodies(spark, {}).withColumn("status", F.lit("S"))).first()
    assert none.parameters == {} and none.user_id is None


def test_stage_meta(spark):
    doc = {"stages": [{"id": "1", "name": "A", "status": "FAILED", "durationMillis": 3, "stageFlowNodes": [{"name": "x"}]}, {"name": "B"}]}
    rows = se.stage_meta(bodies(spark, doc, {})).orderBy("stage_pos").collect()
    assert [(r.name, r.status, r.stage_id, len(r.nodes)) for r in rows] == [("A", "FAILED", "1", 1), ("B", "UNKNOWN", "", 0)]
    assert se.stage_nodes(se.stage_meta(bodies(spark, doc))).first().status == "UNKNOWN"


def test_filters(spark):
    jobs = spark.createDataFrame([(s,) for s in ("success", "failed", "canceled", "skipped", "manual", None)], "status string")
    assert {r.status for r in ev.filter_jobs_by_status(jobs).collect()} == {"success", "failed"}
    assert {r.status for r in ev.filter_jobs_by_status(jobs, success=False, skipped=True).collect()} == {"failed", "skipped"}
    assert ev.filter_job_logs(jobs).count() == 6
    assert {r.status for r in ev.filter_processable(jobs.withColumn("status", F.upper("status"))).collect()} >= {"SUCCESS", None}
    pipes = spark.createDataFrame([(1, "failed"), (2, "failed"), (3, "success")], "project_id int, status string")
    ids = lambda df: sorted(r.project_id for r in df.collect())
    assert ids(ev.filter_pipelines_to_save(pipes, ("failed",), projects=("2", "3"), excluded=("2",))) == [2]
    assert ids(ev.filter_pipelines_to_save(pipes, excluded=("2",))) == [1, 3]
    white = spark.createDataFrame([(1,), (1,)], "project_id int")
    assert ids(ev.filter_pipelines_to_save(pipes, projects=white)) == [1]


def test_pipeline_summary_text(spark):
    pipes = spark.createDataFrame(
        [(1, "main", "main", "failed", 225.0), (2, "x", "child", "success", 0.0)],
        "pipeline_id int, ref string, pipeline_type string, status string, duration double",
    )
    jobs = spark.createDataFrame([(1, 3, "success"), (1, 1, "failed"), (1, 2, "success")], "pipeline_id int, o int, status string")
    rows = {r.pipeline_id: r.summary for r in ev.summary_text(ev.pipeline_summary(pipes, jobs, F.col("o"))).collect()}
    assert rows[1] == "Pipeline #1 (main)\nType: main\nStatus: failed\nDuration: 3m 45s\nJobs: 3 total (1 failed, 2 success)"
    assert rows[2].endswith("Duration: N/A\nJobs: 0 total ()")


NOW = "2024-01-02 00:00:00"
REQUEST = "id int, timestamp timestamp_ntz, status string, pipeline_type string, processing_time double, success_count int, error_count int"


def history(spark, *rows):
    return spark.createDataFrame([(i, dt.datetime(2024, 1, 1, 12) + dt.timedelta(minutes=i), *r) for i, r in enumerate(rows)], REQUEST)


def test_request_summary(spark):
    rows = history(spark, ("completed", "main", 1.0, 2, None), ("completed", None, None, None, 3), ("failed", "main", 2.0, 1, 1), ("processing", "child", None, 0, 0))
    got = rq.request_summary(rows, NOW).first()
    assert (got.total_requests, got.success_rate, got.avg_processing_time_seconds, got.total_jobs_processed) == (4, 66.67, 1.5, 4)
    empty = rq.request_summary(rows.limit(0), NOW).first()
    assert (empty.total_requests, empty.success_rate, empty.avg_processing_time_seconds, empty.total_jobs_processed) == (0, 0, 0, 0)
    assert rq.recent_requests(rows, 3).count() == 3


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_latency_percentiles(spark, n):
    import numpy as np

    times = [round((i * 37 % 50) / 3 + 0.5, 3) for i in range(n)]
    rows = history(spark, *[("completed", "main", t, 0, 0) for t in times])
    got = rq.latency_percentiles(rows, NOW).first()
    want = [np.mean(times), *np.percentile(times, [50, 95, 99])]
    assert list(got) == pytest.approx(want)


def test_upsert_overwrites_with_nulls(spark):
    schema = "id int, status string, processing_time double, success_count int, error_count int, error_message string"
    new = spark.createDataFrame([(1, "queued", 1.0, 5, 5, "x"), (2, "queued", None, 1, None, None)], schema)
    changes = spark.createDataFrame([(1, "processing", 2.0, 1, 1, "y", 1), (1, "failed", None, None, 2, None, 2)], schema + ", event_seq int")
    rows = {r.id: tuple(r)[1:] for r in rq.upsert_request_state(new, changes).collect()}
    assert rows == {1: ("failed", None, None, 2, None), 2: ("queued", None, 1, None, None)}


def test_timeline_interval(spark):
    rows = history(spark, *[("completed", "main", 1.0, 0, 0)] * 40)
    assert [r.requests for r in rq.status_timeline(rows, NOW, 24, 30).collect()] == [30, 10]
    assert rq.expire_requests(rows, "2024-01-31 12:10:00", 30).first().deleted == 10
    assert rq.keep_after_expiry(rows, "2024-01-31 12:10:00", 30).count() == 30
