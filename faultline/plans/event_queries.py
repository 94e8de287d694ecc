"""Queries over pipeline events, jobs and the request history."""

from pyspark.sql import functions as F

from ..functions import text
from ..operators import events as ev
from ..operators import requests as rq
from ..operators.shared import new_path, settle
from . import sql_views as sv
from . import views
from .registry import query

AS_OF = "2024-01-30 12:00:00"
_P, _J, _R = f"with {sv.PIPELINES}", f"with {sv.PIPELINES}, {sv.JOBS}", f"with {sv.REQUESTS}"


def _typed(spark, sf):
    return ev.classify_pipeline_type(views.pipelines(spark, sf))


def _stamp(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return df


_TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"


@query("classify_pipeline_type", f"{_P} select pipeline_id, pipeline_type from typed")
def _(spark, sf):
    return _typed(spark, sf).select("pipeline_id", "pipeline_type")


@query("project_jobs", f"{_J} select pipeline_id, job_id, name, stage, status, duration, false as allow_failure from jobs")
def _(spark, sf):
    job = F.struct(
        F.col("job_id").alias("id"), "name", "stage", "status", F.lit(None).cast("string").alias("started_at"),
        F.lit(None).cast("string").alias("finished_at"), "duration", F.lit(None).cast("boolean").alias("allow_failure"),
        F.lit(None).cast("struct<id:bigint,description:string>").alias("runner"),
    )
    events = views.jobs(spark, sf).select("pipeline_id", F.array(job).alias("builds"))
    return ev.project_jobs(events).select("pipeline_id", "job_id", "name", "stage", "status", "duration", "allow_failure")


@query("filter_processable", f"{_P} select pipeline_id, status from pipelines where status not in ('running', 'pending', 'created')")
def _(spark, sf):
    return ev.filter_processable(views.pipelines(spark, sf)).select("pipeline_id", "status")


@query("filter_jobs_by_status", f"{_J} select pipeline_id, job_id, status from jobs where status in ('success', 'failed')")
def _(spark, sf):
    return ev.filter_jobs_by_status(views.jobs(spark, sf)).select("pipeline_id", "job_id", "status")


@query("filter_pipelines_to_save", f"""{_P} select pipeline_id, project_id, status from pipelines
  where status in ('failed', 'running') and project_id not in (select n_nationkey from nation where n_regionkey = 1)""")
def _(spark, sf):
    shut = views.table(spark, sf, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("project_id"))
    kept = ev.filter_pipelines_to_save(views.pipelines(spark, sf), ("failed", "running"), excluded=shut)
    return kept.select("pipeline_id", "project_id", "status")


@query("filter_job_logs", f"{_J} select pipeline_id, job_id, status from jobs where status in ('failed', 'skipped')")
def _(spark, sf):
    return ev.filter_job_logs(views.jobs(spark, sf), ("failed", "skipped")).select("pipeline_id", "job_id", "status")


@query("route_event", f"""{_P} select pipeline_id, case when event_type <> 'Pipeline Hook' then 'ignored'
  when status in ('running', 'pending', 'created') then 'skipped' else 'queued' end as request_status from pipelines""")
def _(spark, sf):
    return ev.route_event(views.pipelines(spark, sf)).select("pipeline_id", "request_status")


@query("drop_external_stage", f"{_P} select pipeline_id, array_to_string(stages, ',') as stages from pipelines where not list_contains(stages, 'external')")
def _(spark, sf):
    return ev.drop_external_stage(views.pipelines(spark, sf)).select("pipeline_id", F.array_join("stages", ",").alias("stages"))


@query("route_storage", f"""{_P} select pipeline_id, pipeline_id % 2 <> 0 or pipeline_id % 3 = 0
  or not coalesce(case when pipeline_id % 7 <> 0 then pipeline_id % 5 <> 0 end, false) as store_text from pipelines""")
def _(spark, sf):
    k = F.col("pipeline_id")
    ok = F.when(k % 7 != 0, k % 5 != 0)
    return ev.route_storage(views.pipelines(spark, sf), k % 2 == 0, k % 3 == 0, ok).select("pipeline_id", "store_text")


@query("filter_metadata_save", f"""{_P} select pipeline_id, project_id, project_name, pipeline_type, status, ref, sha, source,
  created_at, duration from typed where status = 'failed'""")
def _(spark, sf):
    return ev.filter_metadata_save(_typed(spark, sf), F.col("status") == "failed").drop("stages")


@query("pipeline_summary", f"""{_J}, per as (select pipeline_id, status, count(*) as n, min(pos) as first from jobs group by 1, 2),
  tot as (select pipeline_id, cast(sum(n) as bigint) as jobs, string_agg(n || ' ' || status, ', ' order by first) as job_counts from per group by 1)
  select t.pipeline_id, ref, pipeline_type, status, case when coalesce(duration, 0) = 0 then 'N/A'
    else (cast(duration as bigint) // 60) || 'm ' || (cast(duration as bigint) % 60) || 's' end as duration_text,
  coalesce(jobs, 0) as jobs, coalesce(job_counts, '') as job_counts from typed t left join tot using (pipeline_id)""")
def _(spark, sf):
    return ev.pipeline_summary(_typed(spark, sf), views.jobs(spark, sf), F.col("job_order"))


@query("format_duration", f"""{_P} select pipeline_id, case when coalesce(duration, 0) = 0 then 'N/A'
    else (cast(duration as bigint) // 60) || 'm ' || (cast(duration as bigint) % 60) || 's' end as duration_text from pipelines""")
def _(spark, sf):
    return views.pipelines(spark, sf).select("pipeline_id", text.format_duration(F.col("duration")).alias("duration_text"))


_WINDOW = f"timestamp > timestamp '{AS_OF}' - interval 72 hours"


@query("request_summary", f"""{_R} select 72 as time_period_hours, count(*) as total_requests,
  round(case when count(*) filter (status in ('completed', 'failed')) > 0 then 100.0 * count(*) filter (status = 'completed')
    / count(*) filter (status in ('completed', 'failed')) else 0 end, 2) as success_rate,
  round(coalesce(avg(processing_time), 0), 2) as avg_processing_time_seconds,
  cast(coalesce(sum(success_count + coalesce(error_count, 0)), 0) as bigint) as total_jobs_processed from requests where {_WINDOW}""")
def _(spark, sf):
    return rq.request_summary(views.requests(spark, sf), AS_OF, 72)


@query("requests_by_status", f"{_R} select status, count(*) as requests from requests where {_WINDOW} group by 1")
def _(spark, sf):
    return rq.requests_by_status(views.requests(spark, sf), AS_OF, 72)


@query("requests_by_type", f"{_R} select pipeline_type, count(*) as requests from requests where {_WINDOW} and pipeline_type is not null group by 1")
def _(spark, sf):
    return rq.requests_by_type(views.requests(spark, sf), AS_OF, 72)


@query("status_timeline", f"""{_R} select {_TS.format("date_trunc('hour', timestamp)")} as time_bucket, status, count(*) as requests
  from requests where {_WINDOW} group by 1, 2""")
def _(spark, sf):
    return _stamp(rq.status_timeline(views.requests(spark, sf), AS_OF, 72), "time_bucket")


@query("activity_health", f"""{_R} select count(*) as total_rows,
  count(*) filter (timestamp > timestamp '{AS_OF}' - interval 1 hour) as last_hour_rows from requests""")
def _(spark, sf):
    return rq.activity_health(views.requests(spark, sf), AS_OF)


@query("success_rate_by_project", f"""{_R} select json_extract_string(metadata, '$.project_name') as project_name, count(*) as total,
  count(*) filter (status = 'completed') as completed,
  round(100.0 * count(*) filter (status = 'completed') / count(*), 2) as success_rate from requests where {_WINDOW} group by 1""")
def _(spark, sf):
    return rq.success_rate_by_project(views.requests(spark, sf), AS_OF, 72)


@query("avg_time_by_type", f"""{_R} select pipeline_type, round(avg(processing_time), 6) as avg_duration, count(*) as requests
  from requests where status = 'completed' group by 1""")
def _(spark, sf):
    return rq.avg_time_by_type(views.requests(spark, sf)).withColumn("avg_duration", F.round("avg_duration", 6))


@query("latency_percentiles", f"""{_R} select round(avg(processing_time), 6) as avg_time, round(quantile_cont(processing_time, 0.5), 6) as median_time,
  round(quantile_cont(processing_time, 0.95), 6) as p95_time, round(quantile_cont(processing_time, 0.99), 6) as p99_time from requests where {_WINDOW}""")
def _(spark, sf):
    out = rq.latency_percentiles(views.requests(spark, sf), AS_OF, 72)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("latency_sketches", f"""{_R}, timed as (select processing_time, count(*) over () as n, sum(processing_time) over () as total from requests
    where processing_time is not null and date_trunc('hour', timestamp) > timestamp '{AS_OF}' - interval 72 hours and date_trunc('hour', timestamp) <= timestamp '{AS_OF}')
  select any_value(n) as requests, round(any_value(total / n), 6) as avg_time, true as median_close, true as p95_close, true as p99_close from timed""")
def _(spark, sf):
    """Percentiles from stored hourly sketches; each stands within 1 % of the ranks of the exact one."""
    requests = views.requests(spark, sf)
    sketches = settle(rq.latency_sketches(requests), "latency-sketches")
    found = settle(rq.sketched_percentiles(sketches, AS_OF, 72), "percentiles")
    hour, now = F.date_trunc("hour", "timestamp").cast("timestamp_ntz"), F.lit(AS_OF).cast("timestamp_ntz")
    timed = requests.filter((hour > now - F.expr("interval 72 hours")) & (hour <= now) & F.col("processing_time").isNotNull())

    def close(name, q):
        at = found.select(name).scalar()
        below, upto = F.count_if(F.col("processing_time") < at), F.count_if(F.col("processing_time") <= at)
        return ((below / F.count("*") <= q + 0.01) & (upto / F.count("*") >= q - 0.01)).alias(name.replace("_time", "_close"))

    checked = timed.agg(close("median_time", 0.5), close("p95_time", 0.95), close("p99_time", 0.99))
    return checked.withColumns({"requests": found.select("requests").scalar(), "avg_time": F.round(found.select("avg_time").scalar(), 6)})


@query("requests_per_minute", f"""{_R} select {_TS.format("date_trunc('minute', timestamp)")} as minute, count(*) as requests
  from requests group by 1 order by 1 desc limit 20""")
def _(spark, sf):
    return _stamp(rq.requests_per_minute(views.requests(spark, sf)), "minute")


@query("status_last_hour", f"""{_R} select status, count(*) as requests from requests
  where timestamp > timestamp '{AS_OF}' - interval 1 hour group by 1""")
def _(spark, sf):
    return rq.status_last_hour(views.requests(spark, sf), AS_OF)


_REQ_COLS = f"""id, {_TS.format('timestamp')} as timestamp, project_id, pipeline_id, pipeline_type, status, ref, sha, source,
  event_type, client_ip, processing_time, job_count, success_count, error_count, error_message, metadata"""


@query("recent_requests", f"{_R} select {_REQ_COLS} from requests order by requests.timestamp desc, id desc limit 50")
def _(spark, sf):
    return _stamp(rq.recent_requests(views.requests(spark, sf)), "timestamp")


@query("pipeline_history", f"{_R} select {_REQ_COLS} from requests where pipeline_id = 7")
def _(spark, sf):
    return _stamp(rq.pipeline_history(views.requests(spark, sf), 7), "timestamp")


@query("failed_requests", f"""{_R} select id, pipeline_id, json_extract_string(metadata, '$.project_name') as project_name, error_message,
  {_TS.format('timestamp')} as timestamp from requests where status = 'failed' order by requests.timestamp desc, id desc limit 20""")
def _(spark, sf):
    return _stamp(rq.failed_requests(views.requests(spark, sf)), "timestamp")


@query("slow_requests", f"{_R} select {_REQ_COLS} from requests where processing_time > 30 order by processing_time desc, id limit 10")
def _(spark, sf):
    return _stamp(rq.slow_requests(views.requests(spark, sf)), "timestamp")


@query("upsert_request_state", f"""{_R} select id, status, case when status <> 'processing' then processing_time end as processing_time,
  case when status <> 'processing' then success_count end as success_count,
  case when status <> 'processing' then error_count end as error_count,
  case when status <> 'processing' then error_message end as error_message, ref from requests""")
def _(spark, sf):
    new = views.requests(spark, sf).withColumn("status", F.lit("queued"))
    out = rq.upsert_request_state(new, views.request_updates(spark, sf))
    return out.select("id", "status", "processing_time", "success_count", "error_count", "error_message", "ref")


@query("expire_stored_requests", f"""{_R} select id, {_TS.format('timestamp')} as timestamp, status from requests where timestamp >= timestamp '{AS_OF}' - interval 10 days""")
def _(spark, sf):
    path = new_path(spark, "requests-by-day")
    rq.store_requests(views.requests(spark, sf), path)
    rq.expire_stored(spark, path, AS_OF, 10)
    return _stamp(spark.read.parquet(path).select("id", "timestamp", "status"), "timestamp")


@query("expire_requests", f"""{_R} select count(*) filter (timestamp < timestamp '{AS_OF}' - interval 10 days) as deleted,
  count(*) filter (timestamp >= timestamp '{AS_OF}' - interval 10 days) as kept from requests""")
def _(spark, sf):
    return rq.expire_requests(views.requests(spark, sf), AS_OF, 10)
