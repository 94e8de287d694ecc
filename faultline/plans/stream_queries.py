"""Queries that run a stream over the whole input and read back what it stored."""

from pyspark.sql import functions as F

from ..operators.requests import upsert_request_state
from ..operators.shared import new_path
from ..streaming import jobs
from . import knowledge_queries as kq
from . import sql_views as sv
from . import views
from .event_queries import _stamp
from .registry import query


ROWS_PER_FILE = 250_000


def _stream(spark, rows, name, files):
    """The rows as a stream: stored as files, `files` at least, more for more rows; half of them are read per micro-batch."""
    path = new_path(spark, name)
    files = max(files, rows.count() // ROWS_PER_FILE)
    rows.repartition(files).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(files // 2, 1)).parquet(path)


def _run(spark, start, source, name, **args):
    out = new_path(spark, f"{name}-out")
    start(source, out, new_path(spark, f"{name}-checkpoint"), **args).awaitTermination()
    return out


@query("stream_ingest", f"""with {sv.PIPELINES} select pipeline_id, project_id, pipeline_type, ref, sha, source, event_type,
  case when event_type <> 'Pipeline Hook' then 'ignored' when status in ('running', 'pending', 'created') then 'skipped' else 'queued' end as status from typed""")
def _(spark, sf):
    source = _stream(spark, views.all_deliveries(spark, sf), "deliveries", 4)
    return spark.read.parquet(_run(spark, jobs.start_ingest, source, "ingest"))


@query("stream_rejects", f"""with {sv.PIPELINES} select pipeline_id as pipeline_no, event_type as hook from typed where pipeline_id % 9 = 0""")
def _(spark, sf):
    source = _stream(spark, views.all_deliveries(spark, sf), "deliveries", 4)
    return spark.read.parquet(_run(spark, jobs.start_rejects, source, "rejects")).select("pipeline_no", "hook")


@query("stream_request_state", f"""with {sv.REQUESTS} select id, status, case when status <> 'processing' then processing_time end as processing_time,
  case when status <> 'processing' then success_count end as success_count, case when status <> 'processing' then error_count end as error_count,
  case when status <> 'processing' then error_message end as error_message from requests""")
def _(spark, sf):
    source = _stream(spark, views.request_updates(spark, sf), "changes", 4)
    changes = spark.read.parquet(_run(spark, jobs.start_request_changes, source, "changes"))
    queued = views.requests(spark, sf).withColumn("status", F.lit("queued"))
    return upsert_request_state(queued, changes).select(
        "id", "status", "processing_time", "success_count", "error_count", "error_message"
    )


@query("stream_status_timeline", f"""with {sv.REQUESTS} select strftime(date_trunc('hour', timestamp), '%Y-%m-%d %H:%M:%S') as time_bucket, status, count(*) as requests
  from requests group by 1, 2""")
def _(spark, sf):
    source = _stream(spark, views.requests(spark, sf).select("id", "timestamp", "status"), "requests", 4)
    out = _run(spark, jobs.start_status_timeline, source, "timeline")
    return _stamp(jobs.latest_counts(spark, out), "time_bucket")


@query("stream_ai_cache", f"with {kq._QUERIES}, {kq._CACHES} select * from ai")
def _(spark, sf):
    source = _stream(spark, kq._caches(spark, sf)[1], "cache-writes", 2)
    out = _run(spark, jobs.start_ai_cache, source, "cache")
    return jobs.valid_entries(spark, out, kq.AS_OF).select("error_hash", "fix_text")


@query("stream_review_state", f"with {kq._OUTCOMES} select error_id, seq, outcome, saved_fix from outcomes")
def _(spark, sf):
    # Spread at random: an error's events come in any order, over several files and micro-batches.
    source = _stream(spark, views.reviews(spark, sf).withColumn("error", F.lit(None).cast("string")), "reviews", 4)
    return spark.read.parquet(_run(spark, jobs.start_review, source, "review", records=views.review_records(spark, sf)))
