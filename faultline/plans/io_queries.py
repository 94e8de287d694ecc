"""Queries for sources, sinks, the stored tree and the service's own logs."""

from pyspark.sql import functions as F

from ..operators import knowledge as kn
from ..operators import sections as sec
from ..operators.shared import new_path, settle
from ..sources import events as se
from ..sources import files as fl
from ..sources import logs as lg
from ..sources import sinks
from . import line_queries as lq
from . import payload_queries as pq
from . import sql_views as sv
from . import views
from .event_queries import AS_OF, _stamp
from .registry import query

_TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"


@query("src_gitlab_events", f"""with {sv.PIPELINES} select pipeline_id as pipeline_no,
  case when pipeline_id % 4 <> 0 then 'pipeline' else 'unknown' end as event_type, pipeline_id, pipeline_url, project_id, project_name,
  pipeline_type, status, ref, sha, source, created_at, duration, username, user_full_name, array_to_string(stages, ',') as stages,
  0 as variables, 'compile ' || status as builds from typed""")
def _(spark, sf):
    out = se.gitlab_events(views.all_deliveries(spark, sf).drop("hook"))
    return _stamp(out, "created_at").select(
        "pipeline_no", "event_type", "pipeline_id", "pipeline_url", "project_id", "project_name", "pipeline_type", "status",
        "ref", "sha", "source", "created_at", "duration", F.col("user.username").alias("username"),
        F.col("user.name").alias("user_full_name"), F.array_join("stages", ",").alias("stages"),
        F.size("variables").alias("variables"),
        F.array_join(F.transform("builds", lambda b: F.concat(b["name"], F.lit(" "), b["status"])), ",").alias("builds"),
    )


@query("src_jenkins_events", """with e as (select o_orderkey as event_no, o_orderkey % 5 as m, 'job-' || (o_custkey % 40) as name from orders)
  select event_no, case when m = 4 then 'rejected' else ['custom', 'generic', 'notification', 'fallback'][m + 1] end as layout,
  case when m < 4 then name end as job_name, case when m < 4 then event_no end as build_number,
  case when m in (1, 2) then 'u' || event_no when m < 4 then '' end as build_url,
  case when m in (1, 2) and event_no % 2 = 0 then 'FAILURE' when m < 4 then 'UNKNOWN' end as status,
  case m when 0 then 'https://ci.example.com/' when 1 then 'https://bob.example.com' when 2 then '' when 3 then '' end as jenkins_url,
  case when m = 0 then 't1' end as timestamp from e""")
def _(spark, sf):
    good, bad = se.jenkins_events(views.jenkins_payloads(spark, sf))
    rejected = bad.select("event_no", F.lit("rejected").alias("layout"))
    return good.unionByName(rejected, allowMissingColumns=True)


_STAGE_CTES = """stage_numbers as (select distinct log_id, line_no // 20 as n from numbered)"""


@query("src_stage_meta", f"""with {sv.LOG_LINES}, {_STAGE_CTES} select log_id, n as stage_no, cast(n as varchar) as stage_id, 'S' || n as name,
  case when (log_id + n) % 3 = 0 then 'FAILED' else 'SUCCESS' end as status, n * 100 as duration_ms,
  'B' || n || '=' || case when (log_id + n) % 2 = 0 then 'FAILED' else 'SUCCESS' end ||
  case when (log_id + n) % 2 = 0 then ',B' || n || 'x=' || case when (log_id + n) % 3 = 0 then 'SUCCESS' else 'FAILED' end else '' end as nodes
  from stage_numbers""")
def _(spark, sf):
    payloads = views.stage_payloads(spark, sf).withColumnRenamed("stage_pos", "stage_no")
    out = se.stage_meta(payloads)
    nodes = F.array_join(F.transform("nodes", lambda n: F.concat(n["name"], F.lit("="), n["status"])), ",")
    return out.select("log_id", "stage_no", "stage_id", "name", "status", "duration_ms", nodes.alias("nodes"))


@query("src_build_params", """select o_orderkey as build_id, 'b' || o_custkey as branch, 'r' || o_custkey as repo, 2 as parameters,
  case when o_orderkey % 2 = 0 then o_orderkey * 5 else 0 end as duration_ms, o_orderkey + 1000 as started,
  case when o_orderkey % 4 <> 0 then 'FAILURE' else 'UNKNOWN' end as result, case when o_orderkey % 3 <> 0 then 'user' || o_custkey end as user_id from orders""")
def _(spark, sf):
    out = se.build_params(views.build_payloads(spark, sf))
    p = F.col("parameters")
    return out.select("build_id", p["branch"].alias("branch"), p["repo"].alias("repo"), F.size(p).alias("parameters"),
                      "duration_ms", "started", "result", "user_id")


_ENTRIES = """entries as (select doc_id, text as error_text, case when toxic = 1 then null else 'fix ' || doc_id end as fix_text,
  case doc_id % 3 when 0 then 'ann' when 1 then 'ben' end as approver, 'manual' as status, quality, toxic
  from labels join documents using (doc_id))"""


@query("src_fix_import", f"""with {_ENTRIES} select doc_id, error_text, fix_text, approver, status, 'manual_api_bulk' as source, 'manual' as ingestion_mode,
  cast(quality as varchar) as quality, case when toxic = 1 then 'skipped' else 'ready' end as outcome from entries""")
def _(spark, sf):
    out = kn.fix_entries(se.fix_import_json(views.fix_files(spark, sf)))
    m = F.col("metadata")
    return out.select("doc_id", "error_text", "fix_text", "approver", "status", m["source"].alias("source"),
                      m["ingestion_mode"].alias("ingestion_mode"), m["quality"].alias("quality"), "outcome")


@query("src_fix_import_csv", """select doc_id, text as error_text, case when doc_id % 5 <> 0 then 'fix, "' || doc_id || '"' end as fix_text, case when doc_id % 3 = 0 then 'ann' end as approver,
  'manual' as status, 'manual_api_bulk' as source, lang, case when doc_id % 5 = 0 then 'skipped' else 'ready' end as outcome from documents where length(trim(text)) > 0""")
def _(spark, sf):
    d = F.col("doc_id")
    rows = views.table(spark, sf, "documents").filter(F.length(F.trim("text")) > 0).select(
        d.cast("string").alias("doc_id"), F.col("text").alias("error"),
        F.when(d % 5 != 0, F.concat(F.lit('fix, "'), d.cast("string"), F.lit('"'))).alias("fix"), F.when(d % 3 == 0, "ann").alias("approved_by"), "lang",
    )
    path = new_path(spark, "fixes-csv")
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)
    out, m = kn.fix_entries(se.fix_import_csv(spark, path)), F.col("metadata")
    return out.select(m["doc_id"].cast("bigint").alias("doc_id"), "error_text", "fix_text", "approver", "status", m["source"].alias("source"), m["lang"].alias("lang"), "outcome")


@query("import_outcomes", f"""with {_ENTRIES} select count(*) as total, count(*) filter (toxic <> 1 and doc_id % 7 <> 0) as imported,
  count(*) filter (toxic <> 1 and doc_id % 7 = 0) as failed, count(*) filter (toxic = 1) as skipped from entries""")
def _(spark, sf):
    return kn.import_outcomes(kn.fix_entries(se.fix_import_json(views.fix_files(spark, sf))), F.col("doc_id") % 7 != 0)


@query("src_domain_patterns", """select item_id, case when item_id % 2 = 0 then 'IT' else 'Devops' end as category, text as failure,
  case when item_id % 3 <> 0 then 'see ' || item_id else '' end as solution from benchmark where item_id % 7 <> 0""")
def _(spark, sf):
    return se.domain_patterns(views.domain_files(spark, sf))


@query("src_ci_instances", "select 'https://ci' || n_nationkey || '.example.com' as jenkins_url, 'bot' || n_nationkey as jenkins_user, n_name as description from nation")
def _(spark, sf):
    return se.ci_instances(views.registry_files(spark, sf))


_APP = """app as (select user_id as file, row_number() over (partition by user_id order by ts, event_id) - 1 as line_no, event_id, user_id,
    event_id % 9 <> 4 as is_record, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') as ts, case event_type when 'error' then 'ERROR' when 'signup' then 'WARN' else 'INFO' end as level,
    'src.mod' || (event_id % 7) as logger, 'r' || (event_id % 97) as request_id,
    'message ' || event_id || case when event_id % 4 = 0 then ' | more' else '' end as message, event_id % 5 <> 0 as has_ctx from events),
owned as (select *, max(case when is_record then line_no end) over (partition by file order by line_no) as record_line from app),
records as (select a.* exclude (record_line), line_no as record_line, coalesce(t.n, 0) as trace_lines from owned a
  left join (select file, record_line, count(*) as n from owned where not is_record group by 1, 2) t on t.file = a.file and t.record_line = a.line_no where is_record)"""


def _app(spark, sf):
    return lg.app_log(views.app_log_lines(spark, sf))


def _ms(df):
    return df.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"))


@query("src_app_log", f"""with {_APP} select file, record_line, ts, level, logger, request_id, message, trace_lines,
  case when has_ctx then cast(user_id % 50 as varchar) end as pipeline_id, case when has_ctx then 'Pipeline Hook' end as event_type,
  case when has_ctx then cast(event_id % 400 as varchar) end as processing_time from records""")
def _(spark, sf):
    c = F.col("ctx")
    return _ms(_app(spark, sf)).select(
        "file", "record_line", "ts", "level", "logger", "request_id", "message", "trace_lines", c["pipeline_id"].alias("pipeline_id"),
        c["event_type"].alias("event_type"), c["processing_time"].alias("processing_time"),
    )


@query("src_app_log_files", f"""with {_APP} select file, record_line, ts, level, logger, request_id, message, trace_lines from records""")
def _(spark, sf):
    path = new_path(spark, "app-log")
    # One file per user; its lines in order.
    named = views.app_log_lines(spark, sf).withColumn("path", F.concat(F.lit("file="), F.col("file").cast("string"), F.lit("/app.log")))
    settle(fl.write_line_files(named, path), "written")
    read = lg.read_lines(spark, path, recursiveFileLookup=True)
    # Stored, so that the files are opened once for the records and their traces.
    lines = settle(read.withColumn("file", F.regexp_extract("file", r"file=(\d+)/", 1).cast("bigint")), "app-log-lines")
    return _ms(lg.app_log(lines)).select("file", "record_line", "ts", "level", "logger", "request_id", "message", "trace_lines")


@query("app_log_traces", f"""with {_APP} select file, record_line, line_no, '  File "x.py", line ' || event_id as raw from owned where not is_record and record_line is not null""")
def _(spark, sf):
    return lg.app_log_traces(views.app_log_lines(spark, sf))


@query("search_app_log", f"""with {_APP} select file, record_line, message from records where level in ('ERROR', 'WARN') and has_ctx
  and user_id % 10 = 3 and ts >= '2024-01-05 00:00:00.000' and ts <= '2024-01-25 00:00:00.000'""")
def _(spark, sf):
    hits = lg.search_app_log(_app(spark, sf), levels=("ERROR", "WARN"), contains={"project_name": "p3"},
                             start="2024-01-05 00:00:00", end="2024-01-25 00:00:00")
    return hits.select("file", "record_line", "message")


@query("search_stored_log", f"""with {_APP} select request_id, ts, file, record_line, level, logger, message,
  date_diff('millisecond', lag(strptime(ts, '%Y-%m-%d %H:%M:%S.%g')) over (partition by request_id order by ts, file, record_line), strptime(ts, '%Y-%m-%d %H:%M:%S.%g')) as step_ms
  from records where request_id = 'r5' and ts >= '2024-01-05 06:00:00.000' and ts <= '2024-01-25 18:00:00.000'""")
def _(spark, sf):
    """The trace of one request id over some days of a stored log."""
    path = new_path(spark, "app-log-by-day")
    lg.store_app_log(_app(spark, sf), path)
    hits = lg.search_stored_log(spark, path, "2024-01-05 06:00:00", "2024-01-25 18:00:00", request_id="r5")
    return _ms(lg.request_trace(hits))


@query("errors_by_module", f"with {_APP} select logger, count(*) as errors from records where level = 'ERROR' group by 1")
def _(spark, sf):
    return lg.errors_by_module(_app(spark, sf))


@query("daily_project_requests", f"with {_APP} select count(*) as lines from records where has_ctx and user_id % 10 = 3 and ts like '2024-01-10%'")
def _(spark, sf):
    return lg.daily_project_requests(_app(spark, sf), "p3", "2024-01-10")


@query("slowest_steps", f"""with {_APP} select file, record_line, request_id, message, cast(event_id % 400 as double) as processing_time from records where has_ctx
  order by event_id % 400 desc, file, record_line limit 20""")
def _(spark, sf):
    return lg.slowest_steps(_app(spark, sf))


@query("request_trace", f"""with {_APP} select request_id, ts, file, record_line, level, logger, message,
  date_diff('millisecond', lag(strptime(ts, '%Y-%m-%d %H:%M:%S.%g')) over (partition by request_id order by ts, file, record_line), strptime(ts, '%Y-%m-%d %H:%M:%S.%g')) as step_ms from records""")
def _(spark, sf):
    return _ms(lg.request_trace(_app(spark, sf)))


@query("src_api_log", """select strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as ts, o_orderkey as pipeline_id, o_custkey % 25 as project_id,
  'http://collector.example.com/api/analyze' as url, case when o_orderkey % 6 = 0 then 'ERROR' else '200' end as status, o_orderkey % 3000 as duration_ms,
  case when o_orderkey % 6 = 0 then 'read timed out ' || o_orderkey end as error, '{"n": ' || o_orderkey || '}' as response from orders where o_orderkey % 50 <> 0""")
def _(spark, sf):
    return _stamp(lg.api_calls(views.api_log_lines(spark, sf)), "ts")


_LISTING = """listing as (select case when l_linenumber < 5 then '/data/NATION_' || (l_orderkey % 25) || '_' || (l_orderkey % 25) || '/pipeline_' || l_orderkey || '/job_' ||
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) || '_job_' || l_linenumber || '.log'
  when l_linenumber = 5 then '/data/jenkins-builds/job' || (l_partkey % 40) || '/' || l_orderkey || '/stage_S' || l_suppkey || '.log'
  when l_linenumber = 6 then '/data/jenkins-builds/job' || (l_partkey % 40) || '/' || l_orderkey || '/console.log'
  else '/data/NATION_1_1/pipeline_' || l_orderkey || '/metadata.json' end as path, cast(floor(l_extendedprice) as bigint) as size, l_shipdate as mtime, * from lineitem)"""


@query("log_path_keys", f"""with {_LISTING} select path, case when l_linenumber < 5 then 'gitlab' when l_linenumber < 7 then 'jenkins' end as source,
  case when l_linenumber < 5 then 'NATION_' || (l_orderkey % 25) || '_' || (l_orderkey % 25) end as project_dir,
  case when l_linenumber < 5 then l_orderkey % 25 end as project_id, case when l_linenumber < 5 then l_orderkey end as pipeline_id,
  case when l_linenumber < 5 then concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) end as job_id,
  case when l_linenumber < 5 then 'job_' || l_linenumber when l_linenumber < 7 then 'job' || (l_partkey % 40) end as job_name,
  case when l_linenumber in (5, 6) then l_orderkey end as build_number, case when l_linenumber = 5 then 'S' || l_suppkey end as stage from listing""")
def _(spark, sf):
    return lg.path_keys(views.listing(spark, sf)).drop("size", "mtime")


_STORED = """stored as (select doc_id, text, case doc_id % 3 when 0 then 'gitlab' else 'jenkins' end as source,
  case when doc_id % 3 = 0 then 'team_' || (doc_id % 7) || '_' || (doc_id % 25) end as project_dir, case when doc_id % 3 = 0 then doc_id % 25 end as project_id,
  case when doc_id % 3 = 0 then doc_id // 10 end as pipeline_id, case when doc_id % 3 = 0 then cast(doc_id as varchar) end as job_id,
  case when doc_id % 3 = 0 then 'unit tests_' || (doc_id % 4) else 'job' || (doc_id % 40) end as job_name,
  case when doc_id % 3 <> 0 then doc_id end as build_number, case when doc_id % 3 = 1 then 'S' || (doc_id % 9) end as stage from documents)"""


def _log_files(spark, sf):
    """Every document as a stored log of its own: the folder and the listing of the files."""
    d = F.col("doc_id")
    s = d.cast("string")
    job = F.concat(F.lit("team_"), (d % 7).cast("string"), F.lit("_"), (d % 25).cast("string"), F.lit("/pipeline_"), F.floor(d / 10).cast("string"),
                   F.lit("/job_"), s, F.lit("_unit tests_"), (d % 4).cast("string"), F.lit(".log"))
    build = F.concat(F.lit("jenkins-builds/job"), (d % 40).cast("string"), F.lit("/"), s)
    stage = F.concat(build, F.lit("/stage_S"), (d % 9).cast("string"), F.lit(".log"))
    path = F.when(d % 3 == 0, job).when(d % 3 == 1, stage).otherwise(F.concat(build, F.lit("/console.log")))
    root = new_path(spark, "logs")
    written = settle(fl.write_files(views.table(spark, sf, "documents").select(path.alias("path"), F.col("text").alias("content")), root), "written")
    return root, written


_KEYS = ["source", "project_dir", "project_id", "pipeline_id", "job_id", "job_name", "build_number", "stage"]


@query("src_log_store", f"with {_STORED} select * exclude (doc_id, text), length(text) as chars, md5(text) as digest from stored")
def _(spark, sf):
    return lg.read_log_store(spark, _log_files(spark, sf)[0]).select(*_KEYS, F.length("content").alias("chars"), F.md5("content").alias("digest"))


@query("src_log_lines", f"""with {_STORED}, parts as (select *, string_split(text, chr(10)) as p from stored where length(text) > 0),
  kept as (select *, case when p[-1] = '' then p[:-2] else p end as q from parts)
  select * exclude (doc_id, text, p, q), unnest(range(len(q))) as line_no, unnest(q) as raw from kept""")
def _(spark, sf):
    return lg.read_log_lines(spark, _log_files(spark, sf)[0]).select(*_KEYS, "line_no", "raw")


def _ends(spark, sf, cut):
    """Doc id and what one end of its file gave; the listing comes from the folder."""
    files = lg.path_keys(cut(lg.list_artefacts(spark, _log_files(spark, sf)[0]).drop("mtime")))
    return files.withColumn("log_id", F.coalesce(F.col("job_id").cast("bigint"), "build_number"))


@query("file_tail_bytes", """select doc_id as log_id, right(hex(encode(text)), 1200) as tail_hex, greatest(octet_length(encode(text)) - 600, 0) as start,
  least(octet_length(encode(text)), 600) as bytes_read from documents""")
def _(spark, sf):
    return _ends(spark, sf, lambda f: fl.file_tail_bytes(f, 4)).select("log_id", F.hex("content").alias("tail_hex"), "start", "bytes_read")


@query("file_tail_lines", """select doc_id as log_id, case when len(string_split(text, chr(10))) > 5
  then array_to_string(string_split(text, chr(10))[-5:], chr(10)) else text end as content from documents""")
def _(spark, sf):
    return _ends(spark, sf, lambda f: fl.file_tail_lines(f, 5)).select("log_id", "content")


@query("file_head_cap", """select doc_id as log_id, array_to_string(string_split(text, chr(10))[:10], chr(10)) as content,
  len(string_split(text, chr(10))) >= 10 as truncated, least(len(string_split(text, chr(10))), 10) as total_lines from documents""")
def _(spark, sf):
    return _ends(spark, sf, lambda f: fl.file_head_cap(f, 10)).select("log_id", "content", "truncated", "total_lines")


@query("file_hybrid_log", lq.HYBRID_SQL)
def _(spark, sf):
    out = _ends(spark, sf, lambda f: fl.file_hybrid_log(f, 3, 20, lq.HYBRID_PATTERNS, ("$$$",)))
    return out.select("log_id", "content", "method", "truncated", "total_lines")


@query("storage_stats", f"""with {_LISTING} select count(distinct l_orderkey % 25) filter (l_linenumber < 5) as projects,
  count(distinct l_orderkey) filter (l_linenumber < 5) as pipelines, count(distinct l_partkey % 40) filter (l_linenumber in (5, 6)) as build_jobs,
  count(distinct (l_partkey % 40, l_orderkey)) filter (l_linenumber in (5, 6)) as builds, count(*) filter (l_linenumber < 7) as log_files,
  cast(sum(size) filter (l_linenumber < 7) as bigint) as total_bytes, round(sum(size) filter (l_linenumber < 7) / 1048576.0, 2) as total_mb from listing""")
def _(spark, sf):
    return lg.storage_stats(views.listing(spark, sf))


@query("largest_logs", f"with {_LISTING} select path, size, {_TS.format('mtime')} as mtime from listing where path like '%.log' order by size desc, path limit 20")
def _(spark, sf):
    return _stamp(lg.largest_logs(views.listing(spark, sf)), "mtime")


@query("list_pipelines", f"""with {sv.PIPELINES}, {sv.JOBS} select project_id, p.pipeline_id, p.status, ref, created_at, count(j.job_id) as job_count
  from pipelines p left join jobs j using (pipeline_id) where project_id = 7 group by all""")
def _(spark, sf):
    return lg.list_pipelines(views.pipelines(spark, sf), views.jobs(spark, sf), 7)


_EXPIRY = f"""{_LISTING}, runs as (select case when contains(path, '/jenkins-builds/') then 'jenkins' else 'gitlab' end as source,
  regexp_replace(path, '/[^/]+$', '') as directory, cast(sum(size) as bigint) as bytes, max(mtime) as newest from listing group by 1, 2),
aged as (select *, cast(floor(epoch(timestamp '2003-01-01 00:00:00' - newest) / 86400) as bigint) as age_days from runs),
plan as (select source, directory, bytes, age_days, age_days > 900 as expired,
  bool_and(age_days > 900) over (partition by regexp_replace(directory, '/[^/]+$', '')) as parent_empty from aged)"""
_OLD = "2003-01-01 00:00:00"


@query("expire_artefacts", f"with {_EXPIRY} select * from plan")
def _(spark, sf):
    return lg.expire_artefacts(views.listing(spark, sf), _OLD, 900)


@query("expiry_summary", f"with {_EXPIRY} select source, count(*) filter (expired) as directories, cast(coalesce(sum(bytes) filter (expired), 0) as bigint) as bytes_freed from plan group by 1")
def _(spark, sf):
    return lg.expiry_summary(lg.expire_artefacts(views.listing(spark, sf), _OLD, 900))


@query("expire_snapshots", """with s as (select o_orderkey as snapshot_id, case o_orderpriority when '1-URGENT' then 'daily' when '2-HIGH' then 'weekly'
    when '3-MEDIUM' then 'monthly' else 'manual' end as tier, cast(floor(epoch(timestamp '1998-01-01 00:00:00' - o_orderdate) / 86400) as bigint) as age_days from orders)
  select *, case tier when 'daily' then age_days > 7 when 'weekly' then age_days > 28 when 'monthly' then age_days > 180 else false end as expired from s""")
def _(spark, sf):
    return lg.expire_snapshots(views.snapshots(spark, sf), "1998-01-01 00:00:00").drop("mtime")


# ---- sinks: write, then read back what was written ----

@query("sink_requests_csv", f"""with {sv.REQUESTS} select id, {_TS.format('timestamp')} as timestamp, project_id, pipeline_id, pipeline_type, status, sha, processing_time,
  success_count, error_message, metadata from requests where timestamp > timestamp '{AS_OF}' - interval 72 hours""")
def _(spark, sf):
    rows = views.requests(spark, sf)
    path = sinks.requests_csv(rows, new_path(spark, "requests-csv"), AS_OF, 72)
    back = spark.read.schema(rows.schema).option("header", True).option("escape", '"').csv(path)
    return _stamp(back, "timestamp").select(
        "id", "timestamp", "project_id", "pipeline_id", "pipeline_type", "status", "sha", "processing_time", "success_count",
        "error_message", "metadata",
    )


@query("sink_log_tree", f"""with {sv.PIPELINES}, {sv.JOBS} select 'gitlab' as source,
  trim(regexp_replace(regexp_replace(project_name, '[^\\p{{L}}\\p{{N}}\\-_.]', '_', 'g'), '_+', '_', 'g'), '_') || '_' || project_id as project_dir,
  pipeline_id, job_id, length(text) as chars, md5(text) as digest from jobs j join pipelines p using (pipeline_id) join documents d on d.doc_id = j.log_id where j.status = 'failed'""")
def _(spark, sf):
    from ..functions import text

    p = views.pipelines(spark, sf).select("pipeline_id", text.project_dir(F.col("project_name"), F.col("project_id")).alias("project_dir"))
    logs = views.jobs(spark, sf).filter("status = 'failed'").join(p, "pipeline_id").select(
        F.lit("gitlab").alias("source"), "project_dir", "pipeline_id", "job_id", F.col("log_id").alias("text_id")
    )
    path = sinks.log_tree(logs, new_path(spark, "log-tree"), views.log_texts(spark, sf))
    back = sinks.read_log_tree(spark, path, "source string, project_dir string, pipeline_id bigint, job_id string")
    return back.select("source", "project_dir", "pipeline_id", "job_id", F.length("content").alias("chars"), F.md5("content").alias("digest"))


@query("sink_metadata_merge", f"""with {sv.PIPELINES}, {sv.JOBS} select pipeline_id, case when pipeline_id % 3 = 0 then 'merged' else status end as status,
  case when pipeline_id % 3 = 0 then null else ref end as ref, case when pipeline_id % 3 = 0 then 2 else 1 end as last_updated from pipelines""")
def _(spark, sf):
    old = views.pipelines(spark, sf).select("pipeline_id", F.lit(1).alias("version"), "status", "ref")
    new = old.filter("pipeline_id % 3 = 0").select(
        "pipeline_id", F.lit(2).alias("version"), F.lit("merged").alias("status"), F.lit(None).cast("string").alias("ref")
    )
    return sinks.merge_latest(old, new, ["pipeline_id"])


@query("src_metadata_json", f"""with {sv.PIPELINES} select pipeline_id, project_id, status, ref, pipeline_type, array_to_string(stages, ',') as stages from typed""")
def _(spark, sf):
    from ..operators import events as ev

    kept = ev.filter_metadata_save(ev.classify_pipeline_type(views.pipelines(spark, sf)), F.lit(True))
    names = ["pipeline_id", "project_id", "status", "ref", "pipeline_type", "stages"]
    root, directory = new_path(spark, "metadata"), F.concat(F.lit("p_"), F.col("project_id").cast("string"), F.lit("/pipeline_"), F.col("pipeline_id").cast("string"))
    settle(sinks.metadata_files(kept.select(*names), root, directory), "written")
    # Files that are not read: one is broken, one has another name.
    other = spark.createDataFrame([("broken/metadata.json", '{"pipeline_id": 1, "sta'), ("other/notes.json", '{"pipeline_id": 2}')], "path string, content string")
    settle(fl.write_files(other, root), "written")
    return lg.read_metadata_json(spark, root).select(*names[:-1], F.array_join("stages", ",").alias("stages"))


@query("sink_job_metadata", f"""with {sv.PIPELINES}, {sv.JOBS}, numbered_jobs as (select *, cast(substr(name, 5) as integer) as no from jobs),
  first as (select * from numbered_jobs where no % 3 <> 0), later as (select * from numbered_jobs where no % 3 = 0 or no = 1),
  entries as (select coalesce(a.pipeline_id, b.pipeline_id) as pipeline_id, coalesce(a.job_id, b.job_id) as job_id, coalesce(b.name || ' again', a.name) as job_name,
    coalesce(b.status, 'stored') as job_status from first a full join (select * from later where pipeline_id % 4 <> 1) b on a.pipeline_id = b.pipeline_id and a.job_id = b.job_id)
  select pipeline_id, case when pipeline_id % 4 <> 1 then 'merged' else status end as status, ref, job_id, job_name, job_status,
    case when pipeline_id % 4 <> 1 then 2 else 1 end as last_updated from pipelines join entries using (pipeline_id)""")
def _(spark, sf):
    jobs = views.jobs(spark, sf).select("pipeline_id", "job_id", "name", "status", F.substring("name", 5, 9).cast("int").alias("no"))

    def mapped(rows, name, status):
        entry = F.struct("job_id", F.struct(F.lit(None).cast("bigint").alias("job_id"), name.alias("job_name"), F.lit(None).cast("string").alias("log_file"), status.alias("status")))
        return rows.groupBy("pipeline_id").agg(F.map_from_entries(F.collect_list(entry)).alias("jobs"))

    p = views.pipelines(spark, sf).select("pipeline_id", F.col("status").alias("state"), "ref")
    old = p.join(mapped(jobs.filter("no % 3 <> 0"), F.col("name"), F.lit("stored")), "pipeline_id", "left")
    stored = old.select("pipeline_id", F.lit(1).alias("version"), F.col("state").alias("status"), "ref", "jobs")
    late = mapped(jobs.filter("no % 3 = 0 or no = 1"), F.concat("name", F.lit(" again")), F.col("status")).filter("pipeline_id % 4 <> 1")
    new = p.filter("pipeline_id % 4 <> 1").join(late, "pipeline_id", "left").select("pipeline_id", F.lit(2).alias("version"), F.lit("merged").alias("status"), "jobs")
    merged = sinks.merge_latest(stored, new, ["pipeline_id"])
    rows = merged.select("pipeline_id", "status", "ref", "last_updated", F.explode("jobs").alias("job_id", "_j"))
    return rows.select("pipeline_id", "status", "ref", "job_id", "_j.job_name", F.col("_j.status").alias("job_status"), "last_updated")


@query("sink_failures", f"with recursive {pq._GITLAB} select 'gitlab' as source, pipeline_url as pipeline_id, failed_count as steps from pipelines join (select pipeline_id, count(*) filter (status = 'failed') as failed_count from jobs group by 1) using (pipeline_id)")
def _(spark, sf):
    from ..operators import payload as pl

    failures = pl.build_failures_gitlab(views.pipelines(spark, sf), views.jobs(spark, sf), pq._texts(spark, sf))
    path = sinks.failures_json(failures, new_path(spark, "failures"))
    back = spark.read.schema(failures.schema).json(path)
    return back.groupBy("source", "pipeline_id").agg(F.count_if("failed").alias("steps"))


@query("sink_failures_default", f"with recursive {pq.GITLAB_DEFAULT} select * replace (coalesce(error_text, '') as error_text) from failures")
def _(spark, sf):
    failures = pq.default_failures(spark, sf)
    path = sinks.failures_json(failures, new_path(spark, "failures"), "job_no")
    return spark.read.schema(failures.schema).json(path).withColumn("error_text", F.array_join("error_lines", "|")).drop("error_lines")


@query("sink_error_summary", f"""with recursive {lq._MATCHED}, {lq._COUNTS} select log_id, cast(sum(lines) filter (kind = 'error') as bigint) as total_errors_found, 10 as max_errors_extracted,
  '/logs/' || log_id || '.log' as extracted_content from counts group by 1 having sum(lines) filter (kind = 'error') > 0""")
def _(spark, sf):
    where = F.concat(F.lit("/logs/"), F.col("log_id").cast("string"), F.lit(".log"))
    summaries = sec.error_summary(views.log_lines(spark, sf), lq.BUCKET_PLAN)
    path = sinks.error_summaries_json(summaries, new_path(spark, "summaries"), where)
    back = spark.read.schema("log_id bigint, total_errors_found bigint, max_errors_extracted bigint, extracted_content string").json(path)
    return back
