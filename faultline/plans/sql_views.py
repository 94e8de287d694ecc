"""DuckDB text of the derived tables in `views.py`."""

ESC = "chr(27)"

LOG_LINES = f"""numbered as (
  select user_id as log_id, event_id, event_type,
         row_number() over (partition by user_id order by ts, event_id) - 1 as line_no
  from events),
log_lines as (
  select log_id, line_no, case
    when event_type = 'error' and event_id % 7 = 0 then 'ERROR: tag v' || event_id
    when event_type = 'error' and event_id % 5 = 0 then {ESC} || '[31mTraceback' || {ESC} || '[0m (most recent call last)'
    when event_type = 'error' and event_id % 3 = 0 then '[12:00:00]make: *** [t' || event_id || '] Error 2'
    when event_type = 'error' then '2024-01-01 00:00:00,123  build   failed ' || event_id
    when event_type = 'purchase' and event_id % 11 = 0 then ''
    else event_type || ' step ' || event_id || ' é✗' end as raw
  from numbered)"""

_CLEAN_STEPS = (
    ("^\\s+|\\s+$", ""),
    ("\\x1b\\[[0-9;]*m", ""),
    ("^\\d{4}-\\d{2}-\\d{2}\\s+\\d{2}:\\d{2}:\\d{2}[.,]\\d+\\s*", ""),
    ("^\\[\\d{2}:\\d{2}:\\d{2}\\]", ""),
    ("[^\\x20-\\x7e\\t\\n]", " "),
    (" +", " "),
    ("^\\s+|\\s+$", ""),
)


def clean(col: str) -> str:
    out = col
    for pattern, new in _CLEAN_STEPS:
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    return f"(case when length({out}) > 1000 then left({out}, 1000) || '...' else {out} end)"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_of(col: str, needles) -> str:
    return "(" + " or ".join(f"contains(lower({col}), {lit(n.lower())})" for n in needles) + ")"


def first_of(col: str, needles) -> str:
    return "(case " + " ".join(f"when contains(lower({col}), {lit(n.lower())}) then {lit(n)}" for n in needles) + " end)"


def clean_lines_cte(source: str = "log_lines") -> str:
    return f"clean_lines as (select log_id, line_no, raw, {clean('raw')} as clean from {source})"


def errors_cte(patterns, ignore) -> str:
    return (
        f"errors as (select log_id, line_no, clean from clean_lines where clean <> '' "
        f"and {any_of('clean', patterns)} and not {any_of('clean', ignore)})"
    )


def console_cte() -> str:
    return """console as (
  select log_id, line_no, case line_no % 20
    when 0 then '[Pipeline] stage (S' || (line_no // 20) || ')'
    when 5 then '[Pipeline] parallel'
    when 6 then '[Pipeline] { (B' || (line_no // 20) || ')'
    when 10 then '[Pipeline] { (B' || (line_no // 20) || 'x)'
    when 9 then '[Pipeline] }' when 13 then '[Pipeline] }'
    when 14 then '[Pipeline] // parallel'
    when 19 then '[Pipeline] // stage' else raw end as raw
  from log_lines)"""


def console_steps_cte() -> str:
    return """console_steps as (
  select log_id, line_no, case line_no % 20
    when 0 then '[Pipeline] stage'
    when 1 then '[Pipeline] { (S' || (line_no // 20) || ')'
    when 6 then '[Pipeline] { (B' || (line_no // 20) || '-unit)'
    when 9 then '[Pipeline] }'
    when 19 then '[Pipeline] // stage' else raw end as raw
  from log_lines)"""


CONSOLE_NESTED = """console_nested as (
  select log_id, line_no, case line_no % 40 when 0 then '[Pipeline] stage' when 1 then '[Pipeline] { (S' || line_no // 40 || ')'
    when 4 then '[Pipeline] parallel' when 5 then '[Pipeline] { (Branch: A' || line_no // 40 || ')' when 6 then '[Pipeline] stage (I' || line_no // 40 || ')'
    when 9 then '[Pipeline] // stage' when 31 then '[Pipeline] // stage' when 10 then '[Pipeline] }' when 17 then '[Pipeline] }' when 30 then '[Pipeline] }'
    when 11 then '[Pipeline] { (B' || line_no // 40 || ')' when 18 then '[Pipeline] // parallel'
    else case when line_no % 40 = 35 and line_no // 40 % 2 = 0 then '[Pipeline] // stage' else raw end end as raw
  from log_lines)"""


REQUESTS = """requests as (
  select event_id as id, ts as timestamp, user_id % 10 as project_id, user_id as pipeline_id,
    case user_id % 4 when 0 then 'main' when 1 then 'child' when 2 then 'merge_request' end as pipeline_type,
    case when event_type in ('view', 'click') then 'completed' when event_type = 'purchase' then 'skipped'
         when event_type = 'error' then 'failed' else 'processing' end as status,
    case when event_id % 2 = 0 then 'main' else 'dev' end as ref, md5(cast(event_id as varchar)) as sha,
    case when user_id % 4 = 1 then 'parent_pipeline' else 'push' end as source, 'Pipeline Hook' as event_type,
    '10.0.0.' || (user_id % 250) as client_ip,
    case when event_id % 13 <> 0 then value end as processing_time, event_id % 6 + event_id % 3 as job_count,
    case when event_type <> 'signup' then event_id % 6 end as success_count,
    case when event_id % 5 <> 0 then event_id % 3 end as error_count,
    case when event_type = 'error' then 'boom ' || event_id end as error_message,
    '{"project_name": "p' || (user_id % 10) || '"}' as metadata
  from events)"""

PIPELINES = """pipelines as (
  select o_orderkey as pipeline_id, 'https://ci.example.com/p/' || o_orderkey as pipeline_url,
    case when o_orderkey % 10 < 9 then 'Pipeline Hook' else 'Push Hook' end as event_type,
    o_custkey % 25 as project_id,
    case when o_custkey % 3 = 0 then '' else 'group é/' end || 'NATION_' || (o_custkey % 25) as project_name,
    case o_orderstatus when 'F' then 'failed' when 'O' then 'success' else 'running' end as status,
    case o_orderpriority when '1-URGENT' then 'push' when '2-HIGH' then 'parent_pipeline' when '3-MEDIUM' then 'schedule'
      when '5-LOW' then 'api' else 'external_pr' end as source,
    o_orderkey % 5 = 0 as has_merge_request,
    case when o_orderkey % 2 = 0 then 'main' else 'feature/' || o_orderkey end as ref,
    case when o_orderkey % 13 <> 0 then md5(cast(o_orderkey as varchar)) end as sha,
    strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as created_at,
    case when o_orderkey % 17 <> 0 then cast(o_orderkey % 400 as double) end as duration,
    case when o_orderkey % 3 <> 0 then 'user' || (o_custkey % 100) end as username,
    case when o_orderkey % 6 <> 0 then 'Name ' || (o_custkey % 100) end as user_full_name,
    case when o_orderkey % 11 = 0 then ['build', 'external'] else ['build', 'test'] end as stages
  from orders),
typed as (
  select *, case when has_merge_request then 'merge_request' when source = 'parent_pipeline' then 'child'
    when source in ('push', 'web', 'schedule', 'trigger', 'api') then 'main' else 'unknown' end as pipeline_type
  from pipelines)"""

JOBS = """jobs as (
  select l_orderkey as pipeline_id,
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) as job_id,
    'job ' || l_linenumber as name, case when l_linestatus = 'F' then 'build' else 'test' end as stage,
    case when l_returnflag = 'R' then 'failed' when l_returnflag = 'A' then 'success'
         when l_linenumber = 7 then 'skipped' else 'canceled' end as status,
    l_quantity as duration, l_partkey as log_id,
    row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate) as pos
  from lineitem)"""
