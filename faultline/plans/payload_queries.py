"""Queries over payloads, users and look-ups."""

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import payload as pl
from ..operators import sections as sec
from ..operators.shared import settle
from . import line_queries as lq
from . import sql_views as sv
from . import stage_queries as sq
from . import views
from .registry import query


_BUILDS = """builds as (
  select o_orderkey as build_id, 'job ' || (o_custkey % 40) as job_name,
    'https://ci' || (o_custkey % 30) || '.example.com/job/' || o_orderkey as build_url,
    case when o_custkey % 31 <> 0 then 'HTTPS://CI' || (o_custkey % 30) || '.example.com//' else '' end as jenkins_url,
    case o_orderkey % 4 when 0 then 'Jenkins' when 1 then 'user' || (o_custkey % 50) end as user_id,
    case when o_orderkey % 19 <> 0 then 'group' end as namespace, 'NATION_' || (o_custkey % 25) as repo,
    case o_orderkey % 3 when 0 then '!' || o_orderkey when 1 then cast(o_custkey as varchar) end as iid,
    case when o_orderkey % 2 <> 0 then md5(cast(o_orderkey as varchar)) end as sha,
    case when o_orderkey % 7 <> 0 then 'br' || o_orderkey end as branch, o_custkey
  from orders)"""
_TRIGGER = f"""{_BUILDS},
projects as (select 'group' as namespace, n_name as repo, n_nationkey as project_id from nation where n_regionkey <> 4),
mrs as (select c_custkey % 25 as project_id, c_custkey as iid, case when c_custkey % 2 = 0 then 'mr' || c_custkey end as username from customer),
authors as (select o_custkey % 25 as project_id, md5(cast(o_orderkey as varchar)) as sha, 'br' || o_orderkey as branch,
  case when o_orderkey % 5 < 3 then 'dev' || o_orderkey when o_orderkey % 5 = 3 then 'Dev ' || o_orderkey end as author from orders),
triggered as (
  select b.*, coalesce(case when lower(b.user_id) <> 'jenkins' then b.user_id end, m.username, a.author, h.author, 'jenkins') || '@internal.com' as triggered_by
  from builds b left join projects p on p.namespace = b.namespace and p.repo = b.repo
  left join mrs m on m.project_id = p.project_id and m.iid = try_cast(b.iid as bigint)
  left join authors a on a.project_id = p.project_id and a.sha = b.sha
  left join authors h on h.project_id = p.project_id and h.branch = b.branch)"""


def _triggered(spark, sf, builds):
    return pl.resolve_trigger_user(
        builds, views.ci_projects(spark, sf), views.ci_merge_requests(spark, sf), views.ci_commits(spark, sf), views.ci_branches(spark, sf)
    )


@query("resolve_trigger_user", f"with {_TRIGGER} select build_id, triggered_by from triggered")
def _(spark, sf):
    return _triggered(spark, sf, views.builds(spark, sf)).select("build_id", "triggered_by")


@query("join_instance_by_url", f"""with {_BUILDS} select build_id, coalesce(case when n_nationkey is not null then 'https://ci' || n_nationkey || '.example.com/' end, 'default') as instance_url,
  case when n_nationkey is not null then 'bot' || n_nationkey end as jenkins_user
  from builds left join nation on o_custkey % 31 <> 0 and n_nationkey = o_custkey % 30""")
def _(spark, sf):
    out = pl.join_instance_by_url(views.builds(spark, sf), views.ci_instances(spark, sf), "default")
    return out.select("build_id", "instance_url", "jenkins_user")


_FETCHED = f"""with {sv.JOBS}, fetched as (
  select j.job_id, case when l_supp = 0 then '[Error fetching log: timeout]'
    when l_supp = 9 or d.text is null then '[Log not available for job ' || j.job_id || ']' else d.text end as log
  from (select *, cast(split_part(job_id, '-', 4) as bigint) % 10 as l_supp from jobs) j left join documents d on d.doc_id = j.log_id)"""


@query("attach_logs", f"{_FETCHED} select job_id, length(log) as chars, md5(log) as digest from fetched")
def _(spark, sf):
    out = pl.attach_logs(views.jobs(spark, sf).drop("log_id"), views.job_logs(spark, sf), views.log_texts(spark, sf))
    return out.select("job_id", F.length("log").alias("chars"), F.md5("log").alias("digest"))


def _texts(spark, sf):
    return settle(sec.format_sections(views.log_lines(spark, sf), lq.BUCKET_PLAN).select("log_id", "text"), "texts")


_GITLAB = f"{lq._CAPPED}, {lq._TEXTS}, {sv.PIPELINES}, {sv.JOBS}"


@query("failed_steps_gitlab", f"""with recursive {_GITLAB} select job_id, name as step_name, coalesce(text, '') as error_text,
  case when text is null then 0 else 1 end as texts from jobs left join texts using (log_id) where status = 'failed'""")
def _(spark, sf):
    out = pl.failed_steps_gitlab(views.jobs(spark, sf), _texts(spark, sf))
    return out.select("job_id", "step_name", F.array_join("error_lines", "").alias("error_text"), F.size("error_lines").alias("texts"))


@query("build_failures_gitlab", f"""with recursive {_GITLAB}
  select 'gitlab' as source, split_part(project_name, '/', -1) as repo, ref as branch, coalesce(left(sha, 7), 'unknown') as commit,
  pipeline_url as pipeline_id, coalesce(coalesce(username, user_full_name) || '@internal.com', p.source) as triggered_by,
  j.job_id, j.name as job_name, j.status = 'failed' as failed, case when j.status = 'failed' then coalesce(text, '') else '' end as error_text
  from pipelines p join jobs j using (pipeline_id) left join texts using (log_id) where p.status not in ('running', 'pending', 'created')""")
def gitlab_failures(spark, sf):
    from ..operators import events as ev

    kept = ev.filter_processable(views.pipelines(spark, sf))
    out = pl.build_failures_gitlab(kept, views.jobs(spark, sf), _texts(spark, sf))
    return out.withColumn("error_text", F.array_join("error_lines", "|")).drop("error_lines", "job_order")


GITLAB_DEFAULT = f"""{lq.DEFAULT_CAPPED}, {lq._TEXTS}, {sv.PIPELINES}, {sv.JOBS}, failures as (
  select 'gitlab' as source, split_part(project_name, '/', -1) as repo, ref as branch, coalesce(left(sha, 7), 'unknown') as commit,
    pipeline_url as pipeline_id, coalesce(coalesce(username, user_full_name) || '@internal.com', p.source) as triggered_by,
    row_number() over (partition by pipeline_id order by pos) as job_no, j.job_id, j.name as job_name, j.status = 'failed' as failed,
    case when j.status = 'failed' then text end as error_text
  from pipelines p join jobs j using (pipeline_id) left join texts using (log_id) where p.status not in ('running', 'pending', 'created'))"""


def default_failures(spark, sf):
    """Payload rows with the sections of the default buckets, their jobs numbered in order."""
    from ..operators import events as ev

    texts = settle(sec.format_sections(views.log_lines(spark, sf)).select("log_id", "text"), "texts")
    out = pl.build_failures_gitlab(ev.filter_processable(views.pipelines(spark, sf)), views.jobs(spark, sf), texts, numbered=True)
    return out.drop("job_order")


@query("build_failures_default", f"with recursive {GITLAB_DEFAULT} select * replace (coalesce(error_text, '') as error_text) from failures")
def _(spark, sf):
    return default_failures(spark, sf).withColumn("error_text", F.array_join("error_lines", "|")).drop("error_lines")


def _stage_rows(spark, sf):
    """Stages of builds: one per job, failed ones with the text of their log or none."""
    jobs = views.jobs(spark, sf)
    status = F.when(F.col("status") == "failed", "FAILED").otherwise("SUCCESS")
    rows = jobs.join(_texts(spark, sf), "log_id", "left")
    return rows.select(
        F.col("pipeline_id").alias("build_id"), F.col("job_order").alias("stage_pos"), "name", status.alias("status"),
        F.coalesce("text", F.lit("")).alias("log_content"),
    )


_STEP_TEXT = "coalesce(text, 'Stage ''' || name || ''' failed but no log content available')"


@query("failed_steps_jenkins", f"""with recursive {_GITLAB} select pipeline_id as build_id, name as step_name, {_STEP_TEXT} as error_text
  from jobs left join texts using (log_id) where status = 'failed'""")
def _(spark, sf):
    out = pl.failed_steps_jenkins(_stage_rows(spark, sf))
    return out.select("build_id", "step_name", F.array_join("error_lines", "").alias("error_text"))


@query("build_failures_jenkins", f"""with recursive {_GITLAB}, {_TRIGGER}, listed as (
  select pipeline_id as build_id, name as step_name, {_STEP_TEXT} as error_text
  from jobs left join texts using (log_id) where status = 'failed')
  select 'jenkins' as source, repo, case when branch is null then 'unknown' else branch end as branch,
  coalesce(sha, 'unknown') as commit, job_name, build_url as pipeline_id, triggered_by,
  step_name, error_text from triggered left join listed using (build_id)""")
def jenkins_failures(spark, sf):
    triggered = _triggered(spark, sf, pl.jenkins_headers(views.builds(spark, sf))).drop("parameters")
    out = pl.build_failures_jenkins(triggered, _stage_rows(spark, sf))
    return out.withColumn("error_text", F.array_join("error_lines", "|")).drop("error_lines", "stage_pos")


_USERS = """users as (select 'U' || c_custkey as id, c_custkey as pos, lower(replace(c_name, '#', '.')) || '@internal.com' as email,
  c_name as real_name, lower(replace(c_name, '#', '.')) as name from customer),
people as (select o_orderkey as order_id, case o_orderkey % 6 when 0 then 'customer.' || lpad(cast(o_custkey as varchar), 9, '0') || '@internal.com'
  when 1 then 'CUSTOMER#' || lpad(cast(o_custkey as varchar), 9, '0') when 2 then 'customer.' || lpad(cast(o_custkey as varchar), 9, '0')
  when 3 then cast(o_custkey as varchar) when 4 then 'stranger' || o_custkey || '@else.example'
  else 'R#0' || right(lpad(cast(o_custkey as varchar), 9, '0'), 3) end as person from orders),
ids as (select distinct person from people),
mailed as (select i.person, min(u.pos) as pos from ids i left join users u on contains(i.person, '@') and u.email = i.person group by 1)"""


def _match_sql(condition: str) -> str:
    return f"""with {_USERS}, named as (select m.person, coalesce(m.pos, min(u.pos)) as pos from mailed m
  left join users u on m.pos is null and ({condition}) group by m.person, m.pos)
  select p.order_id, p.person, 'U' || n.pos as user_id from people p join named n using (person)"""


@query("match_user_exact", _match_sql("lower(m.person) = lower(u.real_name) or lower(m.person) = u.name"))
def _(spark, sf):
    return pl.match_user_exact(views.people(spark, sf), views.users(spark, sf)).select("order_id", "person", "user_id")


@query("match_user_fuzzy", _match_sql("contains(lower(u.real_name), lower(m.person)) or contains(u.name, lower(m.person))"))
def _(spark, sf):
    return pl.match_user_fuzzy(views.people(spark, sf), views.users(spark, sf)).select("order_id", "person", "user_id")
