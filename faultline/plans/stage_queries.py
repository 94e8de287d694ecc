"""Queries over console stages."""

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import stages as st
from . import line_queries as lq
from . import sql_views as sv
from . import views
from .line_queries import BUCKET_PLAN
from .registry import query

_CONSOLE = f"{sv.LOG_LINES}, {sv.console_cte()}"
_STEPS = f"{sv.LOG_LINES}, {sv.console_steps_cte()}"

_SEGMENTED = f"""{_CONSOLE}, kinds as (
  select *, case when regexp_matches(raw, '\\[Pipeline\\] stage \\(.*?\\)') then 'stage'
    when contains(raw, '[Pipeline] parallel') then 'open'
    when regexp_matches(raw, '\\[Pipeline\\] \\{{ \\(.*?\\)') then 'branch'
    when contains(raw, '[Pipeline] // parallel') then 'close' end as kind from console),
staged as (
  select *, count(*) filter (kind = 'stage') over w as stage_no,
    last_value(case when kind = 'stage' then regexp_extract(raw, '\\[Pipeline\\] stage \\((.*?)\\)', 1) end ignore nulls) over w as stage_name,
    last_value(case when kind in ('stage', 'open', 'close') then kind end ignore nulls) over w as mode
  from kinds window w as (partition by log_id order by line_no)),
turned as (select *, kind = 'branch' and mode = 'open' as opens from staged),
blocked as (
  select *, last_value(case when opens or kind in ('stage', 'close') then line_no end ignore nulls) over w as block_at,
    max(case when opens or kind in ('stage', 'close') then line_no end) over (partition by log_id) as last_turn
  from turned window w as (partition by log_id order by line_no)),
named as (
  select b.*, case when o.opens then regexp_extract(o.raw, '\\[Pipeline\\] \\{{ \\((.*?)\\)', 1) end as block_name
  from blocked b left join turned o on o.log_id = b.log_id and o.line_no = b.block_at
  where b.stage_no > 0 and (b.kind is null or (b.kind = 'branch' and not b.opens)))"""


@query("segment_stages", f"with {_SEGMENTED} select log_id, stage_no, stage_name, line_no, raw from named where block_name is null")
def _(spark, sf):
    return st.segment_stages(views.console(spark, sf))


@query("segment_parallel", f"""with {_SEGMENTED} select log_id, stage_no, stage_name, block_at as block_start, block_name, line_no, raw
  from named where block_name is not null and block_at < last_turn""")
def _(spark, sf):
    return st.segment_parallel(views.console(spark, sf))


_NUMBERS = "stage_numbers as (select distinct log_id, line_no // 20 as n from numbered)"


def _slice(start: str, end: str, source: str) -> str:
    """Lines after the first start line of a name up to the next end line, without repeated start lines."""
    return f"""firsts as (select w.log_id, w.name, min(l.line_no) as s from wanted w join {source} l on l.log_id = w.log_id and {start} group by 1, 2),
spans as (select f.*, (select min(l.line_no) from {source} l where l.log_id = f.log_id and l.line_no > f.s and {end}) as e from firsts f),
sliced as (select w.log_id, w.name, l.line_no, l.raw from spans w join {source} l on l.log_id = w.log_id and l.line_no > w.s
  and (w.e is null or l.line_no < w.e) and not ({start}))"""


_STAGE_START, _STAGE_END = "contains(lower(l.raw), lower('stage (' || w.name || ')'))", "contains(lower(l.raw), '// stage')"
_BLOCK_START = "(contains(l.raw, '{ (' || w.name || ')') or contains(l.raw, 'Branch: ' || w.name))"
_BLOCK_END = "(contains(l.raw, '[Pipeline] }') or contains(l.raw, '// parallel'))"
_STEP_START, _STEP_END = "contains(l.raw, '{ (' || w.name)", "contains(l.raw, '[Pipeline] }')"


def _wanted(spark, sf, prefix):
    n = F.col("n").cast("string")
    return views.stage_numbers(spark, sf).select("log_id", F.concat(F.lit(prefix), n).alias("name"))


@query("slice_stage", f"""with {_CONSOLE}, {_NUMBERS}, wanted as (select log_id, 's' || n as name from stage_numbers),
  {_slice(_STAGE_START, _STAGE_END, 'console')} select * from sliced""")
def _(spark, sf):
    return st.slice_stage(views.console(spark, sf), _wanted(spark, sf, "s"))


@query("slice_block", f"""with {_CONSOLE}, {_NUMBERS}, wanted as (select log_id, 'B' || n as name from stage_numbers),
  {_slice(_BLOCK_START, _BLOCK_END, 'console')} select * from sliced""")
def _(spark, sf):
    return st.slice_block(views.console(spark, sf), _wanted(spark, sf, "B"))


@query("slice_step", f"""with {_STEPS}, {_NUMBERS}, wanted as (select log_id, 'B' || n as name from stage_numbers),
  {_slice(_STEP_START, _STEP_END, 'console_steps')} select * from sliced""")
def _(spark, sf):
    return st.slice_step(views.console_steps(spark, sf), _wanted(spark, sf, "B"))


_TWO_LINE = """pairs as (select *, lead(raw) over (partition by log_id order by line_no) as next_raw from console_steps),
two_firsts as (select w.log_id, w.name, min(p.line_no) as s from wanted w join pairs p on p.log_id = w.log_id
  and regexp_matches(p.raw, '(?i)^\\[Pipeline\\]\\s+stage\\s*$')
  and regexp_matches(p.next_raw, '(?i)^\\[Pipeline\\]\\s+\\{\\s*\\(' || regexp_escape(w.name) || '\\s*\\)') group by 1, 2),
two_spans as (select f.*, (select min(l.line_no) from console_steps l where l.log_id = f.log_id and l.line_no > f.s
  and regexp_matches(l.raw, '(?i)^\\[Pipeline\\]\\s+//\\s+stage\\s*$')) as e from two_firsts f),
two_sliced as (select w.log_id, w.name, l.line_no, l.raw from two_spans w join console_steps l on l.log_id = w.log_id
  and l.line_no >= w.s and (w.e is null or l.line_no <= w.e))"""


@query("slice_stage_two_line", f"""with {_STEPS}, {_NUMBERS}, wanted as (select log_id, 's' || n as name from stage_numbers),
  {_TWO_LINE} select * from two_sliced""")
def _(spark, sf):
    return st.slice_stage_two_line(views.console_steps(spark, sf), _wanted(spark, sf, "s"))


_META = """stage_meta as (select log_id, n as stage_pos, 'S' || n as name, case when (log_id + n) % 3 = 0 then 'FAILED' else 'SUCCESS' end as status,
  n * 100 as duration_ms, (log_id + n) % 2 = 0 as is_parallel from stage_numbers),
stage_nodes as (select log_id, n as stage_pos, 0 as node_pos, 'B' || n as name, case when (log_id + n) % 2 = 0 then 'FAILED' else 'SUCCESS' end as status, n * 10 as duration_ms from stage_numbers
  union all select log_id, n, 1, 'B' || n || 'x', case when (log_id + n) % 3 = 0 then 'SUCCESS' else 'FAILED' end, n * 10 from stage_numbers where (log_id + n) % 2 = 0)"""


@query("stage_tree", f"""with {_CONSOLE}, {_NUMBERS}, {_META}, parts as (
  select log_id, stage_pos, name as stage_name, false as is_parallel, null as node_pos, name as part_name, status, duration_ms from stage_meta where not is_parallel
  union all select m.log_id, m.stage_pos, m.name, true, x.node_pos, x.name, x.status, x.duration_ms from stage_meta m
    join stage_nodes x on x.log_id = m.log_id and x.stage_pos = m.stage_pos where m.is_parallel),
  wanted as (select log_id, part_name as name, is_parallel from parts),
  firsts as (select w.*, (select min(l.line_no) from console l where l.log_id = w.log_id
    and case when w.is_parallel then {_BLOCK_START} else {_STAGE_START} end) as s from wanted w),
  spans as (select f.*, (select min(l.line_no) from console l where l.log_id = f.log_id and l.line_no > f.s
    and case when f.is_parallel then {_BLOCK_END} else {_STAGE_END} end) as e from firsts f),
  sized as (select w.log_id, w.name, count(*) as lines, cast(sum(length(l.raw)) as bigint) as chars from spans w join console l
    on l.log_id = w.log_id and l.line_no > w.s and (w.e is null or l.line_no < w.e) group by 1, 2)
  select p.*, coalesce(lines, 0) as lines, coalesce(chars, 0) as chars from parts p left join sized s
    on s.log_id = p.log_id and s.name = p.part_name""")
def _(spark, sf):
    return st.stage_tree(views.stage_meta(spark, sf), views.console(spark, sf))


_FLAT_SPANS = f"""parts as (
  select log_id, stage_pos, name as stage_name, false as is_parallel, null as node_pos, name as part_name, status, duration_ms from stage_meta where not is_parallel
  union all select m.log_id, m.stage_pos, m.name, true, x.node_pos, x.name, x.status, x.duration_ms from stage_meta m
    join stage_nodes x on x.log_id = m.log_id and x.stage_pos = m.stage_pos where m.is_parallel),
wanted as (select log_id, part_name as name, is_parallel from parts),
firsts as (select w.*, (select min(l.line_no) from console l where l.log_id = w.log_id
  and case when w.is_parallel then {_BLOCK_START} else {_STAGE_START} end) as s from wanted w),
spans as (select f.*, (select min(l.line_no) from console l where l.log_id = f.log_id and l.line_no > f.s
  and case when f.is_parallel then {_BLOCK_END} else {_STAGE_END} end) as e from firsts f)"""


@query("stage_texts", f"""with {_CONSOLE}, {_NUMBERS}, {_META}, {_FLAT_SPANS},
  texts as (select w.log_id, w.is_parallel, w.name, l.line_no // 4096 as part, string_agg(l.raw, chr(10) order by l.line_no) as text from spans w
    join console l on l.log_id = w.log_id and l.line_no > w.s and (w.e is null or l.line_no < w.e) group by all)
  select p.*, t.part, t.text from parts p join texts t on t.log_id = p.log_id and t.is_parallel = p.is_parallel and t.name = p.part_name""")
def _(spark, sf):
    return st.stage_texts(views.stage_meta(spark, sf), views.console(spark, sf))


# Depth by a window over the whole log, the closing marker and the span around by look-ups.
_NESTED = f"""{sv.LOG_LINES}, {sv.CONSOLE_NESTED}, marks as (
  select log_id, line_no, raw, case when regexp_matches(raw, '\\[Pipeline\\] (// )?stage( \\(.*\\))?\\s*$') then 'stage'
    when regexp_matches(raw, '\\[Pipeline\\] (// )?parallel\\s*$') then 'parallel'
    when regexp_matches(raw, '\\[Pipeline\\] (\\{{( \\(.*\\))?|\\}})\\s*$') then 'brace' end as kind,
    case when contains(raw, '[Pipeline] // ') or contains(raw, '[Pipeline] }}') then -1 else 1 end as step,
    nullif(regexp_extract(raw, '\\[Pipeline\\] (?:stage|\\{{) \\((?:Branch: )?(.*)\\)\\s*$', 1), '') as name from console_nested),
summed as (select *, sum(step) over (partition by log_id, kind order by line_no) as total from marks where kind is not null),
lowest as (select *, coalesce(min(total) over (partition by log_id, kind order by line_no rows between unbounded preceding and 1 preceding), 0) as low from summed),
levels as (select *, case when step > 0 then total - least(0, low) when total >= least(0, low) then total - least(0, low) + 1 end as level from lowest),
opened as (select o.log_id, o.kind, o.line_no, o.name, (select min(c.line_no) from levels c where c.log_id = o.log_id and c.kind = o.kind and c.step < 0
  and c.level = o.level and c.line_no > o.line_no) as e from levels o where o.step > 0),
around as (select x.*, (select max_by(o.kind, o.line_no) from opened o where o.log_id = x.log_id and o.line_no < x.line_no and (o.e is null or o.e > x.line_no)) as inside from opened x),
nodes as (select o.log_id, 'stage' as kind, coalesce(o.name, b.name) as name, o.line_no, o.e from opened o
    left join opened b on b.log_id = o.log_id and b.kind = 'brace' and b.line_no = o.line_no + 1 where o.kind = 'stage'
  union all select log_id, 'block', name, line_no, e from around where kind = 'brace' and inside = 'parallel'),
sizes as (select log_id, count(*) as total_lines from console_nested group by 1),
tree as (select x.log_id, x.kind, x.name, x.line_no as start_line, coalesce(x.e, total_lines) as end_line, x.e is not null as closed,
    cast(1 + count(o.line_no) as integer) as depth, max(o.line_no) as parent
  from nodes x join sizes using (log_id) left join nodes o on o.log_id = x.log_id and o.line_no < x.line_no and (o.e is null or o.e > x.line_no) group by all)"""
_NESTED_PARTS = f"""{_NESTED}, numbers as (select distinct log_id, line_no // 40 as n from numbered),
parts as (select log_id, n * 2 as stage_pos, 's' || n as stage_name, true as is_parallel, 0 as node_pos, 'A' || n as part_name, 'SUCCESS' as status, n * 10 as duration_ms from numbers
  union all select log_id, n * 2, 's' || n, true, 1, 'B' || n, 'SUCCESS', n * 10 from numbers
  union all select log_id, n * 2 + 1, case when n % 3 = 2 then 'ZZ' else 'I' end || n, false, null, case when n % 3 = 2 then 'ZZ' else 'I' end || n, 'FAILED', n * 100 from numbers),
placed as (select p.*, coalesce(b.start_line, case when not is_parallel then s.start_line end) as start_line, coalesce(b.end_line, case when not is_parallel then s.end_line end) as end_line,
    coalesce(b.closed, case when not is_parallel then s.closed end) as closed
  from parts p left join tree s on s.log_id = p.log_id and s.kind = 'stage' and lower(s.name) = lower(p.stage_name)
  left join tree b on p.is_parallel and b.log_id = p.log_id and b.kind = 'block' and b.parent = s.start_line and b.name = p.part_name)"""


@query("nested_spans", f"with {_NESTED} select * from tree")
def _(spark, sf):
    return st.nested_spans(views.console_nested(spark, sf))


@query("stage_tree_nested", f"""with {_NESTED_PARTS} select p.*, (select count(*) from console_nested l where l.log_id = p.log_id and l.line_no > p.start_line and l.line_no < p.end_line) as lines,
  cast(coalesce((select sum(length(raw)) from console_nested l where l.log_id = p.log_id and l.line_no > p.start_line and l.line_no < p.end_line), 0) as bigint) as chars from placed p""")
def _(spark, sf):
    return st.stage_tree(views.nested_meta(spark, sf), views.console_nested(spark, sf), nested=True)


@query("stage_texts_nested", f"""with {_NESTED_PARTS} select p.* exclude (start_line, end_line, closed), l.line_no // 4096 as part, string_agg(l.raw, chr(10) order by l.line_no) as text
  from placed p join console_nested l on l.log_id = p.log_id and l.line_no > p.start_line and l.line_no < p.end_line group by all""")
def _(spark, sf):
    return st.stage_texts(views.nested_meta(spark, sf), views.console_nested(spark, sf), nested=True)


_NODES = f"""with {sv.JOBS}, nodes as (select pipeline_id, pos, name, case status when 'failed' then 'FAILED'
  when 'success' then 'SUCCESS' when 'skipped' then 'SKIPPED' else 'ABORTED' end as status from jobs),
  flags as (select *, coalesce(max(case when status in ('SUCCESS', 'SKIPPED') then 1 else 0 end) over
    (partition by pipeline_id order by pos rows between 1 following and unbounded following), 0) = 1 as went_on from nodes),
  failures as (select pipeline_id, max_by(name, pos) filter (not went_on) as step_name, count(*) as total_failed,
    count(*) filter (went_on) as handled from flags where status in ('FAILED', 'FAILURE') group by 1)"""


def _nodes(spark, sf):
    s = F.col("status")
    status = F.when(s == "failed", "FAILED").when(s == "success", "SUCCESS").when(s == "skipped", "SKIPPED").otherwise("ABORTED")
    return views.jobs(spark, sf).select("pipeline_id", F.col("job_order").alias("node_pos"), "name", status.alias("status"))


@query("real_failures", f"{_NODES} select * from failures")
def _(spark, sf):
    return st.real_failures(_nodes(spark, sf), ["pipeline_id"])


@query("failed_step_counts", f"{_NODES} select pipeline_id, total_failed, handled from failures")
def _(spark, sf):
    return st.failed_step_counts(_nodes(spark, sf), ["pipeline_id"])


_CHOICE_AFTER = "case when n < 2 then 1 when n < 5 then 1 else 0 end"
_CHOICE_BEFORE = "case when {0}n < 2 then 3 when {0}n < 5 then 2 else 1 end"

CHOICE_SQL = f"""{_STEPS}, {_NUMBERS}, failed as (
  select log_id, n as stage_pos, case when (log_id + n) % 7 = 0 then 'ZZ' else 'S' end || n as name,
    case when (log_id + n) % 2 = 0 then case when (log_id + n) % 4 = 0 then 'B' else 'QQ' end || n end as step_name,
    (log_id + n) % 5 = 0 as has_own_log
  from stage_numbers where (log_id + n) % 3 = 0),
own as (select f.log_id, f.name, l.line_no, l.raw from failed f join log_lines l on l.log_id = f.log_id and l.line_no // 20 = f.stage_pos where has_own_log),
wanted_steps as (select log_id, name as stage, step_name as name from failed where not has_own_log and step_name is not null),
step_firsts as (select w.log_id, w.stage, w.name, min(l.line_no) as s from wanted_steps w join console_steps l on l.log_id = w.log_id and {_STEP_START} group by 1, 2, 3),
step_spans as (select f.*, (select min(l.line_no) from console_steps l where l.log_id = f.log_id and l.line_no > f.s and {_STEP_END}) as e from step_firsts f),
step_lines as (select w.log_id, w.stage as name, l.line_no, l.raw from step_spans w join console_steps l on l.log_id = w.log_id and l.line_no > w.s
  and (w.e is null or l.line_no < w.e) and not ({_STEP_START})),
wanted as (select log_id, name from failed f where not has_own_log and not exists (select 1 from step_lines s where s.log_id = f.log_id and s.name = f.name)),
{_TWO_LINE},
rest as (select w.* from wanted w where not exists (select 1 from two_sliced t where t.log_id = w.log_id and t.name = w.name)),
cand as (
  select 'stage log' as src, * from own
  union all select 'step', * from step_lines
  union all select 'stage slice', * from two_sliced
  union all select 'console', r.log_id, r.name, l.line_no, l.raw from rest r join console_steps l using (log_id)),
cleaned as (select *, {sv.clean('raw')} as clean from cand),
errs as (select src, log_id, name, line_no from cleaned where src <> 'step' and clean <> '' and {sv.any_of('clean', fixed.ERROR_PATTERNS)} and not {sv.any_of('clean', fixed.IGNORE_PATTERNS)}),
picks(src, log_id, name, n, x) as (
  select src, log_id, name, 0, max(line_no) from errs group by 1, 2, 3
  union all
  select p.src, p.log_id, p.name, p.n + 1, (select max(e.line_no) from errs e where e.src = p.src and e.log_id = p.log_id and e.name = p.name
     and e.line_no < greatest(0, p.x - ({_CHOICE_BEFORE.format('p.')}))) from picks p where p.x is not null and p.n + 1 < 10),
secs as (select src, log_id, name, n, x - ({_CHOICE_BEFORE.format('')}) as s, x + ({_CHOICE_AFTER}) as e from picks where x is not null),
sec_texts as (select k.src, k.log_id, k.name, k.n, string_agg('Line ' || (c.line_no + 1) || ': ' || c.clean, chr(10) order by c.line_no) as text
  from secs k join cleaned c on c.src = k.src and c.log_id = k.log_id and c.name = k.name and c.line_no between k.s and k.e where c.clean <> '' group by 1, 2, 3, 4),
cut as (select src, log_id, name, string_agg(text, chr(10) || chr(10) || '--- Next Error Section ---' || chr(10) || chr(10) order by n desc) as text from sec_texts group by 1, 2, 3),
choices as (
  select log_id, name, src || ' sections' as choice, 0 as part, text from cut
  union all
  select log_id, name, src, line_no // 4096, string_agg(raw, chr(10) order by line_no) from cand c
  where not exists (select 1 from cut k where k.src = c.src and k.log_id = c.log_id and k.name = c.name) group by 1, 2, 3, 4)"""


def chosen(spark, sf):
    failed = views.failed_stages(spark, sf)
    return st.stage_log_choice(failed, views.own_stage_logs(spark, sf), views.console_steps(spark, sf), BUCKET_PLAN)


query("stage_log_choice", f"with recursive {CHOICE_SQL} select * from choices")(chosen)


_DEFAULT_CHOICE = CHOICE_SQL.replace(_CHOICE_BEFORE.format("p."), lq.DEFAULT_BEFORE.replace("n <", "p.n <")).replace(
    _CHOICE_BEFORE.format(""), lq.DEFAULT_BEFORE).replace(_CHOICE_AFTER, lq.DEFAULT_AFTER).replace("p.n + 1 < 10", "p.n + 1 < 300")


@query("stage_log_choice_default", f"with recursive {_DEFAULT_CHOICE} select * from choices")
def _(spark, sf):
    return st.stage_log_choice(views.failed_stages(spark, sf), views.own_stage_logs(spark, sf), views.console_steps(spark, sf))
