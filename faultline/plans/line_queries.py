"""Queries over log lines and whole-log text."""

from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import lines as ln
from ..operators import sections as sec
from ..operators.shared import settle
from . import sql_views as sv
from . import views
from .registry import query

BUCKETS = ((2, 3, 1), (3, 2, 1), (5, 1, 0))
BUCKET_PLAN = sec.context_plan(buckets=BUCKETS, mode="buckets")
FIXED_PLAN = sec.context_plan(3, 1, mode="fixed")

_LINES = sv.LOG_LINES
_CLEAN = f"{_LINES}, {sv.clean_lines_cte()}"
_ERRORS = f"{_CLEAN}, {sv.errors_cte(fixed.ERROR_PATTERNS, fixed.IGNORE_PATTERNS)}"
_SIZES = "sizes as (select log_id, max(line_no) + 1 as total_lines from log_lines group by 1)"

_BEFORE = "case when n < 2 then 3 when n < 5 then 2 else 1 end"
_AFTER = "case when n < 2 then 1 when n < 5 then 1 else 0 end"
DEFAULT_BEFORE = "case when n < 50 then 50 when n < 150 then 10 else 5 end"
DEFAULT_AFTER = "case when n < 50 then 10 when n < 150 then 5 else 2 end"
# Next pick: the highest error line at or under the limit left by the former pick.
_CAPPED = f"""{_ERRORS}, {_SIZES},
picks(log_id, n, x) as (
  select log_id, 0, max(line_no) from errors group by 1
  union all
  select p.log_id, p.n + 1, (select max(e.line_no) from errors e where e.log_id = p.log_id
      and e.line_no < greatest(0, p.x - ({_BEFORE.replace('n <', 'p.n <')})))
  from picks p where p.x is not null and p.n + 1 < 10),
sections as (
  select log_id, count(*) over (partition by log_id) - n - 1 as section_no, x as error_line,
         greatest(x - ({_BEFORE}), 0) as start_line, least(x + ({_AFTER}) + 1, total_lines) as end_line
  from picks join sizes using (log_id) where x is not null)"""
_FIXED = f"""{_ERRORS}, {_SIZES},
picks(log_id, n, x) as (
  select log_id, 0, max(line_no) from errors group by 1
  union all
  select p.log_id, p.n + 1, (select max(e.line_no) from errors e where e.log_id = p.log_id
      and e.line_no < greatest(0, p.x - 3))
  from picks p where p.x is not null),
sections as (
  select log_id, count(*) over (partition by log_id) - n - 1 as section_no, x as error_line,
         greatest(x - 3, 0) as start_line, least(x + 2, total_lines) as end_line
  from picks join sizes using (log_id) where x is not null)"""
_SECTION_TEXTS = """section_texts as (
  select s.log_id, s.section_no, string_agg('Line ' || (c.line_no + 1) || ': ' || c.clean, chr(10) order by c.line_no) as text
  from sections s join clean_lines c on c.log_id = s.log_id and c.line_no >= s.start_line and c.line_no < s.end_line
  where c.clean <> '' group by 1, 2)"""
_TEXTS = f"""{_SECTION_TEXTS},
texts as (
  select log_id, count(*) as sections,
         string_agg(text, chr(10) || chr(10) || '--- Next Error Section ---' || chr(10) || chr(10) order by section_no) as text
  from section_texts group by 1)"""


def overview(spark, sf):
    """What broke in each log: totals, first error line shown and the text of all sections."""
    lines = views.log_lines(spark, sf)
    errors = settle(ln.error_lines(lines).select("log_id", "line_no"), "error_lines")
    totals = errors.groupBy("log_id").agg(F.count("*").alias("total_errors"))
    shown = sec.bottom_up_sections(lines, BUCKET_PLAN, errors).groupBy("log_id").agg(F.min("error_line").alias("first_error_line"))
    texts = sec.format_sections(lines, BUCKET_PLAN, errors)
    return texts.join(shown, "log_id").join(totals, "log_id").select(
        "log_id", "total_errors", "sections", "first_error_line", "text"
    )


query("what_broke", f"""with recursive {_CAPPED}, {_TEXTS}
select log_id, (select count(*) from errors e where e.log_id = t.log_id) as total_errors, sections,
       (select min(error_line) from sections s where s.log_id = t.log_id) as first_error_line, text
from texts t""")(overview)


@query("explode_lines", """select doc_id as log_id, unnest(range(len(string_split(text, chr(10))))) as line_no,
  unnest(string_split(text, chr(10))) as raw from documents where length(text) > 0""")
def _(spark, sf):
    return ln.explode_lines(views.table(spark, sf, "documents").select(F.col("doc_id").alias("log_id"), "text"), "text")


@query("clean_line", f"with {_CLEAN} select log_id, line_no, clean from clean_lines")
def _(spark, sf):
    return ln.clean_lines(views.log_lines(spark, sf)).select("log_id", "line_no", "clean")


@query("error_lines", f"with {_ERRORS} select log_id, line_no, clean from errors")
def _(spark, sf):
    return ln.error_lines(views.log_lines(spark, sf)).select("log_id", "line_no", "clean")


@query("error_count", f"""with {_ERRORS} select log_id, count(e.line_no) as errors
  from log_lines l left join errors e using (log_id, line_no) group by 1""")
def _(spark, sf):
    return ln.error_count(views.log_lines(spark, sf))


_MATCHED = f"""{_CLEAN}, matched as (
  select log_id, line_no, {sv.first_of('clean', fixed.ERROR_PATTERNS)} as pattern,
         {sv.first_of('clean', fixed.IGNORE_PATTERNS)} as ignored_by
  from clean_lines)"""
_COUNTS = """counts as (select log_id, case when ignored_by is null then 'error' else 'ignored' end as kind,
  coalesce(ignored_by, pattern) as pattern, count(*) as lines from matched where pattern is not null group by 1, 2, 3)"""
_SAMPLES = """samples as (select log_id, pattern, count(*) as lines,
  case when count(*) <= 5 then string_agg(line_no + 1, ',' order by line_no)
       else array_to_string(list(line_no + 1 order by line_no)[1:5], ',') || ' ... ' || max(line_no + 1) end
  || ' (' || count(*) || ' total)' as sample
  from matched where pattern is not null and ignored_by is null group by 1, 2)"""


@query("error_pattern_counts", f"with {_MATCHED}, {_COUNTS} select * from counts")
def _(spark, sf):
    return ln.error_pattern_counts(views.log_lines(spark, sf))


@query("error_line_samples", f"with {_MATCHED}, {_SAMPLES} select * from samples")
def _(spark, sf):
    return ln.error_line_samples(views.log_lines(spark, sf))


def _flat(col):
    entries = F.transform(F.map_entries(col), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return F.array_join(F.array_sort(entries), "; ")


_SUMMARY = f"""{_MATCHED}, {_COUNTS}, {_SAMPLES}
select log_id, cast(sum(case when kind = 'error' then c.lines else 0 end) as bigint) as total_errors_found,
  '2:3:1,3:2:1,5:1:0' as error_settings, 'bottom-up' as search_technique,
  'incremental buckets (errors 1-2: 3b/1a, errors 3-5: 2b/1a, errors 6-10: 1b/0a)' as context_used,
  coalesce(string_agg(c.pattern || '=' || c.lines, '; ' order by c.pattern || '=' || c.lines) filter (kind = 'error'), '') as error_types,
  coalesce(string_agg(c.pattern || '=' || s.sample, '; ' order by c.pattern || '=' || s.sample) filter (kind = 'error'), '') as line_samples,
  coalesce(string_agg(c.pattern || '=' || c.lines, '; ' order by c.pattern || '=' || c.lines) filter (kind = 'ignored'), '') as ignored_patterns,
  true as extraction_capped, 10 as max_errors_extracted
from counts c left join samples s using (log_id, pattern) group by log_id
having sum(case when kind = 'error' then c.lines else 0 end) > 0"""


@query("error_summary", f"with {_SUMMARY}")
def _(spark, sf):
    out = sec.error_summary(views.log_lines(spark, sf), BUCKET_PLAN)
    for c in ("error_types", "line_samples", "ignored_patterns"):
        out = out.withColumn(c, _flat(F.col(c)))
    return out


_ISLANDS = f"""{_ERRORS}, {_SIZES},
near as (select log_id, line_no, greatest(line_no - 3, 0) as s, line_no + 2 as e,
  max(line_no + 2) over (partition by log_id order by line_no rows between unbounded preceding and 1 preceding) as prev_e from errors),
marked as (select *, sum(case when prev_e is null or s > prev_e then 1 else 0 end) over (partition by log_id order by line_no) as island from near)
select log_id, min(s) as start_line, least(max(e), max(total_lines)) as end_line, count(*) as errors
from marked join sizes using (log_id) group by log_id, island"""


@query("fixed_context", f"with {_ISLANDS}")
def _(spark, sf):
    return sec.fixed_context(views.log_lines(spark, sf), 3, 1)


@query("bottom_up_sections", f"with recursive {_FIXED} select * from sections")
def _(spark, sf):
    return sec.bottom_up_sections(views.log_lines(spark, sf), FIXED_PLAN)


@query("incremental_buckets", f"with recursive {_CAPPED} select * from sections")
def _(spark, sf):
    return sec.bottom_up_sections(views.log_lines(spark, sf), BUCKET_PLAN)


DEFAULT_CAPPED = _CAPPED.replace(_BEFORE.replace("n <", "p.n <"), DEFAULT_BEFORE.replace("n <", "p.n <")).replace(
    _BEFORE, DEFAULT_BEFORE).replace(_AFTER, DEFAULT_AFTER).replace("p.n + 1 < 10", "p.n + 1 < 300")


@query("incremental_buckets_default", f"with recursive {DEFAULT_CAPPED} select * from sections")
def _(spark, sf):
    return sec.bottom_up_sections(views.log_lines(spark, sf))


@query("format_sections_default", f"with recursive {DEFAULT_CAPPED}, {_TEXTS} select * from texts")
def _(spark, sf):
    return sec.format_sections(views.log_lines(spark, sf))


_DEFAULT_SUMMARY = _SUMMARY.replace("'2:3:1,3:2:1,5:1:0'", "'50:50:10,100:10:5,150:5:2'").replace(
    "errors 1-2: 3b/1a, errors 3-5: 2b/1a, errors 6-10: 1b/0a", "errors 1-50: 50b/10a, errors 51-150: 10b/5a, errors 151-300: 5b/2a"
).replace("10 as max_errors_extracted", "300 as max_errors_extracted")


@query("error_summary_default", f"with {_DEFAULT_SUMMARY}")
def _(spark, sf):
    out = sec.error_summary(views.log_lines(spark, sf))
    for c in ("error_types", "line_samples", "ignored_patterns"):
        out = out.withColumn(c, _flat(F.col(c)))
    return out


@query("section_texts", f"with recursive {_FIXED}, {_SECTION_TEXTS} select * from section_texts")
def _(spark, sf):
    lines = views.log_lines(spark, sf)
    return sec.section_texts(lines, sec.bottom_up_sections(lines, FIXED_PLAN))


@query("format_sections", f"with recursive {_CAPPED}, {_TEXTS} select * from texts")
def _(spark, sf):
    return sec.format_sections(views.log_lines(spark, sf), BUCKET_PLAN)


@query("adaptive_context", f"""with {_ERRORS}, counted as (select log_id, count(e.line_no) as errors
  from log_lines l left join errors e using (log_id, line_no) group by 1)
  select *, case when errors <= 5 then 50 when errors <= 10 then 10 else 5 end as lines_before,
  case when errors <= 5 then 10 when errors <= 10 then 5 else 2 end as lines_after from counted""")
def _(spark, sf):
    return sec.adaptive_context(ln.error_count(views.log_lines(spark, sf)), ((5, 50, 10), (10, 10, 5), (20, 5, 2)))


@query("grep_context", f"""with {_LINES} select l.log_id, l.line_no, l.raw, contains(l.raw, 'Traceback') as is_hit
  from log_lines l where exists (select 1 from log_lines h where h.log_id = l.log_id and contains(h.raw, 'Traceback')
  and h.line_no between l.line_no - 5 and l.line_no + 5)""")
def _(spark, sf):
    return ln.grep_context(views.log_lines(spark, sf), F.col("raw").contains("Traceback"), 5)


def _docs(spark, sf):
    return views.table(spark, sf, "documents").select(F.col("doc_id").alias("log_id"), F.col("text").alias("content"))


@query("tail_lines", """select doc_id as log_id, case when len(string_split(text, chr(10))) > 5
  then array_to_string(string_split(text, chr(10))[-5:], chr(10)) else text end as content from documents""")
def _(spark, sf):
    return _docs(spark, sf).withColumn("content", ln.tail_lines(F.col("content"), 5))


@query("tail_bytes", """select doc_id as log_id, case when octet_length(encode(text)) > 600
  then right(hex(encode(text)), 1200) else hex(encode(text)) end as tail_hex from documents""")
def _(spark, sf):
    return _docs(spark, sf).select("log_id", F.hex(ln.tail_bytes(F.col("content"), 4)).alias("tail_hex"))


@query("head_cap", """select doc_id as log_id, array_to_string(string_split(text, chr(10))[:10], chr(10)) as content,
  len(string_split(text, chr(10))) >= 10 as truncated, least(len(string_split(text, chr(10))), 10) as total_lines from documents""")
def _(spark, sf):
    return ln.head_cap(_docs(spark, sf), 10)


HYBRID_PATTERNS = ("token", "###")


HYBRID_SQL = """with d as (select doc_id as log_id, text, string_split(text, chr(10)) as p from documents),
  e as (select *, case when len(p) > 3 then p[-3:] else p end as last from d),
  f as (select *, len(list_filter(last, lambda x: (contains(lower(x), 'token') or contains(lower(x), '###')) and not contains(lower(x), '$$$'))) > 0 as hit from e)
  select log_id, case when hit then array_to_string(last, chr(10)) else array_to_string(p[:20], chr(10)) end as content,
  case when hit then 'tail' else 'streaming' end as method, (not hit) and len(p) >= 20 as truncated,
  case when hit then len(last) else least(len(p), 20) end as total_lines from f"""


@query("hybrid_log", HYBRID_SQL)
def _(spark, sf):
    return ln.hybrid_log(_docs(spark, sf), 3, 20, patterns=HYBRID_PATTERNS, ignore=("$$$",))


_DOC_LINES = f"""log_lines as (select doc_id as log_id, unnest(range(len(string_split(text, chr(10))))) as line_no,
    unnest(string_split(text, chr(10))) as raw from documents where length(text) > 0), {sv.clean_lines_cte()},
  {sv.errors_cte(('tion ', '###'), ('$$$',))}"""


@query("extract_error_sections", f"""with recursive {_CAPPED.replace(_ERRORS, _DOC_LINES)}, {_TEXTS}
  select doc_id as log_id, (select count(*) from errors e where e.log_id = doc_id) as total_errors, coalesce(sections, 0) as sections, t.text
  from documents left join texts t on t.log_id = doc_id""")
def _(spark, sf):
    out = sec.extract_error_sections(_docs(spark, sf), BUCKET_PLAN, patterns=("tion ", "###"), ignore=("$$$",))
    return out.drop("content")
