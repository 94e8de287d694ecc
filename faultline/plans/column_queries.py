"""Queries for text, key and path rules over whole tables, and for model replies."""

from pyspark.sql import functions as F

from ..functions import fixed, replies, text
from . import sql_views as sv
from . import views
from .registry import query




def _docs(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", "text")


@query("sanitize_name", "select doc_id, trim(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{N}\\-_.]', '_', 'g'), '_+', '_', 'g'), '_') as name from documents")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", text.sanitize_name(F.col("text")).alias("name"))


_SAFE = "trim(regexp_replace(regexp_replace({}, '[^\\p{{L}}\\p{{N}}\\-_.]', '_', 'g'), '_+', '_', 'g'), '_')"


@query("artefact_path", f"""with {sv.PIPELINES}, {sv.JOBS} select job_id,
  {_SAFE.format('project_name')} || '_' || project_id || '/pipeline_' || pipeline_id || '/job_' || job_id || '_' || {_SAFE.format('name')} || '.log' as job_path,
  'jenkins-builds/' || {_SAFE.format('name')} || '/' || pipeline_id || '/stage_' || {_SAFE.format('j.stage')} || '.log' as stage_path,
  replace(replace(lower(project_name), ' ', '_'), '/', '_') as stage_file
  from jobs j join pipelines p using (pipeline_id)""")
def _(spark, sf):
    p = views.pipelines(spark, sf).select("pipeline_id", "project_name", "project_id")
    c = F.col
    return views.jobs(spark, sf).join(p, "pipeline_id").select(
        "job_id", text.job_log_path(c("project_name"), c("project_id"), c("pipeline_id"), c("job_id"), c("name")).alias("job_path"),
        text.stage_log_path(c("name"), c("pipeline_id"), c("stage")).alias("stage_path"),
        text.stage_file_name(c("project_name")).alias("stage_file"),
    )


@query("repo_short_name", f"with {sv.PIPELINES} select pipeline_id, split_part(project_name, '/', -1) as repo from pipelines")
def _(spark, sf):
    return views.pipelines(spark, sf).select("pipeline_id", text.repo_short_name(F.col("project_name")).alias("repo"))


@query("short_sha", f"with {sv.PIPELINES} select pipeline_id, coalesce(left(sha, 7), 'unknown') as commit from pipelines")
def _(spark, sf):
    return views.pipelines(spark, sf).select("pipeline_id", text.short_sha(F.col("sha")).alias("commit"))


@query("normalize_url", "select page_id, lower(rtrim(url || '//', '/')) as url from pages")
def _(spark, sf):
    return views.table(spark, sf, "pages").select("page_id", text.normalize_url(F.concat("url", F.lit("//"))).alias("url"))


@query("email_local_part", "select c_custkey, lower(replace(c_name, '#', '.')) as user_name from customer")
def _(spark, sf):
    return views.users(spark, sf).select(F.col("pos").alias("c_custkey"), text.email_local_part(F.col("email")).alias("user_name"))


def _mask(col: str) -> str:
    return f"case when length({col}) < 12 then '****' else left({col}, 4) || '...[REDACTED***]' || right({col}, 4) end"


@query("mask_token", f"select o_orderkey, {_mask('t')} as masked from (select o_orderkey, left(md5(cast(o_orderkey as varchar)), cast(o_orderkey % 33 as int)) as t from orders)")
def _(spark, sf):
    k = F.col("o_orderkey")
    token = F.left(F.md5(k.cast("string")), (k % 33).cast("int"))
    return views.table(spark, sf, "orders").select("o_orderkey", text.mask_token(token).alias("masked"))


def _mask_sql(col: str) -> str:
    out = col
    for p in reversed(fixed.SECRET_PATTERNS):
        lit = sv.lit(p)
        value = f"regexp_extract({col}, {lit}, 2)"
        out = f"case when regexp_matches({col}, {lit}) then regexp_replace({col}, {lit}, regexp_extract({col}, {lit}, 1) || {_mask(value)}, 'g') else {out} end"
    return f"case when length({col}) > 20 then {out} else {col} end"


_SECRETS = """secrets as (select doc_id, case doc_id % 4 when 0 then replace(text, 'token = ', 'token=')
  when 1 then text || ' PRIVATE-TOKEN: ' || md5(text) when 2 then text || ' secret: ' || left(md5(text), 8) || ' glpat-' || md5(text) || ' glpat-' || md5(text || 'x')
  else 'short ' || doc_id end as text from documents)"""


def _secrets(spark, sf):
    d, t = F.col("doc_id"), F.col("text")
    value = (
        F.when(d % 4 == 0, F.replace(t, F.lit("token = "), F.lit("token=")))
        .when(d % 4 == 1, F.concat(t, F.lit(" PRIVATE-TOKEN: "), F.md5(t)))
        .when(d % 4 == 2, F.concat(t, F.lit(" secret: "), F.left(F.md5(t), F.lit(8)), F.lit(" glpat-"), F.md5(t), F.lit(" glpat-"),
                                   F.md5(F.concat(t, F.lit("x")))))
        .otherwise(F.concat(F.lit("short "), d.cast("string")))
    )
    return _docs(spark, sf).select("doc_id", value.alias("text"))


@query("mask_text", f"with {_SECRETS} select doc_id, {_mask_sql('text')} as masked from secrets")
def _(spark, sf):
    return _secrets(spark, sf).select("doc_id", text.mask_text(F.col("text")).alias("masked"))


@query("mask_map", f"with {_SECRETS}, m as (select doc_id, text as message, md5(text) as api_token, left(text, 5) as password_hint from secrets) select doc_id, {_mask_sql('message')} as message, {_mask('api_token')} as api_token, {_mask('password_hint')} as password_hint from m")
def _(spark, sf):
    t = F.col("text")
    entries = F.create_map(F.lit("message"), t, F.lit("Api_Token"), F.md5(t), F.lit("password_hint"), F.left(t, F.lit(5)))
    out = _secrets(spark, sf).select("doc_id", text.mask_map(entries).alias("m"))
    return out.select("doc_id", F.col("m")["message"].alias("message"), F.col("m")["Api_Token"].alias("api_token"),
                      F.col("m")["password_hint"].alias("password_hint"))


@query("error_text_norm", r"select doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10)) as text from documents")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", text.error_text_norm(F.col("text")).alias("text"))


@query("error_hash", "select doc_id, sha256(text) as error_hash from documents")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", text.error_hash(F.col("text")).alias("error_hash"))


@query("fix_id", "select doc_id, 'fix-' || sha1(text) as id from documents")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", text.fix_id(F.col("text")).alias("id"))


@query("flatten_metadata", """select event_id, 'k' as key, json_extract_string(props, '$.k') as value from events
  union all select event_id, 'run_type', event_type from events union all select event_id, 'run_user', cast(user_id as varchar) from events
  union all select event_id, 'tags', '["a","b"]' from events""")
def _(spark, sf):
    e = views.table(spark, sf, "events")
    meta = F.concat(
        F.regexp_replace("props", r"\}$", ""), F.lit(', "run": {"type": "'), F.col("event_type"), F.lit('", "user": '),
        F.col("user_id").cast("string"), F.lit('}, "tags": ["a","b"]}'),
    )
    return e.select("event_id", F.explode(text.flatten_metadata(meta)).alias("key", "value"))


@query("chunk_text", "select doc_id, i as chunk_no, substring(text, i * 2500 + 1, 2500) as chunk from (select doc_id, text, unnest(range((length(text) + 2499) // 2500)) as i from documents where length(text) > 0)")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", F.posexplode(text.chunks(F.col("text"))).alias("chunk_no", "chunk"))


def _replaced(col: str, pairs) -> str:
    for old, new in pairs:
        col = f"replace({col}, {sv.lit(old)}, {sv.lit(new)})"
    return col


# Symbols are put between the words of the documents, so that there is something to take out.
_DECORATED = "replace(replace(replace(replace(text, 'e ', 'e 🚀 '), 's ', 's ⚙️ ✅ '), 'n ', 'n ❌ '), 'r ', 'r ⚠️ 🔧 ')"


def _decorated():
    out = F.col("text")
    for old, new in (("e ", "e 🚀 "), ("s ", "s ⚙️ ✅ "), ("n ", "n ❌ "), ("r ", "r ⚠️ 🔧 ")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


@query("strip_emoji", f"select doc_id, {_replaced(_DECORATED, [(s, '') for s in fixed.REMOVED_SYMBOLS])} as text from documents")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", text.strip_emoji(_decorated()).alias("text"))


@query("normalize_symbols", f"select doc_id, {_replaced(_replaced(_DECORATED, [(s, '') for s in fixed.REMOVED_SYMBOLS]), fixed.REPLACED_SYMBOLS)} as text from documents")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", text.normalize_symbols(text.strip_emoji(_decorated())).alias("text"))


_STRIPPED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


def _replies(spark, sf):
    """Reply bodies in every shape, with the text of a conversation turn."""
    c = views.table(spark, sf, "conversations")
    t, k = F.to_json(F.struct(F.col("text").alias("t"))), (F.col("conv_id") + F.col("turn")) % 10
    quoted = F.substring(t, 6, 1 << 30)
    quoted = F.left(quoted, F.length(quoted) - 1)

    def shape(before, after):
        return F.concat(F.lit(before), quoted, F.lit(after))

    body = (
        F.when(k == 0, shape('{"choices": [', "]}"))
        .when(k == 1, shape('{"choices": [{"message": ', "}]}"))
        .when(k == 2, shape('{"choices": [{"message": {"content": ', "}}]}"))
        .when(k == 3, shape('{"choices": [{"message": {"content": [{"type": "text", "text": ', '}, "tail", {"type": "image"}]}}]}'))
        .when(k == 4, shape('{"choices": [{"message": {"content": {"text": ', "}}}]}"))
        .when(k == 5, shape('{"choices": [{"text": ', "}]}"))
        .when(k == 6, shape('{"choices": [{"message": {"content": "  "}}, {"index": 1}, {"result": ', "}]}"))
        .when(k == 7, shape('{"message": {"content": ', "}}"))
        .when(k == 8, shape('{"choices": [], "message": ', "}"))
        .otherwise(shape("not json ", ""))
    )
    return c.select("conv_id", "turn", body.alias("body"))


@query("parse_llm_reply", f"""select conv_id, turn, case when (conv_id + turn) % 10 >= 8 then null
  when (conv_id + turn) % 10 = 3 then regexp_replace(text || chr(10) || 'tail', '^\\s+|\\s+$', '', 'g') else nullif({_STRIPPED}, '') end as reply from conversations""")
def _(spark, sf):
    return _replies(spark, sf).select("conv_id", "turn", replies.parse_llm_reply(F.col("body")).alias("reply"))


_SCORED = """scored as (select doc_id, quality, toxic, doc_id % 5 as k from labels)"""


def _scores(spark, sf):
    """Score replies: whole, without some scores, with findings of both kinds, without JSON."""
    d, q, t = F.col("doc_id"), F.col("quality").cast("string"), F.col("toxic")
    k = d % 5
    full = F.concat(
        F.lit('Here: {"quality_score": '), q, F.lit(', "security_score": 7, "maintainability_score": 8.5, "overall_summary": "doc '),
        d.cast("string"), F.lit('", "potential_vulnerabilities": ['),
        F.when(t == 1, '"leak", {"type": "XSS", "severity": "high", "description": " bad ", "line": "x = 1"}, {"type": "CSRF"}').otherwise(""),
        F.lit('], "recommended_improvements": ["test more", "doc"]} done'),
    )
    body = (
        F.when(k < 2, full)
        .when(k == 2, F.concat(F.lit('{"security_score": '), q, F.lit(', "summary_text": "partly"}')))
        .when(k == 3, F.lit(' {"verdict": "fine"} '))
        .otherwise(F.concat(F.lit("  no braces here "), d.cast("string"), F.lit(" ")))
    )
    return views.table(spark, sf, "labels").select("doc_id", body.alias("body"))


@query("extract_json", f"""with {_SCORED} select doc_id, case when k < 2 then 'doc ' || doc_id end as overall_summary,
  case when k = 2 then 'partly' when k = 4 then 'no braces here ' || doc_id end as summary_text, case when k = 3 then 'fine' end as verdict from scored""")
def _(spark, sf):
    out = _scores(spark, sf).withColumn("j", replies.extract_json(F.col("body")))
    return out.select("doc_id", *[F.get_json_object("j", f"$.{c}").alias(c) for c in ("overall_summary", "summary_text", "verdict")])


@query("review_scores", f"""with {_SCORED} select doc_id, case when k < 2 then cast(quality as varchar) else 'N/A' end as quality,
  case when k < 2 then '7' when k = 2 then cast(quality as varchar) else 'N/A' end as security,
  case when k < 2 then '8.5' else 'N/A' end as maintainability,
  case when k < 2 then 'doc ' || doc_id when k = 2 then 'partly' else {sv.lit(fixed.UNSCORED_TEXT)} end as summary,
  case when k < 2 and toxic = 1 then '• leak' || chr(10) || '• *[high]* XSS — bad' || chr(10) || '   → `x = 1`' || chr(10) || '• *[N/A]* CSRF — '
    else {sv.lit(fixed.NO_FINDINGS_TEXT)} end as findings,
  case when k < 2 then '• test more' || chr(10) || '• doc' else {sv.lit(fixed.NO_ADVICE_TEXT)} end as recommendations from scored""")
def _(spark, sf):
    out = _scores(spark, sf).select("doc_id", replies.review_scores(replies.extract_json(F.col("body"))).alias("s"))
    return out.select("doc_id", "s.*")
