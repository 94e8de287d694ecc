"""Queries over fixes, domain patterns, caches, prompts and reviews."""

from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import knowledge as kn
from ..operators import review as rv
from ..operators.knn import VectorIndex
from ..operators.shared import new_path, settle
from . import payload_queries as pq
from . import sql_views as sv
from . import views
from .registry import query

AS_OF = "2024-01-30 12:00:00"

_FIXES = """fixes as (select 'fix-' || vec_id as id, 'Error V' || vec_id as error_text,
  case label when 7 then ' ' when 8 then '(empty fix)' when 9 then '' else 'do ' || vec_id end as fix_text,
  case when vec_id % 3 = 0 then 'alice' end as approved_by, case when vec_id % 4 <> 0 then 'approved' end as status,
  cast(embedding as double[]) as embedding, vec_id from embeddings where vec_id % 10 <> 0)"""
_QUERIES = """fix_queries as (select sha256('error q' || a.vec_id) as error_hash, a.vec_id,
  ' error q' || a.vec_id || chr(10) || chr(10) || '  line two ' as error_text,
  list_transform(range(1, len(a.embedding) + 1), lambda i: cast(b.embedding[i] as double) + cast(a.embedding[i] as double) * ((2 + (a.vec_id // 10) % 6) / 10)) as embedding
  from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 where a.vec_id % 10 = 0)"""
_DOMAIN = """domain_patterns as (select 'p' || (b.item_id * 10 + 1) as id, b.item_id * 10 + 1 as seq,
  case (b.item_id * 10 + 1) % 3 when 0 then 'IT' when 1 then 'Product' else 'Devops' end as category,
  case when (b.item_id * 10 + 1) % 70 = 1 then ' ' else b.text end as failure, 'see ' || (b.item_id * 10 + 1) as solution,
  cast(e.embedding as double[]) as embedding from benchmark b join embeddings e on e.vec_id = b.item_id * 10 + 1)"""
_SQUARED = "list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: (q.embedding[i] - f.embedding[i]) * (q.embedding[i] - f.embedding[i])))"
_NEAR_FIX = f"""{_FIXES}, {_QUERIES}, near as (
  select q.error_hash as query_id, f.id, f.fix_text, 1 - {_SQUARED} as similarity,
    row_number() over (partition by q.error_hash order by {_SQUARED}, f.id) as rank from fix_queries q, fixes f),
best as (select query_id, min_by(id, rank) as fix_id, min_by(fix_text, rank) as fix_text, min_by(similarity, rank) as confidence
  from near where rank <= 5 and trim(fix_text) not in ('', '(empty fix)') group by 1)"""


def _fix_queries(spark, sf):
    return views.fix_queries(spark, sf).select(F.col("error_hash").alias("query_id"), "embedding")


@query("knn_fix", f"with {_NEAR_FIX} select query_id, fix_id, fix_text, round(confidence, 6) as confidence from best where confidence > 0.78")
def _(spark, sf):
    out = kn.knn_fix(_fix_queries(spark, sf), views.fixes(spark, sf))
    return out.withColumn("confidence", F.round("confidence", 6))


@query("knn_fix_cosine", f"""with {_FIXES}, {_QUERIES}, near as (
  select q.error_hash as query_id, f.id, f.fix_text, list_cosine_similarity(q.embedding, f.embedding) as similarity,
    row_number() over (partition by q.error_hash order by round(list_cosine_similarity(q.embedding, f.embedding), 12) desc, f.id) as rank from fix_queries q, fixes f),
best as (select query_id, min_by(id, rank) as fix_id, min_by(fix_text, rank) as fix_text, min_by(similarity, rank) as confidence
  from near where rank <= 5 and trim(fix_text) not in ('', '(empty fix)') and similarity > 0.3 group by 1)
  select query_id, fix_id, fix_text, round(confidence, 6) as confidence from best""")
def _(spark, sf):
    out = kn.knn_fix(_fix_queries(spark, sf), views.fixes(spark, sf), min_similarity=0.3, metric="cosine")
    return out.withColumn("confidence", F.round("confidence", 6))


@query("knn_fix_index", f"with {_NEAR_FIX} select query_id, fix_id, fix_text, round(confidence, 6) as confidence from best where confidence > 0.78")
def _(spark, sf):
    # Two thirds of the store first, the rest by two inserts, one of them twice.
    fixes, turn = views.fixes(spark, sf), F.pmod(F.xxhash64("id"), F.lit(6))
    index = kn.fix_index(fixes.filter(turn > 1), new_path(spark, "fix-index"))
    for n in (0, 1, 1):
        index.insert(kn.fix_items(fixes.filter(turn == n)), f"late{n}")
    return kn.knn_fix(_fix_queries(spark, sf), VectorIndex(spark, index.location)).withColumn("confidence", F.round("confidence", 6))


_NEAR_DOMAIN = f"""{_DOMAIN}, {_QUERIES}, ranked as (
  select q.error_hash as query_id, f.*, 1 - {_SQUARED} as similarity,
    row_number() over (partition by q.error_hash order by {_SQUARED}, f.id) as rank from fix_queries q, domain_patterns f),
matches as (select query_id, rank, id as pattern_id, category, failure, solution, similarity from ranked where rank <= 5 and similarity >= {{0}})"""


def _matches(spark, sf, least):
    return kn.knn_domain(_fix_queries(spark, sf), views.domain_patterns(spark, sf), min_similarity=least)


@query("knn_domain", f"with {_NEAR_DOMAIN.format(0.55)} select query_id, rank, pattern_id, category, failure, solution, round(similarity, 6) as similarity from matches")
def _(spark, sf):
    return _matches(spark, sf, 0.55).withColumn("similarity", F.round("similarity", 6))


@query("knn_domain_index", f"with {_NEAR_DOMAIN.format(0.55)} select query_id, rank, pattern_id, category, failure, solution, round(similarity, 6) as similarity from matches")
def _(spark, sf):
    index = kn.domain_index(views.domain_patterns(spark, sf), new_path(spark, "domain-index"))
    return kn.knn_domain(_fix_queries(spark, sf), index, min_similarity=0.55).withColumn("similarity", F.round("similarity", 6))


_SNIPPETS = f"""{_NEAR_DOMAIN.format(-0.4)}, snippets as (
  select query_id, 'Domain knowledge (historical patterns):' || chr(10) || string_agg('- [' || category || '] "' ||
    case when length(trim(failure)) > 200 then left(trim(failure), 197) || '...' else trim(failure) end || '" — similarity ≈ ' ||
    printf('%.2f', similarity) || chr(10) || '  Suggested handling: ' || solution, chr(10) order by rank) as snippet
  from matches group by 1)"""


def _snippets(spark, sf):
    return kn.domain_snippet(_matches(spark, sf, -0.4))


@query("domain_snippet", f"with {_SNIPPETS} select * from snippets")
def _(spark, sf):
    return _snippets(spark, sf)


_CACHES = """sme as (select error_hash, 'sme ' || vec_id as fix_text from fix_queries where vec_id % 30 = 0),
ai as (select error_hash, 'ai ' || vec_id as fix_text from fix_queries where vec_id % 20 = 0 and vec_id % 3 <> 2)"""


def _caches(spark, sf):
    q = views.fix_queries(spark, sf)
    at = F.lit(AS_OF).cast("timestamp_ntz")
    v = F.col("vec_id")
    sme = q.filter(v % 30 == 0).select("error_hash", F.concat(F.lit("sme "), v.cast("string")).alias("fix_text"), at.alias("ts"))
    # Entries of the third kind are a day old or more.
    age = F.when(v % 3 == 2, F.expr("interval 25 hours")).otherwise(F.expr("interval 2 hours"))
    ai = q.filter(v % 20 == 0).select("error_hash", F.concat(F.lit("ai "), v.cast("string")).alias("fix_text"), (at - age).alias("cached_at"))
    old = ai.select("error_hash", F.lit("older").alias("fix_text"), (F.col("cached_at") - F.expr("interval 1 hour")).alias("cached_at"))
    return sme, ai.unionByName(old)


_CASCADE = f"""{_NEAR_FIX}, {_CACHES}, cascade as (
  select q.error_hash, case when s.error_hash is not null then 'sme_cache' when a.error_hash is not null then 'ai_cache'
    when b.query_id is not null then 'vector_db' else 'generated' end as source,
    coalesce(s.fix_text, a.fix_text, b.fix_text) as fix_text,
    case when s.error_hash is null and a.error_hash is null then b.confidence end as confidence
  from fix_queries q left join sme s using (error_hash) left join ai a using (error_hash)
  left join (select * from best where confidence > 0.78) b on b.query_id = q.error_hash)"""


def _cascade(spark, sf):
    sme, ai = _caches(spark, sf)
    return kn.resolve_fix_cascade(views.fix_queries(spark, sf), sme, ai, views.fixes(spark, sf), AS_OF)


@query("resolve_fix_cascade", f"with {_CASCADE} select error_hash, source, fix_text, round(confidence, 6) as confidence from cascade")
def _(spark, sf):
    return _cascade(spark, sf).withColumn("confidence", F.round("confidence", 6))


@query("live_ai_cache", f"with {_QUERIES}, {_CACHES} select * from ai")
def _(spark, sf):
    return kn.live_ai_cache(_caches(spark, sf)[1], AS_OF).select("error_hash", "fix_text")


_PAYLOAD_ERRORS = f"""{pq.GITLAB_DEFAULT}, {_FIXES}, occurrences as (
  select * exclude (error_text, failed), regexp_replace(error_text, '^\\s+|\\s+$', '', 'g') as error_text from failures where length(trim(error_text)) > 0),
  hashed as (select *, sha256(error_text) as error_hash from occurrences),
  once as (select error_hash, any_value(error_text) as error_text, cast(any_value(length(error_text)) as bigint) as size from hashed group by 1),
  asked as (select error_hash, e.embedding from once join embeddings e on e.vec_id = size % (select count(*) from embeddings))"""


@query("resolve_failures", f"""with recursive {_PAYLOAD_ERRORS}, near as (
    select q.error_hash, f.id, f.fix_text, 1 - {_SQUARED} as similarity, row_number() over (partition by q.error_hash order by {_SQUARED}, f.id) as rank
    from (select error_hash, cast(embedding as double[]) as embedding from asked where left(error_hash, 1) > '4') q, fixes f),
  best as (select error_hash, min_by(fix_text, rank) as fix_text, min_by(similarity, rank) as confidence from near
    where rank <= 5 and similarity > 0.78 and trim(fix_text) not in ('', '(empty fix)') group by 1)
  select h.* exclude (source), h.source as ci, case when left(error_hash, 1) < '2' then 'sme_cache' when left(error_hash, 1) < '5' then 'ai_cache'
      when b.fix_text is not null then 'vector_db' else 'generated' end as source,
    case when left(error_hash, 1) < '2' then 'by hand ' || left(error_hash, 6) when left(error_hash, 1) < '5' then 'by model ' || left(error_hash, 6) else b.fix_text end as fix_text,
    case when left(error_hash, 1) > '4' then round(b.confidence, 6) end as confidence
  from hashed h left join best b using (error_hash)""")
def _(spark, sf):
    failures = settle(pq.default_failures(spark, sf), "payload-rows")
    errors = settle(kn.distinct_errors(failures), "distinct")
    first, short = F.left("error_hash", F.lit(1)), F.left("error_hash", F.lit(6))
    at = F.lit(AS_OF).cast("timestamp_ntz")
    sme = errors.filter(first < "2").select("error_hash", F.concat(F.lit("by hand "), short).alias("fix_text"), at.alias("ts"))
    ai = errors.filter((first >= "2") & (first < "5")).select("error_hash", F.concat(F.lit("by model "), short).alias("fix_text"), at.alias("cached_at"))
    vectors = views.table(spark, sf, "embeddings").select("vec_id", "embedding")
    size = F.pmod(F.length("error_text").cast("bigint"), F.lit(vectors.count()))
    embeddings = errors.withColumn("vec_id", size).join(vectors, "vec_id").select("error_hash", F.col("embedding").cast("array<double>").alias("embedding"))
    out = kn.resolve_failures(failures, embeddings, sme, ai, views.fixes(spark, sf), AS_OF)
    return out.drop("failed").withColumn("confidence", F.round("confidence", 6))


_PROMPT_HEAD = "'Pipeline context:' || chr(10) || 'Repository: r' || vec_id || case when vec_id % 20 = 0 then chr(10) || 'Branch: main' else '' end || chr(10) || 'Step: build'"


@query("build_prompts", f"""with {_SNIPPETS} select error_hash, {sv.lit(chr(10).join(fixed.SYSTEM_PROMPT))} ||
  coalesce(chr(10) || chr(10) || 'Domain knowledge snippet:' || chr(10) || snippet, '') || chr(10) || chr(10) ||
  'Enterprise CI/CD infrastructure overview (internal docs):' || chr(10) || 'One overview.' as system_prompt,
  {_PROMPT_HEAD} || chr(10) || chr(10) || 'Error log:' || chr(10) || repeat('-', 20) || chr(10) || 'error q' || vec_id || chr(10) || 'line two' ||
  chr(10) || repeat('-', 20) || chr(10) || chr(10) || 'Now propose a fix as described in the system instructions.' as user_prompt
  from fix_queries left join snippets on query_id = error_hash""")
def _(spark, sf):
    v = F.col("vec_id")
    none = F.lit(None).cast("string")
    errors = views.fix_queries(spark, sf).select(
        "error_hash", "error_text", F.concat(F.lit("r"), v.cast("string")).alias("repo"),
        F.when(v % 20 == 0, "main").otherwise("").alias("branch"), none.alias("commit"), none.alias("job_name"),
        F.lit("build").alias("step_name"), none.alias("pipeline_id"), none.alias("triggered_by"),
    )
    return kn.build_prompts(errors, _snippets(spark, sf), " One overview.\n")


@query("search_fixes_by_error", f"with {_FIXES} select id, error_text from fixes where contains(lower(error_text), 'r v1')")
def _(spark, sf):
    return kn.search_fixes_by_error(views.fixes(spark, sf), "R V1").select("id", "error_text")


@query("search_fixes_index", f"with {_FIXES} select id, error_text, approved_by from fixes where contains(lower(error_text), 'r v1')")
def _(spark, sf):
    stored = views.fixes(spark, sf).select("id", "error_text", "approved_by")
    index = kn.error_text_index(stored, new_path(spark, "error-texts"))
    return kn.search_fixes_by_error(index, "R V1").select("id", "error_text", "approved_by")


@query("list_fixes", f"""with {_FIXES} select id, coalesce(status, 'unknown') as status, coalesce(approved_by, 'N/A') as approved_by,
  error_text, case when fix_text = '' then '(empty fix)' else fix_text end as fix_text from fixes""")
def _(spark, sf):
    return kn.list_fixes(views.fixes(spark, sf))


@query("fix_store_count", f"with {_FIXES} select count(*) as fixes from fixes")
def _(spark, sf):
    return kn.fix_store_count(views.fixes(spark, sf))


def _ids(spark, sf):
    e = views.table(spark, sf, "embeddings").filter("vec_id % 7 = 0")
    return e.select(F.concat(F.lit("fix-"), F.col("vec_id").cast("string")).alias("id"))


def _labelled(*parts):
    out = None
    for label, df in parts:
        rows = df.select("id", F.lit(label).alias("outcome"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("delete_fixes_by_id", f"""with {_FIXES} select id, case when vec_id % 7 = 0 then 'deleted' else 'kept' end as outcome from fixes
  union all select 'fix-' || vec_id, 'unknown' from embeddings where vec_id % 7 = 0 and vec_id % 10 = 0""")
def _(spark, sf):
    kept, gone, unknown = kn.delete_fixes_by_id(views.fixes(spark, sf), _ids(spark, sf))
    return _labelled(("kept", kept), ("deleted", gone), ("unknown", unknown))


@query("delete_fixes_by_error", f"with {_FIXES} select id, case when contains(lower(error_text), 'v12') then 'deleted' else 'kept' end as outcome from fixes")
def _(spark, sf):
    kept, gone = kn.delete_fixes_by_error(views.fixes(spark, sf), "V12")
    return _labelled(("kept", kept), ("deleted", gone))


@query("delete_all_fixes", f"with {_FIXES} select id, 'deleted' as outcome from fixes")
def _(spark, sf):
    kept, gone = kn.delete_all_fixes(views.fixes(spark, sf))
    return _labelled(("kept", kept), ("deleted", gone))


@query("edit_fix", f"""with {_FIXES} select id, error_text, case when vec_id % 7 = 0 and vec_id % 2 = 0 then 'new ' || vec_id else fix_text end as fix_text,
  approved_by from fixes""")
def _(spark, sf):
    e = views.table(spark, sf, "embeddings").filter("vec_id % 7 = 0")
    s = F.col("vec_id").cast("string")
    edits = e.select(
        F.concat(F.lit("fix-"), s).alias("id"),
        F.when(F.col("vec_id") % 2 == 0, F.concat(F.lit("new "), s)).otherwise("  ").alias("fix_text"),
    )
    return kn.edit_fix(views.fixes(spark, sf), edits).select("id", "error_text", "fix_text", "approved_by")


@query("save_fix", """with c as (select *, case when vec_id % 3 = 0 then 'generated' when vec_id % 3 = 1 then 'approved' else 'edited' end as status,
    case when vec_id % 11 = 0 then ' ' else 'do ' || vec_id end as fix_text,
    case when vec_id % 13 = 0 then '(missing error)' else 'err ' || (vec_id // 2) end as error_text from embeddings),
  ok as (select * from c where status <> 'generated' and trim(fix_text) <> '' and vec_id % 17 <> 0),
  firsts as (select error_text, min(vec_id) as vec_id from ok group by 1)
  select 'fix-' || sha1(error_text) as id, error_text, fix_text, status, 'slack' as meta_source, cast(vec_id as varchar) as meta_run_no
  from ok join firsts using (error_text, vec_id) where error_text not in (select 'err ' || (vec_id // 2) from embeddings where vec_id % 8 = 0)""")
def _(spark, sf):
    e = views.table(spark, sf, "embeddings")
    v, s = F.col("vec_id"), F.col("vec_id").cast("string")
    half = F.floor(v / 2).cast("string")
    rows = e.select(
        F.when(v % 13 == 0, "").otherwise(F.concat(F.lit("err "), half)).alias("error_text"),
        F.when(v % 11 == 0, " ").otherwise(F.concat(F.lit("do "), s)).alias("fix_text"),
        F.lit("bob").alias("approver"),
        F.when(v % 3 == 0, "generated").when(v % 3 == 1, "approved").otherwise("edited").alias("status"),
        F.concat(F.lit('{"source": "slack", "run": {"no": '), s, F.lit("}}")).alias("metadata"),
        F.when(v % 17 != 0, F.col("embedding")).alias("embedding"), v.alias("seq"),
    )
    stored = e.filter("vec_id % 8 = 0").select(text.fix_id(F.concat(F.lit("err "), half)).alias("id")).distinct()
    return kn.save_fix(rows, stored).select(
        "id", "error_text", "fix_text", "status", F.col("metadata")["source"].alias("meta_source"),
        F.col("metadata")["run_no"].alias("meta_run_no"),
    )


@query("index_domain_patterns", f"""with {_DOMAIN}, ok as (select * from domain_patterns where trim(failure) <> ''),
  firsts as (select failure, min(seq) as seq from ok group by 1)
  select sha256(failure) as id, category, solution from ok join firsts using (failure, seq)
  where failure not in (select text from benchmark where item_id % 2 = 0)""")
def _(spark, sf):
    stored = views.table(spark, sf, "benchmark").filter("item_id % 2 = 0").select(F.sha2("text", 256).alias("id"))
    return kn.index_domain_patterns(views.domain_patterns(spark, sf), stored).select("id", "category", "solution")


_RECORDS = """records as (select conv_id || ':' || turn as error_id, 'talk ' || conv_id as error, 'fix ' || turn as fix, role as source,
  conv_id * 100 + turn as ts from conversations)"""


@query("lookup_fix_record", f"""with {_RECORDS}, keys as (select error_id as key from records where ts % 2 = 0
    union all select distinct error from records union all select 'nobody ' || conv_id from conversations where turn = 0),
  newest as (select error, max_by(error_id, ts) as error_id from records group by 1)
  select k.key, r.error_id, r.fix, r.source from keys k left join newest n on n.error = k.key
  left join records r on r.error_id = coalesce((select x.error_id from records x where x.error_id = k.key), n.error_id)""")
def _(spark, sf):
    c = views.table(spark, sf, "conversations")
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    records = c.select(
        F.concat(conv, F.lit(":"), turn).alias("error_id"), F.concat(F.lit("talk "), conv).alias("error"),
        F.concat(F.lit("fix "), turn).alias("fix"), F.col("role").alias("source"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("ts"),
    )
    keys = (
        records.filter("ts % 2 = 0").select(F.col("error_id").alias("key"))
        .unionByName(records.select(F.col("error").alias("key")).distinct())
        .unionByName(c.filter("turn = 0").select(F.concat(F.lit("nobody "), conv).alias("key")))
    )
    return kn.lookup_fix_record(keys, records)


_REVIEWS = """acts as (select conv_id as error_id, turn as seq, case when role <> 'user' then 'button' else 'reply' end as kind,
  case when role = 'system' then 'edit' when role = 'user' then null when length(text) % 5 = 0 then 'approve' when length(text) % 5 = 4 then 'discard' else 'edit' end as action,
  'U' || (case when length(text) % 4 = 0 then conv_id % 2 + 1 else conv_id % 2 end) as user_id,
  case when role = 'user' and length(text) % 5 <> 0 then case when length(text) % 5 = 1 then 'x' else 'm' end || conv_id end as thread_ts,
  case when role = 'user' then 'try ' || length(text) end as text from conversations),
recs as (select distinct conv_id as error_id, 'fix ' || conv_id as fix, 'm' || conv_id as message_ts from conversations where conv_id % 6 <> 5)"""


@query("lookup_thread", f"""with {_REVIEWS}, opened as (select error_id, min_by(user_id, seq) as user_id from acts where kind = 'button' and action = 'edit' group by 1)
  select a.error_id, a.seq, r.error_id as thread_error, coalesce(r.error_id = o.error_id, false) as valid
  from acts a left join recs r on r.message_ts = a.thread_ts
  left join opened o on o.error_id % 40 = a.error_id % 40 and o.user_id = a.user_id and o.error_id = a.error_id where a.kind = 'reply'""")
def _(spark, sf):
    acts = views.reviews(spark, sf)
    channel = F.concat(F.lit("c"), F.col("error_id").cast("string"))
    replies = acts.filter("kind = 'reply'").withColumn("channel_id", channel)
    threads = views.review_records(spark, sf).withColumn("channel_id", channel).select("error_id", "channel_id", "message_ts")
    opened = acts.filter("kind = 'button' and action = 'edit'").groupBy("error_id").agg(F.min_by("user_id", "seq").alias("user_id"))
    out = kn.lookup_thread(replies, threads, opened.withColumn("channel_id", channel))
    return out.select("error_id", "seq", "thread_error", "valid")


_OUTCOMES = f"""{_REVIEWS},
gone as (select error_id, min(seq) as removed from acts where kind = 'button' and action = 'discard' group by 1),
seen as (select a.*, r.fix, r.message_ts, r.error_id is not null and (g.removed is null or a.seq <= g.removed) as present
  from acts a left join recs r using (error_id) left join gone g using (error_id)),
edits as (select *, max(case when kind = 'button' and action = 'edit' and present then seq end) over w as edit_seq,
  max_by(user_id, case when kind = 'button' and action = 'edit' and present then seq end) over w as edit_user
  from seen window w as (partition by error_id order by seq rows between unbounded preceding and current row)),
closing as (select error_id, edit_seq, min(seq) as closed from edits where kind = 'reply' and edit_user = user_id and thread_ts = message_ts and present group by 1, 2),
judged as (select e.*, case when kind = 'button' and not present then 'missing_error'
    when kind = 'button' then case action when 'approve' then 'approved' when 'edit' then 'edit_opened' else 'discarded' end
    when edit_user is null or edit_user <> user_id or coalesce(seq > closed, false) then 'ignored'
    when thread_ts is null then 'must_reply_in_thread' when message_ts is null or thread_ts <> message_ts then 'wrong_thread'
    when not present then 'missing_error' else 'edited' end as outcome
  from edits e left join closing c on c.error_id = e.error_id and c.edit_seq = e.edit_seq),
outcomes as (select *, case when outcome in ('approved', 'edited') then coalesce(last_value(case when outcome = 'edited' then text end ignore nulls) over
    (partition by error_id order by seq rows between unbounded preceding and current row), fix) end as saved_fix from judged)"""


@query("review_outcomes", f"with {_OUTCOMES} select error_id, seq, kind, action, outcome, saved_fix from outcomes")
def _(spark, sf):
    out = rv.review_outcomes(views.reviews(spark, sf), views.review_records(spark, sf))
    return out.select("error_id", "seq", "kind", "action", "outcome", "saved_fix")


@query("review_state", f"""with {_OUTCOMES}, last as (select error_id,
    arg_max(outcome, seq) filter (outcome in ('approved', 'edited')) as o, arg_max(saved_fix, seq) filter (outcome in ('approved', 'edited')) as f,
    arg_max(user_id, seq) filter (outcome in ('approved', 'edited')) as u, arg_max(saved_fix, seq) filter (outcome = 'approved') as sme,
    bool_or(outcome = 'discarded') as gone, count(*) filter (outcome in ('approved', 'edited')) as saves from outcomes group by 1)
  select error_id, case when gone then 'removed' when o is not null then o else 'unchanged' end as source,
  case when not coalesce(gone, false) then coalesce(f, fix) end as fix, u as approved_by, sme as sme_fix, coalesce(saves, 0) as saves
  from recs left join last using (error_id)""")
def _(spark, sf):
    records = views.review_records(spark, sf)
    return rv.review_state(rv.review_outcomes(views.reviews(spark, sf), records), records)
