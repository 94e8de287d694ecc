"""Known fixes and domain patterns: look-up, resolution, upkeep, prompts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text
from .knn import VectorIndex, nearest
from .postings import TextIndex
from .shared import settle


def search_fixes_by_error(fixes: DataFrame | TextIndex, needle: str) -> DataFrame:
    """Fixes whose error text contains the needle in any case; an index made by `error_text_index` reads only what can contain it."""
    if isinstance(fixes, TextIndex):
        return fixes.search(needle).withColumnRenamed("text", "error_text")
    return fixes.filter(F.contains(F.lower("error_text"), F.lower(F.lit(needle))))


def error_text_index(fixes: DataFrame, location: str) -> TextIndex:
    """A stored index of the error texts of `fixes(id, error_text, ..)`, with their other columns beside them."""
    return TextIndex.create(fixes.withColumnRenamed("error_text", "text"), location)


def list_fixes(fixes: DataFrame) -> DataFrame:
    return fixes.select(
        "id",
        F.coalesce("status", F.lit("unknown")).alias("status"),
        F.coalesce("approved_by", F.lit("N/A")).alias("approved_by"),
        F.coalesce("error_text", F.lit("N/A")).alias("error_text"),
        F.coalesce(text.filled(F.col("fix_text")), F.lit(fixed.EMPTY_FIX)).alias("fix_text"),
    )


def fix_store_count(fixes: DataFrame) -> DataFrame:
    return fixes.agg(F.count("*").alias("fixes"))


def _usable(fix_text: Column) -> Column:
    return text.not_blank(fix_text).isNotNull() & (text.strip(fix_text) != fixed.EMPTY_FIX)


def _best_fix(near: DataFrame) -> DataFrame:
    best = F.min_by(F.struct("item_id", "fix_text", "similarity"), "rank").alias("_b")
    return near.filter(_usable(F.col("fix_text"))).groupBy("query_id").agg(best).select(
        "query_id", F.col("_b.item_id").alias("fix_id"), "_b.fix_text", F.col("_b.similarity").alias("confidence")
    )


def knn_fix(
    queries: DataFrame, fixes: DataFrame | VectorIndex, k: int = fixed.TOP_K, min_similarity: float = fixed.FIX_SIMILARITY,
    metric: str = "l2sq",
) -> DataFrame:
    """Best usable fix per query: blank fixes are dropped only after the top k, and similarity must exceed the minimum.

    `fixes(id, fix_text, embedding)`, or an index made by `fix_index`, of which only the cells near the queries are read.
    """
    if isinstance(fixes, VectorIndex):
        return _best_fix(fixes.search(queries, k, min_similarity, True))
    near = nearest(queries, fixes.select(F.col("id").alias("item_id"), "embedding"), k, min_similarity, True, metric)
    return _best_fix(near.join(fixes.select(F.col("id").alias("item_id"), "fix_text"), "item_id"))


def fix_index(fixes: DataFrame, location: str, metric: str = "l2sq") -> VectorIndex:
    """A stored index of `fixes(id, fix_text, embedding)`; `insert` takes rows in the shape of `fix_items`."""
    return VectorIndex.create(fix_items(fixes), location, metric)


def fix_items(fixes: DataFrame) -> DataFrame:
    return fixes.select(F.col("id").alias("item_id"), "fix_text", "embedding")


def knn_domain(
    queries: DataFrame, patterns: DataFrame | VectorIndex, k: int = fixed.TOP_K, min_similarity: float = fixed.DOMAIN_SIMILARITY,
    metric: str = "l2sq",
) -> DataFrame:
    """All of the top k domain patterns at or above the minimum, in rank order; `patterns` may be an index made by `domain_index`."""
    shown = ("query_id", "rank", F.col("item_id").alias("pattern_id"), "category", "failure", "solution", "similarity")
    if isinstance(patterns, VectorIndex):
        return patterns.search(queries, k, min_similarity).select(*shown)
    near = nearest(queries, patterns.select(F.col("id").alias("item_id"), "embedding"), k, min_similarity, False, metric)
    return near.join(patterns.select(F.col("id").alias("item_id"), "category", "failure", "solution"), "item_id").select(*shown)


def domain_items(patterns: DataFrame) -> DataFrame:
    return patterns.select(F.col("id").alias("item_id"), "category", "failure", "solution", "embedding")


def domain_index(patterns: DataFrame, location: str, metric: str = "l2sq") -> VectorIndex:
    """A stored index of `patterns(id, category, failure, solution, embedding)`; `insert` takes rows in the shape of `domain_items`."""
    return VectorIndex.create(domain_items(patterns), location, metric)


def error_occurrences(failures: DataFrame) -> DataFrame:
    """One row per error text of a payload row: its header and job columns, error_text (stripped) and error_hash; blank texts are skipped.

    `failures` are rows with `error_lines`, as `build_failures_gitlab` and `build_failures_jenkins` give.
    """
    rows = failures.select("*", F.explode("error_lines").alias("_t")).withColumn("error_text", text.not_blank(text.strip(F.col("_t"))))
    rows = rows.filter(F.col("error_text").isNotNull())
    return rows.withColumn("error_hash", text.error_hash(F.col("error_text"))).drop("_t", "error_lines")


def distinct_errors(failures: DataFrame) -> DataFrame:
    """Error texts of payload rows, one row (error_hash, error_text) per distinct text."""
    return error_occurrences(failures).groupBy("error_hash").agg(F.any_value("error_text").alias("error_text"))


def resolve_failures(
    failures: DataFrame, embeddings: DataFrame, sme_cache: DataFrame, ai_cache: DataFrame, fixes: DataFrame, as_of: str, **knn
) -> DataFrame:
    """Payload rows to resolutions: every occurrence of an error with source, fix_text and confidence of its text; the payload's own source is `ci`.

    `embeddings(error_hash, embedding)`; a text without one is looked up in the caches only. Each distinct text is resolved once, however often
    it occurs; occurrences meet their resolution by hash in a join whose large keys Spark splits.
    """
    found = settle(error_occurrences(failures), "occurrences")
    once = found.groupBy("error_hash").agg(F.any_value("error_text").alias("error_text"))
    asked = settle(once.select("error_hash").join(embeddings.select("error_hash", "embedding"), "error_hash", "left"), "distinct-errors")
    resolved = settle(resolve_fix_cascade(asked, sme_cache, ai_cache, fixes, as_of, **knn), "resolutions")
    return found.withColumnRenamed("source", "ci").join(resolved, "error_hash")


def live_ai_cache(cache: DataFrame, as_of: str, hours: int = fixed.CACHE_HOURS) -> DataFrame:
    """Newest entry per error among those younger than `hours`."""
    now = F.lit(as_of).cast("timestamp_ntz")
    live = cache.filter(F.col("cached_at") > now - F.expr(f"interval {hours} hours"))
    return live.groupBy("error_hash").agg(F.max_by("fix_text", "cached_at").alias("fix_text"), F.max("cached_at").alias("cached_at"))


def resolve_fix_cascade(
    errors: DataFrame, sme_cache: DataFrame, ai_cache: DataFrame, fixes: DataFrame, as_of: str, **knn
) -> DataFrame:
    """(error_hash, source, fix_text, confidence): expert cache, then AI cache, then nearest fix, else 'generated'.

    Errors are resolved once per hash, and only those without a cache hit reach the nearest-fix search.
    """
    once = errors.groupBy("error_hash").agg(F.first("embedding", ignorenulls=True).alias("embedding"))
    sme = sme_cache.groupBy("error_hash").agg(F.max_by("fix_text", "ts").alias("_sme"))
    ai = live_ai_cache(ai_cache, as_of).select("error_hash", F.col("fix_text").alias("_ai"))
    cached = settle(once.join(sme, "error_hash", "left").join(ai, "error_hash", "left"), "cached")
    unresolved = cached.filter(F.col("_sme").isNull() & F.col("_ai").isNull())
    found = knn_fix(unresolved.select(F.col("error_hash").alias("query_id"), "embedding"), fixes, **knn).select(
        F.col("query_id").alias("error_hash"), F.col("fix_text").alias("_knn"), "confidence"
    )
    return cached.join(found, "error_hash", "left").select(
        "error_hash",
        F.when(F.col("_sme").isNotNull(), "sme_cache").when(F.col("_ai").isNotNull(), "ai_cache")
        .when(F.col("_knn").isNotNull(), "vector_db").otherwise("generated").alias("source"),
        F.coalesce("_sme", "_ai", "_knn").alias("fix_text"),
        F.when(F.col("_sme").isNull() & F.col("_ai").isNull(), F.col("confidence")).alias("confidence"),
    )


def lookup_fix_record(keys: DataFrame, records: DataFrame) -> DataFrame:
    """`keys(key)`: the record whose error id is the key, else the record of the newest error id with that error text."""
    by_id = records.groupBy(F.col("error_id").alias("key")).agg(F.max_by(F.struct("error_id", "fix", "source"), "ts").alias("_id"))
    newest = records.groupBy(F.col("error").alias("key")).agg(F.max_by("error_id", "ts").alias("_mapped"))
    by_text = newest.join(by_id.select(F.col("key").alias("_mapped"), F.col("_id").alias("_text")), "_mapped").select("key", "_text")
    found = keys.join(by_id, "key", "left").join(by_text, "key", "left").withColumn("_f", F.coalesce("_id", "_text"))
    return found.select("key", "_f.error_id", "_f.fix", "_f.source")


def lookup_thread(replies: DataFrame, threads: DataFrame, open_edits: DataFrame) -> DataFrame:
    """Replies with the error id of their thread; valid when it is the one the user has open for editing."""
    mapped = replies.join(
        threads.select("channel_id", F.col("message_ts").alias("thread_ts"), F.col("error_id").alias("thread_error")),
        ["channel_id", "thread_ts"], "left",
    )
    edits = open_edits.select("channel_id", "user_id", F.col("error_id").alias("open_error"))
    return mapped.join(edits, ["channel_id", "user_id"], "left").withColumn(
        "valid", F.coalesce(F.col("thread_error") == F.col("open_error"), F.lit(False))
    )


# ---- upkeep ----

def delete_fixes_by_id(fixes: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(what remains, what would go, requested ids that do not exist)."""
    wanted = ids.select("id").distinct()
    return (
        fixes.join(wanted, "id", "left_anti"), fixes.join(wanted, "id", "left_semi"),
        wanted.join(fixes, "id", "left_anti"),
    )


def delete_fixes_by_error(fixes: DataFrame, needle: str) -> tuple[DataFrame, DataFrame]:
    hit = F.coalesce(F.contains(F.lower("error_text"), F.lower(F.lit(needle))), F.lit(False))
    return fixes.filter(~hit), fixes.filter(hit)


def delete_all_fixes(fixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    return fixes.filter(F.lit(False)), fixes


def edit_fix(fixes: DataFrame, edits: DataFrame) -> DataFrame:
    """Replace fix texts by id; blank texts are refused, everything else of the row stays."""
    new = edits.filter(text.not_blank(F.col("fix_text")).isNotNull()).select("id", F.col("fix_text").alias("_new"))
    return fixes.join(new, "id", "left").select(
        *[F.coalesce("_new", "fix_text").alias(c) if c == "fix_text" else F.col(c) for c in fixes.columns]
    )


def save_fix(candidates: DataFrame, stored: DataFrame, gate: bool = True) -> DataFrame:
    """New rows of the fix store from `candidates(error_text, fix_text, approver, status, metadata JSON, embedding, seq)`.

    With the gate only approved or edited fixes with text pass. Rows without embedding are not saved; the first of
    several candidates for one error wins, and an error that is stored already is left alone.
    """
    rows = candidates
    if gate:
        rows = rows.filter(F.col("status").isin("approved", "edited") & text.not_blank(F.col("fix_text")).isNotNull())
    shaped = rows.filter(F.size("embedding") > 0).withColumns(
        {
            "error_text": F.coalesce(text.filled(F.col("error_text")), F.lit("(missing error)")),
            "fix_text": F.coalesce(text.filled(F.col("fix_text")), F.lit("(no fix provided)")),
            "metadata": text.flatten_metadata(F.col("metadata")),
        }
    ).withColumn("id", text.fix_id(F.col("error_text")))
    value = F.struct("error_text", "fix_text", F.col("approver").alias("approved_by"), "status", "metadata", "embedding")
    first = shaped.groupBy("id").agg(F.min_by(value, "seq").alias("_v"))
    return first.join(stored.select("id"), "id", "left_anti").select("id", "_v.*")


def index_domain_patterns(patterns: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows to add to the pattern store; safe to repeat, because stored ids are left out."""
    rows = patterns.filter(text.not_blank(F.col("failure")).isNotNull() & (F.size("embedding") > 0))
    value = F.struct("category", "failure", F.coalesce("solution", F.lit("")).alias("solution"), "embedding")
    first = rows.groupBy(F.sha2("failure", 256).alias("id")).agg(F.min_by(value, "seq").alias("_v"))
    return first.join(stored.select("id"), "id", "left_anti").select("id", "_v.*")


def fix_entries(rows: DataFrame, entry: str = "entry", source: str = "manual_api_bulk", base: Sequence[str] = fixed.FIX_BASE_FIELDS) -> DataFrame:
    """Fix import rows from a MAP<STRING,STRING> column: key aliases, default status, other keys as metadata.

    `outcome` is 'skipped' without error or fix text, else 'ready'.
    """
    e = F.col(entry)

    def first(*keys: str) -> Column:
        return F.coalesce(*[text.filled(e[k]) for k in keys])

    extra = F.map_filter(e, lambda k, v: ~k.isin(*base, "source"))
    tags = F.create_map(F.lit("source"), F.lit(source))
    mode = F.create_map(F.lit("ingestion_mode"), F.coalesce(e["ingestion_mode"], F.lit("manual")))
    meta = F.map_concat(F.map_filter(extra, lambda k, v: k != "ingestion_mode"), tags, mode)
    shaped = rows.withColumns(
        {
            "error_text": first("error_text", "error"), "fix_text": first("fix_text", "fix"),
            "approver": first("approver", "approved_by"), "status": F.coalesce(first("status"), F.lit("manual")),
            "metadata": meta,
        }
    )
    ready = F.col("error_text").isNotNull() & F.col("fix_text").isNotNull()
    return shaped.withColumn("outcome", F.when(ready, "ready").otherwise("skipped")).drop(entry)


def import_outcomes(entries: DataFrame, embedded: Column) -> DataFrame:
    """One row of counts; a ready row without embedding counts as failed."""
    ready = F.col("outcome") == "ready"
    ok = F.coalesce(embedded, F.lit(False))
    return entries.agg(
        F.count("*").alias("total"), F.count_if(ready & ok).alias("imported"), F.count_if(ready & ~ok).alias("failed"),
        F.count_if(~ready).alias("skipped"),
    )


# ---- prompts ----

def domain_snippet(matches: DataFrame) -> DataFrame:
    """One text per query from its ranked domain matches (at most k of them)."""
    failure = text.strip(F.coalesce("failure", F.lit("")))
    short = F.when(F.length(failure) > 200, F.concat(F.left(failure, F.lit(197)), F.lit("..."))).otherwise(failure)
    line = F.concat(
        F.lit("- ["), F.coalesce("category", F.lit("Unknown")), F.lit('] "'), short, F.lit('" — similarity ≈ '),
        F.format_string("%.2f", "similarity"), F.lit("\n  Suggested handling: "),
        text.strip(F.coalesce("solution", F.lit(""))),
    )
    ordered = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return matches.groupBy("query_id").agg(
        F.concat(
            F.lit("Domain knowledge (historical patterns):\n"), F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")
        ).alias("snippet")
    )


_CONTEXT = (
    ("repo", "Repository"), ("branch", "Branch"), ("commit", "Commit"), ("job_name", "Job"), ("step_name", "Step"),
    ("pipeline_id", "Pipeline ID"), ("triggered_by", "Triggered by"),
)


def build_prompts(errors: DataFrame, snippets: DataFrame, overview: str = "") -> DataFrame:
    """System and user prompt per unresolved error; context lines only for fields that are present."""
    joined = errors.join(snippets.withColumnRenamed("query_id", "error_hash"), "error_hash", "left")
    header = F.concat_ws("\n", *[
        F.when(F.length(F.col(c).cast("string")) > 0, F.concat(F.lit(f"{label}: "), F.col(c).cast("string"))) for c, label in _CONTEXT
    ])
    rule = "-" * 20
    user = F.concat(
        F.lit("Pipeline context:\n"), F.coalesce(text.filled(header), F.lit("(no extra pipeline metadata)")),
        F.lit(f"\n\nError log:\n{rule}\n"), text.error_text_norm(F.col("error_text")),
        F.lit(f"\n{rule}\n\nNow propose a fix as described in the system instructions."),
    )
    domain = F.when(F.length("snippet") > 0, F.concat(F.lit("\n\nDomain knowledge snippet:\n"), F.col("snippet"))).otherwise("")
    shown = overview.strip()[: fixed.OVERVIEW_CHARS]
    infra = f"\n\nEnterprise CI/CD infrastructure overview (internal docs):\n{shown}" if shown else ""
    return joined.select(
        "error_hash", F.concat(F.lit("\n".join(fixed.SYSTEM_PROMPT)), domain, F.lit(infra)).alias("system_prompt"),
        user.alias("user_prompt"),
    )
