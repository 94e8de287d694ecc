"""Pipeline events and jobs: classification, filters, routing, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text

METADATA_COLUMNS = (
    "pipeline_id", "project_id", "project_name", "pipeline_type", "status", "ref", "sha", "source", "created_at",
    "finished_at", "duration", "user", "stages",
)


def pipeline_type(source: Column, has_merge_request: Column) -> Column:
    return (
        F.when(F.coalesce(has_merge_request, F.lit(False)), "merge_request")
        .when(source == fixed.CHILD_SOURCE, "child")
        .when(source.isin(*fixed.MAIN_SOURCES), "main")
        .otherwise("unknown")
    )


def classify_pipeline_type(pipelines: DataFrame) -> DataFrame:
    """Add `pipeline_type`; an empty merge request object (null fields) is not a merge request."""
    return pipelines.withColumn("pipeline_type", pipeline_type(F.col("source"), F.col("has_merge_request")))


def project_jobs(pipelines: DataFrame, builds: str = "builds") -> DataFrame:
    """One row per job of the `builds` array, with the nine job fields and their defaults."""
    job = F.col("_job")
    fields = ("id", "name", "stage", "status", "started_at", "finished_at", "duration")
    return pipelines.select("pipeline_id", F.explode(builds).alias("_job")).select(
        "pipeline_id",
        *[job[f].alias("job_id" if f == "id" else f) for f in fields],
        F.coalesce(job["allow_failure"], F.lit(False)).alias("allow_failure"),
        job["runner"].alias("runner"),
    )


def is_processable(status: Column) -> Column:
    return ~F.lower(F.coalesce(status, F.lit(""))).isin(*fixed.UNFINISHED_STATUSES)


def filter_processable(pipelines: DataFrame) -> DataFrame:
    return pipelines.filter(is_processable(F.col("status")))


def filter_jobs_by_status(
    jobs: DataFrame, success: bool = True, failed: bool = True, canceled: bool = False, skipped: bool = False
) -> DataFrame:
    flags = {"success": success, "failed": failed, "canceled": canceled, "skipped": skipped}
    return jobs.filter(F.col("status").isin(*[s for s, on in flags.items() if on]))


def _in_statuses(status: Column, statuses: Sequence[str]) -> Column:
    return F.lit(True) if "all" in statuses else F.lower(F.coalesce(status, F.lit(""))).isin(*statuses)


def filter_pipelines_to_save(
    pipelines: DataFrame, statuses: Sequence[str] = ("all",), projects: Sequence[str] | DataFrame = (),
    excluded: Sequence[str] | DataFrame = (),
) -> DataFrame:
    """Status list, then project white list, then black list when there is no white list.

    Lists may be given as DataFrames with a `project_id` column; they then become semi / anti joins.
    """
    out = pipelines.filter(_in_statuses(F.col("status"), statuses))
    key = F.coalesce(F.col("project_id").cast("string"), F.lit(""))

    def listed(ids: DataFrame) -> DataFrame:
        return ids.select(F.col("project_id").cast("string").alias("_p"))

    if isinstance(projects, DataFrame):
        return out.join(listed(projects), key == F.col("_p"), "left_semi")
    if projects:
        return out.filter(key.isin(*projects))
    if isinstance(excluded, DataFrame):
        return out.join(listed(excluded), key == F.col("_p"), "left_anti")
    return out.filter(~key.isin(*excluded)) if excluded else out


def filter_job_logs(jobs: DataFrame, statuses: Sequence[str] = ("all",)) -> DataFrame:
    return jobs.filter(_in_statuses(F.col("status"), statuses))


def route_event(events: DataFrame) -> DataFrame:
    """Add `request_status`: ignored, skipped or queued."""
    return events.withColumn(
        "request_status",
        F.when(F.coalesce(F.col("event_type"), F.lit("")) != fixed.PIPELINE_HOOK, "ignored")
        .when(~is_processable(F.col("status")), "skipped")
        .otherwise("queued"),
    )


def drop_external_stage(pipelines: DataFrame) -> DataFrame:
    return pipelines.filter(~F.coalesce(F.array_contains("stages", "external"), F.lit(False)))


def route_storage(df: DataFrame, post_enabled: Column, dual_mode: Column, post_ok: Column) -> DataFrame:
    """Add `store_text`: posting is off, or both are wanted, or the post failed."""
    return df.withColumn("store_text", ~post_enabled | dual_mode | ~F.coalesce(post_ok, F.lit(False)))


def filter_metadata_save(pipelines: DataFrame, logs_kept: Column, always: bool = False) -> DataFrame:
    """Metadata rows to keep, with the fixed metadata columns."""
    kept = pipelines if always else pipelines.filter(logs_kept)
    return kept.select(*[c for c in METADATA_COLUMNS if c in pipelines.columns])


def pipeline_summary(pipelines: DataFrame, jobs: DataFrame, job_order: Column) -> DataFrame:
    """One row per pipeline with its duration text, job total and counts per status in first-seen order."""
    per_status = (
        jobs.withColumn("_o", job_order)
        .groupBy("pipeline_id", F.coalesce("status", F.lit("unknown")).alias("_s"))
        .agg(F.count("*").alias("_n"), F.min("_o").alias("_first"))
    )
    seen = F.array_sort(F.collect_list(F.struct("_first", "_n", "_s")))
    totals = per_status.groupBy("pipeline_id").agg(
        F.sum("_n").alias("_jobs"),
        F.array_join(F.transform(seen, lambda x: F.concat(x["_n"].cast("string"), F.lit(" "), x["_s"])), ", ").alias("_text"),
    )
    return pipelines.join(totals, "pipeline_id", "left").select(
        "pipeline_id", "ref", "pipeline_type", "status",
        text.format_duration(F.col("duration")).alias("duration_text"),
        F.coalesce("_jobs", F.lit(0)).alias("jobs"),
        F.coalesce("_text", F.lit("")).alias("job_counts"),
    )


def summary_text(summaries: DataFrame) -> DataFrame:
    """The five-line text of a pipeline summary."""
    s = {c: F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in summaries.columns}
    return summaries.withColumn(
        "summary",
        F.concat(
            F.lit("Pipeline #"), s["pipeline_id"], F.lit(" ("), s["ref"], F.lit(")\nType: "), s["pipeline_type"],
            F.lit("\nStatus: "), s["status"], F.lit("\nDuration: "), s["duration_text"], F.lit("\nJobs: "), s["jobs"],
            F.lit(" total ("), s["job_counts"], F.lit(")"),
        ),
    )
