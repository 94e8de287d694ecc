"""Stored logs, their listing and metadata, and the service's own logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.blocked import carry_forward, number_rows
from .files import list_files, read_files, read_text_lines


def path_keys(files: DataFrame, path: str = "path") -> DataFrame:
    """Add the keys that a stored log's path tells; `source` is null for other files.

    Layouts: {project}_{id}/pipeline_{id}/job_{id}_{name}.log and jenkins-builds/{job}/{number}/stage_{name}.log or
    console.log.
    """
    # The split path comes out of a generator, so that it is made once for all keys.
    cut = files.select("*", F.explode(F.array(F.split(path, "/"))).alias("_p"))

    def part(i: int) -> Column:
        return F.coalesce(F.try_element_at("_p", F.lit(i)), F.lit(""))

    file, parent, grand = part(-1), part(-2), part(-3)
    job_file, run, project = r"^job_([^_]+)_(.*)\.log$", r"^pipeline_(\d+)$", r"^(.+)_(\d+)$"
    is_job = file.startswith("job_") & parent.startswith("pipeline_") & file.rlike(job_file) & parent.rlike(run) & grand.rlike(project)
    is_stage = (part(-4) == "jenkins-builds") & parent.rlike(r"^\d+$") & (
        (file == "console.log") | (file.startswith("stage_") & file.endswith(".log"))
    )
    kind = F.when(is_job, "gitlab").when(is_stage, "jenkins")
    known = cut.select("*", F.explode_outer(F.array(kind)).alias("source"))
    git, jenkins = F.col("source") == "gitlab", F.col("source") == "jenkins"
    return known.withColumns(
        {
            "project_dir": F.when(git, grand), "project_id": F.when(git, F.regexp_extract(grand, project, 2)).cast("bigint"),
            "pipeline_id": F.when(git, F.regexp_extract(parent, run, 1)).cast("bigint"),
            "job_id": F.when(git, F.regexp_extract(file, job_file, 1)),
            "job_name": F.when(git, F.regexp_extract(file, job_file, 2)).when(jenkins, grand),
            "build_number": F.when(jenkins, parent).cast("bigint"),
            "stage": F.when(jenkins & (file != "console.log"), F.regexp_extract(file, r"^stage_(.*)\.log$", 1)),
        }
    ).drop("_p")


def _file_path() -> Column:
    """The file of a row as it is named: Spark gives it percent-encoded."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def read_log_store(spark: SparkSession, root: str) -> DataFrame:
    """Stored logs with their keys and text, one row per file."""
    files = read_files(list_files(spark, root, "*.log").select("path", "size"))
    return path_keys(files.select("path", F.col("content").cast("string").alias("content")))


def list_artefacts(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime) of all stored files but empty ones; contents are not read."""
    return list_files(spark, root).select("path", "size", F.timestamp_millis("mtime_ms").cast("timestamp_ntz").alias("mtime"))


PIPELINE_METADATA = """project_id bigint, project_name string, pipeline_id bigint, status string, ref string, sha string,
  source string, pipeline_type string, created_at string, finished_at string, duration double, stages array<string>,
  last_updated string, jobs map<string, struct<job_id: bigint, job_name: string, log_file: string, status: string>>"""


def read_metadata_json(spark: SparkSession, root: str) -> DataFrame:
    """All metadata.json files of the tree; unreadable ones are skipped."""
    files = read_files(list_files(spark, root, "metadata.json").select("path", "size"))
    bodies = files.select(F.try_validate_utf8(F.col("content").cast("string")).alias("body")).dropna()
    return spark.read.schema(PIPELINE_METADATA).option("mode", "DROPMALFORMED").json(bodies.rdd.map(lambda r: r.body))


def read_lines(spark: SparkSession, path: str, **options: str | bool) -> DataFrame:
    """Lines of text files in file order: (file, line_no, raw). An empty file has no line.

    A file of any size is read in byte ranges; lines are counted per range and numbered from the sums. A tree of files
    (`recursiveFileLookup`) is listed and read in tasks, whole files are numbered while they are read.
    """
    if options.get("recursiveFileLookup") is True and not set(options) - {"recursiveFileLookup", "pathGlobFilter"}:
        files = list_files(spark, path, str(options.get("pathGlobFilter", "*"))).select("path", "size")
        return read_text_lines(files).select(F.col("path").alias("file"), "line_no", "raw")
    read = spark.read.options(**options).text(path, lineSep="\n").select(
        _file_path().alias("file"), F.col("value").alias("raw"), F.col("_metadata.file_block_start").alias("_from"),
        F.monotonically_increasing_id().alias("_at"),
    )
    return number_rows(read, ["file"], ["_at"], F.col("_from"), "line_no").select("file", "line_no", "raw")


def read_log_lines(spark: SparkSession, root: str) -> DataFrame:
    """Stored logs with their keys, one row per line; `read_log_store` gives small logs as one row each."""
    lines = read_lines(spark, root, pathGlobFilter="*.log", recursiveFileLookup=True)
    return path_keys(lines.withColumnRenamed("file", "path"))


_HEADER = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3} \| "


def _context(parts: Column) -> Column:
    last = F.element_at(parts, -1)
    return F.when((F.size(parts) >= 6) & last.rlike(r"^\w+="), last)


def app_log(lines: DataFrame) -> DataFrame:
    """Records of the service log with `trace_lines`, the number of continuation lines that follow.

    `lines(file, line_no, raw)`. Columns: ts, level, logger, request_id, message, ctx MAP.
    """
    # What later columns use many times comes out of a generator, so that it is made once a line.
    cut = lines.filter(F.col("raw").rlike(_HEADER)).select("file", "line_no", F.explode(F.array(F.split("raw", r" \| "))).alias("_parts"))
    cut = cut.select("*", F.explode(F.array(_context(F.col("_parts")))).alias("_last"))
    parts, last = F.col("_parts"), F.col("_last")
    n = F.size(parts) - F.when(last.isNotNull(), 5).otherwise(4)
    pairs = F.transform(
        F.split(last, r" (?=\w+=)"),
        lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.regexp_replace(p, r"^\w+=", "").alias("value")),
    )
    cut = cut.select("*", F.explode(F.array(pairs)).alias("_pairs"))
    traces = app_log_traces(lines).groupBy("file", "record_line").agg(F.count("*").alias("trace_lines"))
    records = cut.select(
        "file", F.col("line_no").alias("record_line"),
        F.btrim(parts[0]).try_cast("timestamp_ntz").alias("ts"),
        F.btrim(parts[1]).alias("level"), F.btrim(parts[2]).alias("logger"), F.btrim(parts[3]).alias("request_id"),
        F.array_join(F.slice(parts, F.lit(5), n), " | ").alias("message"),
        F.when(last.isNotNull(), text.later_wins(F.col("_pairs"))).alias("ctx"),
    )
    return records.join(traces, ["file", "record_line"], "left").withColumn("trace_lines", F.coalesce("trace_lines", F.lit(0)))


def app_log_traces(lines: DataFrame) -> DataFrame:
    """Continuation lines with the line number of the record they belong to."""
    header = F.col("raw").rlike(_HEADER)
    owned = carry_forward(lines, ["file"], "line_no", last={"record_line": F.when(header, F.col("line_no"))})
    return owned.filter(~header & F.col("record_line").isNotNull()).select("file", "record_line", "line_no", "raw")


def search_app_log(
    records: DataFrame, request_id: str | None = None, pipeline_id: str | None = None, project_id: str | None = None,
    levels: Sequence[str] = (), logger: str | None = None, start: str | None = None, end: str | None = None,
    contains: dict[str, str] | None = None,
) -> DataFrame:
    """Records that meet all given conditions; `contains` are key=value conditions on the context."""
    out = records
    if request_id is not None:
        out = out.filter(F.col("request_id") == request_id)
    for key, value in {"pipeline_id": pipeline_id, "project_id": project_id, **(contains or {})}.items():
        if value is not None:
            out = out.filter(F.col("ctx")[key] == value)
    if levels:
        out = out.filter(F.col("level").isin(*levels))
    if logger is not None:
        out = out.filter(F.col("logger") == logger)
    if start is not None:
        out = out.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out.filter(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    return out


def store_app_log(records: DataFrame, path: str, ids_per_file: int = 100_000, group_bytes: int = 128 << 20) -> None:
    """Write records of `app_log` as a table partitioned by day, with Bloom filters on the request id.

    Rows of a day are in order of time. `ids_per_file` sizes the filters, `group_bytes` the row groups they let a look-up pass over.
    """
    dated = records.withColumn("day", F.to_date("ts")).hint("rebalance", "day").sortWithinPartitions("day", "ts")
    options = {
        "parquet.bloom.filter.enabled#request_id": "true", "parquet.bloom.filter.expected.ndv#request_id": str(ids_per_file),
        # Filters answer only where the column has no dictionary of its own.
        "parquet.enable.dictionary#request_id": "false", "parquet.block.size": str(group_bytes),
    }
    dated.write.options(**options).partitionBy("day").parquet(path)


def search_stored_log(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, **conditions) -> DataFrame:
    """`search_app_log` on a table made by `store_app_log`: other days are not opened, and a request id passes over row groups without it."""
    stored = spark.read.parquet(path)
    for bound, keep in ((start, F.col("day") >= F.to_date(F.lit(start))), (end, F.col("day") <= F.to_date(F.lit(end)))):
        stored = stored if bound is None else stored.filter(keep)
    return search_app_log(stored, start=start, end=end, **conditions).drop("day")


def errors_by_module(records: DataFrame) -> DataFrame:
    return (
        records.filter(F.col("level") == "ERROR").groupBy("logger").agg(F.count("*").alias("errors"))
        .orderBy(F.desc("errors"), "logger")
    )


def daily_project_requests(records: DataFrame, project: str, day: str, key: str = "project_name") -> DataFrame:
    hit = (F.col("ctx")[key] == project) & (F.to_date("ts") == F.lit(day).cast("date"))
    return records.agg(F.count_if(hit).alias("lines"))


def slowest_steps(records: DataFrame, limit: int = 20) -> DataFrame:
    seconds = F.col("ctx")["processing_time"].try_cast("double")
    timed = records.withColumn("processing_time", seconds).filter(F.col("processing_time").isNotNull())
    return timed.orderBy(F.desc("processing_time"), "file", "record_line").limit(limit).select(
        "file", "record_line", "request_id", "message", "processing_time"
    )


def request_trace(records: DataFrame) -> DataFrame:
    """Records of each request in order, with the milliseconds since its former record.

    Requests are cut by hour, so one busy request id does not fill one task.
    """
    placed = records.withColumn("_pos", F.struct("ts", "file", "record_line"))
    hour = F.floor(text.micros(F.col("ts")) / F.lit(3_600_000_000)).cast("bigint")
    timed = carry_forward(placed, ["request_id"], "_pos", last={"_prev": F.col("ts")}, block=hour, inclusive=False)
    gap = text.micros(F.col("ts")) - text.micros(F.col("_prev"))
    return timed.select(
        "request_id", "ts", "file", "record_line", "level", "logger", "message", (gap / 1000).cast("bigint").alias("step_ms")
    )


_API = (
    r"^\[([^\]]+)\] PIPELINE_ID=(\S*) PROJECT_ID=(\S*) URL=(\S*) STATUS=(\S*) DURATION=(\d+)ms "
    r"(?:ERROR=(.*?) )?RESPONSE=(.*)$"
)


def api_calls(lines: DataFrame, column: str = "raw") -> DataFrame:
    """Calls of the API log: ts, pipeline_id, project_id, url, status, duration_ms, error, response."""
    hit = lines.filter(F.col(column).rlike(_API))

    def at(i: int) -> Column:
        return F.regexp_extract(column, _API, i)

    return hit.select(
        at(1).try_cast("timestamp_ntz").alias("ts"), at(2).try_cast("bigint").alias("pipeline_id"),
        at(3).try_cast("bigint").alias("project_id"), at(4).alias("url"), at(5).alias("status"),
        at(6).cast("bigint").alias("duration_ms"), text.filled(at(7)).alias("error"), at(8).alias("response"),
    )


# ---- storage reports ----

def storage_stats(listing: DataFrame) -> DataFrame:
    """One row: projects, pipelines, build jobs, builds, log files and bytes, keys taken from the parsed paths."""
    logs = path_keys(listing).filter(F.col("source").isNotNull())
    owner = F.when(F.col("source") == "gitlab", F.col("project_dir")).otherwise(F.col("job_name"))
    per_run = logs.groupBy("source", owner.alias("_owner"), F.coalesce("pipeline_id", "build_number").alias("_run")).agg(
        F.count("*").alias("_files"), F.sum("size").alias("_bytes")
    )
    per_owner = per_run.groupBy("source", "_owner").agg(
        F.count("*").alias("_runs"), F.sum("_files").alias("_files"), F.sum("_bytes").alias("_bytes")
    )
    git = F.col("source") == "gitlab"
    total = F.coalesce(F.sum("_bytes"), F.lit(0))
    return per_owner.agg(
        F.count_if(git).alias("projects"), F.coalesce(F.sum(F.when(git, F.col("_runs"))), F.lit(0)).alias("pipelines"),
        F.count_if(~git).alias("build_jobs"), F.coalesce(F.sum(F.when(~git, F.col("_runs"))), F.lit(0)).alias("builds"),
        F.coalesce(F.sum("_files"), F.lit(0)).alias("log_files"), total.alias("total_bytes"),
        F.round(total / 1048576, 2).alias("total_mb"),
    )


def list_pipelines(pipelines: DataFrame, job_entries: DataFrame, project_id: int | None = None) -> DataFrame:
    """Stored pipelines with their number of stored jobs."""
    shown = pipelines if project_id is None else pipelines.filter(F.col("project_id") == project_id)
    counts = job_entries.groupBy("pipeline_id").agg(F.count("*").alias("job_count"))
    return shown.join(counts, "pipeline_id", "left").select(
        "project_id", "pipeline_id", "status", "ref", "created_at", F.coalesce("job_count", F.lit(0)).alias("job_count")
    )


def largest_logs(listing: DataFrame, limit: int = 20) -> DataFrame:
    return listing.filter(F.col("path").endswith(".log")).orderBy(F.desc("size"), "path").limit(limit)


def _age_days(mtime: Column, as_of: str) -> Column:
    now = F.lit(as_of).cast("timestamp_ntz")
    return F.floor((text.micros(now) - text.micros(mtime)) / F.lit(86_400_000_000)).cast("bigint")


def expire_artefacts(listing: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """The delete plan (nothing is deleted): run directories with source, size, age and whether they would go.

    A directory is as old as its newest file. `parent_empty` marks those whose project or job directory would be empty.
    """
    p = F.col("path")
    run = F.regexp_extract(p, r"^(.*/pipeline_[^/]+|(?:.*/)?jenkins-builds/[^/]+/\d+)/[^/]+$", 1)
    source = F.when(p.rlike(r"(^|/)jenkins-builds/"), "jenkins").otherwise("gitlab")
    dirs = (
        listing.withColumn("directory", run).filter(F.col("directory") != "")
        .groupBy(source.alias("source"), "directory").agg(F.sum("size").alias("bytes"), F.max("mtime").alias("_newest"))
        .withColumn("age_days", _age_days(F.col("_newest"), as_of)).withColumn("expired", F.col("age_days") > days)
    )
    parent = F.regexp_replace("directory", "/[^/]+$", "")
    kept = dirs.groupBy(parent.alias("_parent")).agg((~F.max(~F.col("expired"))).alias("parent_empty"))
    return dirs.withColumn("_parent", parent).join(kept, "_parent").select(
        "source", "directory", "bytes", "age_days", "expired", "parent_empty"
    )


def expiry_summary(plan: DataFrame) -> DataFrame:
    gone = F.col("expired")
    return plan.groupBy("source").agg(
        F.count_if(gone).alias("directories"), F.coalesce(F.sum(F.when(gone, F.col("bytes"))), F.lit(0)).alias("bytes_freed")
    )


# ---- fixed values: snapshots kept per tier, in days ----
SNAPSHOT_DAYS = (("daily", 7), ("weekly", 4 * 7), ("monthly", 6 * 30))


def expire_snapshots(snapshots: DataFrame, as_of: str, keep_days: Sequence[tuple[str, int]] = SNAPSHOT_DAYS) -> DataFrame:
    """Snapshots with their age and whether the tier's limit is passed; other tiers are kept."""
    limit = F.lit(None).cast("int")
    for tier, days in keep_days:
        limit = F.when(F.col("tier") == tier, days).otherwise(limit)
    return snapshots.withColumn("age_days", _age_days(F.col("mtime"), as_of)).withColumn(
        "expired", F.coalesce(F.col("age_days") > limit, F.lit(False))
    )
