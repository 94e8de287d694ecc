"""Statistics, lists and upkeep of the request history. `as_of` stands for 'now' and is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocked import carry_forward
from .shared import settle

CUTS = 64


def moment(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def within_hours(requests: DataFrame, as_of: str, hours: int) -> DataFrame:
    return requests.filter(F.col("timestamp") > moment(as_of) - F.expr(f"interval {hours} hours"))


def request_summary(requests: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """One row: totals, success rate, average time, jobs processed (rows without success count do not add jobs)."""
    done, failed = F.count_if(F.col("status") == "completed"), F.count_if(F.col("status") == "failed")
    rate = F.when(done + failed > 0, done / (done + failed) * 100).otherwise(0.0)
    jobs = F.sum(F.col("success_count") + F.coalesce("error_count", F.lit(0)))
    return within_hours(requests, as_of, hours).agg(
        F.lit(hours).alias("time_period_hours"),
        F.count("*").alias("total_requests"),
        F.round(rate, 2).alias("success_rate"),
        F.round(F.coalesce(F.avg("processing_time"), F.lit(0.0)), 2).alias("avg_processing_time_seconds"),
        F.coalesce(jobs, F.lit(0)).alias("total_jobs_processed"),
    )


def requests_by_status(requests: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    return within_hours(requests, as_of, hours).groupBy("status").agg(F.count("*").alias("requests"))


def requests_by_type(requests: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    kept = within_hours(requests, as_of, hours).filter(F.col("pipeline_type").isNotNull())
    return kept.groupBy("pipeline_type").agg(F.count("*").alias("requests"))


def status_timeline(requests: DataFrame, as_of: str, hours: int = 24, minutes: int = 60) -> DataFrame:
    bucket = F.window("timestamp", f"{minutes} minutes")["start"]
    return (
        within_hours(requests, as_of, hours).groupBy(bucket.alias("time_bucket"), "status")
        .agg(F.count("*").alias("requests")).orderBy("time_bucket", "status")
    )


def activity_health(requests: DataFrame, as_of: str) -> DataFrame:
    recent = F.col("timestamp") > moment(as_of) - F.expr("interval 1 hour")
    return requests.agg(F.count("*").alias("total_rows"), F.count_if(recent).alias("last_hour_rows"))


def project_name() -> Column:
    return F.get_json_object("metadata", "$.project_name")


def success_rate_by_project(requests: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    done = F.count_if(F.col("status") == "completed")
    return (
        within_hours(requests, as_of, hours).groupBy(project_name().alias("project_name"))
        .agg(
            F.count("*").alias("total"), done.alias("completed"),
            F.round(F.lit(100.0) * done / F.count("*"), 2).alias("success_rate"),
        )
        .orderBy(F.desc("total"), "project_name")
    )


def avg_time_by_type(requests: DataFrame) -> DataFrame:
    done = requests.filter(F.col("status") == "completed")
    return done.groupBy("pipeline_type").agg(F.avg("processing_time").alias("avg_duration"), F.count("*").alias("requests"))


def latency_percentiles(requests: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Average, median, P95 and P99, exact and interpolated.

    Times are first counted per value, then ranked by running counts cut at quantiles of the values themselves, so that no
    task holds all values (the built-in exact percentile would) and none gets a busy second alone.
    """
    times = (
        within_hours(requests, as_of, hours).filter(F.col("processing_time").isNotNull())
        .groupBy("processing_time").agg(F.count("*").alias("_n"))
    )
    times = settle(times, "latencies")
    edges = sorted(set(times.approxQuantile("processing_time", [k / CUTS for k in range(1, CUTS)], 0.25 / CUTS)))
    block = F.size(F.filter(F.array(*map(F.lit, edges)).cast("array<double>"), lambda e: e <= F.col("processing_time")))
    ranked = carry_forward(times, [], "processing_time", sums={"_upto": F.col("_n")}, block=block)
    ranked = ranked.withColumn("_total", times.select(F.sum("_n")).scalar())

    def at(q: float, name: str) -> Column:
        rank = F.lit(q) * (F.col("_total") - 1)
        low = F.min(F.when(F.col("_upto") > F.floor(rank), F.col("processing_time")))
        high = F.min(F.when(F.col("_upto") > F.ceil(rank), F.col("processing_time")))
        return (low + (high - low) * F.first(rank - F.floor(rank))).alias(name)

    return ranked.agg(
        (F.sum(F.col("processing_time") * F.col("_n")) / F.sum("_n")).alias("avg_time"),
        at(0.5, "median_time"), at(0.95, "p95_time"), at(0.99, "p99_time"),
    )


def latency_sketches(requests: DataFrame, k: int = 400) -> DataFrame:
    """(hour, requests, seconds, sketch): per hour the number of timed requests, their sum and a mergeable quantile sketch."""
    timed = requests.filter(F.col("processing_time").isNotNull()).withColumn("processing_time", F.col("processing_time").cast("double"))
    return timed.groupBy(F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("hour")).agg(
        F.count("*").alias("requests"), F.sum("processing_time").alias("seconds"), F.kll_sketch_agg_double("processing_time", k).alias("sketch")
    )


def sketched_percentiles(sketches: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Average, median, P95 and P99 from stored `latency_sketches` of whole hours: those that begin after `as_of` less `hours`.

    The average is exact; a percentile is a time that occurred, whose rank is off by 1 % of the requests at most (k = 400), however many
    hours are merged. `latency_percentiles` is the exact form.
    """
    now = moment(as_of)
    rows = sketches.filter((F.col("hour") > now - F.expr(f"interval {hours} hours")) & (F.col("hour") <= now))
    merged = rows.agg(F.sum("requests").alias("requests"), F.sum("seconds").alias("seconds"), F.kll_merge_agg_double("sketch").alias("_s"))

    def at(q: float, name: str) -> Column:
        return F.kll_sketch_get_quantile_double("_s", F.lit(q)).alias(name)

    shown = merged.filter("requests > 0")
    return shown.select("requests", (F.col("seconds") / F.col("requests")).alias("avg_time"), at(0.5, "median_time"), at(0.95, "p95_time"), at(0.99, "p99_time"))


def requests_per_minute(requests: DataFrame, newest: int = 20) -> DataFrame:
    minute = F.date_trunc("minute", "timestamp").alias("minute")
    return requests.groupBy(minute).agg(F.count("*").alias("requests")).orderBy(F.desc("minute")).limit(newest)


def status_last_hour(requests: DataFrame, as_of: str) -> DataFrame:
    return requests_by_status(requests, as_of, 1)


def recent_requests(requests: DataFrame, limit: int = 50) -> DataFrame:
    return requests.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)


def pipeline_history(requests: DataFrame, pipeline_id: int) -> DataFrame:
    return requests.filter(F.col("pipeline_id") == pipeline_id).orderBy(F.desc("timestamp"), F.desc("id"))


def failed_requests(requests: DataFrame, limit: int = 20) -> DataFrame:
    failed = requests.filter(F.col("status") == "failed").orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)
    return failed.select("id", "pipeline_id", project_name().alias("project_name"), "error_message", "timestamp")


def slow_requests(requests: DataFrame, seconds: float = 30, limit: int = 10) -> DataFrame:
    return requests.filter(F.col("processing_time") > seconds).orderBy(F.desc("processing_time"), "id").limit(limit)


def upsert_request_state(inserts: DataFrame, updates: DataFrame, version: str = "event_seq") -> DataFrame:
    """Rows of the request table after all updates: the newest update of an id overwrites all five fields, nulls too."""
    fields = ["status", "processing_time", "success_count", "error_count", "error_message"]
    newest = updates.groupBy("id").agg(F.max_by(F.struct(*fields), version).alias("_u"))
    joined = inserts.join(newest, "id", "left")
    return joined.select(
        *[
            F.when(F.col("_u").isNotNull(), F.col(f"_u.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)
            for c in inserts.columns
        ]
    )


def keep_after_expiry(requests: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return requests.filter(F.col("timestamp") >= moment(as_of) - F.expr(f"interval {days} days"))


def expire_requests(requests: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """One row: how many rows go and how many stay."""
    old = F.col("timestamp") < moment(as_of) - F.expr(f"interval {days} days")
    return requests.agg(F.count_if(old).alias("deleted"), F.count_if(~old).alias("kept"))


def store_requests(requests: DataFrame, path: str) -> None:
    """Write requests as a table partitioned by day."""
    requests.withColumn("day", F.to_date("timestamp")).hint("rebalance", "day").write.partitionBy("day").parquet(path)


def expire_stored(spark: SparkSession, path: str, as_of: str, days: int = 30) -> DataFrame:
    """Take requests older than `days` out of a table made by `store_requests`; one row: how many went and how many stay.

    Whole days go as directories, without being read beyond their row counts; only the day that holds the limit is rewritten, and the files of
    later days stay as they are. Doing it again, also after a run that broke off, changes nothing more. Rows without a time stay.
    """
    stored = spark.read.parquet(path)
    limit = spark.range(1).select((moment(as_of) - F.expr(f"interval {days} days")).alias("at")).first()["at"]
    edge = limit.date()
    counts = {r["day"]: r["n"] for r in stored.groupBy("day").agg(F.count("*").alias("n")).collect()}  # one row per day
    gone = [d for d in counts if d is not None and d < edge]
    deleted = sum(counts[d] for d in gone)
    if edge in counts:
        kept = settle(stored.filter((F.col("day") == F.lit(edge)) & (F.col("timestamp") >= F.lit(limit))), "boundary-day")
        left = kept.count()
        deleted += counts[edge] - left
        if not left:
            gone.append(edge)
        elif left < counts[edge]:
            kept.write.partitionBy("day").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    for d in gone:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/day={d.isoformat()}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return spark.createDataFrame([(deleted, sum(counts.values()) - deleted)], "deleted long, kept long")
