import datetime as dt
import random
import time

from pyspark.sql import functions as F

from faultline.operators.requests import status_timeline
from faultline.operators.review import review_outcomes
from faultline.operators.shared import new_path
from faultline.streaming import jobs


def stream(spark, rows, files=3):
    path = new_path(spark, "in")
    rows.repartition(files).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, start, source, **args):
    out, mark = new_path(spark, "out"), new_path(spark, "mark")
    start(source, out, mark, **args).awaitTermination()
    return out, mark


def test_timeline_equals_batch(spark):
    start = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame(
        [(i, start + dt.timedelta(minutes=17 * i), "completed" if i % 3 else "failed") for i in range(60)], "id int, timestamp timestamp_ntz, status string"
    )
    out, _ = run(spark, jobs.start_status_timeline, stream(spark, rows))
    want = status_timeline(rows, "2024-01-02 00:00:00", 48)
    pair = lambda df: sorted(tuple(r) for r in df.select("time_bucket", "status", "requests").collect())
    assert pair(jobs.latest_counts(spark, out)) == pair(want)


def test_late_rows_count_and_valid_entries_stay(spark):
    """A row may be far older than what came before, a cache write as old as entries live."""
    at = dt.datetime(2024, 1, 1, 12)
    path, out, mark = new_path(spark, "in"), new_path(spark, "out"), new_path(spark, "mark")
    schema = "id int, timestamp timestamp_ntz, status string"
    for n, back in enumerate((0, 0, 6, 900)):
        spark.createDataFrame([(n, at - dt.timedelta(hours=back), "failed")], schema).coalesce(1).write.mode("append").parquet(path)
        jobs.start_status_timeline(spark.readStream.schema(schema).parquet(path), out, mark).awaitTermination()
    got = {r.time_bucket: r.requests for r in jobs.latest_counts(spark, out).collect()}
    assert got == {at: 2, at - dt.timedelta(hours=6): 1, at - dt.timedelta(hours=900): 1}

    path, out, mark = new_path(spark, "in"), new_path(spark, "out"), new_path(spark, "mark")
    schema = "error_hash string, fix_text string, cached_at timestamp_ntz"
    for key, back in (("a", 0), ("b", 0), ("c", 3), ("d", 23)):
        spark.createDataFrame([(key, "fix", at - dt.timedelta(hours=back))], schema).coalesce(1).write.mode("append").parquet(path)
        jobs.start_ai_cache(spark.readStream.schema(schema).parquet(path), out, mark).awaitTermination()
    assert sorted(r.error_hash for r in jobs.valid_entries(spark, out, "2024-01-01 12:30:00").collect()) == ["a", "b", "c", "d"]


def test_broken_deliveries_are_rejected(spark):
    body = '{"object_attributes": {"id": 1, "status": "failed", "source": "push"}}'
    rows = spark.createDataFrame(
        [("Pipeline Hook", body), ("Pipeline Hook", "not json"), ("Pipeline Hook", body[:20]), ("Pipeline Hook", None), ("Push Hook", "[1]")],
        "hook string, body string",
    )
    good, _ = run(spark, jobs.start_ingest, stream(spark, rows))
    bad, _ = run(spark, jobs.start_rejects, stream(spark, rows))
    assert [r.pipeline_id for r in spark.read.parquet(good).collect()] == [1]
    assert sorted(str(r.body) for r in spark.read.parquet(bad).collect()) == sorted(["not json", body[:20], "None", "[1]"])


def test_every_delivery_is_kept_and_restart_adds_nothing(spark):
    body = '{"object_attributes": {"id": 1, "status": "%s", "source": "push"}}'
    rows = spark.createDataFrame(
        [("Pipeline Hook", body % "failed")] * 2 + [("Pipeline Hook", body % "running"), ("Push Hook", body % "failed")], "hook string, body string"
    )
    source = stream(spark, rows, 2)
    out, mark = new_path(spark, "out"), new_path(spark, "mark")
    for _ in range(2):
        jobs.start_ingest(source, out, mark).awaitTermination()
    assert sorted(r.status for r in spark.read.parquet(out).collect()) == ["ignored", "queued", "queued", "skipped"]


def test_request_changes_keep_newest(spark):
    rows = spark.createDataFrame([(1, 1, "processing"), (1, 2, "failed"), (2, 3, "processing")], "id int, event_seq int, status string")
    out, _ = run(spark, jobs.start_request_changes, stream(spark, rows, 1))
    assert sorted((r.id, r.status) for r in spark.read.parquet(out).collect()) == [(1, "failed"), (2, "processing")]


def test_ai_cache_last_write_wins(spark):
    at = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame(
        [("a", "one", at), ("a", "two", at + dt.timedelta(hours=1)), ("b", "x", at - dt.timedelta(hours=30))], "error_hash string, fix_text string, cached_at timestamp_ntz"
    )
    out, _ = run(spark, jobs.start_ai_cache, stream(spark, rows))
    valid = jobs.valid_entries(spark, out, "2024-01-01 20:00:00").collect()
    assert [(r.error_hash, r.fix_text) for r in valid] == [("a", "two")]
    assert jobs.valid_entries(spark, out, "2024-01-02 01:00:00").count() == 0
    ends = spark.read.parquet(out).filter("fix_text = 'two'").select(F.col("expires_at").cast("string")).first()[0]
    assert ends == "2024-01-02 01:00:00"


def test_ai_cache_entries_leave_the_state_by_themselves(spark):
    """While an entry lives an older write changes nothing; afterwards the key is as new."""
    at = dt.datetime(2024, 1, 1, 12)
    schema = "error_hash string, fix_text string, cached_at timestamp_ntz"

    def after(live_ms):
        path, out, mark = new_path(spark, "in"), new_path(spark, "out"), new_path(spark, "mark")
        for text, back in (("new", 0), ("older", 5)):
            spark.createDataFrame([("a", text, at - dt.timedelta(hours=back)), ("b", None, at)], schema).coalesce(1).write.mode("append").parquet(path)
            jobs.start_ai_cache(spark.readStream.schema(schema).parquet(path), out, mark, live_ms=live_ms).awaitTermination()
            time.sleep(1.2)
        return [r.fix_text for r in spark.read.parquet(out).orderBy("batch").collect()]

    assert after(3_600_000) == ["new"]
    assert after(1_000) == ["new", "older"]
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"


REVIEW = "error_id bigint, seq bigint, kind string, action string, user_id string, channel_id string, thread_ts string, text string, error string"


def test_review_state_lives_across_batches(spark):
    batches = [
        [(1, -1, "record", None, None, "c", "m", "fix", "err"), (1, 0, "button", "edit", "u", "c", None, None, None)],
        [(1, 1, "reply", None, "u", "c", None, "x", None), (1, 2, "reply", None, "u", "c", "m", "\t new\n", None)],
        [(1, 3, "button", "approve", "v", "c", None, None, None), (1, 4, "reply", None, "u", "c", "m", "z", None)],
        [(1, 5, "button", "edit", "u", "c", None, None, None), (1, 6, "reply", None, "u", "c", "m", None, None)],
    ]
    path, out, mark = new_path(spark, "in"), new_path(spark, "out"), new_path(spark, "mark")
    for rows in batches:
        spark.createDataFrame(rows, REVIEW).coalesce(1).write.mode("append").parquet(path)
        jobs.start_review(spark.readStream.schema(REVIEW).parquet(path), out, mark).awaitTermination()
    got = [(r.seq, r.outcome, r.saved_fix) for r in spark.read.parquet(out).orderBy("seq").collect()]
    assert got == [(0, "edit_opened", None), (1, "must_reply_in_thread", None), (2, "edited", "new"), (3, "approved", "new"), (4, "ignored", None), (5, "edit_opened", None), (6, "edited", "")]


def test_reviews_in_any_order_equal_the_batch_operator(spark):
    """Events of a few errors, shuffled over seven micro-batches and partly delivered twice; records as initial state."""
    rng, events = random.Random(4), []
    for error in range(5):
        for seq in range(40):
            kind = rng.choice(("button", "reply"))
            action = rng.choices(("edit", "approve", "other", "discard"), (8, 4, 1, 0.2))[0] if kind == "button" else None
            reply = (rng.choice((None, "m", "m", "x")), f" t{seq} ") if kind == "reply" else (None, None)
            events.append((error, seq, kind, action, rng.choice("uv"), "c", *reply, None))
    records = spark.createDataFrame([(e, f"err {e}", f"fix {e}", "c", "m") for e in range(4)], "error_id long, error string, fix string, channel_id string, message_ts string")
    want = review_outcomes(spark.createDataFrame(events, REVIEW), records)
    want = sorted((r.error_id, r.seq, r.outcome, r.saved_fix) for r in want.collect())
    sent = events + rng.sample(events, 30)
    rng.shuffle(sent)
    path, out, mark = new_path(spark, "in"), new_path(spark, "out"), new_path(spark, "mark")
    for n in range(7):
        spark.createDataFrame(sent[n::7], REVIEW).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(REVIEW).option("maxFilesPerTrigger", 1).parquet(path)
    jobs.start_review(source, out, mark, records=records).awaitTermination()
    assert sorted((r.error_id, r.seq, r.outcome, r.saved_fix) for r in spark.read.parquet(out).collect()) == want
