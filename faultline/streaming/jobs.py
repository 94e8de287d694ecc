"""Event-driven work as Structured Streaming jobs.

Each `start_*` takes a streaming DataFrame and folders in shared storage and returns the running query. By default a
job works off what is there and stops; pass `every` for a processing-time trigger.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import TimerValues

from ..functions import fixed
from ..operators.events import route_event
from ..sources.events import gitlab_events, readable

# Executors get the state functions with the task; the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(fixed)


def _begin(writer, every: str | None) -> StreamingQuery:
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


@contextmanager
def _state_settings(spark: SparkSession, every: str | None) -> Iterator[None]:
    """Settings that a query with own state takes over when it starts: a state store with times to live, and no batches without data
    when the query is to stop at the end of its input."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    if not every:
        wanted["spark.sql.streaming.noDataMicroBatches.enabled"] = "false"
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _append_batches(path: str, partition: str = "batch"):
    """foreachBatch sink that replaces the batch's own folder, so a repeated batch leaves no duplicates."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/{partition}={batch}")

    return write


# ---- ingest: every delivery is a new request row ----

def routed_requests(payloads: DataFrame) -> DataFrame:
    """Payloads `(hook, body)` as request rows with the routed status; `hook` is the kind of event delivered."""
    events = gitlab_events(payloads).withColumn("event_type", F.col("hook"))
    return route_event(events).select(
        "project_id", "pipeline_id", "pipeline_type", F.col("request_status").alias("status"), "ref", "sha", "source",
        "event_type",
    )


def start_rejects(payloads: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Deliveries whose body is no JSON object, as they came; `start_ingest` leaves them out."""
    writer = readable(payloads)[1].writeStream.format("parquet").outputMode("append")
    return _begin(writer.option("path", path).option("checkpointLocation", checkpoint), every)


def start_ingest(payloads: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    writer = routed_requests(payloads).writeStream.format("parquet").outputMode("append")
    return _begin(writer.option("path", path).option("checkpointLocation", checkpoint), every)


# ---- request state: changes are kept as they come, the newest per id is taken on reading ----

def start_request_changes(changes: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Store state changes, one per id and micro-batch (the newest). Nothing has to stay in a state store."""
    fields = [c for c in changes.columns if c not in ("id", "event_seq")]
    sink = _append_batches(path)

    def write(df: DataFrame, batch: int) -> None:
        newest = df.groupBy("id").agg(F.max("event_seq").alias("event_seq"), F.max_by(F.struct(*fields), "event_seq").alias("_v"))
        sink(newest.select("id", "event_seq", "_v.*"), batch)

    return _begin(changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), every)


# ---- live status counts ----

def status_counts(requests: DataFrame, bucket: str = "1 hour") -> DataFrame:
    """Requests per time bucket and status."""
    counts = requests.groupBy(F.window(F.col("timestamp").cast("timestamp"), bucket).alias("w"), "status").agg(F.count("*").alias("requests"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("time_bucket"), "status", "requests")


def start_status_timeline(requests: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Counts of every micro-batch by themselves; `latest_counts` adds them up. A row may come as late as it likes, and there is no
    state to keep."""
    sink = _append_batches(path)
    writer = requests.writeStream.foreachBatch(lambda df, batch: sink(status_counts(df), batch))
    return _begin(writer.option("checkpointLocation", checkpoint), every)


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    """The timeline so far."""
    return spark.read.parquet(path).groupBy("time_bucket", "status").agg(F.sum("requests").alias("requests"))


# ---- AI cache: last write wins, entries live for a day ----

class _CacheEntries(StatefulProcessor):
    """Per key the newest write. The entry leaves the state store by itself when its time to live is over."""

    def __init__(self, live_ms: int):
        self.live_ms = live_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", "micros long", ttlDurationMs=self.live_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        held = self.entry.get()[0] if self.entry.exists() else None
        newest = None
        for row in rows:
            if (held is None or row.micros >= held) and (newest is None or (row.micros, row.fix_text) >= (newest.micros, newest.fix_text)):
                newest = row
        if newest is not None:
            self.entry.update((newest.micros,))
            yield Row(error_hash=key[0], fix_text=newest.fix_text, micros=newest.micros)

    def close(self) -> None:
        pass


def ai_cache(writes: DataFrame, live_ms: int = fixed.CACHE_HOURS * 3_600_000) -> DataFrame:
    """Stream of cache writes `(error_hash, fix_text, cached_at)` -> the entry now valid per key, with its end.

    The state holds one time stamp per key, for `live_ms` after its last write; a write older than it changes nothing. Rows of a key pass
    one by one. Of writes at the same moment the greater text stays. Writes without a key, text or time are left out.
    """
    timed = writes.select("error_hash", "fix_text", F.unix_micros(F.col("cached_at").cast("timestamp")).alias("micros")).dropna()
    entries = timed.groupBy("error_hash").transformWithState(
        _CacheEntries(live_ms), "error_hash string, fix_text string, micros long", "update", "processingTime"
    )
    at = F.timestamp_micros("micros")
    return entries.select("error_hash", "fix_text", at.alias("cached_at"), (at + F.expr(f"interval {fixed.CACHE_HOURS} hours")).alias("expires_at"))


def start_ai_cache(
    writes: DataFrame, path: str, checkpoint: str, every: str | None = None, live_ms: int = fixed.CACHE_HOURS * 3_600_000
) -> StreamingQuery:
    writer = ai_cache(writes, live_ms).writeStream.outputMode("update").foreachBatch(_append_batches(path))
    with _state_settings(writes.sparkSession, every):
        return _begin(writer.option("checkpointLocation", checkpoint), every)


def valid_entries(spark: SparkSession, path: str, as_of: str) -> DataFrame:
    """Entries still valid at `as_of`, newest per key."""
    now = F.lit(as_of).cast("timestamp_ntz")
    rows = spark.read.parquet(path).withColumn("cached_at", F.col("cached_at").cast("timestamp_ntz"))
    newest = rows.groupBy("error_hash").agg(
        F.max_by("fix_text", F.struct("cached_at", "batch")).alias("fix_text"), F.max("cached_at").alias("cached_at")
    )
    return newest.filter(F.col("cached_at") > now - F.expr(f"interval {fixed.CACHE_HOURS} hours"))


# ---- review actions ----

_RECORD = "error string, fix string, channel string, thread string"
_EDIT = "editor string, edit_channel string"
_EVENT = "kind string, action string, user_id string, channel_id string, thread_ts string, text string"
_REVIEW_OUT = "error_id long, seq long, outcome string, saved_fix string"


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _step(state: dict, a: dict) -> tuple[str, str | None]:
    """Outcome and saved text of one event; `state` is changed in place."""
    if a["kind"] == "button":
        if not state.get("error"):
            return "missing_error", None
        if a["action"] == "approve":
            return "approved", state.get("fix")
        if a["action"] == "edit":
            state.update(editor=a["user_id"], edit_channel=a["channel_id"])
            return "edit_opened", None
        if a["action"] == "discard":
            state.update(error=None)
            return "discarded", None
        return "unknown_action", None
    if state.get("editor") != a["user_id"] or state.get("edit_channel") != a["channel_id"]:
        return "ignored", None
    if a["thread_ts"] is None:
        return "must_reply_in_thread", None
    if state.get("thread") != a["thread_ts"] or state.get("channel") != a["channel_id"]:
        return "wrong_thread", None
    if not state.get("error"):
        return "missing_error", None
    state.update(fix=(a["text"] or "").strip(), editor=None, edit_channel=None)
    return "edited", state["fix"]


class _Reviews(StatefulProcessor):
    """Per error its record, the open edit, the number of the next event, and the events that came before their turn."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.record = handle.getValueState("record", _RECORD)
        self.edit = handle.getValueState("edit", _EDIT)
        self.next = handle.getValueState("next", "seq long")
        self.waiting = handle.getMapState("waiting", "seq long", _EVENT)

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: TimerValues) -> None:
        self.record.update(tuple(initialState[n] for n in _names(_RECORD)))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        held: dict = {}
        for value, schema in ((self.record, _RECORD), (self.edit, _EDIT)):
            held.update(zip(_names(schema), value.get(), strict=True) if value.exists() else ())
        due = self.next.get()[0] if self.next.exists() else 0
        begun, first = due, dict(held)
        early = any(True for _ in self.waiting.keys())
        for row in rows:
            if row.kind == "record":
                held.update(error=row.error, fix=row.text, channel=row.channel_id, thread=row.thread_ts)
                continue
            if row.seq != due:
                if row.seq > due:
                    self.waiting.updateValue((row.seq,), tuple(row[n] for n in _names(_EVENT)))
                    early = True
                continue
            event = {n: row[n] for n in _names(_EVENT)}
            while event is not None:
                outcome, saved = _step(held, event)
                yield Row(error_id=key[0], seq=due, outcome=outcome, saved_fix=saved)
                due, event = due + 1, None
                if early and self.waiting.containsKey((due,)):
                    event = dict(zip(_names(_EVENT), self.waiting.getValue((due,)), strict=True))
                    self.waiting.removeKey((due,))
        if held != first:
            self.record.update(tuple(held.get(n) for n in _names(_RECORD)))
            self.edit.update(tuple(held.get(n) for n in _names(_EDIT)))
        if due != begun:
            self.next.update((due,))

    def close(self) -> None:
        pass


def review_outcomes(events: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """Live twin of the batch operator of the same name, keyed by error id.

    `records(error_id, error, fix, channel_id, message_ts)` are known before the first event; a record that comes later is an event of kind
    'record' (error, text = fix, thread_ts = message) and counts at once. The other events of an error are numbered 0, 1, 2, .. by
    `seq` and take effect in this order, however they come: one that is early waits in the state until the ones before it are there, one that
    comes twice counts once. Rows of a key pass one by one.
    """
    initial = None
    if records is not None:
        known = records.select("error_id", "error", "fix", F.col("channel_id").alias("channel"), F.col("message_ts").alias("thread"))
        initial = known.groupBy("error_id")
    return events.groupBy("error_id").transformWithState(_Reviews(), _REVIEW_OUT, "append", "none", initial)


def start_review(
    events: DataFrame, path: str, checkpoint: str, every: str | None = None, records: DataFrame | None = None
) -> StreamingQuery:
    writer = review_outcomes(events, records).writeStream.outputMode("append").format("parquet")
    with _state_settings(events.sparkSession, every):
        return _begin(writer.option("path", path).option("checkpointLocation", checkpoint), every)
