"""Structured Streaming forms of the stateful operators, over the same rules as the batch forms.

The source has no event-time engine, so the policy is ours: one hour of watermark by default, state that expires
with the largest window of the operator. Stateful processors need the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gridmend.functions import constants as K
from gridmend.streaming.review import guest_quota_stream, settle_in_order_stream, settle_stream  # noqa: F401

WATERMARK = "1 hour"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _RateLimiter(StatefulProcessor):
    def __init__(self, max_hits: int, window_ms: int):
        self.max_hits, self.window_ms = max_hits, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "count long, reset long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # one micro-batch of one key, in event order
        batch = pd.concat(list(rows)).sort_values(["ts", "ev_id"])
        count, reset = tuple(self.window.get()) if self.window.exists() else (0, -1)
        out = []
        for ev, ts in zip(batch.ev_id, batch.ts):
            now = int(ts.value // 1_000_000)
            if now > reset:
                count, reset, ok = 1, now + self.window_ms, True
            elif count >= self.max_hits:
                ok = False
            else:
                count, ok = count + 1, True
            out.append((key[0], ev, ts, reset, ok))
        self.window.update((count, reset))
        self.handle.registerTimer(reset)
        yield pd.DataFrame(out, columns=["key", "ev_id", "ts", "window_reset_ms", "allowed"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # a window that has run out decides nothing any more
        if self.window.exists() and self.window.get()[1] <= timerValues.getCurrentWatermarkInMs():
            self.window.clear()
        return iter(())

    def close(self) -> None:
        pass


def rate_limit_stream(requests: DataFrame, max_hits: int, window_seconds: int) -> DataFrame:
    return (requests.withWatermark("ts", WATERMARK).groupBy("key").transformWithStateInPandas(
        _RateLimiter(max_hits, window_seconds * 1000), "key string, ev_id string, ts timestamp, window_reset_ms long, allowed boolean", "Append", "EventTime"))


class _Watchdog(StatefulProcessor):
    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.opened = handle.getValueState("opened", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for status, ts in zip(pdf.status, pdf.ts):
                at = int(ts.value // 1_000_000)
                if status in ("completed", "failed"):
                    if self.opened.exists():
                        self.handle.deleteTimer(self.opened.get()[0] + self.limit_ms)
                        self.opened.clear()
                elif not self.opened.exists():
                    self.opened.update((at,))
                    self.handle.registerTimer(at + self.limit_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.opened.clear()
        yield pd.DataFrame({"job_id": [key[0]], "status": ["failed"], "error_message": [K.STALE_MESSAGE]})

    def close(self) -> None:
        pass


def watchdog_stream(job_events: DataFrame, minutes: int = K.STALE_MINUTES) -> DataFrame:
    """Jobs neither completed nor failed ``minutes`` after they opened. ``job_events``: job_id, status, ts."""
    return (job_events.withWatermark("ts", WATERMARK).groupBy("job_id").transformWithStateInPandas(
        _Watchdog(minutes * 60_000), "job_id string, status string, error_message string", "Append", "EventTime"))


class _Uploads(StatefulProcessor):
    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "job_id string, status string, at long", ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "ev_id"])
        job, status, at = tuple(self.latest.get()) if self.latest.exists() else (None, None, -1)
        out = []
        for ev, ts, kind, j, st in zip(batch.ev_id, batch.ts, batch.kind, batch.job_id, batch.status):
            if kind == "status":
                now = int(ts.value)
                if now >= at:  # an older report that comes later does not undo a newer one
                    job, status, at = j, st, now
            else:
                action = "new" if job is None else "in_progress" if status in ("pending", "processing") else "rerun"
                out.append((ev, *key, action, job))
        if job is not None:
            self.latest.update((job, status, at))
        yield pd.DataFrame(out, columns=["upload_id", "user_id", "file_hash", "action", "job_id"])

    def close(self) -> None:
        pass


def upload_dedup_stream(events: DataFrame, keep_days: int = 365) -> DataFrame:
    """Every upload with what it leads to, as ``flow.upload_dedup`` decides: the running job, a re-run or a new job.

    ``events``: user_id, file_hash, ts, ev_id, kind (upload or status), job_id and status (of status reports). One row of
    state per (user, file), dropped ``keep_days`` after its last report.
    """
    return (events.withWatermark("ts", WATERMARK).groupBy("user_id", "file_hash").transformWithStateInPandas(
        _Uploads(keep_days * 86_400_000), "upload_id string, user_id string, file_hash string, action string, job_id string", "Append", "ProcessingTime"))


def activity_stream(visits: DataFrame) -> DataFrame:
    """Update-mode aggregate: last visit and logins per user."""
    return visits.groupBy("user_id").agg(F.max("ts").alias("last_active_at"), F.count_if(F.col("is_login")).alias("login_count"))


def guest_hours(admitted: DataFrame) -> DataFrame:
    """Admitted guest jobs per address in trailing days, sliding by the hour."""
    return admitted.withWatermark("ts", WATERMARK).groupBy(F.window("ts", "24 hours", "1 hour"), "ip_hash").agg(F.count("*").alias("n"))


def learn_from_labels(labels: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint_dir: str):
    """Approved, non-blank labels handed on exactly once per micro-batch; the file source's offsets are the high-water
    mark, and they advance only when ``apply`` returned."""
    good = labels.filter("status = 'approved' and trim(label) <> ''")
    return good.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
