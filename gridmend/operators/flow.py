"""Time rules over jobs, requests and uploads: batch forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmend.functions import constants as K
from gridmend.functions.distributed import first_n, latest_by, ordinal
from gridmend.session import checkpoint


def stale_jobs(jobs: DataFrame, now: Column, minutes: int = K.STALE_MINUTES, since: str = "created_at") -> DataFrame:
    """Jobs still open past the cutoff, as they are after the reset. ``since`` may name the last status change instead."""
    cutoff = now - F.make_interval(mins=F.lit(minutes))
    late = jobs.filter(F.col("status").isin("pending", "processing") & (F.col(since) < cutoff))
    return late.withColumn("status", F.lit("failed")).withColumn("error_message", F.lit(K.STALE_MESSAGE))


#: Distinct milliseconds of a key that one task reads, and how many block maps are composed at a time.
LIMIT_BLOCK, LIMIT_FAN = 8192, 64
_STEPS = "key string, blk long, brk array<long>, out array<long>"


def _eval(brk: np.ndarray, out: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A step function: ``out[k]`` for x under ``brk[k]`` (the first such k), x itself from the last break on."""
    at = np.searchsorted(brk, x, side="right")
    return np.where(at < len(brk), out[np.minimum(at, len(out) - 1)], x)


def _slim(brk: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = np.append(out[1:] != out[:-1], True)
    return brk[keep], out[keep]


def _compose(steps: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    brk, out = next(steps)
    for b, o in steps:
        # inputs that the first function passes on unchanged meet the breaks of the next one
        tail = b > brk[-1]
        brk, out = _slim(np.concatenate([brk, b[tail]]), np.concatenate([_eval(b, o, out), o[tail]]))
    return brk, out


def rate_limit(requests: DataFrame, max_hits: int, window_seconds: int) -> DataFrame:
    """Every request with its window and the decision. ``requests``: key, ts, ev_id.

    A window opens at the first request after the previous one ran out and lasts ``window_seconds``; denied requests
    do not count. The first ``max_hits`` requests of a window are allowed.

    Windows chain through time, so where a block of requests starts depends on all before it. A block is a step function
    from the end of the window that is open when it begins to the end of the one open after it. The blocks of a key hold
    ``LIMIT_BLOCK`` distinct milliseconds each, whatever the window's length; their functions are composed ``LIMIT_FAN`` at
    a time, level by level, and the entries handed down again, so no task reads more than a block or ``LIMIT_FAN`` functions
    and the blocks mark their windows independently.
    """
    w = window_seconds * 1000
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000)).cast("long")
    r = requests.select("key", "ev_id", "ts", ms.alias("ms"))
    distinct = r.select("key", "ms").distinct()
    points = checkpoint(ordinal(distinct, ["key"], ["ms"], [F.floor(F.col("ms") / 600_000).cast("long")], "n").select("key", "ms", F.floor(F.col("n") / LIMIT_BLOCK).cast("long").alias("blk")))
    top = points.agg(F.max("blk")).first()[0] or 0

    def steps(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf["ms"].to_numpy())
        nxt = np.searchsorted(t, t + w, side="right")
        end = t + w
        for i in range(len(t) - 1, -1, -1):  # the window that opens at a point hands on to the next point after it
            if nxt[i] < len(t):
                end[i] = end[nxt[i]]
        brk, out = _slim(t, end)
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "blk": [pdf["blk"].iloc[0]], "brk": [brk], "out": [out]})

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("blk")
        brk, out = _compose(zip(pdf["brk"], pdf["out"]))
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "blk": [pdf["blk"].iloc[0] // LIMIT_FAN], "brk": [brk], "out": [out]})

    def handed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("blk")
        x, carries = np.array([pdf["carry"].iloc[0]]), []
        for brk, out in zip(pdf["brk"], pdf["out"]):
            carries.append(int(x[0]))
            x = _eval(brk, out, x)
        return pd.DataFrame({"key": pdf["key"], "blk": pdf["blk"], "carry": carries})

    group = F.floor(F.col("blk") / LIMIT_FAN).cast("long")
    levels = []
    if top:
        levels.append(checkpoint(points.groupBy("key", "blk").applyInPandas(steps, _STEPS)))
        while (top := top // LIMIT_FAN) > 0:
            levels.append(checkpoint(levels[-1].groupBy("key", group.alias("grp")).applyInPandas(merged, _STEPS)))
    carried = points.select("key", F.lit(0).cast("long").alias("blk"), F.lit(-1).cast("long").alias("carry")).distinct()
    for level in reversed(levels):
        entry = carried.select(F.col("key").alias("__k"), F.col("blk").alias("__g"), "carry")
        members = level.join(entry, F.col("key").eqNullSafe(F.col("__k")) & (group == F.col("__g"))).select("key", "blk", "brk", "out", "carry", F.col("__g"))
        carried = members.groupBy("key", "__g").applyInPandas(handed, "key string, blk long, carry long")

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        t, carry = np.sort(pdf["ms"].to_numpy()), int(pdf["carry"].iloc[0])
        i = int(np.searchsorted(t, carry, side="right"))
        resets = np.full(len(t), carry, dtype="int64")
        while i < len(t):
            j = int(np.searchsorted(t, t[i] + w, side="right"))
            resets[i:j] = t[i] + w
            i = j
        return pd.DataFrame({"key": pdf["key"].iloc[0], "ms": t, "reset": resets})

    entry = carried.select(F.col("key").alias("__k"), F.col("blk").alias("__g"), "carry")
    known = points.join(entry, F.col("key").eqNullSafe(F.col("__k")) & (F.col("blk") == F.col("__g"))).select("key", "blk", "ms", "carry")
    windows = known.groupBy("key", "blk").applyInPandas(mark, "key string, ms long, reset long").select(F.col("key").alias("__k"), F.col("ms").alias("__ms"), "reset")
    tagged = r.join(windows, F.col("key").eqNullSafe(F.col("__k")) & (F.col("ms") == F.col("__ms"))).select("key", "ev_id", "ts", "ms", "reset")
    allowed = first_n(tagged, ["key", "reset"], ["ms", "ts", "ev_id"], max_hits).select(F.col("key").alias("__k"), F.col("ev_id").alias("__e"), F.lit(True).alias("ok"))
    return (tagged.join(allowed, F.col("key").eqNullSafe(F.col("__k")) & (F.col("ev_id") == F.col("__e")), "left")
            .select("key", "ev_id", "ts", F.col("reset").alias("window_reset_ms"), F.coalesce("ok", F.lit(False)).alias("allowed")))


def upload_dedup(uploads: DataFrame, jobs: DataFrame) -> DataFrame:
    """What an upload leads to: the running job, a re-run of the finished one, or a new job.

    ``uploads``: upload_id, user_id, file_hash. The latest job per (user, hash) is an aggregate.
    """
    latest = latest_by(jobs.select("user_id", "file_hash", "job_id", "status", "created_at"), ["user_id", "file_hash"], ["created_at", "job_id"])
    j = uploads.join(latest, ["user_id", "file_hash"], "left")
    action = F.when(F.col("job_id").isNull(), "new").when(F.col("status").isin("pending", "processing"), "in_progress").otherwise("rerun")
    return j.select("upload_id", "user_id", "file_hash", action.alias("action"), "job_id")


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def activity(visits: DataFrame) -> DataFrame:
    return visits.groupBy("user_id").agg(F.max("ts").alias("last_active_at"), F.count_if(F.col("is_login")).alias("login_count"))


def feedback_upsert(feedback: DataFrame) -> DataFrame:
    """One row per job, the latest rating wins; feedback without a job is kept as it is."""
    return latest_by(feedback.filter("job_id is not null"), ["job_id"], ["created_at", "id"]).unionByName(feedback.filter("job_id is null"))
