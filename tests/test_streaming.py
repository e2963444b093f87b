"""Stream results equal batch results over the same events."""

import datetime as dt
import random
import tempfile

import pytest

from gridmend.operators import flow, ledger
from gridmend.streaming import jobs as ST

T0 = dt.datetime(2024, 1, 1)


def run_stream(spark, df, schema, build, name, batches=3):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = df
    step = -(-len(rows) // batches)
    for i in range(batches):
        spark.createDataFrame(rows[i * step:(i + 1) * step], schema).coalesce(1).write.parquet(f"{root}/in/b{i}")
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{root}/in"))
    q = (build(src).writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start())
    q.awaitTermination(120)
    return spark.table(name).collect()


@pytest.fixture(autouse=True)
def rocksdb(spark):
    ST.use_rocksdb(spark)


def test_rate_limit_stream_matches_batch(spark):
    rnd = random.Random(3)
    t, rows = 0, []
    for i in range(120):
        t += rnd.choice([1, 5, 20, 90])
        rows.append((rnd.choice("ab"), f"{i:05d}", T0 + dt.timedelta(seconds=t)))
    schema = "key string, ev_id string, ts timestamp"
    got = run_stream(spark, rows, schema, lambda s: ST.rate_limit_stream(s, 2, 60), "rl")
    want = flow.rate_limit(spark.createDataFrame(rows, schema), 2, 60).collect()
    assert {(r.ev_id, r.allowed, r.window_reset_ms) for r in got} == {(r.ev_id, r.allowed, r.window_reset_ms) for r in want}


def test_settle_stream_matches_batch(spark):
    rnd = random.Random(5)
    rows = [(f"u{rnd.randrange(3)}", f"{i:05d}", T0 + dt.timedelta(seconds=i), *rnd.choice([("run", f"j{rnd.randrange(8)}", rnd.randrange(30)), ("topup", None, 25)])) for i in range(90)]
    schema = "user_id string, ev_id string, ts timestamp, kind string, job_id string, amount long"
    got = run_stream(spark, rows, schema, lambda s: ST.settle_stream(s), "st")
    want = ledger.settle(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)


def test_watchdog_fails_only_silent_jobs(spark):
    m = lambda n: T0 + dt.timedelta(minutes=n)
    rows = [("a", "processing", m(0)), ("b", "pending", m(1)), ("a", "completed", m(10)), ("c", "pending", m(30)), ("z", "pending", m(400)), ("z", "completed", m(401)), ("y", "completed", m(900)), ("y", "completed", m(901)), ("y", "completed", m(902))]
    got = run_stream(spark, rows, "job_id string, status string, ts timestamp", lambda s: ST.watchdog_stream(s), "wd", batches=3)
    assert {r.job_id for r in got} == {"b", "c"}


def test_uploads_name_the_running_job(spark):
    rnd, rows, latest, want = random.Random(8), [], {}, set()
    for i in range(90):
        user, file, ev = f"u{rnd.randrange(3)}", f"f{rnd.randrange(3)}", f"{i:05d}"
        if rnd.random() < 0.5:
            job, status = f"j{rnd.randrange(9)}", rnd.choice(["pending", "processing", "completed", "failed"])
            rows.append((user, file, T0 + dt.timedelta(seconds=i), ev, "status", job, status))
            latest[user, file] = (job, status)
        else:
            job, status = latest.get((user, file), (None, None))
            rows.append((user, file, T0 + dt.timedelta(seconds=i), ev, "upload", None, None))
            want.add((ev, user, file, "new" if job is None else "in_progress" if status in ("pending", "processing") else "rerun", job))
    got = run_stream(spark, rows, "user_id string, file_hash string, ts timestamp, ev_id string, kind string, job_id string, status string", ST.upload_dedup_stream, "up")
    assert {tuple(r) for r in got} == want
