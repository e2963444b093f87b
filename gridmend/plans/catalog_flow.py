"""Queries over time rules: watchdog, limits, uploads, activity, feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmend.operators import flow
from gridmend.plans.catalog_review import DTS, text_ts, ts
from gridmend.plans.registry import query
from gridmend.plans.standins import oracle, table

NOW = "1998-06-15 10:00:00"


@query("stale_jobs", oracle(f"SELECT job_id, 'failed' AS status FROM jobs WHERE status IN ('pending', 'processing') AND created_at < timestamp '{NOW}' - INTERVAL 20 MINUTE", "jobs"))
def stale_jobs(spark, sf):
    return flow.stale_jobs(table(spark, sf, "jobs"), ts(NOW)).select("job_id", "status")


@query("stale_jobs_recovered", oracle(f"SELECT count(*) AS recovered FROM jobs WHERE status IN ('pending', 'processing') AND created_at < timestamp '{NOW}' - INTERVAL 20 MINUTE", "jobs"))
def stale_jobs_recovered(spark, sf):
    return flow.stale_jobs(table(spark, sf, "jobs"), ts(NOW)).agg(F.count("*").alias("recovered"))


def _requests(spark, sf):
    return table(spark, sf, "events").selectExpr("'u' || (user_id % 12) as key", "lpad(cast(event_id as string), 12, '0') as ev_id", "ts")


@query("rate_limit", oracle("""
, r AS (SELECT 'u' || (user_id % 12) AS key, lpad(cast(event_id as varchar), 12, '0') AS ev_id, epoch_us(ts) // 1000 AS ms, ts FROM events),
 o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, ts, ev_id) AS n FROM r),
 f AS (SELECT key, ev_id, n, ms + 3600000 AS reset, cast(1 as bigint) AS c, true AS ok FROM o WHERE n = 1
  UNION ALL SELECT o.key, o.ev_id, o.n, CASE WHEN o.ms > f.reset THEN o.ms + 3600000 ELSE f.reset END, CASE WHEN o.ms > f.reset THEN 1 WHEN f.c >= 3 THEN f.c ELSE f.c + 1 END, o.ms > f.reset OR f.c < 3
   FROM f JOIN o ON o.key = f.key AND o.n = f.n + 1)
SELECT key, ev_id, reset AS window_reset_ms, ok AS allowed FROM f""", recursive=True))
def rate_limit(spark, sf):
    return flow.rate_limit(_requests(spark, sf), 3, 3600).drop("ts")


@query("upload_dedup", oracle("""
, up AS (SELECT event_id AS upload_id, 'u' || user_id AS user_id, md5(user_id || '-' || event_id % 6) AS file_hash FROM events),
 l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, file_hash ORDER BY created_at DESC, job_id DESC) rn FROM jobs) WHERE rn = 1)
SELECT upload_id, up.user_id, up.file_hash, CASE WHEN l.job_id IS NULL THEN 'new' WHEN status IN ('pending', 'processing') THEN 'in_progress' ELSE 'rerun' END AS action, l.job_id
FROM up LEFT JOIN l ON l.user_id = up.user_id AND l.file_hash = up.file_hash""", "jobs"))
def upload_dedup(spark, sf):
    u = table(spark, sf, "events").selectExpr("event_id as upload_id", "'u' || user_id as user_id", "md5(user_id || '-' || event_id % 6) as file_hash")
    return flow.upload_dedup(u, table(spark, sf, "jobs"))


@query("document_hashes", oracle("SELECT doc_id, sha256(text) AS file_hash FROM documents"))
def document_hashes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", flow.file_hash(F.col("text").cast("binary")).alias("file_hash"))


@query("activity", oracle(f"SELECT user_id, {DTS.format('max(ts)')} AS last_active_at, count(*) FILTER (event_type = 'signup') AS login_count FROM events GROUP BY user_id"))
def activity(spark, sf):
    v = table(spark, sf, "events").select("user_id", "ts", (F.col("event_type") == "signup").alias("is_login"))
    return flow.activity(v).withColumn("last_active_at", text_ts("last_active_at"))


FEEDBACK = "SELECT event_id AS id, CASE WHEN event_id % 9 <> 0 THEN 'j' || (event_id % 700) END AS job_id, event_id % 5 + 1 AS rating, ts AS created_at FROM events"


@query("feedback_upsert", oracle(f""", f AS ({FEEDBACK}) SELECT id, job_id, rating FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, id DESC) rn FROM f) WHERE rn = 1 OR job_id IS NULL"""))
def feedback_upsert(spark, sf):
    table(spark, sf, "events")
    return flow.feedback_upsert(spark.sql(FEEDBACK)).select("id", "job_id", "rating")
