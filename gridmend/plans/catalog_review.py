"""Label review, administration and ledger queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmend.operators import admin, labels, ledger, search
from gridmend.plans.registry import query
from gridmend.plans.standins import Duck, Spark, oracle, table

NOW = "2001-07-31 12:00:00"
SEASON = "2024-03-03 00:00:00"
REVIEW_NOW = "2024-03-10 00:00:00"


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


def text_ts(c):
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd HH:mm:ss")


DTS = "strftime({}, '%Y-%m-%d %H:%M:%S')"

STATS_SQL = """
stats AS (SELECT job_id, count(*) AS total, count(*) FILTER (status = 'pending') AS pending,
  count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'approved') AS approved,
  count(*) FILTER (status = 'rejected') AS rejected, max(created_at) AS last_activity,
  first(crop_path ORDER BY created_at, id) AS thumb_path,
  first(verified_by ORDER BY verified_at DESC NULLS LAST, id DESC) FILTER (verified_by IS NOT NULL) AS worker_id,
  max(verified_at) AS worker_at FROM training GROUP BY job_id)"""


@query("file_stats", oracle("," + STATS_SQL + f"""
SELECT job_id, total, pending, verified, approved, rejected, {DTS.format('last_activity')} AS last_activity, thumb_path, worker_id,
       {DTS.format('worker_at')} AS worker_at FROM stats""", "training"))
def file_stats(spark, sf):
    return (labels.file_stats(table(spark, sf, "training")).withColumn("last_activity", text_ts("last_activity"))
            .withColumn("worker_at", text_ts("worker_at")))


@query("overview_totals", oracle("," + STATS_SQL + """
SELECT count(*) AS files, cast(sum(total) as bigint) AS crops, cast(sum(pending) as bigint) AS pending,
  cast(sum(verified) as bigint) AS verified, cast(sum(approved) as bigint) AS approved FROM stats""", "training"))
def overview_totals(spark, sf):
    return labels.overview_totals(labels.file_stats(table(spark, sf, "training")))


@query("reviewer_stats", oracle(f"""
SELECT r.verified_by, total_verified, awaiting_review, approved, rejected, {DTS.format('r.la')} AS last_activity, last_7_days_verified,
  CASE WHEN r.verified_by IS NOT NULL THEN coalesce(p.email, '(unknown)') END AS email, p.full_name, coalesce(p.is_admin, false) AS is_admin
FROM (SELECT verified_by, count(*) AS total_verified, count(*) FILTER (status = 'verified') AS awaiting_review,
   count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'rejected') AS rejected,
   max(verified_at) AS la, count(*) FILTER (verified_at >= timestamp '{REVIEW_NOW}' - INTERVAL 7 DAY) AS last_7_days_verified
   FROM training WHERE verified_by IS NOT NULL GROUP BY ROLLUP (verified_by)) r LEFT JOIN profiles p ON p.user_id = r.verified_by""",
    "training", "profiles"))
def reviewer_stats(spark, sf):
    out = labels.reviewer_stats(table(spark, sf, "training"), table(spark, sf, "profiles"), ts(REVIEW_NOW))
    return out.withColumn("last_activity", text_ts("last_activity"))


@query("leaderboard", oracle(f"""
SELECT t.verified_by, count(*) AS sent, any_value(coalesce(nullif(trim(full_name), ''), nullif(split_part(email, '@', 1), ''), 'trainer')) AS name
FROM training t LEFT JOIN profiles p ON p.user_id = t.verified_by
WHERE t.verified_by IS NOT NULL AND verified_at >= timestamp '{SEASON}' GROUP BY t.verified_by""", "training", "profiles"))
def leaderboard(spark, sf):
    return labels.leaderboard(table(spark, sf, "training"), table(spark, sf, "profiles"), ts(SEASON))


@query("kpis", oracle(f"""
SELECT * FROM (SELECT count(*) AS total_users, count(*) FILTER (created_at >= date_trunc('month', timestamp '{NOW}')) AS new_users_this_month,
  count(*) FILTER (balance_cents <= 0) AS accounts_out_of_credit, cast(sum(rows_used_total) as bigint) AS total_rows_extracted,
  count(*) FILTER (last_active_at >= date_trunc('day', timestamp '{NOW}')) AS active_today,
  count(*) FILTER (last_active_at >= timestamp '{NOW}' - INTERVAL 7 DAY) AS active_this_week, cast(sum(login_count) as bigint) AS total_logins FROM profiles),
 (SELECT count(*) AS total_documents, count(*) FILTER (created_at >= date_trunc('day', timestamp '{NOW}')) AS documents_today,
  count(*) FILTER (status = 'failed') AS failed_documents FROM jobs), (SELECT count(*) AS waitlist_pending FROM supplier)""", "profiles", "jobs"))
def kpis(spark, sf):
    return admin.kpis(table(spark, sf, "profiles"), table(spark, sf, "jobs"), table(spark, sf, "supplier"), ts(NOW))


JOB_STATS = """, js AS (SELECT j.job_id, j.user_id, j.document_name, j.created_at, j.status, count(l_orderkey) AS total,
  count(*) FILTER (l_returnflag = 'N') AS pending, count(*) FILTER (l_returnflag = 'A') AS verified, count(*) FILTER (l_returnflag = 'R') AS approved,
  cast(0 as bigint) AS rejected, max(l_shipdate) AS last_activity FROM jobs j LEFT JOIN lineitem ON j.order_key = l_orderkey GROUP BY ALL)"""


def _job_stats(spark, sf):
    """Crops per job, with order lines standing in for crops."""
    jobs, li = table(spark, sf, "jobs"), table(spark, sf, "lineitem")
    st = li.groupBy(F.col("l_orderkey").alias("order_key")).agg(
        F.count("*").alias("total"), F.count_if(F.col("l_returnflag") == "N").alias("pending"),
        F.count_if(F.col("l_returnflag") == "A").alias("verified"), F.count_if(F.col("l_returnflag") == "R").alias("approved"),
        F.lit(0).cast("long").alias("rejected"), F.max("l_shipdate").alias("last_activity"))
    return jobs, jobs.select("job_id", "order_key").join(st, "order_key").drop("order_key")


@query("best_display_job", oracle(JOB_STATS + f"""
SELECT user_id, document_name, job_id, total, {DTS.format('last_activity')} AS last_activity FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id, document_name ORDER BY total * 1000000000.0 + epoch_ms(last_activity) DESC, job_id DESC) rn FROM js
 WHERE total > 0) WHERE rn = 1""", "jobs"))
def best_display_job(spark, sf):
    jobs, st = _job_stats(spark, sf)
    out = labels.best_display_job(jobs.select("job_id", "user_id", "document_name").join(st, "job_id"))
    return out.select("user_id", "document_name", "job_id", "total", text_ts("last_activity").alias("last_activity"))


@query("training_overview", oracle(JOB_STATS + f""", r AS (SELECT * FROM js WHERE status = 'completed' ORDER BY created_at DESC, job_id LIMIT 500),
 i AS (SELECT *, total = 0 AS needs_crop, coalesce(last_activity, created_at) AS la FROM r),
 b AS (SELECT *, row_number() OVER (PARTITION BY user_id, document_name ORDER BY total * 1000000000.0 + epoch_ms(la) DESC, job_id DESC) rn FROM i)
SELECT job_id, total, pending, verified, approved, {DTS.format('la')} AS last_activity, needs_crop,
 (total > 0 AND pending = 0 AND verified = 0 AND approved > 0) AS is_done FROM b WHERE rn = 1""", "jobs"))
def training_overview(spark, sf):
    jobs, st = _job_stats(spark, sf)
    st = st.withColumn("worker_id", F.lit(None).cast("string"))
    out = labels.training_overview(jobs, st, table(spark, sf, "profiles"))
    return out.select("job_id", "total", "pending", "verified", "approved", text_ts("last_activity").alias("last_activity"),
                      "needs_crop", "is_done")


@query("review_queue", oracle(f"""
SELECT id, job_id, label, {DTS.format('verified_at')} AS verified_at FROM training WHERE status = 'verified'
ORDER BY verified_at ASC NULLS LAST, id LIMIT 50 OFFSET 50""", "training"))
def review_queue(spark, sf):
    return labels.review_queue(table(spark, sf, "training"), page=2).select("id", "job_id", "label", text_ts("verified_at").alias("verified_at"))


@query("review_queue_total", oracle("SELECT count(*) AS total FROM training WHERE status = 'verified'", "training"))
def review_queue_total(spark, sf):
    return labels.review_queue_total(table(spark, sf, "training"))


@query("flat_label_list", oracle("""
SELECT id, participant_index, status FROM training WHERE job_id = 'jsrc3' AND status = 'verified' ORDER BY participant_index, id LIMIT 100""", "training"))
def flat_label_list(spark, sf):
    return labels.flat_label_list(table(spark, sf, "training"), "verified", "jsrc3").select("id", "participant_index", "status")


@query("dedupe_keep_first", oracle("""
SELECT text_hash, doc_id, lang FROM (SELECT sha1(text) AS text_hash, doc_id, lang,
  row_number() OVER (PARTITION BY sha1(text) ORDER BY n_chars, doc_id) rn FROM documents) WHERE rn = 1"""))
def dedupe_keep_first(spark, sf):
    docs = table(spark, sf, "documents").select(F.sha1("text").alias("text_hash"), "doc_id", "lang", "n_chars")
    return labels.dedupe_keep_first(docs, ["text_hash"], ["n_chars", "doc_id"]).drop("n_chars")


@query("latest_per_key", oracle("""
SELECT job_id, row_idx, field_name, id, corrected_value FROM (SELECT *, row_number() OVER (PARTITION BY job_id, row_idx, field_name
  ORDER BY created_at DESC, id DESC) rn FROM corrections) WHERE rn = 1""", "corrections"))
def latest_per_key(spark, sf):
    c = table(spark, sf, "corrections").select("job_id", "row_idx", "field_name", "id", "corrected_value", "created_at")
    return labels.latest_per_key(c, ["job_id", "row_idx", "field_name"], ["created_at", "id"]).drop("created_at")


@query("recent_corrections", oracle("""
SELECT field_name, original_value, corrected_value FROM corrections ORDER BY created_at DESC, id LIMIT 5""", "corrections"))
def recent_corrections(spark, sf):
    return labels.recent_corrections(table(spark, sf, "corrections"))


@query("cap_per_document", oracle("""
SELECT job_id, row_idx, person FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY row_idx) rn FROM form_rows) WHERE rn <= 3""", "form_rows"))
def cap_per_document(spark, sf):
    return labels.cap_per_document(table(spark, sf, "form_rows"), "job_id", ["row_idx"], 3).select("job_id", "row_idx", "person")


WAITLIST = """, waitlist AS (SELECT event_id AS id, 'mail' || (event_id % 700) || '@example.org' AS email,
  CASE WHEN event_id % 3 = 0 THEN 'Guest ' || (event_id % 700) END AS name, ts AS created_at,
  CASE WHEN event_id % 2 = 0 THEN 'u' || user_id END AS user_id FROM events)"""


@query("waitlist_view", oracle(WAITLIST + """
SELECT w.id, w.email, CASE WHEN w.user_id IS NOT NULL THEN coalesce(p.plan, 'free') END AS current_plan, coalesce(p.full_name, w.name) AS full_name
FROM (SELECT *, row_number() OVER (PARTITION BY email ORDER BY created_at DESC, id DESC) rn FROM waitlist) w
LEFT JOIN (SELECT *, CASE WHEN balance_cents > 5000 THEN 'plus' END AS plan FROM profiles) p ON p.user_id = w.user_id
WHERE rn = 1 AND (contains(lower(coalesce(p.full_name, w.name, '')), '1') OR contains(lower(w.email), '1'))""", "profiles"))
def waitlist_view(spark, sf):
    w = table(spark, sf, "events").selectExpr(
        "event_id as id", "'mail' || (event_id % 700) || '@example.org' as email",
        "case when event_id % 3 = 0 then 'Guest ' || (event_id % 700) end as name", "ts as created_at",
        "case when event_id % 2 = 0 then 'u' || user_id end as user_id")
    p = table(spark, sf, "profiles").withColumn("plan", F.when(F.col("balance_cents") > 5000, "plus"))
    return labels.waitlist_view(w, p, "1").select("id", "email", "current_plan", "full_name")


def _review_events_sql(d):
    return """SELECT 't' || (event_id % 400) AS id, event_id AS seq, CASE WHEN event_type IN ('click', 'view', 'error') THEN 'reviewer' ELSE 'approver' END AS role,
      CASE event_type WHEN 'click' THEN 'verified' WHEN 'view' THEN CASE WHEN event_id % 3 = 0 THEN 'pending' ELSE 'verified' END
         WHEN 'purchase' THEN 'approved' WHEN 'signup' THEN CASE WHEN event_id % 7 = 0 THEN 'rejected' ELSE 'approved' END END AS action,
      CASE WHEN event_type = 'error' THEN ' fix ' || event_id END AS label, 'u' || user_id AS actor, ts, CASE WHEN event_id % 2 = 0 THEN 'blurred ' ELSE '' END AS reason FROM events"""


@query("review_lifecycle", oracle(f""", ev AS ({_review_events_sql(None)}),
 o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS n FROM ev),
 st AS (SELECT id, status, label, cast(NULL as varchar) verified_by, cast(NULL as timestamp) verified_at, cast(NULL as varchar) approved_by,
   cast(NULL as timestamp) approved_at, cast(NULL as varchar) rejected_by, cast(NULL as timestamp) rejected_at, cast(NULL as varchar) reason,
   cast(0 as bigint) applied, cast(0 as bigint) n FROM training
  UNION ALL SELECT s.id,
   CASE WHEN (o.role = 'reviewer' AND o.action IS NOT NULL) OR (o.role = 'approver' AND s.status = 'verified') THEN o.action ELSE s.status END,
   CASE WHEN o.role = 'reviewer' AND o.label IS NOT NULL THEN trim(o.label) ELSE s.label END,
   CASE WHEN o.role = 'reviewer' AND o.action = 'verified' THEN o.actor WHEN o.role = 'reviewer' AND o.action = 'pending' THEN NULL ELSE s.verified_by END,
   CASE WHEN o.role = 'reviewer' AND o.action = 'verified' THEN o.ts WHEN o.role = 'reviewer' AND o.action = 'pending' THEN NULL ELSE s.verified_at END,
   CASE WHEN o.role = 'approver' AND s.status = 'verified' AND o.action = 'approved' THEN o.actor ELSE s.approved_by END,
   CASE WHEN o.role = 'approver' AND s.status = 'verified' AND o.action = 'approved' THEN o.ts ELSE s.approved_at END,
   CASE WHEN o.role = 'approver' AND s.status = 'verified' AND o.action = 'rejected' THEN o.actor ELSE s.rejected_by END,
   CASE WHEN o.role = 'approver' AND s.status = 'verified' AND o.action = 'rejected' THEN o.ts ELSE s.rejected_at END,
   CASE WHEN o.role = 'approver' AND s.status = 'verified' AND o.action = 'rejected' THEN nullif(trim(o.reason), '') ELSE s.reason END,
   s.applied + CASE WHEN o.role = 'reviewer' OR s.status = 'verified' THEN 1 ELSE 0 END, o.n
  FROM st s JOIN o ON o.id = s.id AND o.n = s.n + 1)
SELECT id, status, label, verified_by, {DTS.format('verified_at')} AS verified_at, approved_by, {DTS.format('approved_at')} AS approved_at,
  rejected_by, {DTS.format('rejected_at')} AS rejected_at, CASE WHEN rejected_at IS NOT NULL THEN reason END AS reason, applied, n AS requested
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC) rn FROM st) WHERE rn = 1 AND n > 0""", "training", recursive=True))
def review_lifecycle(spark, sf):
    table(spark, sf, "events")
    events = spark.sql(_review_events_sql(Spark))
    out = labels.review_lifecycle(table(spark, sf, "training"), events)
    for c in ("verified_at", "approved_at", "rejected_at"):
        out = out.withColumn(c, text_ts(c))
    return out


# --- administration ---------------------------------------------------------------------------------------

@query("search_documents", oracle("""
SELECT job_id, user_id, document_name FROM jobs WHERE document_name ILIKE '%SHEET 1%' AND status = 'completed'
 AND created_at >= timestamp '1996-01-01' AND created_at <= timestamp '2000-01-01' ORDER BY created_at DESC, job_id LIMIT 25 OFFSET 25""", "jobs"))
def search_documents(spark, sf):
    hits = admin.search(table(spark, sf, "jobs"), ["document_name"], "SHEET 1", {"status": "completed"},
                        start=ts("1996-01-01 00:00:00"), end=ts("2000-01-01 00:00:00"))
    return admin.page_of(hits, [F.desc("created_at"), "job_id"], 2, 25).select("job_id", "user_id", "document_name")


@query("search_documents_total", oracle("""
SELECT count(*) AS total FROM jobs WHERE document_name ILIKE '%SHEET 1%' AND status = 'completed'""", "jobs"))
def search_documents_total(spark, sf):
    return admin.total_of(admin.search(table(spark, sf, "jobs"), ["document_name"], "SHEET 1", {"status": "completed"}))


@query("search_users", oracle("""
SELECT user_id, email FROM profiles WHERE email ILIKE '%build%' OR full_name ILIKE '%build%' ORDER BY created_at DESC, user_id LIMIT 20""", "profiles"))
def search_users(spark, sf):
    hits = admin.search(table(spark, sf, "profiles"), ["email", "full_name"], "build")
    return admin.page_of(hits, [F.desc("created_at"), "user_id"], 1, 20).select("user_id", "email")


def _document_index(spark, sf):
    return search.build_index(table(spark, sf, "jobs").select("job_id", "user_id", "document_name", "status", "created_at"), ["document_name"], "job_id")


@query("search_documents_indexed", oracle("""
SELECT job_id, user_id, document_name FROM jobs WHERE document_name ILIKE '%SHEET 1%' AND status = 'completed'
 AND created_at >= timestamp '1996-01-01' AND created_at <= timestamp '2000-01-01'""", "jobs"))
def search_documents_indexed(spark, sf):
    root = _document_index(spark, sf)
    return search.search_index(spark, root, ["document_name"], "SHEET 1", {"status": "completed"}, start=ts("1996-01-01 00:00:00"), end=ts("2000-01-01 00:00:00")).select("job_id", "user_id", "document_name")


AUDIT_LOG = """SELECT event_id AS id, 'u' || user_id AS actor_id, 'training.' || event_type || '_' || (event_id % 37) AS action,
 CASE WHEN event_id % 3 = 0 THEN 'training' ELSE 'document' END AS target_type, ts AS created_at FROM events"""


@query("search_audit_log", oracle(f""", au AS ({AUDIT_LOG})
SELECT id, actor_id, action FROM au WHERE action ILIKE '%CHASE_1%' AND target_type = 'training' AND created_at >= timestamp '2024-01-05' ORDER BY created_at DESC, id LIMIT 100 OFFSET 0"""))
def search_audit_log(spark, sf):
    """The first page of the log: a part of the action, the target type and a time from which on."""
    table(spark, sf, "events")
    root = search.build_index(spark.sql(AUDIT_LOG), ["action"], "id")
    hits = search.search_index(spark, root, ["action"], "CHASE_1", {"target_type": "training"}, start=ts("2024-01-05 00:00:00"))
    return admin.page_of(hits, [F.desc("created_at"), "id"], 1, 100).select("id", "actor_id", "action")


@query("search_audit_log_total", oracle(f""", au AS ({AUDIT_LOG}) SELECT count(*) AS total FROM au WHERE action ILIKE '%CHASE_1%' AND target_type = 'training' AND created_at >= timestamp '2024-01-05'"""))
def search_audit_log_total(spark, sf):
    table(spark, sf, "events")
    root = search.build_index(spark.sql(AUDIT_LOG), ["action"], "id")
    return admin.total_of(search.search_index(spark, root, ["action"], "CHASE_1", {"target_type": "training"}, start=ts("2024-01-05 00:00:00")))


@query("owner_view", oracle("SELECT job_id, document_name, status FROM jobs WHERE user_id = 'u7'", "jobs"))
def owner_view(spark, sf):
    mine = admin.owner_filter(table(spark, sf, "jobs"), "u7")
    return admin.project_public(mine, ["job_id", "document_name", "status"])


@query("display_name", oracle("""
SELECT user_id, coalesce(nullif(trim(full_name), ''), nullif(trim(meta_name), ''), nullif(split_part(email, '@', 1), ''), email, 'User ' || user_id[1:8]) AS name
FROM profiles""", "profiles"))
def display_name(spark, sf):
    return table(spark, sf, "profiles").select("user_id", admin.display_name(
        F.col("full_name"), F.col("meta_name"), F.col("email"), F.col("user_id")).alias("name"))


@query("hydrate", oracle("""
SELECT l.id, l.user_id, p.email, p.full_name FROM ledger l LEFT JOIN (SELECT * FROM profiles WHERE nation_key <> 3) p USING (user_id)""", "ledger", "profiles"))
def hydrate(spark, sf):
    p = table(spark, sf, "profiles").filter("nation_key <> 3")
    return admin.hydrate(table(spark, sf, "ledger").select("id", "user_id"), p, ["email", "full_name"])


@query("heal_profiles", oracle("""
SELECT a.user_id, coalesce(nullif(trim(a.meta_name), ''), split_part(a.email, '@', 1)) AS full_name,
  CASE WHEN p.user_id IS NULL THEN 'insert' ELSE 'repair' END AS action
FROM profiles a LEFT JOIN (SELECT * FROM profiles WHERE nation_key <> 3) p ON a.user_id = p.user_id
WHERE p.user_id IS NULL OR (nullif(trim(p.full_name), '') IS NULL AND nullif(trim(a.meta_name), '') IS NOT NULL)""", "profiles"))
def heal_profiles(spark, sf):
    everyone = table(spark, sf, "profiles")
    return admin.heal_profiles(everyone.select("user_id", "email", "meta_name"), everyone.filter("nation_key <> 3"))


@query("recent_documents", oracle(f"""
, a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, job_id) rc,
   CASE WHEN completed_at IS NOT NULL THEN row_number() OVER (PARTITION BY user_id, completed_at IS NULL ORDER BY completed_at DESC, job_id) END rd FROM jobs),
 m AS (SELECT *, coalesce(completed_at, created_at) AS la FROM a WHERE rc <= 5 OR rd <= 5)
SELECT user_id, job_id, {DTS.format('la')} AS last_activity, cast(rn as int) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY la DESC, job_id) rn FROM m) WHERE rn <= 5""", "jobs"))
def recent_documents(spark, sf):
    out = admin.recent_documents(table(spark, sf, "jobs").select("job_id", "user_id", "created_at", "completed_at"), 5)
    return out.select("user_id", "job_id", text_ts("last_activity").alias("last_activity"), "position")


@query("trace_summary", oracle("""
, stages AS (SELECT 'j' || l_orderkey AS job_id, l_partkey * 8 + l_linenumber AS stage_no, 'stage ' || (l_partkey * 8 + l_linenumber) AS stage,
  CASE l_returnflag WHEN 'R' THEN 'SKIPPED' WHEN 'A' THEN 'FAILED' ELSE 'OK' END AS status FROM lineitem),
 f AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY stage_no, stage) rn, count(*) OVER (PARTITION BY job_id) n FROM stages WHERE status = 'FAILED'),
 g AS (SELECT job_id, string_agg(stage, ', ' ORDER BY rn) FILTER (rn <= 3) || any_value(CASE WHEN n > 3 THEN ' … and ' || (n - 3) || ' more' ELSE '' END) AS d FROM f GROUP BY job_id)
SELECT s.job_id, count(*) FILTER (status = 'OK') AS completed, count(*) FILTER (status = 'SKIPPED') AS skipped, count(*) FILTER (status = 'FAILED') AS failed,
  coalesce(any_value(g.d), '') AS digest FROM stages s LEFT JOIN g USING (job_id) GROUP BY s.job_id"""))
def trace_summary(spark, sf):
    st = table(spark, sf, "lineitem").selectExpr(
        "'j' || l_orderkey as job_id", "l_partkey * 8 + l_linenumber as stage_no", "'stage ' || (l_partkey * 8 + l_linenumber) as stage",
        "case l_returnflag when 'R' then 'SKIPPED' when 'A' then 'FAILED' else 'OK' end as status")
    return admin.trace_summary(st, cap=3)


# --- ledger -------------------------------------------------------------------------------------------------

@query("spend_from_ledger", oracle("""
SELECT user_id, cast(-sum(amount_cents) as bigint) AS spent_cents FROM ledger WHERE kind = 'charge' GROUP BY user_id""", "ledger"))
def spend_from_ledger(spark, sf):
    return ledger.spend_from_ledger(table(spark, sf, "ledger"))


@query("usage_view", oracle("""
, sp AS (SELECT user_id, cast(-sum(amount_cents) as bigint) AS spent FROM ledger WHERE kind = 'charge' GROUP BY user_id)
SELECT p.user_id, balance_cents, coalesce(spent, rows_used_total) AS spent_cents, balance_cents + coalesce(spent, rows_used_total) AS lifetime_cents,
  greatest(0, cast(floor(balance_cents * 10 / 15) as bigint)) AS rows_affordable, balance_cents > 0 AS can_upload
FROM profiles p LEFT JOIN sp USING (user_id)""", "ledger", "profiles"))
def usage_view(spark, sf):
    return ledger.usage_view(table(spark, sf, "profiles"), table(spark, sf, "ledger"))


@query("statement", oracle("""
SELECT user_id, line, ref, cents, cast(position as int) AS position FROM (
 SELECT user_id, 'transaction' AS line, id AS ref, amount_cents AS cents, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS position, 50 AS lim FROM ledger
 UNION ALL SELECT user_id, 'held', job_id, cost_cents, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, job_id DESC), 20 FROM jobs WHERE payment_status = 'unpaid')
WHERE position <= lim""", "ledger", "jobs"))
def statement(spark, sf):
    return ledger.statement(table(spark, sf, "ledger"), table(spark, sf, "jobs"))


@query("prior_charge_exists", oracle("""
SELECT job_id, user_id FROM jobs j WHERE EXISTS (SELECT 1 FROM ledger l WHERE l.user_id = j.user_id AND l.kind = 'charge'
  AND (l.job_id IS NULL OR l.job_id <> j.job_id))""", "ledger", "jobs"))
def prior_charge_exists(spark, sf):
    return ledger.prior_charge_exists(table(spark, sf, "jobs").select("job_id", "user_id"), table(spark, sf, "ledger"))


CHARGES = """, charges AS (SELECT 'charge' AS kind, job_id, completed_at + to_seconds(order_key % 900 - 300) AS created_at FROM jobs WHERE completed_at IS NOT NULL)"""


@query("just_charged", oracle(CHARGES + f""", m AS (SELECT job_id, max(created_at) AS ca FROM charges GROUP BY job_id)
SELECT j.job_id, {DTS.format("CASE WHEN payment_status = 'paid' AND cost_cents > 0 AND completed_at IS NOT NULL THEN ca END")} AS charged_at,
 coalesce(payment_status = 'paid' AND cost_cents > 0 AND abs(epoch(completed_at) - epoch(ca)) < 300 AND epoch(timestamp '1998-06-15 10:00:00') - epoch(ca) < 1800, false) AS just_charged
FROM jobs j LEFT JOIN m USING (job_id)""", "jobs"))
def just_charged(spark, sf):
    jobs = table(spark, sf, "jobs")
    charges = jobs.filter("completed_at is not null").selectExpr(
        "'charge' as kind", "job_id", "timestampadd(SECOND, order_key % 900 - 300, completed_at) as created_at")
    out = ledger.just_charged(jobs, charges, ts("1998-06-15 10:00:00"))
    return out.select("job_id", text_ts("charged_at").alias("charged_at"), "just_charged")


@query("mask_locked", oracle("""
SELECT job_id, CASE WHEN payment_status <> 'unpaid' THEN file_hash END AS file_hash, payment_status = 'unpaid' AS locked,
 CASE WHEN payment_status = 'unpaid' THEN coalesce(p.balance_cents, 0) END AS balance_cents,
 CASE WHEN payment_status = 'unpaid' THEN greatest(0, cost_cents - coalesce(p.balance_cents, 0)) END AS shortfall_cents
FROM jobs LEFT JOIN profiles p USING (user_id)""", "jobs", "profiles"))
def mask_locked(spark, sf):
    p = table(spark, sf, "profiles")
    return ledger.mask_locked(table(spark, sf, "jobs").select("job_id", "user_id", "payment_status", "cost_cents", "file_hash"), p,
                              ["file_hash"]).select("job_id", "file_hash", "locked", "balance_cents", "shortfall_cents")


@query("guest_quota", oracle("""
, g AS (SELECT 'j' || event_id AS job_id, 'ip' || (user_id % 40) AS ip_hash, ts FROM events)
SELECT job_id, ip_hash, ip_day, all_day, ip_day >= 2 OR all_day >= 25 AS next_denied FROM (SELECT job_id, ip_hash,
  count(*) OVER (PARTITION BY ip_hash ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS ip_day,
  count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS all_day FROM g)"""))
def guest_quota(spark, sf):
    g = table(spark, sf, "events").selectExpr(
        "'j' || event_id as job_id", "'ip' || (user_id % 40) as ip_hash", "ts as created_at")
    return ledger.guest_quota(g)


@query("claim_guest_jobs", oracle("""
, gj AS (SELECT job_id, CASE WHEN order_key % 3 = 0 THEN user_id ELSE 'guest' END AS owner, CASE WHEN order_key % 5 <> 0 THEN file_hash END AS h,
   CASE WHEN order_key % 2 = 0 THEN created_at + to_days(7) END AS ex, status, row_count FROM jobs),
 cl AS (SELECT 'e' || event_id AS claim_id, 'j' || (event_id * 2) AS job_id, md5((event_id % 1500) || '-' || (event_id * 2 % 6)) AS ch,
   CASE WHEN event_id % 17 = 0 THEN 'guest' ELSE 'u' || user_id END AS user_id FROM events),
 r AS (SELECT cl.*, gj.*, CASE WHEN cl.user_id = 'guest' THEN 'invalid' WHEN owner IS NULL THEN 'not_found' WHEN owner = cl.user_id THEN 'claimed'
    WHEN owner <> 'guest' OR h IS NULL OR h <> CASE WHEN event_n % 2 = 0 THEN h ELSE 'wrong' END THEN 'invalid'
    WHEN ex < timestamp '1998-01-01' THEN 'expired' ELSE 'claimed' END AS result
  FROM (SELECT *, cast(substr(claim_id, 2) as bigint) AS event_n FROM cl) cl LEFT JOIN gj ON cl.job_id = gj.job_id)
SELECT claim_id, job_id, user_id, result, (user_id <> 'guest' AND owner IS NOT NULL AND owner = user_id) AS already,
 CASE WHEN result = 'claimed' AND owner <> user_id AND status = 'completed' THEN cast(floor((row_count * 3 + 1) / 2) as bigint) END AS cost_cents FROM r""", "jobs"))
def claim_guest_jobs(spark, sf):
    jobs = table(spark, sf, "jobs").selectExpr(
        "job_id", "case when order_key % 3 = 0 then user_id else 'guest' end as owner", "case when order_key % 5 <> 0 then file_hash end as guest_claim_hash",
        "case when order_key % 2 = 0 then timestampadd(DAY, 7, created_at) end as guest_expires_at", "status", "row_count")
    claims = table(spark, sf, "events").selectExpr("'e' || event_id as claim_id", "'j' || (event_id * 2) as job_id", "event_id",
                                                   "case when event_id % 17 = 0 then 'guest' else 'u' || user_id end as user_id")
    known = jobs.select("job_id", F.col("guest_claim_hash").alias("k"))
    claims = claims.join(known, "job_id", "left").withColumn(
        "claim_hash", F.coalesce(F.when(F.col("event_id") % 2 == 0, F.col("k")), F.lit("wrong"))).drop("k", "event_id")
    return ledger.claim_guest_jobs(claims, jobs, "guest", ts("1998-01-01 00:00:00"))


@query("add_balance", oracle("""
, e AS (SELECT id AS ev_id, user_id, created_at AS ts, amount_cents * 100 AS amount FROM ledger WHERE kind <> 'charge')
SELECT e.user_id, ev_id, CASE WHEN amount > 0 THEN 'topup' ELSE 'adjust' END AS kind, amount AS amount_cents,
  cast(coalesce(p.balance_cents, 0) + sum(amount) OVER (PARTITION BY e.user_id ORDER BY ts, ev_id ROWS UNBOUNDED PRECEDING) as bigint) AS balance_after
FROM e LEFT JOIN profiles p USING (user_id) WHERE amount <> 0 AND abs(amount) <= 100000""", "ledger", "profiles"))
def add_balance(spark, sf):
    e = table(spark, sf, "ledger").filter("kind <> 'charge'").selectExpr("id as ev_id", "user_id", "created_at as ts", "amount_cents * 100 as amount")
    return ledger.add_balance(e, table(spark, sf, "profiles"))


def settle_events(spark, sf):
    return table(spark, sf, "ledger").selectExpr(
        "user_id", "lpad(cast(event_id as string), 12, '0') as ev_id", "created_at as ts",
        "case when kind = 'charge' then 'run' else kind end as kind", "job_id",
        "case when kind = 'charge' then event_id % 40 else amount_cents end as amount")


@query("settle", oracle("""
, e AS (SELECT user_id, lpad(cast(event_id as varchar), 12, '0') AS ev_id, CASE WHEN kind = 'charge' THEN 'run' ELSE kind END AS kind, job_id,
   CASE WHEN kind = 'charge' THEN event_id % 40 ELSE amount_cents END AS amount,
   row_number() OVER (PARTITION BY user_id ORDER BY created_at, event_id) AS n FROM ledger),
 f AS (SELECT user_id, cast(0 as bigint) AS n, '' AS ev_id, '' AS kind, cast(NULL as varchar) AS job_id, '' AS outcome, cast(0 as bigint) AS cost_cents,
    cast(50 as bigint) AS bal, cast(0 as bigint) AS short, MAP {} :: MAP(VARCHAR, BIGINT) AS paid, cast([] as varchar[]) AS charged FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL
  SELECT user_id, n, ev_id, kind, job_id, outcome, CASE outcome WHEN 'already' THEN pc WHEN 'paid' THEN c WHEN 'held' THEN c ELSE 0 END,
    CASE outcome WHEN 'credited' THEN bal + amount WHEN 'paid' THEN bal - c ELSE bal END, CASE WHEN outcome = 'held' THEN c - bal ELSE 0 END,
    CASE outcome WHEN 'paid' THEN map_concat(paid, MAP {job_id: c}) WHEN 'free_empty' THEN map_concat(paid, MAP {job_id: 0::BIGINT})
       WHEN 'first_free' THEN map_concat(paid, MAP {job_id: 0::BIGINT}) ELSE paid END,
    CASE WHEN outcome IN ('paid', 'first_free') THEN list_append(charged, job_id) ELSE charged END
  FROM (SELECT f.*, CASE WHEN kind <> 'run' THEN CASE WHEN amount = 0 THEN 'ignored' ELSE 'credited' END
      WHEN pc IS NOT NULL THEN 'already' WHEN c = 0 THEN 'free_empty'
      WHEN len([x for x in charged if x <> job_id]) = 0 THEN 'first_free' WHEN bal >= c THEN 'paid' ELSE 'held' END AS outcome
    FROM (SELECT e.user_id, e.n, e.ev_id, e.kind, e.job_id, e.amount, cast(floor((e.amount * 3 + 1) / 2) as bigint) AS c,
       f.bal, f.paid, f.charged, f.paid[e.job_id] AS pc FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1) f))
SELECT user_id, ev_id, kind, job_id, outcome, cost_cents, bal AS balance_cents, short AS shortfall_cents FROM f WHERE n > 0""", "ledger", recursive=True))
def settle(spark, sf):
    return ledger.settle(settle_events(spark, sf))
