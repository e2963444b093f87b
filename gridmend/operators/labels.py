"""Label review: statistics, queues, dedup and the review state machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmend.functions.distributed import earliest_by, first_n, latest_by

STATUSES = ("pending", "verified", "approved", "rejected")


def file_stats(training: DataFrame) -> DataFrame:
    """Per job: counts by status, last activity, first crop, the latest verifier."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    # nulls sort last on verified_at, so an undated verification only wins when nothing is dated
    dated = F.struct(F.coalesce(F.col("verified_at").cast("timestamp_ntz"), F.lit("0001-01-01").cast("timestamp_ntz")), F.col("id"))
    return training.groupBy("job_id").agg(
        F.count("*").alias("total"), *counts, F.max("created_at").alias("last_activity"),
        F.min_by("crop_path", F.struct("created_at", "id")).alias("thumb_path"),
        F.max_by("verified_by", F.when(F.col("verified_by").isNotNull(), dated)).alias("worker_id"),
        F.max("verified_at").alias("worker_at"))


def overview_totals(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count("*").alias("files"), F.sum("total").alias("crops"), F.sum("pending").alias("pending"),
                     F.sum("verified").alias("verified"), F.sum("approved").alias("approved"))


def reviewer_stats(training: DataFrame, profiles: DataFrame, now: Column) -> DataFrame:
    """Per verifier throughput; the null reviewer row carries the totals over all reviewers."""
    week_ago = now - F.expr("interval 7 days")
    rows = training.filter(F.col("verified_by").isNotNull()).rollup("verified_by").agg(
        F.count("*").alias("total_verified"),
        F.count_if(F.col("status") == "verified").alias("awaiting_review"),
        F.count_if(F.col("status") == "approved").alias("approved"),
        F.count_if(F.col("status") == "rejected").alias("rejected"),
        F.max("verified_at").alias("last_activity"),
        F.count_if(F.col("verified_at") >= week_ago).alias("last_7_days_verified"))
    people = profiles.select(F.col("user_id"), "email", "full_name", "is_admin")
    return (rows.join(people, rows.verified_by == people.user_id, "left").drop("user_id")
            .withColumn("email", F.when(F.col("verified_by").isNotNull(), F.coalesce("email", F.lit("(unknown)"))))
            .withColumn("is_admin", F.coalesce("is_admin", F.lit(False))))


def leaderboard(training: DataFrame, profiles: DataFrame, season_start: Column) -> DataFrame:
    sent = (training.filter(F.col("verified_by").isNotNull() & (F.col("verified_at") >= season_start))
            .groupBy("verified_by").agg(F.count("*").alias("sent")))
    people = profiles.select("user_id", "full_name", "email")
    name = F.coalesce(F.nullif(F.trim("full_name"), F.lit("")), F.nullif(F.split_part("email", F.lit("@"), F.lit(1)), F.lit("")),
                      F.lit("trainer"))
    return (sent.join(people, sent.verified_by == people.user_id, "left")
            .select("verified_by", "sent", name.alias("name")).orderBy(F.desc("sent"), "name", "verified_by"))


def best_display_job(stats: DataFrame, recency_first: bool = True) -> DataFrame:
    """One job per (user, document): most crops, recency in milliseconds counting against a billion per crop.

    ``recency_first=False`` compares crops first and recency only on ties.
    """
    ms = F.unix_micros(F.col("last_activity").cast("timestamp")) / F.lit(1000)
    if recency_first:
        score = (F.col("total").cast("double") * F.lit(1e9) + F.floor(ms))
        return latest_by(stats.withColumn("score", score), ["user_id", "document_name"], ["score", "job_id"])
    return latest_by(stats.withColumn("score", F.col("total").cast("double")), ["user_id", "document_name"],
                     ["score", "last_activity", "job_id"])


def training_overview(jobs: DataFrame, stats: DataFrame, profiles: DataFrame, limit: int = 500) -> DataFrame:
    """Latest completed jobs with their crop counts, one per document, unfinished files first."""
    recent = jobs.filter("status = 'completed'").orderBy(F.desc("created_at"), "job_id").limit(limit)
    zero = {c: 0 for c in ("total", *STATUSES)}
    items = (recent.select("job_id", "user_id", "document_name", "created_at").join(stats, "job_id", "left")
             .withColumn("needs_crop", F.col("total").isNull()).fillna(zero)
             .withColumn("last_activity", F.coalesce("last_activity", "created_at")))
    people = profiles.select(F.col("user_id").alias("worker_id"), F.coalesce("full_name", "email").alias("worked_by"))
    best = best_display_job(items.select("job_id", "user_id", "document_name", "total", *STATUSES, "last_activity",
                                         "needs_crop", "worker_id"))
    done = (F.col("total") > 0) & (F.col("pending") == 0) & (F.col("verified") == 0) & (F.col("approved") > 0)
    return (best.join(people, "worker_id", "left").withColumn("is_done", done)
            .orderBy("is_done", F.desc("last_activity"), "job_id"))


def review_queue(training: DataFrame, page: int = 1, limit: int = 50) -> DataFrame:
    """Verified rows, oldest verification first. Bounded by the page, so a top-k and not a global sort."""
    limit = max(1, min(limit, 200))
    return (training.filter("status = 'verified'").orderBy(F.col("verified_at").asc_nulls_last(), "id")
            .offset((page - 1) * limit).limit(limit))


def review_queue_total(training: DataFrame) -> DataFrame:
    return training.filter("status = 'verified'").agg(F.count("*").alias("total"))


def flat_label_list(training: DataFrame, status: str | None, job_id: str, page: int = 1, limit: int = 100) -> DataFrame:
    rows = training.filter(F.col("job_id") == job_id)
    if status and status != "all":
        rows = rows.filter(F.col("status") == status)
    return rows.orderBy("participant_index", "id").offset((page - 1) * limit).limit(limit)


def dedupe_keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return earliest_by(df, keys, order)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return latest_by(df, keys, order)


def cap_per_document(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    return first_n(df, [key], order, n)


def recent_corrections(corrections: DataFrame, n: int = 5) -> DataFrame:
    return (corrections.orderBy(F.desc("created_at"), "id").limit(n)
            .select("field_name", "original_value", "corrected_value"))


def waitlist_view(waitlist: DataFrame, profiles: DataFrame, search: str | None = None) -> DataFrame:
    """Newest entry per e-mail with plan and name attached."""
    newest = latest_by(waitlist, ["email"], ["created_at", "id"])
    people = profiles.select(F.col("user_id").alias("__u"), F.col("plan").alias("__plan"), F.col("full_name").alias("__full"))
    out = (newest.join(people, F.col("user_id") == F.col("__u"), "left")
           .withColumn("current_plan", F.when(F.col("user_id").isNotNull(), F.coalesce("__plan", F.lit("free"))))
           .withColumn("full_name", F.coalesce("__full", "name")).drop("__u", "__plan", "__full"))
    if search:
        q = search.lower()
        out = out.filter(F.lower(F.coalesce("full_name", "name", F.lit(""))).contains(q) | F.lower("email").contains(q))
    return out


# --- review state machine ----------------------------------------------------------------------------------

START_STATES = ("pending", "verified", "approved", "rejected")


def review_lifecycle(labels: DataFrame, events: DataFrame, resume: bool = False) -> DataFrame:
    """Apply ordered review events to labels.

    ``events``: id, seq (long, unique per id), role (reviewer|approver), action (target status or null), label,
    actor, ts, reason.  A reviewer sets pending or verified from any state; an approver acts only on verified
    rows.  The state has four values, so a block of events is a map from start state to end state: blocks are
    folded in parallel for all four start states, then the block maps are chained.  No task sees more than one
    block of a hot label, whatever its number of events.

    With ``resume`` the labels bring all columns of an earlier result, and the events continue it: names and times carry
    on, counts add up.
    """
    ev = events.withColumn("blk", F.floor(F.col("seq") / F.lit(4096)).cast("long"))
    event = F.struct("seq", "role", "action", "label", "actor", "ts", "reason")
    blocks = ev.groupBy("id", "blk").agg(F.array_sort(F.collect_list(event)).alias("evs"))
    state_type = ("struct<status:string,label:string,verified_by:string,verified_at:timestamp_ntz,approved_by:string,"
                  "approved_at:timestamp_ntz,rejected_by:string,rejected_at:timestamp_ntz,reason:string,touched:int,"
                  "v_set:boolean,applied:bigint>")
    names = ["status", "label", "verified_by", "verified_at", "approved_by", "approved_at", "rejected_by", "rejected_at",
             "reason", "touched", "v_set", "applied"]
    none = F.lit(None)

    def start(status):
        return F.struct(F.lit(status), none, none, none, none, none, none, none, none, F.lit(0), F.lit(False),
                        F.lit(0).cast("long")).cast(state_type)

    def step(acc, e):
        reviewer = e["role"] == "reviewer"
        sets = reviewer & e["action"].isin("pending", "verified")
        approves = (e["role"] == "approver") & (e["action"] == "approved") & (acc["status"] == "verified")
        rejects = (e["role"] == "approver") & (e["action"] == "rejected") & (acc["status"] == "verified")
        relabel = (reviewer | approves) & e["label"].isNotNull()
        applied = sets | approves | rejects | (reviewer & e["label"].isNotNull())
        verified = e["action"] == "verified"
        return F.struct(
            F.when(sets | approves | rejects, e["action"]).otherwise(acc["status"]),
            F.when(relabel, F.trim(e["label"])).otherwise(acc["label"]),
            F.when(sets, F.when(verified, e["actor"])).otherwise(acc["verified_by"]),
            F.when(sets, F.when(verified, e["ts"])).otherwise(acc["verified_at"]),
            F.when(approves, e["actor"]).otherwise(acc["approved_by"]),
            F.when(approves, e["ts"]).otherwise(acc["approved_at"]),
            F.when(rejects, e["actor"]).otherwise(acc["rejected_by"]),
            F.when(rejects, e["ts"]).otherwise(acc["rejected_at"]),
            F.when(rejects, F.nullif(F.substring(F.trim(e["reason"]), 1, 500), F.lit(""))).otherwise(acc["reason"]),
            F.greatest(acc["touched"], F.when(applied, F.lit(1)).otherwise(F.lit(0))),
            acc["v_set"] | sets,
            acc["applied"] + F.when(applied, F.lit(1)).otherwise(F.lit(0)).cast("long")).cast(state_type)

    maps = blocks.select("id", "blk", F.size("evs").cast("long").alias("requested"),
                         *[F.aggregate("evs", start(s), step).alias(s) for s in START_STATES])
    # a chain entry per block: a hot label contributes one row per 4096 events
    per_id = maps.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("blk", "requested", *START_STATES))).alias("chain"))

    def pick(status, b):
        return F.when(status == "pending", b["pending"]).when(status == "verified", b["verified"]).when(
            status == "approved", b["approved"]).otherwise(b["rejected"])

    def chain(acc, b):
        got = pick(acc["status"], b)
        return F.struct(
            got["status"], F.coalesce(got["label"], acc["label"]),
            F.when(got["v_set"], got["verified_by"]).otherwise(acc["verified_by"]),
            F.when(got["v_set"], got["verified_at"]).otherwise(acc["verified_at"]),
            # the last approval, and the last rejection with its reason or the lack of one
            *[F.when(got[at].isNotNull(), got[c]).otherwise(acc[c]) for c, at in (("approved_by", "approved_at"), ("approved_at", "approved_at"), ("rejected_by", "rejected_at"),
                                                                                  ("rejected_at", "rejected_at"), ("reason", "rejected_at"))],
            F.greatest(got["touched"], acc["touched"]), got["v_set"] | acc["v_set"],
            got["applied"] + acc["applied"]).cast(state_type)

    held = [F.col(f"{n}") if resume else none for n in names[2:9]]
    counts = [F.col(n) if resume else F.lit(0).cast("long") for n in ("applied", "requested")]
    before = F.struct("status", "label", *held, F.lit(0), F.lit(False), counts[0]).cast(state_type)
    joined = labels.select("id", before.alias("first"), counts[1].alias("asked")).join(per_id, "id")
    first = F.col("first")
    requested = F.aggregate("chain", F.col("asked"), lambda a, b: a + b["requested"])
    out = joined.select("id", F.aggregate("chain", first, chain).alias("st"), requested.alias("requested"))
    return out.select("id", *[F.col(f"st.{n}").alias(n) for n in names if n not in ("touched", "v_set")], "requested")
