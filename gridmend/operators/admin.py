"""Administration views: search, hydration, healing, figures and trace digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmend.functions.distributed import first_n


def kpis(profiles: DataFrame, jobs: DataFrame, waitlist: DataFrame, now: Column) -> DataFrame:
    """Eleven measures from one aggregate per table, joined as single rows."""
    month, day = F.date_trunc("month", now), F.date_trunc("day", now)
    week = now - F.expr("interval 7 days")
    p = profiles.agg(
        F.count("*").alias("total_users"), F.count_if(F.col("created_at") >= month).alias("new_users_this_month"),
        F.count_if(F.col("balance_cents") <= 0).alias("accounts_out_of_credit"),
        F.sum("rows_used_total").alias("total_rows_extracted"),
        F.count_if(F.col("last_active_at") >= day).alias("active_today"),
        F.count_if(F.col("last_active_at") >= week).alias("active_this_week"), F.sum("login_count").alias("total_logins"))
    j = jobs.agg(F.count("*").alias("total_documents"), F.count_if(F.col("created_at") >= day).alias("documents_today"),
                 F.count_if(F.col("status") == "failed").alias("failed_documents"))
    w = waitlist.agg(F.count("*").alias("waitlist_pending"))
    one = F.lit(1).alias("__k")
    return p.select("*", one).join(j.select("*", one), "__k").join(w.select("*", one), "__k").drop("__k")


def owner_filter(df: DataFrame, user_id: str) -> DataFrame:
    return df.filter(F.col("user_id") == user_id)


def project_public(df: DataFrame, allowed: list[str]) -> DataFrame:
    return df.select(*[c for c in allowed if c in df.columns])


def search(df: DataFrame, text_cols: list[str], term: str | None = None, equals: dict[str, str] | None = None,
           ts_col: str = "created_at", start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Case-blind substring over the text columns, equality filters and a closed time range."""
    if term:
        hit = F.lit(False)
        for c in text_cols:
            hit = hit | F.coalesce(F.col(c).ilike(f"%{term}%"), F.lit(False))
        df = df.filter(hit)
    for c, v in (equals or {}).items():
        df = df.filter(F.col(c) == v)
    if start is not None:
        df = df.filter(F.col(ts_col) >= start)
    if end is not None:
        df = df.filter(F.col(ts_col) <= end)
    return df


def page_of(df: DataFrame, order: list, page: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset((page - 1) * limit).limit(limit)


def total_of(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def display_name(full: Column, meta: Column, email: Column, user_id: Column) -> Column:
    def filled(c):
        return F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(filled(full), filled(meta), filled(F.split_part(email, F.lit("@"), F.lit(1))), filled(email),
                      F.concat(F.lit("User "), F.substring(user_id, 1, 8)))


def hydrate(df: DataFrame, profiles: DataFrame, cols: list[str], on: str = "user_id") -> DataFrame:
    """Left join that keeps rows with no profile. The physical join is left to runtime statistics."""
    return df.join(profiles.select(on, *cols), on, "left")


def heal_profiles(auth_users: DataFrame, profiles: DataFrame) -> DataFrame:
    """Rows to insert (no profile) or repair (blank name with a known one); everything else is left out."""
    a = auth_users.select(F.col("user_id").alias("auth_id"), F.col("email").alias("auth_email"), "meta_name")
    p = profiles.select("user_id", "full_name", F.lit(True).alias("has_profile"))
    j = a.join(p, a.auth_id == p.user_id, "full_outer")
    known = F.nullif(F.trim("meta_name"), F.lit(""))
    blank = F.nullif(F.trim("full_name"), F.lit("")).isNull()
    action = F.when(F.col("has_profile").isNull(), "insert").when(blank & known.isNotNull() & F.col("auth_id").isNotNull(), "repair")
    return (j.withColumn("action", action).filter("action is not null")
            .select(F.col("auth_id").alias("user_id"), F.coalesce(known, F.split_part("auth_email", F.lit("@"), F.lit(1))).alias("full_name"),
                    "action"))


def recent_documents(jobs: DataFrame, n: int = 50) -> DataFrame:
    """Per user, the n jobs with the latest activity among the n newest uploads and n newest completions."""
    cols = jobs.columns
    by_created = first_n(jobs, ["user_id"], [F.desc("created_at"), "job_id"], n).select(*cols)
    by_completed = first_n(jobs.filter("completed_at is not null"), ["user_id"], [F.desc("completed_at"), "job_id"], n).select(*cols)
    merged = by_created.unionByName(by_completed).dropDuplicates(["job_id"])
    active = merged.withColumn("last_activity", F.greatest(F.coalesce("completed_at", "created_at"), F.col("created_at")))
    return first_n(active, ["user_id"], [F.desc("last_activity"), "job_id"], n, "position")


def trace_summary(stages: DataFrame, cap: int = 8) -> DataFrame:
    """Per job: outcome counts and the failed-stage digest.

    The digest shows the first ``cap`` failures by stage order; only those are gathered, the rest is counted.
    """
    counts = stages.groupBy("job_id").agg(
        F.count_if(F.col("status") == "OK").alias("completed"), F.count_if(F.col("status") == "SKIPPED").alias("skipped"),
        F.count_if(F.col("status") == "FAILED").alias("failed"))
    shown = first_n(stages.filter("status = 'FAILED'"), ["job_id"], ["stage_no", "stage"], cap)
    digest = shown.groupBy("job_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "stage"))), lambda x: x["stage"]), ", ").alias("d"))
    more = F.when(F.col("failed") > cap, F.concat(F.lit(" … and "), (F.col("failed") - cap).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return (counts.join(digest, "job_id", "left")
            .select("job_id", "completed", "skipped", "failed", F.concat(F.coalesce("d", F.lit("")), more).alias("digest")))


def score_text(text: Column) -> Column:
    """Words weighted by the share of Arabic characters."""
    from gridmend.functions.text import arabic_share, tokens
    return F.coalesce(F.size(tokens(text)) * (F.lit(0.3) + F.lit(0.7) * arabic_share(text)), F.lit(0.0))


# --- fixed values: engine preference --------------------------------------------------------------------
ENGINE_ORDER = ["azure", "vision", "gemini", "layout"]


def choose_engine(results: DataFrame) -> DataFrame:
    """First engine in preference order that succeeded with a score above zero; the layout engine needs a table.

    ``results``: doc_id, engine, success, text, tables.
    """
    priority = F.array_position(F.array(*[F.lit(e) for e in ENGINE_ORDER]), F.col("engine"))
    usable = F.when(F.col("engine") == "layout", F.col("success") & (F.col("tables") > 0)).otherwise(
        F.col("success") & (F.col("score") > 0))
    scored = results.withColumn("score", score_text(F.col("text"))).withColumn("priority", priority)
    return scored.groupBy("doc_id").agg(F.min_by("engine", F.when(usable, F.col("priority"))).alias("chosen"),
                                        F.max("score").alias("best_score"))


TEXT_SOURCES = ["merged", "markdown", "grid", "annotated", "linear", "full"]


def choose_text_source(docs: DataFrame, sources: list[str] = TEXT_SOURCES) -> DataFrame:
    """First non-blank text among the sources, with the name of the source used."""
    def filled(c):
        return F.nullif(F.trim(F.col(c)), F.lit(""))
    label = F.coalesce(*[F.when(filled(c).isNotNull(), F.lit(c)) for c in sources])
    text = F.coalesce(*[F.when(filled(c).isNotNull(), F.col(c)) for c in sources])
    return docs.withColumn("text_source", label).withColumn("text", text)
