"""Prepaid ledger: pricing, settlement folds, quotas and statements. Money is whole cents throughout."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmend.functions import constants as K
from gridmend.functions.distributed import first_n, running_total
from gridmend.operators import settlement
from gridmend.session import checkpoint


def cost_cents(rows: Column) -> Column:
    """1.5 cents a row, rounded up once per document."""
    n = F.greatest(F.coalesce(rows, F.lit(0)), F.lit(0)).cast("long")
    return F.floor((n * 3 + 1) / 2).cast("long")


def rows_affordable(balance: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.floor(balance * 10 / K.ROW_PRICE_TENTHS).cast("long"))


def spend_from_ledger(ledger: DataFrame) -> DataFrame:
    return (ledger.filter("kind = 'charge'").groupBy("user_id")
            .agg((-F.sum("amount_cents")).alias("spent_cents")))


def usage_view(profiles: DataFrame, ledger: DataFrame) -> DataFrame:
    spent = spend_from_ledger(ledger)
    j = profiles.select("user_id", "balance_cents", "rows_used_total").join(spent, "user_id", "left")
    bal = F.coalesce("balance_cents", F.lit(0)).cast("long")
    spend = F.coalesce(F.col("spent_cents"), F.col("rows_used_total"), F.lit(0)).cast("long")
    return j.select("user_id", bal.alias("balance_cents"), spend.alias("spent_cents"), (bal + spend).alias("lifetime_cents"),
                    rows_affordable(bal).alias("rows_affordable"), (bal > 0).alias("can_upload"))


def statement(ledger: DataFrame, jobs: DataFrame, transactions: int = 50, held: int = 20) -> DataFrame:
    """Per user: the latest transactions and the latest documents held unpaid, tagged by kind of line."""
    t = first_n(ledger, ["user_id"], [F.desc("created_at"), F.desc("id")], transactions, "position").select(
        "user_id", F.lit("transaction").alias("line"), F.col("id").alias("ref"), F.col("amount_cents").cast("long").alias("cents"), "position")
    h = first_n(jobs.filter("payment_status = 'unpaid'"), ["user_id"], [F.desc("created_at"), F.desc("job_id")], held, "position").select(
        "user_id", F.lit("held").alias("line"), F.col("job_id").alias("ref"), F.col("cost_cents").cast("long").alias("cents"), "position")
    return t.unionByName(h)


def prior_charge_exists(jobs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Jobs whose owner has a charge for no job or another job.

    Answered from two aggregates instead of a user-level self join: all charges of the user against the charges
    of this very job.
    """
    charges = ledger.filter("kind = 'charge'")
    per_user = charges.groupBy("user_id").agg(F.count("*").alias("n_all"))
    per_job = charges.filter("job_id is not null").groupBy("user_id", "job_id").agg(F.count("*").alias("n_own"))
    return (jobs.join(per_user, "user_id").join(per_job, ["user_id", "job_id"], "left")
            .filter(F.col("n_all") > F.coalesce("n_own", F.lit(0))).select(*jobs.columns))


def just_charged(jobs: DataFrame, ledger: DataFrame, now: Column) -> DataFrame:
    latest = (ledger.filter("kind = 'charge' and job_id is not null").groupBy("job_id")
              .agg(F.max("created_at").alias("charged_at")))
    paid = (F.col("payment_status") == "paid") & (F.col("cost_cents") > 0) & F.col("completed_at").isNotNull()
    gap = F.abs(F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("charged_at").cast("timestamp")))
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("charged_at").cast("timestamp"))
    fresh = (gap < 5 * 60_000_000) & (age < 30 * 60_000_000)
    j = jobs.join(latest, "job_id", "left")
    return j.withColumn("charged_at", F.when(paid, F.col("charged_at"))).withColumn(
        "just_charged", F.coalesce(paid & fresh, F.lit(False)))


def mask_locked(jobs: DataFrame, profiles: DataFrame, content: list[str]) -> DataFrame:
    locked = F.col("payment_status") == "unpaid"
    bal = profiles.select("user_id", F.col("balance_cents").alias("__b"))
    j = jobs.join(bal, "user_id", "left")
    for c in content:
        j = j.withColumn(c, F.when(~locked, F.col(c)))
    b, cost = F.coalesce("__b", F.lit(0)).cast("long"), F.coalesce("cost_cents", F.lit(0)).cast("long")
    return (j.withColumn("locked", locked).withColumn("balance_cents", F.when(locked, b))
            .withColumn("shortfall_cents", F.when(locked, F.greatest(F.lit(0).cast("long"), cost - b))).drop("__b"))


def guest_quota(jobs: DataFrame, per_ip: int = 2, overall: int = 25, hours: int = 24) -> DataFrame:
    """For every admitted guest job, the admitted jobs of its address and of all guests in the trailing day.

    A trailing count is a difference of two running counts, at the row and just before the window opens, so both
    are running totals over minute blocks: no window ever holds one address, or all guests, in one task.
    ``jobs``: job_id, ip_hash, created_at.
    """
    us = F.unix_micros(F.col("created_at").cast("timestamp"))
    base = jobs.select("job_id", "ip_hash", us.alias("t"))
    span = hours * 3_600_000_000
    # kind 0 = window opening (counts rows strictly before it), 1 = arrival, 2 = reading after equal arrivals
    marks = base.select("job_id", "ip_hash", F.inline(F.array(
        F.struct((F.col("t") - span).alias("at"), F.lit(0).alias("kind")),
        F.struct(F.col("t").alias("at"), F.lit(1).alias("kind")),
        F.struct(F.col("t").alias("at"), F.lit(2).alias("kind")))))
    value = F.when(F.col("kind") == 1, F.lit(1)).otherwise(F.lit(0)).cast("long")
    minute = F.floor(F.col("at") / F.lit(60_000_000)).cast("long")
    by_ip = running_total(marks, ["ip_hash"], [minute], ["at", "kind", "job_id"], value, "n_ip")
    both = running_total(by_ip, [], [minute], ["at", "kind", "job_id"], value, "n_all")
    counts = both.filter("kind <> 1").groupBy("job_id", "ip_hash").agg(
        (F.sum(F.when(F.col("kind") == 2, F.col("n_ip")).otherwise(-F.col("n_ip")))).alias("ip_day"),
        (F.sum(F.when(F.col("kind") == 2, F.col("n_all")).otherwise(-F.col("n_all")))).alias("all_day"))
    return counts.withColumn("next_denied", (F.col("ip_day") >= per_ip) | (F.col("all_day") >= overall))


def claim_guest_jobs(claims: DataFrame, jobs: DataFrame, guest: str, now: Column) -> DataFrame:
    """``claims``: claim_id, job_id, claim_hash, user_id. ``jobs``: job_id, owner, guest_claim_hash, guest_expires_at,
    status, row_count. A completed job that is claimed is priced for its new owner."""
    j = claims.join(jobs, "job_id", "left")
    bad_user = F.col("user_id").isNull() | (F.col("user_id") == guest)
    wrong = (F.col("owner") != guest) | F.col("guest_claim_hash").isNull() | (F.col("guest_claim_hash") != F.col("claim_hash"))
    result = (F.when(bad_user, "invalid").when(F.col("owner").isNull(), "not_found")
              .when(F.col("owner") == F.col("user_id"), "claimed").when(F.coalesce(wrong, F.lit(True)), "invalid")
              .when(F.col("guest_expires_at") < now, "expired").otherwise("claimed"))
    already = F.coalesce((~bad_user) & (F.col("owner") == F.col("user_id")), F.lit(False))
    out = j.withColumn("result", result).withColumn("already", already)
    price = F.when((F.col("result") == "claimed") & ~F.col("already") & (F.col("status") == "completed"), cost_cents(F.col("row_count")))
    return out.select("claim_id", "job_id", "user_id", "result", "already", price.alias("cost_cents"))


# --- ordered folds -------------------------------------------------------------------------------------------

SETTLE_SCHEMA = ("user_id string, ev_id string, kind string, job_id string, outcome string, cost_cents long, "
                 "balance_cents long, shortfall_cents long")
RULES = ("v030", "v035", "v037", "v041")


def settle_event(state: dict, kind: str, job_id: str | None, amount: int, rules: str) -> tuple[str, int, int]:
    """One event against one account. Returns (outcome, cost, shortfall) and updates the account in place."""
    if kind in ("topup", "grant", "adjust"):
        if not amount:
            return "ignored", 0, 0
        if kind != "grant" and abs(amount) > K.ADMIN_BALANCE_LIMIT_CENTS:
            return "refused", 0, 0
        state["balance"] += amount
        return "credited", 0, 0
    rows = max(amount or 0, 0)
    cost = rows if rules == "v030" else (rows * 3 + 1) // 2
    held = state["held"].get(job_id)
    if rules != "v037":
        if job_id in state["paid"]:
            return "already", (state["paid"][job_id] if rules != "v030" else cost), 0
        if rules in ("v035", "v041") and held and held[0] == rows:
            cost = held[1]
    if cost == 0:
        state["paid"][job_id] = 0
        state["held"].pop(job_id, None)
        return "free_empty", 0, 0
    if rules == "v041" and not (state["charged"] - {job_id}):
        state["charged"].add(job_id)
        state["paid"][job_id] = 0
        state["held"].pop(job_id, None)
        return "first_free", 0, 0
    if state["balance"] >= cost:
        state["balance"] -= cost
        state["charged"].add(job_id)
        state["paid"][job_id] = cost
        state["held"].pop(job_id, None)
        return "paid", cost, 0
    state["paid"].pop(job_id, None)
    state["held"][job_id] = (rows, cost)
    return "held", cost, cost - state["balance"]


def new_account(opening: int) -> dict:
    return {"balance": opening, "paid": {}, "held": {}, "charged": set()}


def settle(events: DataFrame, opening_cents: int = K.SIGNUP_GRANT_CENTS, rules: str = "v041") -> DataFrame:
    """Ordered settlement per user. ``events``: user_id, ev_id, ts, kind (run|topup|grant|adjust), job_id, amount
    (rows for a run, cents otherwise).

    Whether a run can be paid depends on every earlier event of the account. Accounts of up to SETTLE_BLOCK events are
    read as sorted streams, one account's state at a time. Longer ones are cut into blocks (``settlement``): a task reads
    one block, however many events the account has.
    """
    if rules not in RULES:
        raise ValueError(f"unknown rule set {rules}")
    own = events.select("user_id", "ev_id", "ts", "kind", "job_id", F.coalesce(F.col("amount"), F.lit(0)).cast("long").alias("amount"))
    long_ones = checkpoint(own.groupBy("user_id").agg(F.count("*").alias("n")).filter(F.col("n") > settlement.SETTLE_BLOCK).select(F.col("user_id").alias("__u")))
    if long_ones.isEmpty():
        return _settle_streams(own, opening_cents, rules)
    own, mine = checkpoint(own), F.col("user_id").eqNullSafe(F.col("__u"))
    few = _settle_streams(own.join(long_ones, mine, "left_anti"), opening_cents, rules)
    return few.unionByName(settlement.settle_blocks(own.join(long_ones, mine, "left_semi"), opening_cents, rules))


def _settle_streams(events: DataFrame, opening_cents: int, rules: str) -> DataFrame:
    ordered = events.repartition("user_id").sortWithinPartitions("user_id", "ts", "ev_id")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, account = None, None
        for pdf in batches:
            out = []
            for u, ev, kind, job, amount in zip(pdf.user_id, pdf.ev_id, pdf.kind, pdf.job_id, pdf.amount):
                if account is None or u != user:
                    user, account = u, new_account(opening_cents)
                outcome, cost, short = settle_event(account, kind, job, int(amount), rules)
                out.append((u, ev, kind, job, outcome, cost, account["balance"], short))
            yield pd.DataFrame(out, columns=["user_id", "ev_id", "kind", "job_id", "outcome", "cost_cents", "balance_cents",
                                             "shortfall_cents"])

    return ordered.mapInPandas(fold, SETTLE_SCHEMA)


def add_balance(events: DataFrame, profiles: DataFrame) -> DataFrame:
    """Credits only: zero or null is ignored, an adjustment beyond the admin limit is refused; balance after each.

    Sums are associative, so this is a running total over time blocks and never one task per account.
    ``events``: user_id, ev_id, ts, amount.
    """
    ok = (F.coalesce("amount", F.lit(0)) != 0) & (F.abs("amount") <= K.ADMIN_BALANCE_LIMIT_CENTS)
    kept = events.filter(ok).withColumn("kind", F.when(F.col("amount") > 0, "topup").otherwise("adjust"))
    minute = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(60_000_000)).cast("long")
    run = running_total(kept, ["user_id"], [minute], ["ts", "ev_id"], F.col("amount").cast("long"), "__run")
    bal = profiles.select("user_id", F.col("balance_cents").cast("long").alias("__b"))
    return (run.join(bal, "user_id", "left")
            .select("user_id", "ev_id", "kind", F.col("amount").cast("long").alias("amount_cents"),
                    (F.coalesce("__b", F.lit(0).cast("long")) + F.col("__run")).alias("balance_after")))
