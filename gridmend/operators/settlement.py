"""Settlement of accounts with more events than one task should read, by maps from opening to closing balance.

A block of events turns an opening balance into a closing one: a credit adds, a run is paid if the balance holds its cost.
Over all openings that is a function of pieces, each of which adds a constant, and a task finds the pieces of its block from
its events alone. A chain then goes from block to block reading pieces only, and with every opening known the blocks are
settled side by side.

What ties events together besides the balance is known beforehand or small. A job with a run of no rows is settled by it at
the latest; the first run that costs something is the free one (rule set v041); both are minima per job and account. A
further try of a job, made because an earlier one may have been held, is a step of its own in the chain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmend.functions import constants as K
from gridmend.functions.distributed import ordinal
from gridmend.session import checkpoint

#: Events of an account that one task reads at a time.
SETTLE_BLOCK = 2048
NOOP, CREDIT, TRY, RETRY = 0, 1, 2, 3


def _job(column: str = "job_id") -> Column:
    return F.coalesce(F.concat(F.lit("j"), F.col(column)), F.lit(""))


def described(events: DataFrame, rules: str) -> DataFrame:
    """Events with their place in the account (ord, blk, seg) and what they can do to its balance (does, cents)."""
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3_600_000_000)).cast("long")
    ranked = checkpoint(ordinal(events, ["user_id"], ["ts", "ev_id"], [hour], "ord").withColumn("job", _job()))
    credit = F.col("kind").isin("topup", "grant", "adjust")
    rows = F.greatest(F.col("amount"), F.lit(0))
    cost = rows if rules == "v030" else F.floor((rows * 3 + 1) / 2).cast("long")
    run_cost = F.when(~credit, cost)
    refused = (F.col("kind") != "grant") & (F.abs("amount") > K.ADMIN_BALANCE_LIMIT_CENTS)
    with_cost = ranked.withColumns({"cost": run_cost, "cents": F.when(credit, F.when(refused, 0).otherwise(F.col("amount"))).otherwise(cost)})
    if rules == "v037":  # a run is charged whatever came before
        known = with_cost.withColumns({"does": F.when(credit, CREDIT).when(F.col("cost") == 0, NOOP).otherwise(TRY), "last": F.lit(False), "watched": F.lit(False), "free": F.lit(False)})
    else:
        runs = with_cost.filter(~credit)
        jobs = runs.groupBy("user_id", "job").agg(F.min(F.when(F.col("cost") == 0, F.col("ord"))).alias("zero"), F.min(F.when(F.col("cost") > 0, F.col("ord"))).alias("first"),
                                                  F.max(F.when(F.col("cost") > 0, F.col("ord"))).alias("final"))
        jobs = checkpoint(jobs.select(F.col("user_id").alias("__u"), F.col("job").alias("__j"), "zero", "first", "final"))
        if rules == "v041":
            free = jobs.filter("first IS NOT NULL AND (zero IS NULL OR first < zero)").groupBy("__u").agg(F.min("first").alias("free_at")).select(F.col("__u").alias("__f"), "free_at")
            jobs = jobs.join(free, F.col("__u").eqNullSafe(F.col("__f")), "left").withColumn("free", F.coalesce(F.col("first") == F.col("free_at"), F.lit(False)))
        else:
            jobs = jobs.withColumn("free", F.lit(False))
        jobs = jobs.select("__u", "__j", "zero", "first", "final", "free")
        j = with_cost.join(jobs, F.col("user_id").eqNullSafe(F.col("__u")) & (F.col("job") == F.col("__j")) & ~credit, "left")
        settled = F.coalesce(F.col("ord") > F.col("zero"), F.lit(False)) | F.col("free")
        does = F.when(credit, CREDIT).when((F.col("cost") == 0) | settled, NOOP).when(F.col("ord") == F.col("first"), TRY).otherwise(RETRY)
        known = j.withColumns({"does": does, "last": F.coalesce(F.col("ord") == F.col("final"), F.lit(False)), "watched": F.coalesce(F.col("first") < F.col("final"), F.lit(False)),
                               "free": F.coalesce(F.col("free") & (F.col("ord") == F.col("first")), F.lit(False))})
    placed = known.select("user_id", "ev_id", "kind", "job_id", "job", "ord", F.floor(F.col("ord") / SETTLE_BLOCK).cast("long").alias("blk"), "does", "cents", "cost", "amount", "last", "watched", "free")
    # a block is read by one task anyway: steps of its own split it further
    so_far = F.sum(F.when(F.col("does") == RETRY, 1).otherwise(0)).over(Window.partitionBy("user_id", "blk").orderBy("ord"))
    return checkpoint(placed.withColumn("seg", (2 * so_far - F.when(F.col("does") == RETRY, 1).otherwise(0)).cast("long")))


def pieces(does: np.ndarray, cents: np.ndarray, watched: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The map of a run of events on openings from ``low`` to ``high``: where pieces begin, what each adds, and for every
    watched try whether a piece pays it."""
    start, plus, paid = np.array([low], np.int64), np.zeros(1, np.int64), []
    for what, c, watch in zip(does.tolist(), cents.tolist(), watched.tolist()):
        if what == CREDIT:
            plus = plus + c
        elif what == TRY:
            need = c - plus  # the opening that just pays it
            end = np.append(start[1:], high + 1)
            cut = np.flatnonzero((need > start) & (need < end))
            if len(cut):
                start = np.insert(start, cut + 1, need[cut])
                plus = np.insert(plus, cut + 1, plus[cut])
                paid = [np.insert(p, cut + 1, p[cut]) for p in paid]
            pays = start + plus >= c
            plus = plus - c * pays
            if watch:
                paid.append(pays)
    return start, plus, paid


MAPS = "user_id string, blk long, seg long, retry boolean, cents long, job string, last boolean, start array<long>, plus array<long>, watched array<string>, paid array<binary>"


def block_maps(events: DataFrame, opening: int) -> DataFrame:
    """One row per segment of a block: its map, or the one further try that it is."""
    moved = events.groupBy("user_id", "blk").agg(F.sum(F.when(F.col("does") == CREDIT, F.col("cents")).otherwise(0)).alias("credits"),
                                                 F.sum(F.when(F.col("does").isin(TRY, RETRY), F.col("cents")).otherwise(0)).alias("costs"))
    earlier = Window.partitionBy("user_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    bounds = moved.select(F.col("user_id").alias("__u"), F.col("blk").alias("__b"), (F.coalesce(F.sum("credits").over(earlier), F.lit(0)) + opening).alias("high"), F.coalesce(F.sum("costs").over(earlier), F.lit(0)).alias("spent"))
    bounded = events.join(bounds, F.col("user_id").eqNullSafe(F.col("__u")) & (F.col("blk") == F.col("__b"))).select("user_id", "blk", "seg", "ord", "does", "cents", "watched", "last", "job", "high", (F.col("high") - F.col("spent")).alias("low"))

    def maps(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        low, high = int(pdf["low"].iloc[0]), int(pdf["high"].iloc[0])
        out = []
        for seg, part in pdf.groupby("seg", sort=True):
            head = (pdf["user_id"].iloc[0], int(pdf["blk"].iloc[0]), int(seg))
            does, cents = part["does"].to_numpy(), part["cents"].to_numpy()
            if does[0] == RETRY:
                out.append((*head, True, int(cents[0]), part["job"].iloc[0], bool(part["last"].iloc[0]), [], [], [], []))
                low -= int(cents[0])
                continue
            start, plus, paid = pieces(does, cents, part["watched"].to_numpy(), low, high)
            jobs = part["job"][(part["does"] == TRY) & part["watched"]].tolist()
            out.append((*head, False, 0, None, False, start.tolist(), plus.tolist(), jobs, [np.packbits(p).tobytes() for p in paid]))
            credits = int(cents[does == CREDIT].sum())
            low, high = low + credits - int(cents[does == TRY].sum()), high + credits
        return pd.DataFrame(out, columns=[c.split()[0] for c in MAPS.split(", ")])

    return bounded.groupBy("user_id", "blk").applyInPandas(maps, MAPS)


OPENINGS = "user_id string, blk long, seg long, opening long, done boolean"


def chained(maps: DataFrame, opening: int) -> DataFrame:
    """The opening balance of every segment, and for a further try whether its job was paid before.

    The chain reads maps, not events; it holds a balance and the jobs that are still to be tried again.
    """
    ordered = maps.repartition("user_id").sortWithinPartitions("user_id", "blk", "seg")

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, balance, open_jobs, first = None, opening, {}, True
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if first or r.user_id != user:
                    user, balance, open_jobs, first = r.user_id, opening, {}, False
                if r.retry:
                    done = open_jobs[r.job]
                    out.append((user, r.blk, r.seg, balance, done))
                    if not done and balance >= r.cents:
                        balance -= r.cents
                        open_jobs[r.job] = True
                    if r.last:
                        del open_jobs[r.job]
                    continue
                out.append((user, r.blk, r.seg, balance, False))
                at = int(np.searchsorted(r.start, balance, side="right")) - 1
                for job, bits in zip(r.watched, r.paid):
                    open_jobs[job] = bool(bits[at >> 3] >> (7 - (at & 7)) & 1)
                balance += int(r.plus[at])
            yield pd.DataFrame(out, columns=["user_id", "blk", "seg", "opening", "done"])

    return ordered.mapInPandas(chain, OPENINGS)


PLACED = "user_id string, ev_id string, kind string, job_id string, job string, ord long, does int, cost long, outcome string, cost_cents long, balance_cents long, shortfall_cents long"


def settle_blocks(events: DataFrame, opening: int, rules: str) -> DataFrame:
    """``ledger.settle`` for long accounts."""
    ev = described(events, rules)
    openings = chained(block_maps(ev, opening), opening).select(F.col("user_id").alias("__u"), F.col("blk").alias("__b"), F.col("seg").alias("__s"), "opening", "done")
    known = ev.join(openings, F.col("user_id").eqNullSafe(F.col("__u")) & (F.col("blk") == F.col("__b")) & (F.col("seg") == F.col("__s")))

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        outcomes, costs, balances, shorts = [], [], [], []
        seg, balance = None, 0
        for s, begin, done, does, cents, amount, kind, free in zip(pdf.seg, pdf.opening, pdf.done, pdf.does, pdf.cents, pdf.amount, pdf.kind, pdf.free):
            if s != seg:
                seg, balance = s, int(begin)
            cost = short = 0
            if does == CREDIT:
                outcome = "ignored" if not amount else "refused" if cents == 0 else "credited"
                balance += int(cents)
            elif free:
                outcome = "first_free"
            elif does == NOOP or done:
                outcome = "settled"
            elif balance >= cents:
                outcome, cost, balance = "paid", int(cents), balance - int(cents)
            else:
                outcome, cost, short = "held", int(cents), int(cents) - balance
            outcomes.append(outcome)
            costs.append(cost)
            balances.append(balance)
            shorts.append(short)
        return pdf[["user_id", "ev_id", "kind", "job_id", "job", "ord", "does", "cost"]].assign(outcome=outcomes, cost_cents=costs, balance_cents=balances, shortfall_cents=shorts)

    done = known.groupBy("user_id", "blk").applyInPandas(apply, PLACED)
    columns = ("user_id", "ev_id", "kind", "job_id", "outcome", "cost_cents", "balance_cents", "shortfall_cents")
    if rules == "v037":
        return done.withColumn("outcome", F.when(F.col("outcome") == "settled", "free_empty").otherwise(F.col("outcome"))).select(*columns)
    # a run of a settled job names what settled it: the paying or free run, or the first run of no rows
    done = checkpoint(done)
    by = F.min(F.when(F.col("outcome").isin("paid", "first_free") | (F.col("cost") == 0), F.struct("ord", "cost_cents")))
    settler = done.filter(~F.col("kind").isin("topup", "grant", "adjust")).groupBy("user_id", "job").agg(by.alias("by")).select(F.col("user_id").alias("__u"), F.col("job").alias("__j"), "by")
    j = done.join(settler, F.col("user_id").eqNullSafe(F.col("__u")) & (F.col("job") == F.col("__j")) & (F.col("outcome") == "settled"), "left")
    again = F.col("ord") > F.col("by.ord")
    price = F.col("cost") if rules == "v030" else F.col("by.cost_cents")
    settled = F.col("outcome") == "settled"
    return j.withColumns({"outcome": F.when(settled, F.when(again, "already").otherwise("free_empty")).otherwise(F.col("outcome")),
                          "cost_cents": F.when(settled, F.when(again, price).otherwise(0)).otherwise(F.col("cost_cents"))}).select(*columns)
