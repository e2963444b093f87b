"""Label review, credits, guest quotas and settlement as streams, in event order and by the rules of their batch forms."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from gridmend.functions import constants as K
from gridmend.operators.labels import review_lifecycle
from gridmend.operators.ledger import SETTLE_SCHEMA, add_balance, settle_event
from gridmend.sources.versioned import VersionedTable
from gridmend.streaming.ordered import KEEP_MS, WATERMARK, InOrder, in_event_order, keyed_rows, late_table, parsed, run_batches

LABEL_STATE = ("id string, status string, label string, verified_by string, verified_at timestamp_ntz, approved_by string, approved_at timestamp_ntz, rejected_by string, "
               "rejected_at timestamp_ntz, reason string, applied bigint, requested bigint")
_STATE_COLUMNS = [c.split()[0] for c in LABEL_STATE.split(", ")]


def open_labels(store: VersionedTable, labels: DataFrame) -> int:
    """Put labels (id, status, label and what else of the state they have) into the store that a review stream continues."""
    kinds = dict(c.split(" ", 1) for c in LABEL_STATE.split(", "))
    start = {"applied": F.lit(0), "requested": F.lit(0)}
    return store.upsert(labels.select(*[(F.col(c) if c in labels.columns else start.get(c, F.lit(None))).cast(kinds[c]).alias(c) for c in _STATE_COLUMNS]))


def review_lifecycle_stream(events: DataFrame, store: VersionedTable, checkpoint_dir: str, late_root: str, delay: str = WATERMARK, keep_ms: int = KEEP_MS):
    """Review events (id, seq, role, action, label, actor, ts, reason) applied to the labels in ``store`` as they come.

    Events wait until the watermark has passed them, so a micro-batch continues the order of those before it, and the
    block maps of ``labels.review_lifecycle`` take every label from its stored state on. Events of one label need times
    that grow with seq. Each micro-batch is one version of the store and is applied once, also if it is replayed. Events
    delivered again do nothing; events that come after a later one of their label was applied go to ``late_root``.
    """
    ordered = in_event_order(events, ["id"], "ts", "seq", delay, keep_ms)

    def apply(batch: DataFrame, number: int) -> None:
        def moved(current: DataFrame | None) -> DataFrame:
            if current is None:
                raise ValueError("open_labels comes first")
            return review_lifecycle(current, batch, resume=True).select(*_STATE_COLUMNS)

        if number > store.done("review"):
            store.commit(moved, "review", number)

    return run_batches(ordered, apply, checkpoint_dir, late_table(late_root))


def credit_tables(spark: SparkSession, root: str) -> tuple[VersionedTable, VersionedTable]:
    """The ledger, cut by day, and the balances that ``add_balance_stream`` keeps under ``root``."""
    return VersionedTable(spark, f"{root}/ledger", [], [], ["day"]), VersionedTable(spark, f"{root}/balances", ["user_id"], ["batch"])


def open_balances(balances: VersionedTable, profiles: DataFrame) -> int:
    return balances.upsert(profiles.select("user_id", F.col("balance_cents").cast("long").alias("balance_cents"), F.lit(-1).cast("long").alias("batch")))


def add_balance_stream(events: DataFrame, ledger: VersionedTable, balances: VersionedTable, checkpoint_dir: str):
    """Credits (user_id, ev_id, ts, amount) booked in ``ledger`` with the balance after each, as ``ledger.add_balance``
    decides, and ``balances`` kept up to date.

    Credits add up in any order, so no row waits and none can be late; a micro-batch is booked in order of time. A row is
    booked once: both tables name the last micro-batch that they hold, so a replayed one adds nothing, and an event whose
    id the ledger holds on its day is left out. The ledger comes first; balances that miss its last batch after a crash
    are made from the rows it booked.
    """

    def apply(batch: DataFrame, number: int) -> None:
        def booked(current: DataFrame | None) -> DataFrame:
            new = batch.dropDuplicates(["ev_id"]).withColumn("day", F.to_date("ts"))
            if current is not None:
                first, last = new.agg(F.min("day"), F.max("day")).first()
                seen = current.where(F.col("day").between(first, last)).select("ev_id")  # folders of other days are not read
                new = new.join(seen, "ev_id", "left_anti")
            have = balances.read()
            none = new.sparkSession.createDataFrame([], "user_id string, balance_cents long")
            done = add_balance(new, none if have is None else have)
            return done.join(new.select("ev_id", "ts", "day"), "ev_id").withColumn("batch", F.lit(number).cast("long"))

        if number > ledger.done("credits"):
            ledger.commit(booked, "credits", number)
        if number > balances.done("credits"):
            rows = ledger.read().where(F.col("batch") == number)
            after = rows.groupBy("user_id").agg(F.max_by("balance_after", F.struct("ts", "ev_id")).alias("balance_cents"))
            balances.commit(lambda current: after.withColumn("batch", F.lit(number).cast("long")), "credits", number)

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()


class _Trailing(InOrder):
    """How many events the trailing ``span`` holds at each event, events of equal time included.

    State is a ring of hour buckets with the times in them; buckets in the middle of a window count whole, the two at its
    edges by their times. Buckets older than a window and ``keep_ms`` go.
    """

    BUCKET = 3_600_000_000

    def __init__(self, names: list[str], span: int, keep_ms: int):
        super().__init__(keep_ms)
        self.names, self.span = names, span

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getMapState("ring", "bucket long", "times array<long>")

    def _bucket(self, b: int) -> list[int]:
        return [int(t) for t in self.ring.getValue((b,))[0]] if self.ring.containsKey((b,)) else []

    def advance(self, key: tuple, rows: list[tuple], late: bool) -> pd.DataFrame:
        held: dict[int, list[int]] = {}
        size: dict[int, int] = {}

        def times(b: int) -> list[int]:
            if b not in held:
                held[b] = self._bucket(b)
            return held[b]

        changed = set()
        for at, *_ in rows:
            insort(times(at // self.BUCKET), at)
            changed.add(at // self.BUCKET)
        for b in changed:
            self.ring.updateValue((b,), (held[b],))
        counts = []
        for at, *_ in rows:
            first, last = (at - self.span) // self.BUCKET, at // self.BUCKET
            n = bisect_right(times(last), at) - (bisect_left(times(last), at - self.span) if first == last else 0)
            if first < last:
                n += len(times(first)) - bisect_left(times(first), at - self.span)
                for b in range(first + 1, last):
                    if b not in size or b in changed:
                        size[b] = len(times(b))
                    n += size[b]
            counts.append(n)
        columns = list(zip(*rows))
        out = {n: [k] * len(rows) for n, k in zip(self.names, key)}
        return pd.DataFrame(out | {"at_us": columns[0], "event_name": columns[1], "event_row": columns[2], "n": counts, "late": late})

    def forget(self, before: int) -> bool:
        keys = [k[0] for k in self.ring.keys()]
        old = [b for b in keys if (b + 1) * self.BUCKET < before - self.span]
        for b in old:
            self.ring.removeKey((b,))
        return len(old) == len(keys)


def guest_quota_stream(jobs: DataFrame, per_ip: int = 2, overall: int = 25, hours: int = 24, delay: str = WATERMARK) -> DataFrame:
    """``ledger.guest_quota`` over a stream of admitted guest jobs (job_id, ip_hash, created_at), with ``late`` added.

    Two stateful steps: by address, then over all guests, which is one key by its meaning; what reaches it is a time, an id
    and a count. A late job is counted for itself and for those after it; verdicts already given stand.
    """
    span = hours * 3_600_000_000
    first = keyed_rows(jobs.select("job_id", "ip_hash", "created_at"), ["ip_hash"], "created_at", "job_id", delay)
    kind = jobs.schema["ip_hash"].dataType.simpleString()
    columns = "at_us long, event_name string, event_row string, n long, late boolean"
    by_ip = first.groupBy("ip_hash").transformWithStateInPandas(_Trailing(["ip_hash"], span, hours * 3_600_000), f"ip_hash {kind}, {columns}", "Append", "EventTime")
    second = by_ip.select(F.lit(0).alias("everyone"), "at_us", "event_name", F.to_json(F.struct("ip_hash", "n", "late")).alias("event_row"))
    both = second.groupBy("everyone").transformWithStateInPandas(_Trailing(["everyone"], span, hours * 3_600_000), f"everyone int, {columns}", "Append", "EventTime")
    own = F.from_json("event_row", f"ip_hash {kind}, n long, late boolean")
    counted = both.select(F.col("event_name").cast(jobs.schema["job_id"].dataType).alias("job_id"), own.alias("own"), F.col("n").alias("all_day"), "late")
    return counted.select("job_id", "own.ip_hash", F.col("own.n").alias("ip_day"), "all_day", ((F.col("own.n") >= per_ip) | (F.col("all_day") >= overall)).alias("next_denied"), (F.col("late") | F.col("own.late")).alias("late"))


class _OrderedSettlement(InOrder):
    """One account: its balance, and a row of state per job, dropped ``keep_ms`` after the job's last event."""

    def __init__(self, opening: int, rules: str, keep_ms: int):
        super().__init__(keep_ms)
        self.opening, self.rules = opening, rules

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.account = handle.getValueState("account", "balance long, charged long")
        self.jobs = handle.getMapState("jobs", "job string", "paid long, n_rows long, cost long, charged boolean, at long")

    def advance(self, key: tuple, rows: list[tuple], late: bool) -> pd.DataFrame:
        balance, charged = self.account.get() if self.account.exists() else (self.opening, 0)
        out = []
        for at, ev, e in parsed(rows):
            kind, job, amount = e["kind"], e["job_id"], int(e["amount"] or 0)
            name = (job or "",)
            paid, n_rows, cost, own, _ = self.jobs.getValue(name) if kind == "run" and self.jobs.containsKey(name) else (None, None, None, False, 0)
            state = {"balance": int(balance), "paid": {} if paid is None else {job: int(paid)}, "held": {} if n_rows is None else {job: (int(n_rows), int(cost))},
                     "charged": ({job} if own else set()) | ({_OTHERS} if charged - bool(own) > 0 else set())}
            outcome, price, short = settle_event(state, kind, job, amount, self.rules)
            balance = state["balance"]
            if kind == "run":
                now = job in state["charged"]
                charged += now and not own
                held = state["held"].get(job, (None, None))
                self.jobs.updateValue(name, (state["paid"].get(job), *held, now, at))
            out.append((*key, ev, kind, job, outcome, price, balance, short, late))
        self.account.update((balance, charged))
        return pd.DataFrame(out, columns=["user_id", "ev_id", "kind", "job_id", "outcome", "cost_cents", "balance_cents", "shortfall_cents", "late"])

    def forget(self, before: int) -> bool:
        for job, (*_, at) in list(self.jobs.iterator()):
            if at < before:
                self.jobs.removeKey(job)
        return not self.account.exists()  # a balance is money and stays


#: Stands for the jobs of an account other than the one at hand.
_OTHERS = object()


def settle_in_order_stream(events: DataFrame, opening_cents: int = K.SIGNUP_GRANT_CENTS, rules: str = "v041", delay: str = WATERMARK, keep_days: int = 400) -> DataFrame:
    """``ledger.settle`` over a stream, in order of event time across micro-batches, with ``late`` added.

    Events wait for the watermark. One that comes later still is settled on arrival and marked, so no money is lost, and
    ``run_batches`` can write the marked rows to a table of their own. A job is remembered ``keep_days`` after its last
    event; the balance, and that the account was charged before, for good.
    """
    rows = keyed_rows(events.select("user_id", "ev_id", "ts", "kind", "job_id", F.col("amount").cast("long").alias("amount")), ["user_id"], "ts", "ev_id", delay)
    return rows.groupBy("user_id").transformWithStateInPandas(_OrderedSettlement(opening_cents, rules, keep_days * 86_400_000), SETTLE_SCHEMA + ", late boolean", "Append", "EventTime")


class _Settlement(_OrderedSettlement):
    """The same account, settled in order of arrival: a micro-batch is ordered, and nothing waits."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = sorted((int(at), ev, row) for pdf in rows for at, ev, row in zip(pdf["at_us"], pdf["event_name"], pdf["event_row"]))
        if not self.mark.exists():
            sweep = batch[-1][0] // 1000 + self.keep_ms + 1
            self.mark.update((0, "", -1, sweep))
            self.handle.registerTimer(sweep)
        yield self.advance(key, batch, False).drop(columns="late")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        self.forget((now - self.keep_ms) * 1000)
        self.handle.registerTimer(now + self.keep_ms)
        return iter(())


def settle_stream(events: DataFrame, opening_cents: int = K.SIGNUP_GRANT_CENTS, rules: str = "v041", keep_days: int = 400) -> DataFrame:
    """``ledger.settle`` over a stream in order of arrival, at once: for callers that cannot wait for the watermark. Events
    behind the watermark are settled like all others."""
    rows = keyed_rows(events.select("user_id", "ev_id", "ts", "kind", "job_id", F.col("amount").cast("long").alias("amount")), ["user_id"], "ts", "ev_id", WATERMARK)
    return rows.groupBy("user_id").transformWithStateInPandas(_Settlement(opening_cents, rules, keep_days * 86_400_000), SETTLE_SCHEMA, "Append", "EventTime")
