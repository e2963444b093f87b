"""Streams in event order equal the batch forms, whatever the order of arrival; late and repeated events; replayed batches."""

import collections
import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from gridmend.operators import labels, ledger
from gridmend.sources.versioned import Conflict, VersionedTable
from gridmend.streaming import jobs as ST
from gridmend.streaming import ordered as O
from gridmend.streaming import review as R

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def rocksdb(spark):
    ST.use_rocksdb(spark)


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def source(spark, batches, schema, root):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/in/b{i:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{root}/in")


def collected(spark, batches, schema, build, name):
    root = folder()
    q = (build(source(spark, batches, schema, root)).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start())
    q.awaitTermination(300)
    return spark.table(name).collect()


def shuffled(rows, at, rnd, minutes, size):
    """Batches in which every row comes at most ``minutes`` out of order."""
    rows = sorted(rows, key=lambda r: r[at] + dt.timedelta(minutes=rnd.random() * minutes))
    return [rows[i:i + size] for i in range(0, len(rows), size)]


REVIEW = "id string, seq long, role string, action string, label string, actor string, ts timestamp, reason string"


def review_events(rnd, n, ids):
    out = []
    for seq in range(n):
        role = rnd.choice(["reviewer", "approver"])
        action = rnd.choice(["pending", "verified", "verified", None] if role == "reviewer" else ["approved", "rejected"])
        out.append((rnd.choice(ids), seq, role, action, rnd.choice([None, " new "]), f"p{seq % 5}", T0 + dt.timedelta(minutes=seq), rnd.choice([None, "why", ""])))
    return out


def test_review_stream_equals_batch(spark):
    rnd = random.Random(4)
    rows = review_events(rnd, 150, ["a", "a", "a", "b", "c"])
    closing = [("z", 10_000, "reviewer", None, None, "p", T0 + dt.timedelta(days=30), None)] * 2
    repeated = rnd.sample(rows, 15)
    batches = shuffled(rows + repeated, 6, rnd, 40, 60) + [closing, closing]
    start = spark.createDataFrame([(i, "pending", "old") for i in "abcz"], "id string, status string, label string")
    root = folder()
    store = VersionedTable(spark, f"{root}/labels", ["id"], ["requested"])
    R.open_labels(store, start)
    late = (rows[0][0], 500_000, "reviewer", "verified", "too late", "p9", T0 - dt.timedelta(minutes=1), None)
    batches.append([late])
    R.review_lifecycle_stream(source(spark, batches, REVIEW, root), store, f"{root}/ck", f"{root}/late").awaitTermination(300)
    want = {r.id: r for r in labels.review_lifecycle(start, spark.createDataFrame(rows, REVIEW)).collect()}
    got = {r.id: r for r in store.read().select(*want["a"].asDict()).collect()}
    assert {k: got[k] for k in want} == want
    assert [r.label for r in spark.read.parquet(f"{root}/late").collect()] == ["too late"]


def test_replayed_batch_adds_nothing(spark):
    rnd = random.Random(6)
    rows = [(f"u{rnd.randrange(4)}", f"e{i:03d}", T0 + dt.timedelta(hours=i), rnd.choice([100, 250, -30, 0, 10**9, None])) for i in range(60)]
    schema = "user_id string, ev_id string, ts timestamp, amount long"
    profiles = spark.createDataFrame([("u0", 1000), ("u1", 5)], "user_id string, balance_cents long")
    want = {r.ev_id: r for r in ledger.add_balance(spark.createDataFrame(rows, schema), profiles).collect()}
    root = folder()
    books, balances = R.credit_tables(spark, root)
    R.open_balances(balances, profiles)
    batches = [rows[i:i + 20] for i in range(0, 60, 20)] + [rows[10:20] + rows[50:]]  # at the end, rows that were booked long ago
    stream = source(spark, batches, schema, root)
    R.add_balance_stream(stream, books, balances, f"{root}/ck").awaitTermination(300)
    check = lambda: {r.ev_id: r for r in books.read().select("user_id", "ev_id", "kind", "amount_cents", "balance_after").collect()}
    assert check() == want and books.read().count() == len(want)
    closing = {r.user_id: r.balance_cents for r in balances.read().collect()}
    # everything once more, as after a lost checkpoint: the same batches under the same numbers
    R.add_balance_stream(stream, books, balances, f"{root}/ck2").awaitTermination(300)
    assert check() == want and books.read().count() == len(want)
    assert {r.user_id: r.balance_cents for r in balances.read().collect()} == closing
    last = {}
    for _, ev, *_ in rows:
        if ev in want:
            last[want[ev].user_id] = want[ev].balance_after
    assert closing == {"u0": 1000, "u1": 5} | last


def test_balances_recover_from_the_ledger(spark):
    """A crash between the two tables: the ledger holds the batch, the balances do not."""
    rows = [("u0", "a", T0, 100), ("u0", "b", T0 + dt.timedelta(hours=1), 20)]
    schema = "user_id string, ev_id string, ts timestamp, amount long"
    root = folder()
    books, balances = R.credit_tables(spark, root)
    R.add_balance_stream(source(spark, [rows], schema, root), books, balances, f"{root}/ck").awaitTermination(120)
    _, lost = R.credit_tables(spark, f"{root}/other")
    R.add_balance_stream(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/in"), books, lost, f"{root}/ck3").awaitTermination(120)
    assert [(r.user_id, r.balance_cents) for r in lost.read().collect()] == [("u0", 120)] and books.read().count() == 2


def test_guest_quota_stream_equals_batch(spark):
    rnd = random.Random(9)
    t, rows = 0, []
    for i in range(140):
        t += rnd.choice([0, 0, 60, 1800, 7000])
        rows.append((f"j{i}", f"ip{rnd.randrange(4)}", T0 + dt.timedelta(seconds=t)))
    edge = rows[0][2] + dt.timedelta(hours=24)
    rows += [("edge", "ip0", edge), ("past", "ip0", edge + dt.timedelta(microseconds=1))]
    schema = "job_id string, ip_hash string, created_at timestamp"
    closing = [("end", "ip9", T0 + dt.timedelta(days=90))]
    got = collected(spark, shuffled(rows, 2, rnd, 30, 50) + [closing, closing, closing], schema, R.guest_quota_stream, "gq")
    want = ledger.guest_quota(spark.createDataFrame(rows, schema)).collect()
    assert {tuple(r)[:5] for r in got if r.job_id != "end"} == {tuple(r) for r in want}
    assert not any(r.late for r in got)


@pytest.mark.parametrize("rules", ["v041", "v037"])
def test_settlement_in_order(spark, rules):
    rnd = random.Random(5)
    rows = [(f"u{rnd.randrange(3)}", f"{i:05d}", T0 + dt.timedelta(minutes=i), *rnd.choice([("run", f"j{rnd.randrange(8)}", rnd.randrange(30)), ("topup", None, 25), ("adjust", None, -9)])) for i in range(150)]
    schema = "user_id string, ev_id string, ts timestamp, kind string, job_id string, amount long"
    closing = [("z", f"{99_000 + i}", T0 + dt.timedelta(days=9), "topup", None, 1) for i in range(1)]
    late = ("u0", "00000x", T0 - dt.timedelta(days=1), "topup", None, 777)
    batches = shuffled(rows, 2, rnd, 50, 80) + [closing, closing, [late]]
    got = collected(spark, batches, schema, lambda s: R.settle_in_order_stream(s, rules=rules), f"so{rules}")
    want = ledger.settle(spark.createDataFrame(rows, schema), rules=rules).collect()
    assert sorted((tuple(r)[:-1] for r in got if r.user_id != "z" and not r.late), key=str) == sorted(map(tuple, want), key=str)
    (too_late,) = [r for r in got if r.late]
    balance = max((r for r in want if r.user_id == "u0"), key=lambda r: r.ev_id).balance_cents
    assert (too_late.ev_id, too_late.outcome, too_late.balance_cents) == ("00000x", "credited", balance + 777)


def test_state_goes(spark):
    """Ids are forgotten some time after the last event: an id that comes again much later is a new event."""
    m = lambda n: T0 + dt.timedelta(minutes=n)
    batches = [[("a", "1", m(0)), ("a", "1", m(0))], [("b", "2", m(100))], [("a", "1", m(0))], [("b", "3", m(9000))], [("b", "4", m(19_000))], [("a", "1", m(18_990))], [("b", "5", m(40_000))], [("b", "6", m(60_000))]]
    got = collected(spark, batches, "k string, ev_id string, ts timestamp", lambda s: O.in_event_order(s, ["k"], keep_ms=1000 * 60_000), "sg")
    assert collections.Counter((r.k, r.ev_id, r.late) for r in got if r.k == "a") == {("a", "1", False): 2}


# --- versioned tables ---------------------------------------------------------------------------------------------


def test_two_writers(spark):
    """The second writer finds its version taken and builds on what the first left."""
    store = VersionedTable(spark, folder() + "/t", ["k"], ["n"])
    rows = lambda *r: spark.createDataFrame(list(r), "k string, n long")
    store.upsert(rows(("a", 1)))
    other, tries = VersionedTable(spark, store.root, ["k"], ["n"]), []

    def add_one(current):
        tries.append(current.count())
        if len(tries) == 1:
            assert other.commit(lambda c: c.withColumn("n", F.col("n") + 10)) == 1
        return current.withColumn("n", F.col("n") + 1)

    assert store.commit(add_one) == 2 and len(tries) == 2
    assert [tuple(r) for r in store.read().collect()] == [("a", 12)]
    assert [tuple(r) for r in store.read(0).collect()] == [("a", 1)]

    def always_late(current):
        other.commit(lambda c: c)
        return current

    with pytest.raises(Conflict):
        store.commit(always_late, retries=1)


def test_snapshots_and_order(spark):
    store = VersionedTable(spark, folder() + "/t", ["k"], ["n"])
    want = {}
    for i in range(19):
        row = (f"k{i % 3}", (i * 7) % 10)
        store.upsert(spark.createDataFrame([row], "k string, n long"))
        want[row[0]] = max(want.get(row[0], -1), row[1])
    assert dict(map(tuple, store.read().collect())) == want
    grown = VersionedTable(spark, folder() + "/g", [], [])
    for i in range(17):
        grown.upsert(spark.createDataFrame([(i,)], "n long"))
    assert sorted(r.n for r in grown.read().collect()) == list(range(17)) and grown.read(3).count() == 4
