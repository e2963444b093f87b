"""Settlement in blocks against the fold of whole accounts."""

import datetime as dt
import random

import numpy as np
import pytest

from gridmend.operators import ledger, settlement

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "user_id string, ev_id string, ts timestamp, kind string, job_id string, amount long"


def folded(rows, rules, opening=50):
    out, accounts = [], {}
    for u, ev, _, kind, job, amount in sorted(rows, key=lambda r: (str(r[0]), r[2], r[1])):
        account = accounts.setdefault(u, ledger.new_account(opening))
        outcome, cost, short = ledger.settle_event(account, kind, job, int(amount or 0), rules)
        out.append((u, ev, kind, job, outcome, cost, account["balance"], short))
    return sorted(out, key=str)


def history(rnd, n, jobs, rich):
    rows = []
    for i in range(n):
        user = "hot" if rnd.random() < 0.9 else rnd.choice(["a", "b", None])
        event = rnd.choice([("run", f"j{rnd.randrange(jobs)}", rnd.choice([0, 3, 8, 20, 20, -2, None])), ("run", f"once{i}", rnd.randrange(40)), ("topup", None, rnd.randrange(60 * rich)), ("adjust", None, rnd.choice([-40, 0, 10**9])), ("run", None, 4)])
        rows.append((user, f"{i:05d}", T0 + dt.timedelta(minutes=i // 3 * 7), *event))
    return rows


@pytest.mark.parametrize("rules", ledger.RULES)
def test_blocks_equal_fold(spark, monkeypatch, rules):
    monkeypatch.setattr(settlement, "SETTLE_BLOCK", 16)
    rows = [r for seed, jobs, rich in ((1, 5, 1), (2, 200, 1), (3, 40, 3)) for r in ((f"{seed}{u}" if u else u, f"{seed}{e}", *rest) for u, e, *rest in history(random.Random(seed), 260, jobs, rich))]
    got = sorted((tuple(r) for r in ledger.settle(spark.createDataFrame(rows, SCHEMA), rules=rules).collect()), key=str)
    assert got == folded(rows, rules)


def test_pieces_are_the_fold():
    rnd = random.Random(4)
    for _ in range(60):
        n = rnd.randrange(1, 40)
        does = np.array([rnd.choice([settlement.CREDIT, settlement.TRY, settlement.TRY, settlement.NOOP]) for _ in range(n)])
        cents = np.array([rnd.randrange(1, 30) * (1 if d != settlement.CREDIT or rnd.random() < 0.8 else -1) for d in does])
        watched = np.array([rnd.random() < 0.3 for _ in range(n)])
        start, plus, paid = settlement.pieces(does, cents, watched, -50, 400)
        assert len(start) <= 450 and (np.diff(start) > 0).all()
        for opening in range(-50, 401):
            b, seen = opening, []
            for d, c, w in zip(does, cents, watched):
                if d == settlement.CREDIT:
                    b += c
                elif d == settlement.TRY:
                    if w:
                        seen.append(b >= c)
                    b -= c if b >= c else 0
            at = np.searchsorted(start, opening, side="right") - 1
            assert opening + plus[at] == b and [p[at] for p in paid] == seen


def test_no_task_reads_more_than_its_block(spark, monkeypatch):
    """Nine tenths of the events on one account: groups stay at the size of a block."""
    monkeypatch.setattr(settlement, "SETTLE_BLOCK", 32)
    rows = history(random.Random(7), 600, 400, 2)
    ev = settlement.described(spark.createDataFrame([r for r in rows if r[0] == "hot"], SCHEMA), "v041")
    assert ev.groupBy("user_id", "blk").count().agg({"count": "max"}).first()[0] <= 32
    maps = settlement.block_maps(ev, 50)
    assert maps.groupBy("blk").count().count() == ev.select("blk").distinct().count() > 10
