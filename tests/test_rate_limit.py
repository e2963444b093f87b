"""Rate limit windows in blocks against one pass over each key."""

import datetime as dt
import random

import numpy as np
import pytest

from gridmend.operators import flow

T0 = dt.datetime(2024, 1, 1)


def one_pass(rows, max_hits, seconds):
    out, state = set(), {}
    for key, ev, ts in sorted(rows, key=lambda r: (str(r[0]), r[2], r[1])):
        now = int((ts - dt.datetime(1970, 1, 1)) / dt.timedelta(milliseconds=1))
        reset, count = state.get(key, (-1, 0))
        if now > reset:
            reset, count = now + seconds * 1000, 0
        count += count <= max_hits
        state[key] = (reset, count)
        out.add((key, ev, reset, count <= max_hits))
    return out


@pytest.mark.parametrize("seconds", [5, 120, 5000, 90_000])
def test_blocks_equal_one_pass(spark, monkeypatch, seconds):
    """Nine tenths on one key; blocks shorter and longer than a window, three levels of composed functions."""
    monkeypatch.setattr(flow, "LIMIT_BLOCK", 5)
    monkeypatch.setattr(flow, "LIMIT_FAN", 4)
    rnd, t, rows = random.Random(seconds), 0.0, []
    for i in range(500):
        t += rnd.choice([0, 0.0004, 0.5, 3, 40, 700])
        rows.append((rnd.choice(["hot"] * 18 + ["b", None]), f"{i:05d}", T0 + dt.timedelta(seconds=t)))
    got = flow.rate_limit(spark.createDataFrame(rows, "key string, ev_id string, ts timestamp"), 3, seconds).collect()
    assert len(got) == len(rows) and {(r.key, r.ev_id, r.window_reset_ms, r.allowed) for r in got} == one_pass(rows, 3, seconds)


def test_composed_steps():
    rnd = np.random.default_rng(3)
    for _ in range(50):
        steps = []
        for low in np.arange(0, 500, 100):
            t = np.unique(rnd.integers(low, low + 100, 8))
            steps.append((t, np.maximum.accumulate(t + rnd.integers(1, 150, len(t)))))
        brk, out = flow._compose(iter(steps))
        x = np.arange(-5, 700)
        want = x
        for b, o in steps:
            want = flow._eval(b, o, want)
        assert (flow._eval(brk, out, x) == want).all() and len(brk) <= 40
