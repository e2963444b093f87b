"""Blocked joins lose nothing: compared with all pairs on random strings."""

import random
from difflib import SequenceMatcher

import pytest

from gridmend.functions.similarity import levenshtein_join, ratcliff_join
from gridmend.operators.resolve import leader_cluster


def edit(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def words(seed, n, alphabet="ابتم ن", lo=1, hi=14):
    rnd = random.Random(seed)
    out = set()
    while len(out) < n:
        w = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(lo, hi))).strip()
        if w:
            out.add(w)
            if len(w) > 2:
                i = rnd.randrange(len(w))
                out.add((w[:i] + rnd.choice(alphabet) + w[i + 1:]).strip() or w)
    return sorted(out)


@pytest.mark.parametrize("t", [0.65, 0.72, 0.86])
def test_ratcliff_join_is_complete(spark, t):
    a, b = words(1, 70), words(2, 70)
    got = {(r.x, r.y) for r in ratcliff_join(spark.createDataFrame([(w,) for w in a], "x string"), spark.createDataFrame([(w,) for w in b], "y string"), "x", "y", t).collect()}
    want = {(x, y) for x in a for y in b if SequenceMatcher(None, x, y).ratio() >= t}
    assert got == want


@pytest.mark.parametrize("thr", [0.20, 0.2858, 0.356])
def test_levenshtein_join_is_complete(spark, thr):
    a, b = words(3, 90, "ابتمن"), words(4, 90, "ابتمن")
    got = {(r.x, r.y, r.distance) for r in levenshtein_join(spark.createDataFrame([(w,) for w in a], "x string"), spark.createDataFrame([(w,) for w in b], "y string"), "x", "y", thr).collect()}
    want = {(x, y, edit(x, y)) for x in a for y in b if edit(x, y) <= thr * max(len(x), len(y)) + 1e-9}
    assert got == want


def test_leader_cluster_equals_greedy(spark):
    rnd = random.Random(9)
    vals = [(w, rnd.randint(1, 4)) for w in words(7, 60, "ابتم", 3, 9)]
    got = {(r.value, r.canonical) for r in leader_cluster(spark.createDataFrame(vals, "value string, n long"), 0.82, every=2).collect()}
    leaders, want = [], set()
    for v, _ in sorted(vals, key=lambda x: (-x[1], x[0])):
        lead = next((c for c in leaders if SequenceMatcher(None, v, c).ratio() >= 0.82), None)
        if lead is None:
            leaders.append(v)
        want.add((v, lead or v))
    assert got == want


def test_pair_tests_in_the_join_are_cheap(spark):
    # The optimizer moves the tests into the join, so no array may be built there for every candidate pair
    a = spark.createDataFrame([("ابجد",)], "t string")
    plan = ratcliff_join(a, a.withColumnRenamed("t", "u"), "t", "u", 0.8)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert joins and not any("array_intersect" in line or "lambda" in line for line in joins)
