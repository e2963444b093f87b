"""The filter audit against a plain walk of every order over every document."""

import collections
import itertools
import random
import re

import numpy as np
import pytest

from gridmend.llm import filter_audit

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def fails(text, doc_id, texts):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": doc_id is not None and any(o is not None and o < doc_id and t == text for o, t in texts)}


def plain(docs, labels):
    texts = [(d, t or "") for d, t, _ in docs]
    mark = lambda k, d: any(r[0] == d and r[k] == 1 for r in labels) if d is not None else False
    rows = [(la or "", {f for f, bad in fails(t or "", d, texts).items() if bad}, mark(1, d), mark(2, d)) for d, t, la in docs]
    out, shapley = {}, collections.Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                stay = [r for r in left if f not in r[1]]
                out[part, order, step] = [len(stay), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shapley[part, f] += len(gone)
                left = stay
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, docs, labels):
    d = spark.createDataFrame([(*r, "z", "z", "z") for r in docs], "doc_id long, text string, lang string, part string, mask string, first_id string")
    m = spark.createDataFrame([(*r, "z") for r in labels], "doc_id long, quality int, toxic int, good string")
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in filter_audit.audit(d, m).collect()}


def test_edges(spark):
    rnd = random.Random(3)
    prose = lambda n, k=10**6: " ".join(f"w{rnd.randrange(k)}" for _ in range(n))
    long, dull = prose(60_000), prose(300, 40)
    docs = [(0, None, "en"), (1, "", None), (2, " \n\t ", ""), (3, prose(200), "en"), (4, prose(199), "en"), (5, dull, "en"), (5, dull, "en"), (6, dull, "fr"), (None, dull, "en"), (None, None, None),
            (7, long, "en"), (8, long + " x", "en"), (9, "ÄÖÜ" * 200 + " " + prose(250), "de"), (10, "ABC " * 30 + prose(300), "de"), (11, prose(250) + " #", "de"), (12, "ABC # " * 100, "de"), (13, dull, "de"), (-4, dull, "de")]
    labels = [(0, 1, 0), (3, 1, None), (5, 0, 1), (6, 1, 1), (12, None, 1), (13, 1, 0), (13, 0, 1), (None, 1, 1), (99, 1, 1)]
    assert audited(spark, docs, labels) == plain(docs, labels)
    assert audited(spark, docs, []) == plain(docs, [])
    assert audited(spark, [], labels) == {}


def test_hot_text(spark):
    """One text in a third of the rows; every mask occurs."""
    rnd = random.Random(8)
    texts = ["same"] * 40 + [" ".join(f"w{rnd.randrange(10 ** (1 + i % 5))}" for _ in range(rnd.choice((20, 260)))) + rnd.choice(("", " #", " AAAAAAAAAA" * 9)) for i in range(60)]
    docs = [(i, t, rnd.choice(("en", "de"))) for i, t in enumerate(rnd.sample(texts * 2, 120))]
    labels = [(i, rnd.randrange(2), rnd.randrange(2)) for i in range(0, 120, 2)]
    assert audited(spark, docs, labels) == plain(docs, labels)


@pytest.mark.parametrize("k", [1, 3, 5])
def test_walk(k):
    counts = np.random.default_rng(k).integers(0, 50, (2, 3, 1 << k))
    states = filter_audit.walk(counts, k)
    for subset in range(1 << k):
        assert (states[..., subset] == counts[..., [m for m in range(1 << k) if not m & subset]].sum(axis=-1)).all()
