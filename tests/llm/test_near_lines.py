"""Near lines against all pairs of lines, without any candidate search."""

import random

import duckdb
import numpy as np
import pytest

from gridmend.llm import line_dedup

SF = "/root/testdata/sf0.001"


def kept_by_all_pairs(docs):
    """Text of every document with one line left of each group that links of similarity 0.9 connect."""
    first = {}
    for d in sorted(docs):
        for i, line in enumerate(docs[d].split("\n")):
            if w := tuple(line_dedup.fold(line).split()):
                first.setdefault(w, (d, i))
    up = {w: w for w in first}

    def find(w):
        while up[w] != w:
            w = up[w]
        return w

    lines = sorted(first, key=len)
    for j, b in enumerate(lines):
        for a in reversed(lines[:j]):
            if len(a) < 0.9 * len(b) - 1e-9:
                break
            if line_dedup.edit_similarity(list(a), list(b)) >= 0.9:
                x, y = sorted((find(a), find(b)), key=first.get)
                up[y] = x
    stay = {first[w] for w in first if find(w) == w}
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) in stay or not line_dedup.fold(x).split()) for d, t in docs.items()}


def edited(rnd, words, edits, other):
    w = list(words)
    for _ in range(edits):
        at, how = rnd.randrange(len(w)), rnd.randrange(3)
        w[at:at + (how > 0)] = [other()] * (how < 2)
    return w


@pytest.mark.parametrize("vocabulary", [3, 40, 900])
def test_planted_lines(spark, vocabulary):
    """Lines of 8 to 320 words with up to a tenth of them changed, left out or put in; few words make word pairs repeat."""
    rnd = random.Random(vocabulary)
    word = lambda: "w" + "".join("abcdefghij"[int(c)] for c in str(rnd.randrange(vocabulary)))  # noqa: E731  digits are folded
    docs = {}
    for n in [*range(8, 42), 99, 100, 101, 318, 320]:
        base = [word() for _ in range(n)]
        docs[n] = "\n".join(" ".join(x) for x in (base, *[edited(rnd, base, e, word) for e in (n // 10, n // 10, (n + 2) // 10 + 1)]))
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert out == kept_by_all_pairs(docs)


def test_given_lines(spark):
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' WHERE text IS NOT NULL").fetchall())
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()} == kept_by_all_pairs(docs)


def test_prefixes_meet():
    """Any order of the word pairs will do: lines within the bound share one of their first ones."""
    rnd = random.Random(5)
    level = np.random.default_rng(1).integers(0, 9, 1 << line_dedup.CELL_BITS).astype(np.uint8)
    tried = 0
    for _ in range(3000):
        a = [f"x{'abcdefghij'[rnd.randrange(10)]}" for _ in range(rnd.randrange(8, 70))]
        b = edited(rnd, a, max(1, len(a) // 10), lambda: "y")
        if a != b and line_dedup.edit_similarity(a, b) >= 0.9:
            h, place, _, count, _, _ = line_dedup._lines([" ".join(a) + "\n" + " ".join(b)])
            keys, starts = line_dedup._prefixes(h, place, count, level)
            assert set(keys[:starts[1]].tolist()) & set(keys[starts[1]:].tolist())
            tried += 1
    assert tried > 500
