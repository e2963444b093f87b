"""The pipeline against a plain restatement, stage by stage, each on its own input."""

import collections
import hashlib
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from gridmend.llm import decontaminate, quality_rules
from tests.llm.test_near_lines import kept_by_all_pairs

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output rows of every stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = ({r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in after.collect()}, after.columns)
        docs = after
    return out


def statistics(t):
    w = re.findall(WORD, t)
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    often, covered = collections.Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    n, chars = len(w), sum(map(len, w))
    share = lambda a, b: np.sqrt(min(1.0, a / b))
    vector = [share(sum(c in quality_rules.SYMBOLS for c in t), n + 20), share(len(covered), n + 20), share(len(lines) - len(set(lines)), len(lines) + 4),
              np.log((chars + 100) / (n + 20)), share(sum("A" <= c <= "Z" for c in t), chars + 60), share(sum(c in "!?" for c in t), n + 20)]
    return np.array(vector), n < 10 or 100 * len(covered) > 20 * n


def quantile(values, p):
    v = np.sort(values)
    return v[max(0, int(np.ceil(p * len(v))) - 1)]


def test_quality_rules(stages):
    before, after, columns = stages["quality_rules"]
    assert columns == list(corpus_pipeline.COLUMNS)
    groups = collections.defaultdict(list)
    base = {d: statistics(r.text or "") for d, r in before.items()}
    for d, r in before.items():
        if not base[d][1]:
            groups[r.lang, r.source].append(d)
    floors = np.array(list(quality_rules.FLOORS.values()))
    want = set()
    for ids in groups.values():
        x = np.array([base[d][0] for d in ids])
        middle = np.array([quantile(x[:, k], 0.5) for k in range(x.shape[1])])
        d2 = (((x - middle) / floors) ** 2).sum(axis=1)
        for _ in range(quality_rules.STEPS):
            near = x[d2 <= quantile(d2, quality_rules.KEPT) + 1e-12]
            cov = near.T @ near / len(near) - np.outer(near.mean(0), near.mean(0)) + np.diag(floors ** 2)
            d2 = np.einsum("ij,jk,ik->i", x - near.mean(0), np.linalg.inv(cov), x - near.mean(0))
        want |= {d for d, v in zip(ids, d2) if v <= quality_rules.CUT}
    assert set(after) == want


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in ids}


def test_line_dedup(stages):
    before, after, columns = stages["line_dedup"]
    assert columns == list(corpus_pipeline.COLUMNS) and set(after) == set(before)
    want = kept_by_all_pairs({d: r.text for d, r in before.items() if r.text is not None})
    assert {d: r.text for d, r in after.items()} == {d: want.get(d) for d in before}
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after.values())


def test_near_copies(stages):
    before, after, columns = stages["minhash_dedup"]
    assert columns == list(corpus_pipeline.COLUMNS)
    sets = {}
    for d, r in before.items():
        w = re.findall(WORD, (r.text or "").lower())
        if w:
            sets[d] = collections.Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))
    links, ids = [], sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            low = sum((sets[a] & sets[b]).values())
            if low >= 0.8 * (sets[a].total() + sets[b].total() - low):
                links.append((a, b))
    root = components(ids, links)
    assert set(after) == {d for d in before if d not in root or root[d] == d}
    assert all(tuple(after[d]) == tuple(before[d]) for d in after)


def test_decontamination(stages):
    before, after, columns = stages["decontaminate"]
    assert columns == list(corpus_pipeline.COLUMNS)
    items = [decontaminate.fold(t or "").split() for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    n, bad = decontaminate.SEED, set()
    places = [collections.defaultdict(list) for _ in items]
    for at, w in zip(places, items):
        for i in range(len(w) - n + 1):
            at[tuple(w[i:i + n])].append(i)
    for d, r in before.items():
        w = decontaminate.fold(r.text or "").split()
        for at, item in zip(places, items):
            hits = [(i, j) for j in range(len(w) - n + 1) for i in at.get(tuple(w[j:j + n]), ())]
            if hits and decontaminate.tile(*np.array(hits).T)[1] >= decontaminate.COVERAGE * len(item):
                bad.add(d)
    assert set(after) == set(before) - bad


def test_mixture(stages):
    before, after, _ = stages["mix_sources"]
    by = collections.defaultdict(list)
    for d, r in before.items():
        h = int(hashlib.md5(str(d).encode()).hexdigest()[:15], 16)
        by[r.source].append((h, d, len(re.findall(WORD, r.text or ""))))
    sizes = {s: sum(x[2] for x in v) for s, v in by.items()}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(s for s in sizes if s is not None))}
    target, open_, left = {}, set(sizes), float(sum(sizes.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]} or open_
        target |= {s: min(share[s], 3.0 * sizes[s]) for s in over}
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    copies = {}
    for s, rows in by.items():
        full = int(target[s] // sizes[s]) if sizes[s] else 0
        need, so_far = target[s] - full * sizes[s], 0
        for _, d, n in sorted(rows):
            copies[d] = full + (need > 0 and so_far + n / 2 <= need)
            so_far += n
    assert {d: r.copies for d, r in after.items()} == {d: c for d, c in copies.items() if c}
