"""The prefix trie against one built turn by turn."""

import hashlib
import random
import zlib

from gridmend.llm import prefix_trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, hashlib.md5(f"{len(r or '')}:{r or ''}{x or ''}".encode()).hexdigest(), (r or "", x or "")))
    own = {c: [turn for *_, turn in sorted(v)] for c, v in own.items()}
    nodes = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append((c, len(path) == d))
    name = {p: min(c for c, _ in m) for p, m in nodes.items()}
    children = {p: [] for p in nodes}
    for p in nodes:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = sum(saved[k] for k in children[p]) + ((len(nodes[p]) - 1) * len(p[-1][1].split()) if p else 0)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((name[p], len(p), name[p[:-1]] if p else -1, len(m), len(children[p]), leaves[p], saved[p], sha([c for c, end in m if end])) for p, m in nodes.items())


def built(spark, rows):
    df = spark.createDataFrame([(*r, "z", "z", 1) for r in rows], "conv_id long, turn long, role string, text string, pos string, depth string, a1 int")
    return sorted(tuple(-1 if r[c] is None and c == "parent_conv_id" else r[c] for c in COLUMNS) for r in prefix_trie.trie(df).collect())


def test_shared_beginnings(spark):
    """Few texts, so that prefixes repeat at all depths; copies, and one beginning in half of the conversations."""
    rnd = random.Random(2)
    rows = []
    for c in range(160):
        n, hot = rnd.choice((1, 2, 3, 4, 5, 8, 9, 13)), c % 2
        rows += [(c, t, ("user", "assistant")[t % 2], "one two" if hot and t < 6 else rnd.choice(("a", "b c", "d e f"))) for t in range(n)]
    rows += [(c, t, "user", f"copy {t}") for c in range(200, 260) for t in range(6)]
    assert built(spark, rows) == plain(rows)


def test_edges(spark):
    rows = [(0, None, None, None), (0, 3, "user", "x"), (0, 3, "user", "x"), (0, None, "user", ""), (1, 0, "user", "one"), (1, 0, "user", "two"), (21, 7, "system", "no base"), (None, 0, "user", "nobody"), (None, None, None, None),
            (40, 0, "user", "b"), *[(c, 0, "user", "short") for c in (*range(41, 60), *range(121, 130))], (60, 0, "u", "ser1"), (80, 0, "us", "er1"), *[(100, t, "user", "word " * 2000) for t in range(70)], *[(103, t, "user", "word " * 2000) for t in range(40)]]
    got = built(spark, rows)
    assert got == plain(rows)
    assert any(d == 0 and e != hashlib.sha256(b"").hexdigest() for _, d, *_, e in got)  # some conversation has no turn left
    assert built(spark, []) == []


def test_long_conversations(spark, monkeypatch):
    """Blocks of blocks: a run of blocks is shortened so that conversations cross several."""
    monkeypatch.setattr(prefix_trie, "RUN", 3)
    monkeypatch.setattr(prefix_trie, "PACK", 4)
    rows = [(c, t, "user", f"t{t if t < 30 + c % 7 else c % 5 * 1000 + t}") for c in range(45) for t in range(33 + c % 3 * 40)]
    assert built(spark, rows) == plain(rows)
