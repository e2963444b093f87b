"""Secret scan through trigrams: Boolean trigram queries derived from each rule, postings intersected, candidates verified.

A text can only match a rule if it holds certain trigrams. They are derived from the rule's pattern as an AND / OR
query. The postings of all trigrams that any rule asks for are kept by row, one bit per trigram, so intersecting them is
bit arithmetic in the scan itself and no text is shuffled. Only candidates are verified with the pattern; a rule whose
pattern has no mandatory trigram is run over every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _parser as parser  # the standard library's own parse tree of a pattern

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmend.llm import spans
from gridmend.llm.common import text_of


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Group whose length is tested (0: the match) and the least length.
    group: int = 0
    least: int = 0


#: The base rules.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (Rule("assign", ASSIGN, 2, 12), Rule("access", r"AKIA[A-Z0-9]{14,}"), Rule("hex", r"[0-9a-f]{16,}"))
#: Rules added by this operator: public formats of common credentials.
MORE = (Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"), Rule("github", r"gh[pousr]_[A-Za-z0-9]{30,}"), Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
        Rule("google", r"AIza[A-Za-z0-9_-]{35}"), Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"))

MOST_EXACT = 64


def _and(a, b):
    return b if a is True else a if b is True else ("and", a, b)


def _or(a, b):
    return True if a is True or b is True else ("or", a, b)


def _of_strings(strings: set[str]):
    """Query for a text that contains one of the strings."""
    if any(len(s) < 3 for s in strings):
        return True
    each = [reduce(_and, [("has", s[i:i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)]
    return reduce(_or, each)


def _item(op, arg) -> tuple[set[str] | None, object]:
    """(all strings the item can match, if few; what any text that matches must hold)."""
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}, True
    if name == "IN":
        chars: set[str] = set()
        for kind, value in arg:
            if str(kind) == "LITERAL":
                chars.add(chr(value).lower())
            elif str(kind) == "RANGE" and value[1] - value[0] < 8:
                chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None, True
        return (chars, True) if len(chars) <= 8 else (None, True)
    if name == "SUBPATTERN":
        return _sequence(arg[3])
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        low, high, inner = arg
        exact, query = _sequence(inner)
        if exact is not None and low == high and len(exact) == 1 and low <= 8:
            return {next(iter(exact)) * low}, True
        if low == 0:
            return (exact | {""}, True) if exact is not None and high == 1 else (None, True)
        return None, query if exact is None else _of_strings(exact)
    if name == "BRANCH":
        parts = [_sequence(p) for p in arg[1]]
        if all(e is not None for e, _ in parts) and sum(len(e) for e, _ in parts) <= MOST_EXACT:
            return set().union(*[e for e, _ in parts]), True
        return None, reduce(_or, [q if e is None else _of_strings(e) for e, q in parts])
    if name in ("AT", "ASSERT", "ASSERT_NOT"):
        return {""}, True
    return None, True


def _sequence(items) -> tuple[set[str] | None, object]:
    run, query, whole = {""}, True, True
    for op, arg in items:
        exact, inner = _item(op, arg)
        if exact is not None and len(run) * len(exact) <= MOST_EXACT:
            run = {a + b for a in run for b in exact}
            continue
        query, whole = _and(_and(query, _of_strings(run)), inner), False
        run = exact if exact is not None else {""}
    return (run, True) if whole else (None, _and(query, _of_strings(run)))


def trigram_query(pattern: str):
    """AND / OR tree over ("has", trigram) that every matching text, lower-cased, satisfies; True where there is none."""
    exact, query = _sequence(parser.parse(pattern))
    return query if exact is None else _of_strings(exact)


def trigrams(query) -> set[str]:
    return set() if query is True else {query[1]} if query[0] == "has" else trigrams(query[1]) | trigrams(query[2])


def postings(text: Column, grams: list[str]) -> list[Column]:
    """One bit for each trigram, 60 to a long."""
    bits = []
    for at in range(0, len(grams), 60):
        bits.append(reduce(lambda a, b: a + b, [F.when(F.contains(text, F.lit(g)), F.lit(1 << i)).otherwise(F.lit(0)) for i, g in enumerate(grams[at:at + 60])]).cast("long"))
    return bits


def candidate(query, grams: list[str], columns: list[str]) -> Column:
    """Whether a row's postings satisfy the query."""
    if query is True:
        return F.lit(True)
    if query[0] == "has":
        i = grams.index(query[1])
        return F.col(columns[i // 60]).bitwiseAND(F.lit(1 << i % 60)) != 0
    a, b = candidate(query[1], grams, columns), candidate(query[2], grams, columns)
    return a & b if query[0] == "and" else a | b


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """One row per document: doc_id and, per rule, its spans in a column ``s_<kind>`` (start, ord, end, kind).

    Null text counts as empty; null ids and repeated rows come back as they are; an empty table gives no rows. Only
    doc_id and text are read.
    """
    asked = {r.kind: trigram_query(r.pattern) for r in rules}
    grams = sorted(set().union(*[trigrams(q) for q in asked.values()]))
    base = docs.select("doc_id", text_of().alias("t")).select("doc_id", "t", F.lower("t").alias("low"))
    names = [f"__p{i}" for i in range(-(-len(grams) // 60))]
    indexed = base.select("doc_id", "t", *[c.alias(n) for c, n in zip(postings(F.col("low"), grams), names)])
    held = indexed.select("doc_id", "t", *[candidate(asked[r.kind], grams, names).alias(f"c_{r.kind}") for r in rules])
    out = []
    for i, r in enumerate(rules):
        keep = (lambda m, g, r=r: F.length(g) >= r.least) if r.least else None
        found = spans.matches(F.col("t"), r.pattern, r.kind, i, keep, r.group or None)
        verified = F.col(f"c_{r.kind}") & F.col("t").rlike(r.pattern)
        out.append(F.when(verified, found).otherwise(spans.none()).alias(f"s_{r.kind}"))
    return held.select("doc_id", *out)


def secrets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256 over the base spans, and all spans as text."""
    found = scan(docs)
    return found.select("doc_id", *[F.size(f"s_{r.kind}").cast("long").alias(f"n_{r.kind}") for r in BASE],
                        F.sha2(spans.joined([F.col(f"s_{r.kind}") for r in BASE]), 256).alias("base_sha256"),
                        spans.joined([F.col(f"s_{r.kind}") for r in BASE + MORE]).alias("spans"))


def _oracle() -> str:
    quoted = lambda s: s.replace("'", "''")
    kinds = []
    for i, r in enumerate(BASE + MORE):
        p = quoted(r.pattern)
        kinds.append(f"SELECT n, {i} AS o, '{r.kind}' AS kind, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {r.group}) AS gs, "
                     f"string_split_regex(t, '{p}') AS ps, {r.least} AS least FROM d WHERE regexp_matches(t, '{p}')")
    base = ", ".join(f"coalesce(count(*) FILTER (kind = '{r.kind}'), 0) AS n_{r.kind}" for r in BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
k AS ({' UNION ALL '.join(kinds)}),
u AS (SELECT *, generate_subscripts(ms, 1) AS i FROM k),
s AS (SELECT n, o, kind, coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS a, length(ms[i]) AS l
      FROM u WHERE length(gs[i]) >= least),
j AS (SELECT n, {base}, coalesce(string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + l AS BIGINT), ',' ORDER BY a, o) FILTER (o < {len(BASE)}), '') AS b,
      string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + l AS BIGINT), ',' ORDER BY a, o) AS spans FROM s GROUP BY n)
SELECT d.doc_id, {', '.join(f'coalesce(j.n_{r.kind}, 0) AS n_{r.kind}' for r in BASE)}, sha256(coalesce(j.b, '')) AS base_sha256, coalesce(j.spans, '') AS spans
FROM d LEFT JOIN j ON d.n = j.n
"""


ORACLE = _oracle()
