"""What each filter of a chain takes away, in every order of the chain, by a Gray-code walk over filter subsets.

Whether a document fails a filter does not depend on the other filters, so a document is its failure mask. Documents are
counted once by (part, mask): at most 32 cells a part for five filters. The walk visits all 32 subsets of active filters,
toggling one filter at a time. Each cell keeps the number of active filters that it fails; only cells whose counter leaves
or reaches 0 change the running number of survivors. The 32 numbers are stored, and every figure of every order is a
difference of two or three of them.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmend.llm.common import saved

FILTERS = "ABCDE"
COUNTS = ("n", "good", "toxic")
MIN_WORDS, MIN_DISTINCT_PCT, MAX_CAPITALS_PCT, SYMBOLS = 200, 50, 3, b"#$%&*|"
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_NOT_CAPITALS = bytes(b for b in range(256) if b not in _CAPITALS)
_INSIDE = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that begin no code point


def own_mask(text: bytes) -> int:
    """Bits 0 to 3: the filters A to D that a text fails by itself."""
    words = text.split()  # bytes split at just the six space characters
    n = len(words)
    capitals = len(text.translate(None, _NOT_CAPITALS))
    code_points = len(text.translate(None, _INSIDE))
    return ((n < MIN_WORDS) | (100 * len(set(words)) < MIN_DISTINCT_PCT * n) << 1 | (100 * capitals > MAX_CAPITALS_PCT * code_points) << 2
            | (len(text.translate(None, SYMBOLS)) < len(text)) << 3)


def flagged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, text_hash): one row per document, mask without filter E. One pass over the whole texts."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.large_binary())
            masks, hashes = [], []
            for t in texts:
                raw = t.as_py() or b""
                masks.append(own_mask(raw))
                hashes.append(hashlib.blake2b(raw, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), pa.array(masks, pa.int32()), pa.array(hashes, pa.binary())], ["doc_id", "part", "mask", "text_hash"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.col("text"))
    return rows.mapInArrow(judge, "doc_id long, part string, mask int, text_hash binary")


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the set of filters that they fail.

    Filter E: a document fails it if a smaller id has the same text anywhere in the table. The smallest id of a text is an
    aggregate, and documents meet it by (text, id), so that no text however common is gathered in one place.
    """
    rows = saved(flagged(docs))
    smallest = rows.groupBy("text_hash").agg(F.min("doc_id").alias("first_id"))
    marks = (labels.select(F.col("doc_id").cast("long").alias("label_id"), (F.coalesce(F.col("quality"), F.lit(0)) == 1).cast("int").alias("good"), (F.coalesce(F.col("toxic"), F.lit(0)) == 1).cast("int").alias("toxic"))
             .where("label_id is not null").groupBy("label_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")))
    holders = smallest.where("first_id is not null").select(F.col("text_hash").alias("first_hash"), "first_id")
    known = (rows.join(holders, (F.col("doc_id") == F.col("first_id")) & (F.col("text_hash") == F.col("first_hash")), "left")
             .join(marks, F.col("doc_id") == F.col("label_id"), "left"))
    repeat = F.when(F.col("doc_id").isNotNull() & F.col("first_id").isNull(), 16).otherwise(0)
    return (known.select("part", F.col("mask").bitwiseOR(repeat).alias("mask"), F.coalesce("good", F.lit(0)).alias("g"), F.coalesce("toxic", F.lit(0)).alias("x"))
            .groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("g").cast("long").alias("good"), F.sum("x").cast("long").alias("toxic")))


def walk(counts: np.ndarray, k: int) -> np.ndarray:
    """Survivors of every subset of ``k`` filters. ``counts``: (..., 2**k) documents by failure mask; same shape out."""
    size = 1 << k
    mask = np.arange(size)
    active = np.zeros(size, np.int64)  # per cell: active filters that it fails
    alive = counts.sum(axis=-1)
    states = np.zeros_like(counts)
    subset = 0
    states[..., 0] = alive
    for step in range(1, size):
        bit = (step & -step).bit_length() - 1  # the one filter in which this Gray code differs from the last
        subset ^= 1 << bit
        fails = (mask >> bit & 1).astype(bool)
        if subset >> bit & 1:
            alive = alive - counts[..., fails & (active == 0)].sum(axis=-1)
            active[fails] += 1
        else:
            active[fails] -= 1
            alive = alive + counts[..., fails & (active == 0)].sum(axis=-1)
        states[..., subset] = alive
    return states


def survivors(found: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, n, good, toxic): per part three arrays of 2**k entries, what is left when just the filters of that subset act
    (bit i of the position: filter i)."""
    k = len(filters)
    size = 1 << k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = np.zeros((b.num_rows, len(COUNTS), size), np.int64)
            for i, held in enumerate(b.column("cells").to_pylist()):
                for c in held:
                    counts[i, :, c["mask"]] += [c[name] for name in COUNTS]
            states = walk(counts, k)
            yield pa.RecordBatch.from_arrays([b.column("part"), *[pa.array(list(states[:, j]), pa.list_(pa.int64())) for j in range(len(COUNTS))]], ["part", *COUNTS])

    # one entry per mask: the array has 2**k entries at most
    by_part = found.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))
    return by_part.mapInArrow(run, "part string, n array<bigint>, good array<bigint>, toxic array<bigint>")


def orders(filters: str = FILTERS) -> list[tuple[str, int, int, int]]:
    """(filter_order, step, bit of its filter, subset before it) for all orders of the filters."""
    out = []
    for order in itertools.permutations(filters):
        subset = 0
        for step, name in enumerate(order, 1):
            bit = filters.index(name)
            out.append(("".join(order), step, bit, subset))
            subset |= 1 << bit
    return out


def figures(states: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every part, order and step with its counts, as differences of stored states."""
    k, full = len(filters), (1 << len(filters)) - 1
    names, steps, bits, befores = zip(*orders(filters), strict=True)
    steps = F.arrays_zip(*[F.lit(list(x)).alias(name) for name, x in (("filter_order", names), ("step", steps), ("bit", bits), ("before", befores))])

    def at(name: str, subset: int | Column) -> Column:
        return F.element_at(name, (F.lit(subset) if isinstance(subset, int) else subset) + 1)

    def shapley(bit: int) -> Column:
        """Sum over all orders: a subset of size j comes just before the filter in j! (k - 1 - j)! of them."""
        before = [u for u in range(full + 1) if not u >> bit & 1]
        terms = [(at("n", u) - at("n", u | 1 << bit)) * math.factorial(u.bit_count()) * math.factorial(k - 1 - u.bit_count()) for u in before]
        return sum(terms[1:], terms[0])

    per_filter = F.array(*[F.struct((at("n", 0) - at("n", 1 << i)).alias("failing"), (at("n", full ^ 1 << i) - at("n", full)).alias("unique_fails"), shapley(i).alias("shapley")) for i in range(k)])
    each = states.withColumn("per_filter", per_filter).select("part", *COUNTS, "per_filter", F.inline(steps))
    after = F.col("before") + F.element_at(F.array(*[F.lit(1 << i) for i in range(k)]), F.col("bit") + 1)
    own = F.element_at("per_filter", F.col("bit") + 1)
    removed = at("n", F.col("before")) - at("n", after)
    return each.select("part", "filter_order", "step", at("n", after).alias("kept"), removed.alias("removed"), (own["failing"] - removed).alias("redundant"), own["unique_fails"].alias("unique_fails"),
                       (at("good", F.col("before")) - at("good", after)).alias("good_lost"), (at("toxic", F.col("before")) - at("toxic", after)).alias("toxic_lost"), own["shapley"].alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: one row per
    language, order of the five filters and step.

    Null text: empty, fails A. Null lang: the part of the empty text. A null id is no smaller than any and has none
    smaller, so it neither fails E nor makes others fail; it has no labels. Rows repeated with the same id do not fail E by
    each other and count one by one. Several labels of one id: any mark of 1 counts. Null labels count as 0. An empty
    documents table has no parts and gives no rows. Further columns are not read.
    """
    return figures(survivors(cells(docs, labels)))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
f AS (SELECT w.doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
      100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(w.doc_id > first_id, false) AS e,
      coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic
      FROM w LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = w.doc_id),
m AS (SELECT doc_id, part, good, toxic, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS failed FROM f),
cell AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, failed),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT x1.f || x2.f || x3.f || x4.f || x5.f AS filter_order FROM x x1, x x2, x x3, x x4, x x5 WHERE len(list_distinct([x1.f, x2.f, x3.f, x4.f, x5.f])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS f, filter_order[1:step - 1] AS earlier FROM o, range(1, 6) r(step)),
p AS (SELECT part, filter_order, step, s.f,
      sum(n) FILTER (NOT contains(failed, s.f) AND translate(failed, earlier, '') = failed) AS kept,
      sum(n) FILTER (contains(failed, s.f) AND translate(failed, earlier, '') = failed) AS removed,
      sum(n) FILTER (contains(failed, s.f) AND translate(failed, earlier, '') <> failed) AS redundant,
      sum(n) FILTER (failed = s.f) AS unique_fails,
      sum(good) FILTER (contains(failed, s.f) AND translate(failed, earlier, '') = failed) AS good_lost,
      sum(toxic) FILTER (contains(failed, s.f) AND translate(failed, earlier, '') = failed) AS toxic_lost
      FROM cell, s GROUP BY part, filter_order, step, s.f)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
       CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley
FROM p
"""
