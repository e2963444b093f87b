"""String similarity at scale: lossless blocking first, the costly measure on distinct surviving pairs only.

Every join here meets distinct strings, never rows, and blocking keys drop no pair that reaches the threshold.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def ratcliff_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks of two texts; the order of the arguments can matter."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a, b)], dtype="float64")


def ratcliff_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.withColumn("ratio", ratcliff_ratio(F.col(a), F.col(b)))


def _keyed(texts: DataFrame, col: str, threshold: float, bits: str) -> DataFrame:
    """(text, ``bits``, __k): keys of which two texts share one whenever their matching share can reach the threshold.

    A ratio of t needs at least ceil(t(la+lb)/2) common characters. With the characters of every text in one global
    order, texts sharing that many must share two among their first la - need + 2 characters, where need is taken at
    the shortest partner allowed. The keys are those pairs. Texts so short that one common character is enough have
    their single characters as further keys.

    ``bits`` are 64, one set for every numbered character: bits that only one of two texts has count characters that it
    does not share. Every array is a column of its own, so that no lambda makes another one anew for each of its elements.
    """
    c = texts.withColumn("__c", F.filter(F.split(col, ""), lambda x: x != ""))
    c = c.withColumn("__t", F.transform("__c", lambda x, i: F.concat(x, F.size(F.filter(F.slice("__c", 1, i + 1), lambda y: y == x)).cast("string"))))
    # later occurrences are rarer than first ones, the rest of the order is an arbitrary but fixed hash
    ranked = F.transform(F.array_sort(F.transform("__t", lambda t: F.struct((-F.substring(t, 2, 9).cast("int")).alias("o"), F.xxhash64(t).alias("h")))), lambda s: s["h"])
    one = F.lit(1).cast("long")
    marks = F.aggregate("__t", F.lit(0).cast("long"), lambda m, t: m.bitwiseOR(F.call_function("shiftleft", one, F.pmod(F.xxhash64(t), F.lit(64)).cast("int"))))
    n = F.size("__r")
    shortest = F.ceil(n * threshold / (2 - threshold) - 1e-9)
    c = c.withColumn("__r", ranked).withColumn(bits, marks).withColumn("__need", F.ceil(F.lit(threshold) * (n + shortest) / 2 - 1e-9))
    c = c.withColumn("__p", F.slice("__r", 1, F.greatest(F.least(n, n - F.col("__need") + 2), F.lit(1)).cast("int")))
    pairs = F.flatten(F.transform("__p", lambda x, i: F.transform(F.slice("__p", i + 2, F.size("__p")), lambda y: F.xxhash64(F.least(x, y), F.greatest(x, y)))))
    c = c.withColumn("__q", pairs)
    return c.select(col, bits, F.explode(F.when(F.col("__need") <= 1, F.array_union("__q", "__r")).otherwise(F.array_distinct("__q"))).alias("__k"))


def ratcliff_join(left: DataFrame, right: DataFrame, lcol: str, rcol: str, threshold: float, right_first: bool = False) -> DataFrame:
    """All pairs of distinct texts whose ratio(left, right) is at least the threshold, with that ratio.

    ``right_first`` measures ratio(right, left). Pairs pass a length bound, a bound on common characters and a bound on edits in
    the JVM before any Python sees them. The optimizer moves these tests into the join, where they meet every pair once per
    shared key, so each is cheap: character bits are made once per text, and the edit distance is native.
    """
    t = threshold
    # few bytes but much work: a fixed number of tasks, which adaptive execution does not merge into one
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = left.select(F.col(lcol).alias("__a")).filter("__a <> ''").distinct().repartition(tasks, "__a")
    b = right.select(F.col(rcol).alias("__b")).filter("__b <> ''").distinct().repartition(tasks, "__b")
    ka, kb = _keyed(a, "__a", t, "__ma"), _keyed(b, "__b", t, "__mb")
    la, lb, ma, mb = F.length("__a"), F.length("__b"), F.col("__ma"), F.col("__mb")
    both = ma.bitwiseAND(mb)
    # characters of one text only, at least so many; what is left bounds the common ones
    common = F.least(la - F.bit_count(ma.bitwiseXOR(both)), lb - F.bit_count(mb.bitwiseXOR(both)))
    # matching blocks are a common subsequence, so what is left over bounds the edits
    edits = F.levenshtein("__a", "__b") <= F.floor((1 - t) * (la + lb) + 1e-9)
    close = ka.join(kb, "__k").filter((2 * common >= t * (la + lb) - 1e-9) & edits).select("__a", "__b").distinct().repartition(tasks, "__a", "__b")
    first, second = ("__b", "__a") if right_first else ("__a", "__b")
    scored = close.withColumn("ratio", ratcliff_ratio(F.col(first), F.col(second))).filter(F.col("ratio") >= t)
    return scored.select(F.col("__a").alias(lcol), F.col("__b").alias(rcol), "ratio")


# --- edit distance ---------------------------------------------------------------------------------------------

def _segments(c: Column, n: Column, k: Column, partner: Column, tag: Column) -> Column:
    """k+1 even, disjoint pieces of a text of length n, each keyed with both lengths and its number."""
    base, extra = F.floor(n / (k + 1)).cast("int"), n - F.floor(n / (k + 1)).cast("int") * (k + 1)

    def piece(i):
        # the last ``extra`` pieces are one longer
        start = i * base + F.greatest(F.lit(0), i - (k + 1 - extra))
        length = base + F.when(i >= k + 1 - extra, F.lit(1)).otherwise(F.lit(0))
        return F.xxhash64(n, partner, i, F.substr(c, start + 1, length))

    return F.transform(F.sequence(F.lit(0), k), piece)


def _probes(c: Column, n: Column, k: Column, owner: Column) -> Column:
    """All places in a text where a piece of a partner of length ``owner`` can sit within k edits."""
    base, extra = F.floor(owner / (k + 1)).cast("int"), owner - F.floor(owner / (k + 1)).cast("int") * (k + 1)
    delta = n - owner

    def at(i):
        start = i * base + F.greatest(F.lit(0), i - (k + 1 - extra))
        length = base + F.when(i >= k + 1 - extra, F.lit(1)).otherwise(F.lit(0))
        lo = F.greatest(F.lit(0), start - i, start + delta - (k - i))
        hi = F.least(n - length, start + i, start + delta + (k - i))
        spots = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
        return F.transform(spots, lambda p: F.xxhash64(owner, n, i, F.substr(c, p + 1, length)))

    return F.flatten(F.transform(F.sequence(F.lit(0), k), at))


def levenshtein_join(tokens: DataFrame, vocab: DataFrame, tcol: str, vcol: str, max_norm: float) -> DataFrame:
    """All (token, word) pairs within ``max_norm`` times the longer length in edits, with the distance.

    Partition join: with k edits allowed, one of k+1 disjoint pieces of the word occurs unchanged in the token near
    its own place. Words emit their pieces, tokens the places to look at; both carry the two lengths, so only texts
    of compatible length ever meet. The edit distance then verifies natively with its bound.
    """
    a = tokens.select(F.col(tcol).alias("__t")).filter("__t <> ''").distinct().withColumn("__n", F.length("__t"))
    b = vocab.select(F.col(vcol).alias("__w")).filter("__w <> ''").distinct().withColumn("__n", F.length("__w"))

    def edits(n, m):
        return F.floor(F.lit(max_norm) * F.greatest(n, m) + 1e-9).cast("int")

    def partners(n):
        lo, hi = F.ceil(n * (1 - max_norm) - 1e-9).cast("int"), F.floor(n / (1 - max_norm) + 1e-9).cast("int")
        return F.explode(F.sequence(F.greatest(F.lit(1), lo), hi))

    wa = b.select("__w", "__n", partners(F.col("__n")).alias("__m")).withColumn("__e", edits(F.col("__n"), F.col("__m")))
    words = wa.select("__w", F.explode(_segments(F.col("__w"), F.col("__n"), F.col("__e"), F.col("__m"), F.lit(0))).alias("__k"))
    ta = a.select("__t", "__n", partners(F.col("__n")).alias("__m")).withColumn("__e", edits(F.col("__n"), F.col("__m")))
    probes = ta.select("__t", F.explode(F.array_distinct(_probes(F.col("__t"), F.col("__n"), F.col("__e"), F.col("__m")))).alias("__k"))
    cand = probes.join(words, "__k").select("__t", "__w").distinct()
    bound = F.floor(F.lit(max_norm) * F.greatest(F.length("__t"), F.length("__w")) + 1e-9).cast("int")
    dist = cand.withColumn("distance", F.levenshtein("__t", "__w")).filter(F.col("distance") <= bound)
    return dist.select(F.col("__t").alias(tcol), F.col("__w").alias(vcol), "distance",
                       (F.col("distance") / F.greatest(F.length("__t"), F.length("__w"))).alias("norm_distance"))
