"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

Everything is column expressions in one scan of the URLs; the trees are trained from the labelled URLs, those that a
rule decides, on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmend.llm.boosting import Trees, bounded, fit
from gridmend.llm.common import saved

#: Labelled URLs that the trees are fitted on at most.
SAMPLE = 20_000
FEATURES = ("url_length", "host_length", "path_length", "depth", "labels", "hyphens", "digit_ratio", "entropy", "params", "fragment", "extension", "longest", "suffix_rate")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule ``host/path`` whose host is the URL's or a parent of it and whose path the URL's starts with."""
    found = F.lit(None).cast("string")
    for rule in sorted((r for r, _ in rules), key=len):  # the longest is asked first
        name, _, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def lexical(pages: DataFrame) -> DataFrame:
    """Add the lexical features of ``u`` (the url, a null one empty), ``host`` and ``path``."""
    u, h, p = F.col("u"), F.col("host"), F.col("path")
    n = F.length(u)
    chars = F.filter(F.split(F.concat(h, p), ""), lambda c: c != "")
    share = F.transform(F.array_distinct("chars"), lambda c: F.size(F.filter("chars", lambda x: x == c)) / F.size("chars"))
    count = lambda text, what: (F.length(text) - F.length(F.translate(text, what, ""))).cast("double")
    words = F.transform(F.split(F.concat(h, p), "[^A-Za-z]+"), lambda w: F.length(w))
    cols = {"url_length": n.cast("double"), "host_length": F.length(h).cast("double"), "path_length": F.length(p).cast("double"), "depth": count(p, "/"), "labels": count(h, ".") + 1,
            "hyphens": count(h, "-"), "digit_ratio": F.when(n > 0, count(u, "0123456789") / n).otherwise(0.0), "params": count(u, "&=;"), "fragment": F.when(F.contains(u, F.lit("#")), 1.0).otherwise(0.0),
            "extension": F.when(p.rlike(r"\.[A-Za-z0-9]{1,5}$"), 1.0).otherwise(0.0), "longest": F.coalesce(F.array_max(words), F.lit(0)).cast("double"), "suffix": F.substring_index(h, ".", -1)}
    with_chars = pages.withColumn("chars", chars)
    entropy = F.aggregate(share, F.lit(0.0), lambda a, x: a - x * F.log2(x))
    return with_chars.select(*pages.columns, entropy.alias("entropy"), *[c.alias(k) for k, c in cols.items()])


def suffix_rates(labelled: DataFrame) -> tuple[DataFrame, float]:
    """Share of blocked URLs per host suffix, shrunk towards the overall share by twenty observations; the overall share.

    A suffix whose labels are all alike has the overall share: they say which rule it fell under, not what blocked URLs
    look like, and the trees would learn nothing else.
    """
    overall = labelled.agg(F.avg("label").alias("r")).first().r
    overall = 0.5 if overall is None else overall
    per = labelled.groupBy(F.col("suffix").alias("s")).agg(F.sum("label").alias("b"), F.count(F.lit(1)).alias("n")).where("b > 0 AND b < n")
    return saved(per.select("s", ((F.col("b") + 20 * overall) / (F.col("n") + 20)).alias("rate"))), overall


def with_rate(pages: DataFrame, rates: tuple[DataFrame, float]) -> DataFrame:
    """Add suffix_rate; a suffix without labels has the overall share."""
    per, overall = rates
    return pages.join(per, F.col("suffix") == F.col("s"), "left").drop("s").withColumn("suffix_rate", F.coalesce("rate", F.lit(float(overall)))).drop("rate")


def train(labelled: DataFrame) -> tuple[Trees, tuple[DataFrame, float]]:
    """Trees and suffix rates from lexical rows with ``label``; hosts are split, so held-out hosts are new to both.

    The rates are a statistic of all labelled rows of one fifth of the hosts; the trees see SAMPLE rows of the others.
    """
    part = F.pmod(F.xxhash64("host"), F.lit(5))
    rates = suffix_rates(labelled.where(part == 1))
    ready = with_rate(saved(bounded(labelled.where(part != 1), SAMPLE, F.col("u"))), rates)
    return fit(ready.select(*FEATURES, "label", (part == 0).alias("held_out")), FEATURES, trees=10, precision=None), rates


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (the trees' probability of block; null if no trees).

    ``rules`` is a list of (``host/path``, allow or block). A null url, or one without ``://``, has empty host and path and
    matches no rule. Without labelled URLs of both kinds there are no trees, and what no rule decides is allowed. Null
    ids and repeated rows come back as they are; an empty table gives no rows. Only page_id and url are read.
    """
    base = pages.select("page_id", F.coalesce("url", F.lit("")).alias("u")).select("page_id", "u", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
    ruled = base.withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules))
    verdict = F.lit(None).cast("string")
    for name, said in rules:
        verdict = F.when(F.col("rule") == name, F.lit(said)).otherwise(verdict)
    rows = lexical(ruled.withColumn("said", verdict))
    trees, rates = train(rows.where("said IS NOT NULL").withColumn("label", F.when(F.col("said") == "block", 1).otherwise(0)))
    score = F.lit(None).cast("double") if trees.threshold is None else trees.probability({f: F.col(f) for f in FEATURES})
    scored = with_rate(rows, rates).withColumn("score", score)
    method = F.when(F.col("score") >= F.lit(trees.threshold if trees.threshold is not None else 2.0), "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "score")
