"""Quality rules: robust multivariate outliers per language and source.

Each document becomes a vector of transformed text statistics. Per (lang, source) a minimum-covariance-determinant
estimate is found by concentration steps: keep the part of the group nearest to its centre, take its mean and covariance
anew, measure again. Documents too far in Mahalanobis distance, in the harmful direction, are rejected. Everything is
column expressions and grouped sums: a step moves one row of sums per group and task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmend.llm.common import SPACES, row_key, saved, text_of, without, words_of

WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: Smallest spread a statistic is measured with: clean text hardly varies in these, and that must not make a stray
#: symbol an outlier.
FLOORS = {"f_symbols": 0.06, "f_repeats": 0.1, "f_lines": 0.18, "f_length": 0.22, "f_upper": 0.06, "f_marks": 0.08}
FEATURES = tuple(FLOORS)
#: Share of a group that a concentration step keeps, number of steps, and cut of the squared distance
#: (the 0.9995 quantile of chi-square with six degrees of freedom, fixed value).
KEPT, STEPS, CUT = 0.6, 3, 24.1


def window_hashes(words: Column) -> Column:
    """A hash for each window of five words, by start; empty where there is one window at most."""
    n = F.size(words)
    each = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    return F.when(n > WINDOW, each).otherwise(F.array().cast("array<bigint>"))


def statistics(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` reduced to __id, __th, doc_id, lang, source and the base statistics, one output row per input row.

    ``n_repeat_words`` counts the words inside a five-word window that occurs twice or more in the text, first occurrence
    included. Only texts where some window repeats are sorted: repeating windows are neighbours of equal hash in
    (hash, position) order, and each covers the words up to the next covered start.
    """
    base = docs.select("doc_id", "lang", "source", text_of().alias("t"))
    kept = base.select("doc_id", "lang", "source", *row_key(F.col("doc_id"), F.col("t")), "t", words_of(F.col("t")).alias("w"),
                       F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0).alias("ls"))
    counted = kept.select("doc_id", "lang", "source", "__id", "__th", F.size("w").cast("long").alias("n_words"),
                          F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
                          (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
                          (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
                          F.size("ls").alias("n_lines"),
                          (F.length("t") - F.length(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("n_upper"),
                          (F.length("t") - F.length(F.translate("t", "!?", ""))).alias("n_marks"),
                          window_hashes(F.col("w")).alias("hs"))
    repeats = F.size(F.array_distinct("hs")) < F.size("hs")
    sorted_ = counted.withColumn("so", F.when(repeats, F.array_sort(F.arrays_zip(F.col("hs").alias("h"), F.sequence(F.lit(0), F.size("hs") - 1).alias("p")))))
    h = lambda i: F.get(F.col("so"), i)["h"]
    twice = F.filter(F.transform("so", lambda x, i: F.when((x["h"] == h(i - 1)) | (x["h"] == h(i + 1)), x["p"])), lambda p: p.isNotNull())
    ps = sorted_.withColumn("ps", F.when(F.col("so").isNotNull(), F.sort_array(twice))).drop("so", "hs")
    covered = F.aggregate("ps", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("e")),
                          lambda a, p: F.struct((a["n"] + F.lit(WINDOW) - F.greatest(F.lit(0), a["e"] - p)).alias("n"), (p + WINDOW).alias("e")), lambda a: a["n"])
    return ps.select("*", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words")).drop("ps")


def transformed(stats: DataFrame) -> DataFrame:
    """The statistic vector: square roots of shares, with twenty average words added so that short texts vary less."""
    n = F.col("n_words")
    share = lambda c, d: F.sqrt(F.least(F.lit(1.0), F.col(c) / d))
    return stats.select("*", share("n_symbols", n + 20).alias("f_symbols"), share("n_repeat_words", n + 20).alias("f_repeats"),
                        share("n_dup_lines", F.col("n_lines") + 4).alias("f_lines"), F.log((F.col("word_chars") + 100) / (n + 20)).alias("f_length"),
                        share("n_upper", F.col("word_chars") + 60).alias("f_upper"), share("n_marks", n + 20).alias("f_marks"))


def moments(rows: DataFrame) -> DataFrame:
    """Mean and the Cholesky factor of the covariance of each group, from one pass of sums."""
    k = len(FEATURES)
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    agg = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f"m{i}") for i, f in enumerate(FEATURES)],
                                             *[F.avg(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"s{i}{j}") for i, j in pairs])
    cov = agg
    for i, j in pairs:
        c = F.col(f"s{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")
        cov = cov.withColumn(f"s{i}{j}", c + F.lit(FLOORS[FEATURES[i]] ** 2) if i == j else c)
    for j in range(k):  # Cholesky, column by column; the floors keep it positive definite
        inner = [F.col(f"s{j}{p}") ** 2 for p in range(j)]
        cov = cov.withColumn(f"s{j}{j}", F.sqrt(F.greatest(F.lit(1e-9), F.col(f"s{j}{j}") - reduce(lambda a, b: a + b, inner, F.lit(0.0)))))
        for i in range(j + 1, k):
            dot = reduce(lambda a, b: a + b, [F.col(f"s{i}{p}") * F.col(f"s{j}{p}") for p in range(j)], F.lit(0.0))
            cov = cov.withColumn(f"s{i}{j}", (F.col(f"s{i}{j}") - dot) / F.col(f"s{j}{j}"))
    return cov.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *[f"m{i}" for i in range(k)], *[f"s{i}{j}" for i, j in pairs])


def measured(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Add d2, the squared Mahalanobis distance to the row's own group, and harm, its part on the harmful side."""
    k = len(FEATURES)
    joined = rows.join(groups, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    for i in range(k):  # forward substitution: L y = x - m
        dot = reduce(lambda a, b: a + b, [F.col(f"s{i}{p}") * F.col(f"y{p}") for p in range(i)], F.lit(0.0))
        joined = joined.withColumn(f"y{i}", (F.col(FEATURES[i]) - F.col(f"m{i}") - dot) / F.col(f"s{i}{i}"))
    d2 = reduce(lambda a, b: a + b, [F.col(f"y{i}") ** 2 for i in range(k)])
    return joined.select(*rows.columns, d2.alias("d2"))


def estimate(vectors: DataFrame) -> DataFrame:
    """Robust centre and spread per (lang, source), from rows that pass the base rules.

    The first centre is the mean of each group's middle in every single statistic; each step then keeps the nearest
    ``KEPT`` of the group.
    """
    medians = vectors.groupBy("lang", "source").agg(*[F.percentile_approx(f, 0.5, 1000).alias(f"q{i}") for i, f in enumerate(FEATURES)])
    g = saved(medians.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *[f"q{i}" for i in range(len(FEATURES))]))
    here = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
    scaled = [((F.col(f) - F.col(f"q{i}")) / FLOORS[f]) ** 2 for i, f in enumerate(FEATURES)]
    rows = vectors.join(g, here, "inner").select(*vectors.columns, reduce(lambda a, b: a + b, scaled).alias("d2"))
    for step in range(STEPS):
        cut = saved(rows.groupBy("lang", "source").agg(F.percentile_approx("d2", KEPT, 1000).alias("cut")).select(F.col("lang").alias("c_lang"), F.col("source").alias("c_source"), "cut"))
        near = rows.join(cut, F.col("lang").eqNullSafe(F.col("c_lang")) & F.col("source").eqNullSafe(F.col("c_source")), "inner").where(F.col("d2") <= F.col("cut"))
        groups = saved(moments(near))
        rows = measured(vectors, groups)
    return groups


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, distance (null where the group has no estimate) and kept.

    Null text counts as empty and fails the base rules (no words). Null lang or source form groups of their own. A group
    without one document that passes the base rules gets no estimate, and only the base rules decide there. Repeated
    rows are judged alike. An empty table gives no rows. Of the input only doc_id, text, lang and source are read.
    """
    return _judged(docs).drop("__id", "__th")


def _judged(docs: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    vectors = saved(transformed(statistics(docs)).select("*", failed.alias("base_failed")))
    groups = estimate(vectors.where("not base_failed").select("lang", "source", *FEATURES))
    far = measured(vectors, groups)
    return far.select("__id", "__th", "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      F.col("d2").alias("distance"), (~F.col("base_failed") & F.coalesce(F.col("d2") <= CUT, F.lit(True))).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, unchanged, that ``judge`` keeps."""
    return without(docs, _judged(docs).where("not kept"))
