"""Held-out scoring of readings against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmend.functions import text as T


def unknown_words(texts: DataFrame, vocab: DataFrame, col: str) -> DataFrame:
    """Words of each distinct text outside the vocabulary; each distinct word is looked up once."""
    d = texts.select(col).filter(F.col(col).isNotNull()).distinct()
    words = d.select(col, F.explode(T.tokens(T.fold(col, "eval"))).alias("w"))
    known = vocab.select(T.fold("token", "eval").alias("w")).distinct()
    unk = words.join(known, "w", "left_anti").groupBy(col).agg(F.count("*").alias("u"))
    return d.join(unk, col, "left").select(col, F.coalesce("u", F.lit(0)).alias("unknown"))


def pick_by_lexicon(pairs: DataFrame, vocab: DataFrame) -> DataFrame:
    """The reading with fewer unknown words, the first on ties; a blank reading loses to one that is not. ``pairs``: id, a, b.

    Two blank readings do not agree; a null reading is a blank one.
    """
    p = pairs.withColumns({c: F.coalesce(c, F.lit("")) for c in ("a", "b")})
    u = unknown_words(p.select(F.explode(F.array("a", "b")).alias("text")), vocab, "text")
    j = (p.join(u.select(F.col("text").alias("a"), F.col("unknown").alias("ua")), "a").join(u.select(F.col("text").alias("b"), F.col("unknown").alias("ub")), "b"))
    has_a, has_b = F.trim("a") != "", F.trim("b") != ""
    use_b = has_b & (~has_a | (F.col("ub") < F.col("ua")))
    return j.select(*pairs.columns, F.when(use_b, F.col("b")).otherwise(F.col("a")).alias("pick"), ((F.col("a") == F.col("b")) & has_a).alias("agree"), F.when(use_b, F.col("ub")).otherwise(F.col("ua")).alias("unknown"))


def per_row_scores(picked: DataFrame) -> DataFrame:
    """Folded exact match, position-wise word hits, edits. ``picked``: id, pick, truth, agree, unknown."""
    folded = picked.withColumns({"__t": T.fold("truth", "eval"), "__p": T.fold("pick", "eval")})
    folded = folded.withColumns({"__tw": T.tokens(F.col("__t")), "__pw": T.tokens(F.col("__p"))})
    ok = F.size(F.filter(F.zip_with("__tw", "__pw", lambda x, y: x.eqNullSafe(y)), lambda z: z))
    return folded.select(*picked.columns, (F.col("__t") == F.col("__p")).alias("hit"), F.size("__tw").alias("words"), ok.alias("words_ok"),
                         F.levenshtein("__t", "__p").alias("edits"), F.length("__t").alias("chars"))


def evaluate_readings(picked: DataFrame) -> DataFrame:
    """One row of figures: exactness, per-word accuracy, near misses, agreement buckets, CER, unknown words.

    Scores depend on the two texts alone, so each distinct pair is scored once and weighs by its number.
    """
    s = per_row_scores(picked.groupBy("truth", "pick", "agree", "unknown").agg(F.count("*").alias("n")))
    n = F.sum("n")

    def total(c: str) -> Column:
        return F.sum(F.col(c) * F.col("n"))

    def count(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0).cast("long"))

    def mean(c: str, cond: Column) -> Column:
        known = cond & F.col(c).isNotNull()
        return F.sum(F.when(known, F.col(c) * F.col("n"))) / F.sum(F.when(known, F.col("n")))

    def share(num: Column, den: Column) -> Column:
        return F.coalesce(num / F.nullif(den, F.lit(0)), F.lit(0.0))

    hit, agree = F.col("hit"), F.col("agree")
    return s.agg(F.coalesce(n, F.lit(0).cast("long")).alias("n"), count(hit).alias("exact"), count(agree).alias("agreed"), total("words").alias("words"), total("words_ok").alias("words_ok"),
                 count(F.col("words") - F.col("words_ok") <= 1).alias("one_word_off"), F.round(share(count(agree & hit), count(agree)), 6).alias("agree_right"),
                 F.round(share(count(~agree & hit), count(~agree)), 6).alias("differ_right"), F.round(share(total("edits"), total("chars")), 6).alias("cer"),
                 F.round(mean("unknown", hit), 6).alias("unknown_right"), F.round(mean("unknown", ~hit), 6).alias("unknown_wrong"))
