"""Vocabulary building and learning from corrections and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmend.functions import constants as K
from gridmend.functions import text as T
from gridmend.operators.resolve import near_match_join


def build_vocab(training: DataFrame) -> DataFrame:
    """Distinct folded tokens of two letters or more from approved labels."""
    toks = training.filter("status = 'approved'").select(F.explode(T.tokens(T.fold("label", "alef"))).alias("token"))
    return toks.filter(F.length("token") >= 2).distinct()


def vocab_diff(new: DataFrame, old: DataFrame) -> DataFrame:
    return new.select("token").join(old.select("token"), "token", "left_anti")


def incremental_labels(training: DataFrame, watermark: Column | None, watermark_col: str = "reviewed_at") -> tuple[DataFrame, DataFrame]:
    """(approved labels past the mark, the next mark). Blank labels do not move the mark; neither does an empty run."""
    rows = training.filter("status = 'approved'")
    if watermark is not None:
        rows = rows.filter(F.col(watermark_col) > watermark)
    rows = rows.filter(F.coalesce(F.trim("label"), F.lit("")) != "")
    mark = rows.agg(F.coalesce(F.max(watermark_col), watermark if watermark is not None else F.lit(None)).alias("watermark"))
    return rows, mark


def gated_tokens(names: DataFrame, vocab: DataFrame) -> DataFrame:
    """Name tokens with the gate each one stopped at, null when it passed all.

    ``names``: job_id, name. Gates look at distinct tokens; the near-match gate is a blocked edit-distance join.
    """
    # counted below the explode: beside it, the whole text would be cut up again for each of its tokens
    cut = names.select("job_id", T.tokens(F.col("name")).alias("tokens")).withColumn("n", F.size("tokens"))
    toks = cut.select("job_id", "n", F.posexplode("tokens").alias("pos", "token"))
    kind = F.when((F.col("n") >= 2) & (F.col("pos") == F.col("n") - 1), "family").otherwise("given")
    occ = toks.select("job_id", "token", kind.alias("name_type"))
    d = occ.select("token").distinct()
    norm = T.fold("token", "letter")
    stop = F.array(*[T.fold(F.lit(w), "letter") for w in K.LEARN_NON_NAME])
    gate = (F.when(~F.length("token").between(2, 20), "length").when(T.arabic_chars(F.col("token")) / F.length("token") < 0.70, "not_arabic")
            .when(F.col("token").rlike(f"[{K.PERSIAN_FROM}]"), "persian").when(F.array_contains(stop, norm), "non_name"))
    g = d.select("token", norm.alias("norm"), gate.alias("gate"))
    known = vocab.select(T.fold("token", "letter").alias("norm"), F.lit(True).alias("known")).distinct()
    g = g.join(known, "norm", "left").withColumn("gate", F.coalesce("gate", F.when(F.col("known"), "known"))).drop("known")
    open_ = g.filter("gate is null").select(F.col("norm").alias("token")).distinct()
    near = near_match_join(open_, known.select(F.col("norm").alias("token"))).select(F.col("token").alias("norm"), F.lit("near").alias("near"))
    g = g.join(near, "norm", "left").withColumn("gate", F.coalesce("gate", "near")).drop("near")
    return occ.join(g, "token")


def collect_candidates(names: DataFrame, vocab: DataFrame, existing: DataFrame | None = None, keep_rejected: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, candidate jobs, gate counters).

    The jobs of a candidate are a long table keyed by (normalized, name_type, job), not an array, so a common name
    never has to fit in one row; occurrences are its distinct jobs. A candidate seen in a new job is accepted.
    ``existing``: normalized, name_type, job_id, status.
    """
    gated = gated_tokens(names, vocab)
    counters = gated.groupBy(F.coalesce("gate", F.lit("validated")).alias("gate")).agg(F.count("*").alias("n"))
    new = gated.filter("gate is null").select(F.col("norm").alias("normalized"), "name_type", "job_id", F.col("token").alias("name"), F.lit(None).cast("string").alias("status"))
    pool = new
    if existing is not None:
        pool = new.unionByName(existing.select("normalized", "name_type", "job_id", F.lit(None).cast("string").alias("name"), "status"))
    edges = pool.groupBy("normalized", "name_type", "job_id").agg(F.min("name").alias("name"), F.max("status").alias("status"), F.count("status").alias("old"))
    cand = edges.groupBy("normalized", "name_type").agg(F.min("name").alias("name"), F.count("job_id").alias("occurrences"), F.max("status").alias("old_status"), F.bool_or(F.col("old") == 0).alias("grew"))
    status = F.when(F.lit(keep_rejected) & (F.col("old_status") == "rejected"), "rejected").when(F.col("grew"), "accepted").otherwise(F.col("old_status"))
    return cand.select("normalized", "name_type", "name", "occurrences", status.alias("status")), edges.select("normalized", "name_type", "job_id"), counters


def promote_candidates(candidates: DataFrame, learned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(grown vocabulary, candidates with the promoted flag set)."""
    ready = candidates.filter("status = 'accepted' and not promoted")
    vocab = learned.select("token").unionByName(ready.select(F.col("normalized").alias("token"))).distinct()
    return vocab, candidates.withColumn("promoted", F.col("promoted") | (F.col("status") == "accepted"))


def candidate_status(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("promoted")).alias("promoted"))


def reject_candidate(candidates: DataFrame, name: str) -> DataFrame:
    hit = F.col("normalized") == T.fold(F.lit(name), "letter")
    return candidates.withColumn("status", F.when(hit, "rejected").otherwise(F.col("status")))
