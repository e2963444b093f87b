"""Mix sources to target weights by hash-threshold histograms.

Every document has a fixed hash. A source that is to give a share of its words gives the documents whose hash lies
under a threshold, so a smaller budget always takes a subset of a larger one. The threshold is found from sums of words
by (source, hash bucket); only the bucket that holds the budget's border is refined, twelve bits at a time. No document
is ever sorted, and the text is read once for the word counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmend.llm.common import SPACE, saved, text_of

BITS, LEVELS = 12, 5


def word_count(text: Column) -> Column:
    parts = F.split(text, SPACE)
    blank = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return (F.size(parts) - blank).cast("long")


def hash60(doc_id: Column) -> Column:
    """First 60 bits of the MD5 of the id written as text; a null id counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h): all that mixing needs of a document."""
    return docs.select("doc_id", "source", word_count(text_of()).alias("size"), hash60(F.col("doc_id")).alias("h"))


def targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3) -> DataFrame:
    """Words each source is to give: (source, source_size, target), one row per source.

    All words are shared by weight (sources in order of code points, null last, weights repeating). A source that would
    give over ``most`` times its words gives just that; the excess is shared again. Sources fill up in the order of
    limit / weight, so one pass in that order finds the level. The windows see one row per source.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = per_source.select("source", "source_size", w.alias("w"), (F.col("source_size") * most).cast("double").alias("cap"))
    by_fill = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    filled = ranked.select("*", F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("c"),
                           F.sum("w").over(by_fill.rowsBetween(0, Window.unboundedFollowing)).alias("rest"),
                           F.sum("source_size").over(everything).cast("double").alias("b"))
    open_ = F.col("w") * (F.col("b") - F.col("c")) / F.col("rest") <= F.col("cap")
    # the first source in filling order that stays under its limit fixes the level of all later ones
    level = F.min(F.when(open_, F.struct((F.col("cap") / F.col("w")).alias("r"), (F.col("b") - F.col("c")).alias("left"), F.col("rest")))).over(everything)
    share = F.col("w") * level["left"] / level["rest"]
    return filled.select("source", "source_size", F.when(level.isNull() | (share > F.col("cap")), F.col("cap")).otherwise(share).alias("target"))


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, source_size, target, full, cut): every document is taken ``full`` times, and once more if h <= cut.

    ``cut`` is the largest hash whose documents still bring the taken words nearer to the target.
    """
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    at = saved(goals.select("source", "source_size", "target", full.alias("full"), (F.col("target") - full * F.col("source_size")).alias("need"),
                            F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("words")))
    part = sizes.select("source", "size", "h")
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        bucket = F.shiftright("h", shift)
        held = at.where("need > 0").select(F.col("source").alias("s"), F.col("bucket").alias("parent"), F.col("before").alias("base"), "need")
        inside = F.shiftright("h", shift + BITS) == F.col("parent") if level else F.lit(True)
        if level:
            part = part.join(held.select("s", "parent"), F.col("source").eqNullSafe(F.col("s")) & inside, "inner").select("source", "size", "h")
        if level == 1:
            part = saved(part)
        sums = part.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        placed = sums.withColumn("earlier", F.coalesce(F.sum("words").over(up_to), F.lit(0)))
        border = (placed.join(held, F.col("source").eqNullSafe(F.col("s")), "inner").where(F.col("base") + F.col("earlier") <= F.col("need"))
                  .groupBy("s").agg(F.max(F.struct("bucket", (F.col("base") + F.col("earlier")).alias("before"), "words")).alias("m")))
        old = at.drop("before", "bucket", "words")
        at = saved(old.join(border, F.col("source").eqNullSafe(F.col("s")), "left").select(*old.columns, "m.before", "m.bucket", "m.words"))
    last = F.when(F.col("before") + F.col("words") / 2 <= F.col("need"), F.col("bucket")).otherwise(F.col("bucket") - 1)
    return at.select("source", "source_size", "target", "full", F.when(F.col("need") > 0, last).otherwise(F.lit(-1)).cast("long").alias("cut"))


def taken(frame: DataFrame, plan: DataFrame) -> DataFrame:
    """Add source_size, target, copies and taken to a frame with source, size and h; the plan has one row per source."""
    p = plan.select(F.col("source").alias("__s"), "source_size", "target", "full", "cut")
    copies = F.col("full") + F.when(F.col("h") <= F.col("cut"), 1).otherwise(0)
    keep = [c for c in frame.columns if c != "h"]
    return frame.join(p, F.col("source").eqNullSafe(F.col("__s")), "inner").select(*keep, "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    Null text: size 0. Null source: a source of its own, last in order. A null id hashes as the empty text; rows with the
    same id share a hash and are taken together. An empty table gives no rows. Only doc_id, source and text are read.
    """
    sizes = saved(sized(docs))
    return taken(sizes, thresholds(sizes, targets(sizes, weights, most)))


def sample(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3) -> DataFrame:
    """The mixed corpus: the documents taken at least once with all their columns, and size, source_size, target, copies
    and taken, which replace input columns of these names. Cases as for ``mix``."""
    narrow = saved(sized(docs))
    plan = thresholds(narrow, targets(narrow, weights, most))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "source", word_count(text_of()).alias("size"), hash60(F.col("doc_id")).alias("h"))
    out = ("size", "source_size", "target", "copies", "taken")
    return taken(row, plan).where("copies > 0").select(*[F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in out], *out)


ORACLE = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
           CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3]::DOUBLE AS w FROM d GROUP BY source),
r AS (SELECT *, CAST(source_size * 3 AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS b FROM s),
f AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS c,
      sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM r),
l AS (SELECT b - c AS lft, rest FROM f WHERE w * (b - c) / rest <= cap ORDER BY cap / w, b - c LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(cap, w * (SELECT lft FROM l) / (SELECT rest FROM l)), cap) AS target FROM f),
n AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS full_ FROM t),
g AS (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h),
k AS (SELECT source, h, words, coalesce(sum(words) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
SELECT d.doc_id, d.source, d.size, n.source_size, n.target,
       n.full_ + CASE WHEN n.target - n.full_ * n.source_size > 0 AND k.before + k.words / 2.0 <= n.target - n.full_ * n.source_size THEN 1 ELSE 0 END AS copies,
       (n.full_ + CASE WHEN n.target - n.full_ * n.source_size > 0 AND k.before + k.words / 2.0 <= n.target - n.full_ * n.source_size THEN 1 ELSE 0 END) * d.size AS taken
FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.h = k.h
"""
