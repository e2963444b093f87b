"""Connected groups from candidate buckets, without all pairs of a bucket and without the driver holding an edge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmend.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every node of ``edges`` (a, b): root is the smallest id of the node's component.

    Alternates large-star and small-star steps: every node links its larger neighbours to its smallest neighbour, then
    all its smaller ones to the smallest. The edge count never grows, hubs are only ever joined to one row, and the
    number of rounds is logarithmic in the component size. Each round is a written table.
    """
    e = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    while True:
        both = e.select(F.col("u").alias("n"), F.col("v").alias("m")).union(e.select(F.col("v").alias("n"), F.col("u").alias("m")))
        least = both.groupBy("n").agg(F.min("m").alias("r")).select(F.col("n").alias("k"), F.least("n", "r").alias("r"))
        large = both.join(least, both["n"] == least["k"], "inner").where("m > n").select(F.col("m").alias("u"), F.col("r").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("r")).select(F.col("u").alias("k"), "r")
        small = large.join(least, large["u"] == least["k"], "inner").where("v != r").select(F.col("v").alias("u"), F.col("r").alias("v"))
        nxt = saved(small.union(least.select("k", "r").toDF("u", "v")).where("u != v").distinct())
        # done when every node hangs on one root and no root hangs on anything
        once = nxt.groupBy("u").agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1)
        roots = nxt.select(F.col("v").alias("u")).join(nxt.select("u"), "u", "left_semi").limit(1)
        e = nxt
        if not once.select("u").union(roots).take(1):
            break
    return saved(e.select(F.col("u").alias("id"), F.col("v").alias("root")).union(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()))


def _labelled(rows: DataFrame, comp: DataFrame, column: str, out: str) -> DataFrame:
    """Add the component of an id; an id without links is a component of its own."""
    c = comp.select(F.col("id").alias("__k"), F.col("root").alias("__r"))
    return rows.join(c, F.col(column) == F.col("__k"), "left").withColumn(out, F.coalesce("__r", column)).drop("__k", "__r")


def grouped(members: DataFrame, verify: Callable[[DataFrame], DataFrame], score: Callable[[Column, Column], Column], cut: int,
            rest: Callable[[DataFrame], DataFrame] | None = None, rounds: int = 2, counted: bool = False) -> DataFrame:
    """(id, root) of all ids that have a verified link, from rows (bucket, id, sig) that name candidates.

    ``score`` estimates from two signatures how alike their owners are; pairs under ``cut`` are no candidates. ``verify``
    takes pairs (a, b) and returns those that hold. A group needs one link per member to be found, not all its pairs:

    * In each round every bucket names four representatives, two of them from different components, and every id is
      verified against the most promising one that is not in its own component. That is linear in the members, and
      components that belong together at least halve in number. A bucket with one component left drops out.
    * After the rounds, or when they bring nothing new, all candidate pairs that still lie across components are
      verified: by ``rest``, which takes the members (bucket, id, root) of the buckets still open and returns the links
      that join components, or else pair by pair.

    So every candidate pair that could join two components is tested, and pairs inside a component are not made at all.
    ``counted`` says that ``members`` has no bucket of one row.
    """
    if not counted:
        several = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("bucket").alias("k"))
        members = members.join(several, F.col("bucket") == F.col("k"), "left_semi")
    live = saved(members.select("bucket", "id", "sig").withColumn("root", F.col("id")))
    held = tested = comp = None
    for turn in range(rounds):
        salt = F.xxhash64("id", F.lit(turn))
        ends = [f(F.struct(*order, "id", "root", "sig")) for order in ((F.col("root").alias("o1"), salt.alias("o2")), (salt.alias("o1"),)) for f in (F.min, F.max)]
        reps = live.groupBy("bucket").agg(*[e.alias(f"r{i}") for i, e in enumerate(ends)]).withColumnRenamed("bucket", "k")
        met = live.join(reps, F.col("bucket") == F.col("k"), "inner")
        scored = met.select("id", "root", *[F.col(f"r{i}.id").alias(f"i{i}") for i in range(4)], *[F.when(F.col(f"r{i}.root") != F.col("root"), score(F.col(f"r{i}.sig"), F.col("sig"))).alias(f"s{i}") for i in range(4)])
        offers = F.array(*[F.when(F.col(f"s{i}") >= cut, F.struct(F.col(f"s{i}").alias("s"), F.col(f"i{i}").alias("id"))) for i in range(4)])
        best = scored.select("id", F.array_max(offers).alias("o")).where("o IS NOT NULL").groupBy("id").agg(F.max("o").alias("o"))
        pairs = best.select(F.least("id", "o.id").alias("a"), F.greatest("id", "o.id").alias("b")).distinct()
        pairs = saved(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        if turn and pairs.isEmpty():
            break
        more = saved(verify(pairs))
        tested = pairs if tested is None else tested.union(pairs)
        if turn and more.isEmpty():
            break
        held = more if held is None else held.union(more)
        comp = components(held)
        labelled = _labelled(live.drop("root"), comp, "id", "root")
        mixed = labelled.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select(F.col("bucket").alias("k"))
        live = saved(labelled.join(mixed, F.col("bucket") == F.col("k"), "left_semi"))
    if rest is not None:
        last = saved(rest(live.select("bucket", "id", "root")))
        return comp if last.isEmpty() else components(held.union(last))
    other = live.toDF("bucket2", "id2", "sig2", "root2")
    apart = (F.col("bucket") == F.col("bucket2")) & (F.col("id") < F.col("id2")) & (F.col("root") != F.col("root2")) & (score(F.col("sig"), F.col("sig2")) >= cut)
    across = live.join(other, apart, "inner").select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct()
    untested = saved(across.join(tested, ["a", "b"], "left_anti"))
    if untested.isEmpty():
        return comp
    last = saved(verify(untested))
    return comp if last.isEmpty() else components(held.union(last))
