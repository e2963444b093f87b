"""Gradient-boosted trees trained by Spark ML, applied as a plain column expression."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Held-out rows that a kind needs for a threshold of its own.
KIND_ROWS = 20
Bin = namedtuple("Bin", "b pos n")


@dataclass(frozen=True)
class Trees:
    """Weighted trees; a node is a leaf value or (feature, threshold, left, right), left where feature <= threshold."""

    features: tuple[str, ...]
    weights: tuple[float, ...] = ()
    roots: tuple = ()
    #: Score from which a row is taken as positive; None: no model could be fitted, nothing is positive.
    threshold: float | None = None
    figures: Mapping = field(default_factory=dict)
    #: Thresholds of the kinds with held-out rows of their own (None: no score of it is sure enough).
    kinds: Mapping = field(default_factory=dict)

    def margin(self, value: Mapping[str, Column]) -> Column:
        total = F.lit(0.0)
        for w, root in zip(self.weights, self.roots):
            total = total + F.lit(w) * self._branch(root, value)
        return total

    def _branch(self, node, value: Mapping[str, Column]) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        feature, at, left, right = node
        return F.when(value[self.features[feature]] <= F.lit(at), self._branch(left, value)).otherwise(self._branch(right, value))

    def probability(self, value: Mapping[str, Column]) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * self.margin(value)))

    def positive(self, value: Mapping[str, Column], kind: Column) -> Column:
        """Whether a row reaches the threshold of its kind, or the common one where its kind has none."""
        cut = F.lit(2.0 if self.threshold is None else self.threshold)
        for k, at in self.kinds.items():
            cut = F.when(kind == k, 2.0 if at is None else at).otherwise(cut)
        return self.probability(value) >= cut


def _read(node):
    if not node.getClass().getSimpleName().startswith("Internal"):
        return float(node.prediction())
    s = node.split()
    return int(s.featureIndex()), float(s.threshold()), _read(node.leftChild()), _read(node.rightChild())


def _cut(bins: Sequence, precision: float | None) -> float | None:
    """Smallest hundredth from which rows (b, pos, n) are right with ``precision``; one half where that is None."""
    pos = n = 0
    best = 0.5 if precision is None else None
    for r in sorted(bins, key=lambda r: -r.b):
        pos, n = pos + r.pos, n + r.n
        if precision is not None and pos >= precision * n:
            best = r.b / 100
    return best


def fit(rows: DataFrame, features: Sequence[str], trees: int = 12, depth: int = 3, precision: float | None = 0.9, held_out: str = "held_out", by: str | None = None, weight: str | None = None) -> Trees:
    """Fit on rows (features, label 0/1, held_out); choose the threshold on the held-out part.

    The threshold is the smallest hundredth from which the held-out rows at or above it are right with ``precision``.
    ``precision`` None: one half. ``by`` names a column of few values, each of which gets a threshold of its own where
    ``KIND_ROWS`` of its rows are held out. ``weight`` names the number of rows that a row stands for, one where it is
    None. The caller bounds the rows. With one class only there is no model.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    features = tuple(features)
    rows = rows.withColumn("__n", F.lit(1) if weight is None else F.col(weight))
    if rows.select("label").distinct().count() < 2:
        return Trees(features)
    train = VectorAssembler(inputCols=list(features), outputCol="x").transform(rows.where(~F.col(held_out)).withColumn("label", F.col("label").cast("double"))).select("x", "label", F.col("__n").cast("double").alias("weight"))
    if train.select("label").distinct().count() < 2:
        return Trees(features)
    booster = GBTClassifier(featuresCol="x", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7, maxBins=32)
    model = (booster if weight is None else booster.setWeightCol("weight")).fit(train)
    java = model._java_obj
    fitted = Trees(features, tuple(float(w) for w in java.treeWeights()), tuple(_read(t.rootNode()) for t in java.trees()))
    kind = F.lit(None).cast("string") if by is None else F.col(by)
    scored = rows.where(held_out).select(F.floor(fitted.probability({f: F.col(f) for f in features}) * 100).cast("int").alias("b"), "label", kind.alias("kind"), "__n")
    bins = scored.groupBy("kind", "b").agg(F.sum(F.col("label") * F.col("__n")).alias("pos"), F.sum("__n").alias("n")).collect()  # 101 rows a kind at most
    pooled = {b: Bin(b, sum(r.pos for r in bins if r.b == b), sum(r.n for r in bins if r.b == b)) for b in {r.b for r in bins}}
    best = _cut(pooled.values(), precision)
    named = {k: [r for r in bins if r.kind == k] for k in {r.kind for r in bins if r.kind is not None}}
    kinds = {k: own for k, own in named.items() if sum(r.n for r in own) >= KIND_ROWS}
    over = [r for r in pooled.values() if best is not None and r.b / 100 >= best]
    figures = {"held_out": sum(r.n for r in bins), "positive": sum(r.pos for r in bins), "found": sum(r.pos for r in over), "wrong": sum(r.n - r.pos for r in over)}
    return Trees(features, fitted.weights, fitted.roots, best, figures, {k: _cut(own, precision) for k, own in kinds.items()})


def bounded(rows: DataFrame, most: int, *key: Column) -> DataFrame:
    """About ``most`` rows at most, chosen by a hash of ``key``; everything where there are no more than that."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(*key), F.lit(1 << 30)) < int(most / n * (1 << 30)))
