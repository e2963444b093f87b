"""Quality scores: document statistics, random Fourier features, ridge regression, isotonic calibration.

The features of a Gaussian kernel are approximated by cosines of random projections, so the kernel regression becomes
a linear one. Its normal equations are sums over rows: each task sums its own and hands over one small matrix. Scores
are calibrated on rows that took no part in the fit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmend.llm import hashing
from gridmend.llm.common import saved, text_of

#: Number of random features, kernel width (in standard deviations of the statistics), ridge, and matrices that the
#: driver adds up (the labelled rows are summed in so many tasks at most).
COSINES, WIDTH, RIDGE, TASKS, BINS = 128, 4.0, 1e-3, 32, 1000
CUT = 0.7
MARKS = (b"#*$%&<>", b"|", b"!", b".,;:?", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\n")
STATISTICS = 7 + 7


def _statistics(texts: list[str]) -> np.ndarray:
    words, bounds = hashing.word_hashes(texts)
    counts = np.diff(bounds)
    out = np.zeros((len(texts), STATISTICS))
    pairs = hashing.window_hashes(words, 2)
    for i, t in enumerate(texts):
        raw = np.bincount(np.frombuffer(t.encode("utf-8", "replace"), np.uint8), minlength=256)
        n, size = counts[i], max(int(raw.sum()), 1)
        out[i, :7] = [np.sqrt(raw[list(m)].sum() / size) for m in MARKS]
        w = words[bounds[i]:bounds[i + 1]]
        _, each = np.unique(w, return_counts=True)
        two = np.unique(pairs[bounds[i]:max(bounds[i], bounds[i + 1] - 1)])
        lines = t.split("\n")
        out[i, 7:] = [np.log1p(n), size / max(n, 1) if n else 0.0, len(each) / max(n, 1), each.max() / n if n else 0.0, len(two) / max(n - 1, 1),
                      len(set(lines)) / len(lines), np.sqrt(raw[128:].sum() / size)]
    out[:, 8] = np.log1p(out[:, 8])
    return out


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("t").to_pylist()
        for lo, hi in hashing.slices(texts, 1 << 20):
            x = _statistics(texts[lo:hi])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, STATISTICS, dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*[b.column(c).slice(lo, hi - lo) for c in ("doc_id", "part")], flat], ["doc_id", "part", "x"])


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, part, x): the statistics of every whole text; part is crc32 of the id as text modulo 4."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    part = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)).cast("int")
    return docs.select("doc_id", part.alias("part"), text_of().alias("t")).mapInArrow(_described, f"doc_id {kind}, part int, x array<double>")


class Model:
    """Centre and spread of the statistics, the random projection, the weights, and the calibration steps."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        rng = np.random.default_rng(17)
        self.mean, self.spread = mean, spread
        self.project = rng.normal(size=(STATISTICS, COSINES)) / WIDTH
        self.shift = rng.uniform(0, 2 * np.pi, COSINES)
        self.weights = np.zeros(COSINES + 1)
        self.steps: tuple[np.ndarray, np.ndarray] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.hstack([np.sqrt(2 / COSINES) * np.cos(z @ self.project + self.shift), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.weights, 0, 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.steps), 0, 1)


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, STATISTICS)


def _normal(model: Model):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((COSINES + 1, COSINES + 2))
        for b in batches:
            if b.num_rows:
                f = model.features(_matrix(b.column("x")))
                total += f.T @ np.column_stack([f, b.column("y").to_numpy(zero_copy_only=False)])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])
    return sums


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres and means of the pools, x ascending."""
    pools: list[list[float]] = []
    for a, b, c in zip(x, y, w):
        pools.append([a * c, b * c, c])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def train(described: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled rows of parts 0 and 1, calibrate on part 3; part 2 is never touched.

    Several labels of one document are averaged, null ones ignored. Without labelled rows every raw score is 0.5.
    """
    y = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("l")).agg(F.avg("quality").alias("y"))
    rows = saved(described.where("part != 2").join(y, F.col("doc_id") == F.col("l"), "inner").select("part", "x", "y"))
    fitting = rows.where("part != 3")
    stats = fitting.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(STATISTICS)], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(STATISTICS)]).first()
    model = Model(np.array([stats[f"m{i}"] or 0.0 for i in range(STATISTICS)]), np.maximum([stats[f"s{i}"] or 0.0 for i in range(STATISTICS)], 1e-3))
    if not stats.n:
        model.weights[-1] = 0.5
        return model
    parts = fitting.select("x", "y").coalesce(TASKS).mapInArrow(_normal(model), "m binary").collect()
    total = sum(np.frombuffer(bytes(p.m)).reshape(COSINES + 1, COSINES + 2) for p in parts)
    ridge = RIDGE * stats.n * np.eye(COSINES + 1)
    ridge[-1, -1] = 0
    model.weights = np.linalg.solve(total[:, :-1] + ridge, total[:, -1])
    bins = rows.where("part = 3").select(F.floor(scorer(model, "raw")("x") * BINS).cast("int").alias("b"), "y").groupBy("b").agg(F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("b").collect()
    if bins:
        model.steps = isotonic(np.array([(r.b + 0.5) / BINS for r in bins]), np.array([r.y for r in bins]), np.array([float(r.n) for r in bins]))
    return model


def scorer(model: Model, what: str):
    @F.pandas_udf(T.DoubleType())
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(getattr(model, what)(np.vstack(x.to_numpy())) if len(x) else np.zeros(0))

    return score


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out (crc32 of the id as text modulo 4 is 2), score (0 to 1), predicted (score >= 0.7).

    Null text counts as empty and is scored like any other; a null id counts as the empty text for held_out and has no
    label. Repeated rows are scored alike; an empty table gives no rows. Of the documents only doc_id and text are read.
    """
    described = saved(statistics(docs))
    model = train(described, labels)
    scored = described.select("doc_id", (F.col("part") == 2).alias("held_out"), scorer(model, "score")("x").alias("score"))
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
