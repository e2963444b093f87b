"""Near-duplicate documents by DartMinHash signatures of weighted five-word shingles, banded joining, and verification.

A shingle that occurs c times in a document owns the region [0, c) of its weight axis. The region is cut into strips
[0, 1), [1, 2), [2, 4), [4, 8) ...; at each strip darts arrive over time at a rate equal to the strip's width, with times,
places and target coordinates all derived from a hash of (shingle, strip, number of the dart), so that every document
throws the same darts at the same strip. A dart counts if its place lies within the document's weight. Each of the
coordinates keeps its earliest dart. A document of total weight W needs only the darts up to time about (k ln k) / W,
so the work is one hash per shingle plus a few hundred darts, and two documents agree in a coordinate with probability
equal to their weighted Jaccard similarity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmend.llm import hashing
from gridmend.llm.common import FILTER_BITS, bit_filter, bit_of, row_key, saved, text_of, thinned, without
from gridmend.llm.graph import grouped

SIMILARITY, SHINGLE = 0.8, 5
#: 20 bands of 5 coordinates: a pair at similarity 0.8 shares a band with probability 0.9996.
BANDS, ROWS = 20, 5
K = BANDS * ROWS
#: Bits of the sketches' 800 that have to agree before two texts are read again. At similarity 0.8, 720 do on average;
#: this is three standard deviations (17 each) under it.
AGREE = 668
#: A bucket that still holds several components is compared in blocks of about so many rows and shingles at most.
BLOCK_ROWS, BLOCK_ITEMS, COLUMNS = 512, 1 << 20, 4096
GOLD = np.uint64(hashing.BASE)
#: A sketch holds the low byte of every coordinate, eight to a long.
SKETCH = -(-K // 8)


def weighted(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: owner, hash, count; ordered by owner, then hash."""
    h, owner = hashing.shingles(words, bounds, SHINGLE)
    if not len(h):
        return owner, h, np.zeros(0, np.int64)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]))
    return owner[new], h[new], np.diff(np.append(new, len(h)))


def _unit(x: np.ndarray) -> np.ndarray:
    """Hash to a number in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53


def dart_signatures(owner: np.ndarray, item: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """(n, K) signature of ``n`` documents from their weighted shingles; documents without any keep zeros."""
    total = np.bincount(owner, count, n) if len(owner) else np.zeros(n)
    # strips: one row per (document, shingle, power of two reached by its weight)
    depth = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))), 0).astype(np.int64) + 1
    src = np.repeat(np.arange(len(item)), depth)
    strip = np.arange(len(src)) - np.repeat(np.cumsum(depth) - depth, depth)
    low = np.where(strip > 0, 2.0 ** (strip - 1), 0.0)
    width = np.where(strip > 0, 2.0 ** (strip - 1), 1.0)
    doc, weight = owner[src], count[src].astype(np.float64)
    seed = hashing.mix64(item[src] + GOLD * (strip.astype(np.uint64) + np.uint64(1)))
    best = np.full(n * K, np.inf)
    value = np.zeros(n * K, np.uint64)
    limit = (K * (math.log(K) + 3)) / np.maximum(total, 1)
    todo = total > 0
    while todo.any():
        live = np.flatnonzero(todo[doc])
        time, throw = np.zeros(len(live)), 0
        while len(live):
            dart = hashing.mix64(seed[live] + np.uint64((2 * throw + 1) * hashing.BASE & hashing.MASK))
            time = time - np.log(_unit(dart)) / width[live]
            on = time <= limit[doc[live]]
            live, time, dart = live[on], time[on], dart[on]
            place = hashing.mix64(dart + GOLD)
            hit = low[live] + _unit(place) * width[live] <= weight[live]
            cell = doc[live][hit] * K + (hashing.mix64(place) % np.uint64(K)).astype(np.int64)[hit]
            when, name = time[hit], dart[hit]
            np.minimum.at(best, cell, when)
            first = best[cell] == when
            value[cell[first]] = name[first]
            throw += 1
        # a document with an empty coordinate throws on, up to twice the time
        todo = np.isinf(best).reshape(n, K).any(axis=1) & (total > 0)
        best.reshape(n, K)[todo] = np.inf
        limit = np.where(todo, limit * 2, limit)
    return value.reshape(n, K)


def band_hashes(signature: np.ndarray) -> np.ndarray:
    """(n, BANDS): one hash per band, the band's number included."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    out = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signature), 1))
    for r in range(ROWS):
        out = hashing.mix64(out * GOLD + parts[:, :, r])
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("t").to_pylist()
        for lo, hi in hashing.slices(texts, 1 << 20):
            words, bounds = hashing.word_hashes([t.lower() for t in texts[lo:hi]])
            owner, item, count = weighted(words, bounds)
            signature = dart_signatures(owner, item, count, hi - lo)
            bands = band_hashes(signature).astype(np.int64)
            total = np.bincount(owner, count, hi - lo) if len(owner) else np.zeros(hi - lo)
            lows = np.zeros((hi - lo, SKETCH * 8), np.uint8)
            lows[:, :K] = signature.astype(np.uint8)
            sketch = pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo + 1) * SKETCH, SKETCH, dtype=np.int32)), pa.array(lows.view(np.int64).ravel()))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(bands.ravel()))
            part = b.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("__id"), part.column("__th"), part.column("key"), pa.array(total.astype(np.int64)), flat, sketch],
                                             ["doc_id", "__id", "__th", "key", "weight", "bands", "sig"])


def jaccard(a: str, b: str) -> float:
    """Weighted Jaccard similarity of the five-word shingles of two texts."""
    words, bounds = hashing.word_hashes([a.lower(), b.lower()])
    owner, item, count = weighted(words, bounds)
    cut = np.searchsorted(owner, 1)
    both, i, j = np.intersect1d(item[:cut], item[cut:], assume_unique=True, return_indices=True)
    low = np.minimum(count[:cut][i], count[cut:][j]).sum()
    total = count.sum() - low
    return float(low / total) if total else 0.0


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = [jaccard(x, y) >= SIMILARITY for x, y in zip(b.column("ta").to_pylist(), b.column("tb").to_pylist())]
        yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of a text as a set: the n-th occurrence of a shingle is an element of its own."""
    for b in batches:
        texts, sets = b.column("t").to_pylist(), []
        for t in texts:
            _, item, count = weighted(*hashing.word_hashes([t.lower()]))
            nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            sets.append(hashing.mix64(np.repeat(item, count) + nth.astype(np.uint64) * GOLD).tobytes())
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(sets, pa.binary()), pa.array([len(x) // 8 for x in sets], pa.int64())], ["key", "items", "n"])


def _links(rows: pd.DataFrame) -> pd.DataFrame:
    """Links that join components among the rows of a block, or between two blocks, from exact similarities.

    The common elements of all pairs are counted by a product of element matrices, a few thousand elements at a time.
    """
    items = [np.frombuffer(x, np.uint64) for x in rows["items"]]
    size = np.array([len(x) for x in items], np.float32)
    owner = np.repeat(np.arange(len(items)), size.astype(np.int64))
    _, inverse, count = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1
    several = count[inverse] > 1
    owner, column = owner[several], place[inverse[several]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(items), len(items)), np.float32)
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        part = np.zeros((len(items), COLUMNS), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        common += part @ part.T
    root, block = rows["root"].to_numpy(), rows["block"].to_numpy()
    similar = common >= SIMILARITY * (size[:, None] + size[None, :] - common)
    if rows["lo"].iloc[0] != rows["hi"].iloc[0]:
        similar &= block[:, None] != block[None, :]
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    found = []
    for i, j in zip(*np.nonzero(np.triu(similar, 1))):
        x, y = find(root[i]), find(root[j])
        if x != y:
            parent[x] = y
            found.append((rows["id"].iloc[i], rows["id"].iloc[j]))
    return pd.DataFrame(found, columns=["a", "b"])


def _agreeing(a: Column, b: Column) -> Column:
    """Number of equal bits of two sketches."""
    return F.lit(8 * K) - reduce(lambda x, y: x + y, [F.bit_count(F.get(a, F.lit(j)).bitwiseXOR(F.get(b, F.lit(j)))) for j in range(SKETCH)])


def classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id of its group), kept (one document of each group).

    Texts equal byte for byte are one class from the start and only one of them is compared. Documents without words are
    no one's copy: each is its own class and kept. A text of fewer than five words is one shingle. A null doc_id comes
    last in a group; rows alike in doc_id and text count as one document and are answered alike. Null text counts as
    empty. An empty table gives no rows. Only doc_id and text are read.
    """
    return _classes(docs).drop("__id", "__th")


def _classes(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", text_of().alias("t")).select("doc_id", *row_key(F.col("doc_id"), F.col("t")), F.unhex(F.md5("t")).alias("key"), "t")
    signed = saved(keyed.mapInArrow(_signed, f"doc_id {kind}, __id {kind}, __th bigint, key binary, weight bigint, bands array<bigint>, sig array<bigint>"))
    real = signed.where("weight > 0")
    # similar texts have similar weights: a bucket is a band's hash and one of two neighbouring weight classes
    size = F.floor(F.log("weight") / F.log(F.lit(1 / SIMILARITY)))
    bands = real.select("key", "weight", F.explode("bands").alias("band")).distinct()
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("band").alias("k"))
    live = bands.join(shared, F.col("band") == F.col("k"), "left_semi").select("key", "band", F.explode(F.array(size, size + 1)).alias("z"))
    sigs = real.select(F.col("key").alias("k2"), "sig").dropDuplicates(["k2"])
    members = live.join(sigs, F.col("key") == F.col("k2"), "inner").select(F.struct("band", "z").alias("bucket"), F.col("key").alias("id"), "sig")
    heads = real.groupBy("key").agg(F.min("doc_id").alias("head"))

    place = lambda key: F.conv(F.hex(F.substring(key, 1, FILTER_BITS // 8)), 16, 10).cast("long")
    # of equal texts the one with the smallest id is read; repeated rows and chance hits of the filter do no harm
    heads_of = heads.select(F.col("key").alias("hk"), F.col("head"))

    def asked(ids: DataFrame) -> DataFrame:
        """(key, t) of the asked texts: thinned by a filter of fixed size in the scan, so that other texts never move."""
        marks = heads_of.join(ids.select(F.col("id").alias("ask")).distinct(), F.col("hk") == F.col("ask"), "left_semi")
        mark = lambda key, doc: bit_of(place(key).bitwiseXOR(F.xxhash64(doc)))
        bitmap = bit_filter(marks.select(mark(F.col("hk"), F.col("head")).alias("bit")))
        return thinned(keyed.select("key", "t", mark(F.col("key"), F.col("doc_id")).alias("bit")), bitmap).select("key", "t")

    def verify(pairs: DataFrame) -> DataFrame:
        texts = saved(asked(pairs.select(F.col("a").alias("id")).union(pairs.select("b"))))
        a, b = texts.toDF("ka", "ta"), texts.toDF("kb", "tb")
        both = pairs.join(a, F.col("a") == F.col("ka"), "inner").join(b, F.col("b") == F.col("kb"), "inner")
        return both.select("a", "b", "ta", "tb").mapInArrow(_alike, "a binary, b binary").distinct()

    def rest(live: DataFrame) -> DataFrame:
        sets = saved(asked(live.select("id")).mapInArrow(_elements, "key binary, items binary, n bigint"))
        rows = live.join(sets, F.col("id") == F.col("key"), "inner").dropDuplicates(["bucket", "id"])
        blocks = rows.groupBy("bucket").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_ITEMS)).cast("int").alias("nb")).withColumnRenamed("bucket", "k")
        placed = rows.join(blocks, F.col("bucket") == F.col("k"), "inner").withColumn("block", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
        paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        sided = paired.select("bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id", "root", "items")
        return sided.groupBy("bucket", "lo", "hi").applyInPandas(_links, "a binary, b binary").distinct()

    near = grouped(members, verify, _agreeing, AGREE, rest)
    group = heads.join(near.select("id", "root"), F.col("key") == F.col("id"), "left").select("key", "head", F.coalesce("root", "key").alias("root"))
    first = group.groupBy("root").agg(F.min("head").alias("class_id"), F.min_by("key", F.struct(F.col("head").isNull(), "head", "key")).alias("best")).select(F.col("root").alias("r"), "class_id", "best")
    named = group.join(first, F.col("root") == F.col("r"), "inner").select(F.col("key").alias("k"), "head", "class_id", (F.col("key") == F.col("best")).alias("best"))
    out = signed.join(named, (F.col("key") == F.col("k")) & (F.col("weight") > 0), "left")
    return out.select("__id", "__th", "doc_id", F.when(F.col("k").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                      (F.col("k").isNull() | (F.col("best") & F.col("doc_id").eqNullSafe(F.col("head")))).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, unchanged, without those that repeat a kept document of their group."""
    return without(docs, _classes(docs).where("not kept"))
