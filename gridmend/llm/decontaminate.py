"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined on seeds, Karp-Rabin hashes of five words that both contain. A run of seeds on
one diagonal of a (document, item) pair is a common passage; the longest is marked first, what overlaps it is cut, and so
on, until no unmarked passage of five words is left. The tiles need not keep their order, so a passage whose sentences
were moved about is still covered. A pair is reported where the tiles cover enough of the item.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmend.llm import hashing
from gridmend.llm.common import FILTER_BITS, bit_filter, bit_of, passes, row_key, saved, text_of, without

SEED, COVERAGE = 5, 0.6
_PUNCT = bytes(b for b in range(33, 127) if not chr(b).isalnum())
FOLD = bytes.maketrans(_PUNCT, b" " * len(_PUNCT))


def fold(text: str) -> str:
    return text.lower().encode("utf-8", "replace").translate(FOLD).decode()


def _seeds(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Seeds of all texts: owner, position and hash; and the number of words of each text."""
    words, bounds = hashing.word_hashes([fold(t) for t in texts])
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    h = hashing.window_hashes(words, SEED)
    inside = np.flatnonzero(owner[:len(h)] == owner[SEED - 1:]) if len(h) else np.zeros(0, np.int64)
    return owner[inside], inside - bounds[owner[inside]], h[inside], np.diff(bounds)


def _seed_rows(test: np.ndarray | None):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("t").to_pylist()
            for lo, hi in hashing.slices(texts, 1 << 20):
                owner, at, h, count = _seeds(texts[lo:hi])
                if test is not None:
                    hit = np.flatnonzero(passes(test, (h & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)))
                    owner, at, h = owner[hit], at[hit], h[hit]
                pick = pa.array(owner + lo)
                yield pa.RecordBatch.from_arrays([b.column("__id").take(pick), b.column("__th").take(pick), pa.array(at.astype(np.int32)), pa.array(h.astype(np.int64)), pa.array(count[owner].astype(np.int32))],
                                                 ["__id", "__th", "at", "seed", "words"])
    return rows


def _keyed(table: DataFrame, id_column: str) -> DataFrame:
    return table.select(F.col(id_column).alias("k"), text_of().alias("t")).select(*row_key(F.col("k"), F.col("t")), "t")


def seeds(table: DataFrame, id_column: str, only: np.ndarray | None = None) -> DataFrame:
    """(__id, __th, at, seed, words): every seed of every text; with ``only``, those that pass the filter."""
    kind = table.schema[id_column].dataType.simpleString()
    return _keyed(table, id_column).mapInArrow(_seed_rows(only), f"__id {kind}, __th bigint, at int, seed bigint, words int")


def seed_filter(items: DataFrame) -> np.ndarray:
    """Filter of fixed size over all benchmark seeds."""
    return bit_filter(items.select(bit_of(F.col("seed")).alias("bit")))


def tile(item_at: np.ndarray, doc_at: np.ndarray) -> tuple[int, int]:
    """Greedy string tiling from matching seeds: number of tiles and of item words that they cover."""
    order = np.lexsort((item_at, doc_at - item_at))
    i, j = item_at[order], doc_at[order]
    head = np.flatnonzero(np.concatenate([[True], (np.diff(i) != 1) | (np.diff(j) != 1)]))
    length = np.diff(np.append(head, len(i))) + SEED - 1
    heap = [(-int(n), int(i[h]), int(j[h])) for n, h in zip(length, head)]
    heapq.heapify(heap)
    in_item, in_doc, tiles = set(), set(), 0
    while heap:
        n, a, b = heapq.heappop(heap)
        free = [k for k in range(-n) if a + k not in in_item and b + k not in in_doc]
        if len(free) == -n:
            in_item.update(range(a, a - n))
            in_doc.update(range(b, b - n))
            tiles += 1
            continue
        start = 0
        for x in range(1, len(free) + 1):  # what is left between marked words, if long enough
            if x == len(free) or free[x] != free[x - 1] + 1:
                if x - start >= SEED:
                    heapq.heappush(heap, (start - x, a + free[start], b + free[start]))
                start = x
    return tiles, len(in_item)


@F.pandas_udf(T.StructType([T.StructField("n_tiles", T.IntegerType()), T.StructField("covered", T.IntegerType())]))
def _tiled(item_at: pd.Series, doc_at: pd.Series, words: pd.Series) -> pd.DataFrame:
    rows = []
    for a, b, n in zip(item_at, doc_at, words):
        most = np.zeros(n, bool)
        for k in range(SEED):
            most[np.unique(a) + k] = True
        # the seeds alone bound the coverage from above
        rows.append(tile(np.asarray(a), np.asarray(b)) if most.sum() >= COVERAGE * n else (0, 0))
    return pd.DataFrame(rows, columns=["n_tiles", "covered"])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per contaminated pair: doc_id, item_id, n_tiles, covered, item_words, coverage (``COVERAGE`` or more).

    Words are compared in lower case without ASCII punctuation. Items of fewer than five words have no seed and are never
    reported. Null texts count as empty; null ids are kept as null; rows alike in id and text are reported once. Without
    items or documents there are no rows. Only the ids and texts are read.
    """
    return _leaks(docs, benchmark).drop("__id", "__th")


def _leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    items = saved(seeds(benchmark, "item_id").distinct())
    found = seeds(docs, "doc_id", seed_filter(items)).drop("words")
    right = items.select(F.col("__id").alias("item_id"), F.col("__th").alias("item_th"), F.col("at").alias("item_at"), F.col("seed").alias("s"), "words")
    matches = found.join(right, F.col("seed") == F.col("s"), "inner")
    pairs = matches.groupBy("__id", "__th", "item_id", "item_th").agg(F.collect_set(F.struct("item_at", "at")).alias("m"), F.first("words").alias("item_words"))
    done = pairs.withColumn("r", _tiled(F.col("m.item_at"), F.col("m.at"), F.col("item_words")))
    share = F.col("r.covered") / F.col("item_words")
    return done.select("__id", "__th", F.col("__id").alias("doc_id"), "item_id", "r.n_tiles", "r.covered", "item_words", share.alias("coverage")).where(F.col("coverage") >= COVERAGE)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, unchanged, that contain no benchmark item."""
    return without(docs, _leaks(docs, benchmark))
