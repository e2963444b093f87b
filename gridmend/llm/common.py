"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmend.session import saved  # noqa: F401

#: A word is a run of anything but these six characters.
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def text_of(column: str = "text") -> Column:
    """The text, a null one taken as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Columns ``__id`` and ``__th`` that name a row: its id and a hash of its text.

    Rows alike in both are one document to every operator that joins back on the key, and are treated alike.
    """
    return [doc_id.alias("__id"), F.xxhash64(text).alias("__th")]


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs``, unchanged, whose row key (``__id``, ``__th``) is not among ``keys``.

    The keys are written first, so that their true size decides between a broadcast and a shuffle.
    """
    gone = saved(keys.select(F.col("__id").alias("__gone_id"), F.col("__th").alias("__gone_th")).distinct())
    mine = docs["doc_id"].eqNullSafe(gone["__gone_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["__gone_th"])
    return docs.join(gone, mine, "left_anti")


#: Size of a filter sent to every task, whatever it is made from: 2**24 bits, 2 MB. A page of it has 2**15 bits.
FILTER_BITS, PAGE_BITS = 24, 15


def bit_of(value: Column) -> Column:
    """The low bits of a long, the place of a value in a filter."""
    return value.bitwiseAND((1 << FILTER_BITS) - 1)


def bit_filter(bits: DataFrame) -> np.ndarray:
    """Bitmap of the column ``bit``, built by Spark. Many values only fill it: it then lets more pass, and what passes is
    always joined exactly."""
    pages = bits.groupBy(F.shiftright("bit", PAGE_BITS).cast("int").alias("page")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND((1 << PAGE_BITS) - 1)).alias("b"))
    size = 1 << PAGE_BITS - 3
    out = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    for row in pages.toLocalIterator():  # 512 pages of 4 kB at most
        out[row.page * size:(row.page + 1) * size] = np.frombuffer(bytes(row.b), np.uint8)
    return out


def passes(bitmap: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & np.uint8(1)).astype(bool)


def thinned(df: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """The rows of ``df`` whose column ``bit`` passes the filter, without a shuffle."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(passes(bitmap, b.column("bit").to_numpy(zero_copy_only=False))))

    return df.mapInArrow(keep, df.schema)
