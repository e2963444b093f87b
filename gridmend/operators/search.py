"""Substring search by trigram postings: which blocks of rows can hold a term, before any text is read.

A row has a dense number; the postings of a trigram are one bitmap per 32,768 rows, built once. A search ands the bitmaps of
the term's trigrams block by block, reads only the shelves of rows that still have a bit, and tests those rows.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmend.functions.distributed import ordinal
from gridmend.operators import admin
from gridmend.session import shared_folder

GRAM = 3
#: Blocks of 32,768 rows that lie in one folder.
SHELF = 16


def grams_of(text: Column) -> Column:
    low = F.lower(text)
    starts = F.when(F.length(low) >= GRAM, F.sequence(F.lit(1), F.length(low) - GRAM + 1)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.array_distinct(F.transform(starts, lambda i: F.substr(low, i, F.lit(GRAM)))), F.array().cast("array<string>"))


def term_grams(spark: SparkSession, term: str) -> list[str]:
    """Trigrams that every text with the term holds; wild cards of the term stand for anything."""
    runs = [r for r in re.split(r"[%_\\]", term) if r]
    if not runs:
        return []
    return sorted({g for r in spark.createDataFrame([(r,) for r in runs], "t string").select(grams_of(F.col("t")).alias("g")).collect() for g in r.g})


def build_index(df: DataFrame, text_cols: list[str], key: str, root: str | None = None) -> str:
    """Write the rows, numbered and in shelves, and the postings of their text columns under ``root``; returns it."""
    root = root or f"{shared_folder(df.sparkSession).rstrip('/')}/gridmend-index-{uuid.uuid4().hex}"
    part = F.pmod(F.xxhash64(key), F.lit(4096))
    numbered = ordinal(df, [], [key], [part], "__pos")
    block = F.bitmap_bucket_number("__pos")
    shelved = numbered.withColumns({"__block": block, "__shelf": F.floor(block / SHELF).cast("int")})
    shelved.write.partitionBy("__shelf").parquet(f"{root}/rows")
    # an index of no rows has folders without files: the schema is kept beside them
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shelved.schema)
    df.sparkSession.createDataFrame([(kind,)], "kind string").coalesce(1).write.text(f"{root}/schema")
    rows = _rows(df.sparkSession, root)
    grams = rows.select("__pos", "__block", F.explode(F.array_distinct(F.concat(*[grams_of(F.col(c)) for c in text_cols]))).alias("gram"))
    postings = grams.groupBy("gram", "__block").agg(F.bitmap_construct_agg(F.bitmap_bit_position("__pos")).alias("bits"))
    # sorted by trigram, so that a search reads few row groups
    postings.repartitionByRange("gram", "__block").sortWithinPartitions("gram").write.parquet(f"{root}/postings")
    return root


def _rows(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(spark.read.text(f"{root}/schema").first()[0]).parquet(f"{root}/rows")


def search_index(spark: SparkSession, root: str, text_cols: list[str], term: str | None = None, equals: dict[str, str] | None = None, ts_col: str = "created_at",
                 start: Column | None = None, end: Column | None = None) -> DataFrame:
    """The rows that ``admin.search`` finds, by the index. A term without a trigram is searched in all rows."""
    rows = _rows(spark, root)
    grams = term_grams(spark, term) if term else []
    if grams:
        held = spark.read.schema("gram string, __block long, bits binary").parquet(f"{root}/postings").filter(F.col("gram").isin(grams))
        blocks = held.groupBy("__block").agg(F.count("*").alias("n"), F.bitmap_and_agg("bits").alias("bits")).filter((F.col("n") == len(grams)) & (F.bitmap_count("bits") > 0))
        asked = blocks.select(F.col("__block").alias("__b"), F.floor(F.col("__block") / SHELF).cast("int").alias("__s"), "bits")
        place = F.bitmap_bit_position("__pos")
        byte = F.conv(F.hex(F.substr("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        # the join names the shelf, a folder: shelves without a block left are not read
        rows = rows.join(asked, (F.col("__shelf") == F.col("__s")) & (F.col("__block") == F.col("__b"))).filter(F.getbit(byte, (place % 8).cast("int")) == 1).drop("__b", "__s", "bits")
    return admin.search(rows, text_cols, term, equals, ts_col, start, end).drop("__pos", "__block", "__shelf")
