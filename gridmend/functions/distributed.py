"""Building blocks that stay distributed when one key holds a large share of the rows.

A window partitioned by a hot key puts that key's rows into one task.  These helpers split every key into
ordered blocks instead: rows are summed per block (with map-side combine), only the small block table is
windowed per key, and the row-level window runs inside a block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POSITION_BLOCK = 1 << 20


def block_of(position: str | Column, width: int = POSITION_BLOCK) -> Column:
    col = F.col(position) if isinstance(position, str) else position
    return F.floor(col / F.lit(width)).cast("long")


def running_total(df: DataFrame, keys: Sequence[str], block: Sequence[Column], order: Sequence[Column | str],
                  value: Column, out: str) -> DataFrame:
    """Running sum of ``value`` per ``keys`` in (block, order) order, rows with equal order counted by row.

    ``block`` must be monotone in the order and name no more rows than one task can hold.
    """
    keys = list(keys)
    blocks = [f"__b{i}" for i in range(len(block))]
    tagged = df.select("*", *[c.alias(n) for c, n in zip(block, blocks)], value.alias("__v"))
    sums = tagged.groupBy(*keys, *blocks).agg(F.sum("__v").alias("__s"))
    per_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = per_key.orderBy(*blocks).rowsBetween(Window.unboundedPreceding, -1)
    # renamed so that the join below never meets two columns of the same name
    offsets = sums.select(*[F.col(k).alias(f"__o_{k}") for k in keys], *[F.col(b).alias(f"__o{b}") for b in blocks],
                          F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__off"))
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__o_{k}"))
    for b in blocks:
        cond = cond & F.col(b).eqNullSafe(F.col(f"__o{b}"))
    inside = Window.partitionBy(*keys, *blocks).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.withColumn("__in", F.sum("__v").over(inside))
    joined = local.join(offsets, cond, "inner")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__off") + F.col("__in")).alias(out))


def ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], block: Sequence[Column],
            out: str, start: int = 0) -> DataFrame:
    """Dense position of each row within ``keys`` (0-based by default), the distributed ``row_number``."""
    ranked = running_total(df, keys, block, order, F.lit(1).cast("long"), out)
    return ranked.withColumn(out, F.col(out) - F.lit(1 - start))


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One whole row per key, the largest in ``order``; nulls lose. An aggregate, so it combines map-side."""
    return _extreme(df, keys, order, F.max_by)


def earliest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    return _extreme(df, keys, order, F.min_by)


def _extreme(df, keys, order, pick):
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    picked = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*cols)).alias("__row"))
    return picked.select(*keys, *[F.col(f"__row.`{c}`").alias(c) for c in rest]).select(*df.columns)


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, out: str = "rank") -> DataFrame:
    """First ``n`` rows per key. With n below 1000 Catalyst keeps only n rows per key and map task before the
    shuffle (WindowGroupLimit), so a hot key sends n rows per task, not all its rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= n)
