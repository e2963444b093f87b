"""Positions of all matches of a pattern, in column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 128
SPAN = "array<struct<start:int,ord:int,end:int,kind:string>>"


def running(lengths: Column) -> Column:
    """Sum of all earlier entries, for every entry of an int array; blockwise, so that long arrays are not quadratic."""

    def inside(block: Column, offset: Column) -> Column:
        none = F.array().cast("array<int>")
        done = F.aggregate(block, F.struct(offset.alias("s"), none.alias("out")), lambda a, x: F.struct((a["s"] + x).alias("s"), F.concat(a["out"], F.array(a["s"])).alias("out")))
        return done["out"]

    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, BLOCK))
    many = F.flatten(F.zip_with(blocks, inside(F.transform(blocks, total), F.lit(0)), inside))
    return F.when(F.size(lengths) == 0, F.array().cast("array<int>")).when(F.size(lengths) <= BLOCK, inside(lengths, F.lit(0))).otherwise(many)


def matches(text: Column, pattern: str, kind: str, order: int, keep: Callable[[Column, Column], Column] | None = None, group: int | None = None) -> Column:
    """Spans (start, ord, end, kind) of the leftmost non-overlapping matches, in code points, end exclusive.

    The text between matches is what splitting by the same pattern leaves, so starts are running sums of lengths.
    ``keep`` sees the match and, if asked for, one group; matches that it refuses are dropped, not retried.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern)
    pairs = F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("p"), inner.alias("g"))
    sums = running(F.transform(pairs, lambda x: F.length(x["p"]) + F.length(x["m"])))
    placed = F.zip_with(pairs, sums, lambda x, s: F.struct((s + F.length(x["p"])).alias("start"), F.lit(order).alias("ord"), (s + F.length(x["p"]) + F.length(x["m"])).alias("end"), F.lit(kind).alias("kind"), x["m"].alias("m"), x["g"].alias("g")))
    good = F.filter(placed, lambda x: keep(x["m"], x["g"])) if keep else placed
    return F.transform(good, lambda x: F.struct(x["start"].alias("start"), x["ord"].alias("ord"), x["end"].alias("end"), x["kind"].alias("kind"))).cast(SPAN)


def none() -> Column:
    return F.array().cast(SPAN)


def joined(spans: Sequence[Column]) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(F.sort_array(F.concat(*spans)), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
