"""Fuzzy line deduplication: shared rare word pairs of normalised lines, edit similarity, one line per group.

A line is normalised (lower case, ASCII punctuation to spaces, digits to 0, single spaces). Lines equal in that form
are one candidate. Different forms are linked where the edit similarity of their words is 0.9 or more, and every such
pair is a candidate: one edit touches two word pairs (neighbouring words) at most, so two lines within k edits share so
many of them that they share one among the first 2k + 1 or so of each, in any order that is the same for all lines.
Pairs of common words come last in it. SimHash only picks the partner that is tried first. Of each connected group the
occurrence that comes first by (doc_id, line number) stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmend.llm import hashing
from gridmend.llm.common import FILTER_BITS, bit_filter, bit_of, passes, row_key, saved, text_of
from gridmend.llm.graph import grouped

SIMILARITY = 0.9
#: One edit is allowed for each STEP words of the longer line; a line with fewer than STEP - 1 words has no near line.
STEP, GRAM = round(1 / (1 - SIMILARITY)), 2
#: Words are counted in 2**CELL_BITS cells over one text in ORDER_SHARE. The counts order the word pairs and decide nothing else.
CELL_BITS, ORDER_SHARE = 18, 4
#: Bytes kept of a word pair's hash. Word pairs are counted by 32 bits of it first, in 2**PAGE_BITS pages.
WIDTH, PAGE_BITS = 5, 10
_PUNCT = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\t\x0b\x0c\r"
FOLD = bytes.maketrans(_PUNCT + b"0123456789", b" " * len(_PUNCT) + b"0" * 10)
SECOND = 0xC2B2AE3D27D4EB4F
#: Byte to eight counters: bit i of the byte in byte i of the word.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64)[:, 0]


def fold(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(FOLD)


def _lines(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Hashes of all words and their place in their line; of every line with a word its first word, words, text and number."""
    blob, lines = [], []
    for t in texts:
        blob.append(fold(t))
        lines.append(blob[-1].count(b"\n") + 1)
    joined = b"\n".join(blob)
    h, start = hashing._hash_blob(joined)
    breaks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 10)
    line = np.searchsorted(breaks, start)
    heads = np.flatnonzero(np.diff(line, prepend=-1))
    count = np.diff(np.append(heads, len(h)))
    place = np.arange(len(h)) - np.repeat(heads, count)
    before = np.concatenate([[0], np.cumsum(lines)])
    owner = np.searchsorted(before, line[heads], side="right") - 1
    return h, place, heads, count, owner, line[heads] - before[owner]


def line_signatures(texts: list[str]) -> tuple[np.ndarray, ...]:
    """For every line with a word: text index, line number, 128-bit key, 128-bit SimHash (both as two columns), words."""
    return _signed(*_lines(texts))


def _signed(h: np.ndarray, place: np.ndarray, heads: np.ndarray, count: np.ndarray, owner: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    if not len(h):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros((0, 2), np.uint64), np.zeros((0, 2), np.uint64), z
    key = np.empty((len(heads), 2), np.uint64)
    for k, base in enumerate((hashing.BASE, SECOND)):
        up = hashing.powers(base, int(count.max()))
        key[:, k] = hashing.mix64(np.add.reduceat(h * up[place], heads) + count.astype(np.uint64))
    # Votes: every byte of a hash is spread into eight counters of eight bits, summed over runs of 255 words at most.
    runs = np.flatnonzero(place % 255 == 0)
    line_runs = np.searchsorted(runs, heads)
    sim = np.empty((len(heads), 2), np.uint64)
    for k in range(2):
        word = h if k == 0 else hashing.mix64(h ^ np.uint64(SECOND))
        byte = word.view(np.uint8).reshape(-1, 8)
        sign = np.empty((len(heads), 8), np.uint8)
        for j in range(8):
            votes = np.add.reduceat(SPREAD[byte[:, j]], runs).view(np.uint8).reshape(-1, 8)
            total = np.add.reduceat(votes, line_runs, axis=0, dtype=np.int32)
            sign[:, j] = np.packbits(2 * total > count[:, None], axis=1, bitorder="little")[:, 0]
        sim[:, k] = sign.view(np.uint64)[:, 0]
    return owner, n, key, sim, count


def _parities(h: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """128 bits of a line, as two columns: each word turns the bit of its hash. An edit turns two bits at most."""
    bit, out = h >> np.uint64(57), np.zeros((len(heads), 2), np.uint64)
    for k in range(2 if len(h) else 0):
        out[:, k] = np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == k, np.uint64(1) << (bit & np.uint64(63)), np.uint64(0)), heads)
    return out


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def prefix_size(words: np.ndarray) -> np.ndarray:
    """How many of its ordered word pairs a line of so many words has to show to meet every line of SIMILARITY or more.

    Lines of at most L words within L // STEP edits share L - 1 - 2 (L // STEP) word pairs or more. For a line that may be
    the shorter one, that is least at its own length or at the next multiple of STEP.
    """
    need = [size - GRAM + 1 - GRAM * (size // STEP) for size in (words, -(-words // STEP) * STEP)]
    return np.where(words < STEP - 1, 0, words - GRAM + 2 - np.minimum(*need))


def _prefixes(h: np.ndarray, place: np.ndarray, count: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first word pairs of all lines in one array, and where each line starts in it (one more than lines)."""
    line = np.repeat(np.arange(len(count)), count)
    at = np.flatnonzero((place <= count[line] - GRAM) & (count[line] >= STEP - 1))
    common = level[_cells(h)].astype(np.int16)
    gram, line, common = hashing.window_hashes(h, GRAM)[at], line[at], sum(common[at + k] for k in range(GRAM))
    order = np.lexsort((gram, common, line))
    gram, line = gram[order], line[order]
    # a word pair that a line holds again is another one
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (line[1:] != line[:-1])
    runs = np.flatnonzero(new)
    again = (np.arange(len(gram)) - np.repeat(runs, np.diff(np.append(runs, len(gram))))).astype(np.uint64)
    rank = np.arange(len(gram)) - np.searchsorted(line, line)
    size = prefix_size(count)
    return hashing.mix64(gram + again * np.uint64(SECOND))[rank < size[line]], np.concatenate([[0], np.cumsum(size)])


def _levels(docs: DataFrame) -> np.ndarray:
    """How common the words of each cell are: four times the binary logarithm of their number."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << CELL_BITS, np.int64)
        for b in batches:
            texts = b.column("t").to_pylist()
            for lo, hi in hashing.slices(texts, 1 << 20):
                seen += np.bincount(_cells(_lines(texts[lo:hi])[0]), minlength=1 << CELL_BITS)
        often = np.flatnonzero(seen > 1)
        yield pa.RecordBatch.from_arrays([pa.array(often), pa.array(seen[often])], ["cell", "c"])

    some = docs.select(text_of().alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(ORDER_SHARE)) == 0)
    counted = some.mapInArrow(cells, "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c")).toArrow()  # 2**CELL_BITS rows at most
    level = np.zeros(1 << CELL_BITS, np.uint8)
    level[counted["cell"].to_numpy()] = np.round(4 * np.log2(1 + counted["c"].to_numpy()))
    return level


def _binary(rows: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(rows)
    width = data.shape[1] * 8
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(np.arange(0, (len(data) + 1) * width, width, dtype=np.int32)), pa.py_buffer(data)])


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The hashes of every line, WIDTH bytes each."""
    low = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :WIDTH]
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((starts * WIDTH).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(low))])


def _hashes(lists: list[bytes]) -> np.ndarray:
    """What :func:`_lists` packed, one line after the other."""
    packed = np.frombuffer(b"".join(lists), np.uint8).reshape(-1, WIDTH)
    wide = np.zeros((len(packed), 8), np.uint8)
    wide[:, :WIDTH] = packed
    return wide.view(np.int64)[:, 0]


def occurrences(docs: DataFrame, level: np.ndarray) -> DataFrame:
    """One narrow row per line with a word: where it stands, its key, its SimHash, its parities and its first word pairs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ids, ths = b.column("t").to_pylist(), b.column("__id"), b.column("__th")
            for lo, hi in hashing.slices(texts, 1 << 20):
                found = _lines(texts[lo:hi])
                h, place, heads = found[:3]
                owner, n, key, sim, count = _signed(*found)
                bits = np.concatenate([sim, _parities(h, heads)], axis=1).astype(np.int64)
                pick = pa.array(owner + lo)
                yield pa.RecordBatch.from_arrays([ids.take(pick), ths.take(pick), pa.array(n.astype(np.int32)), _binary(key), *[pa.array(np.ascontiguousarray(bits[:, k])) for k in range(4)], pa.array(count.astype(np.int32)), _lists(*_prefixes(h, place, count, level))],
                                                 ["__id", "__th", "n", "h", "s0", "s1", "p0", "p1", "words", "grams"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", text_of().alias("t")).select(*row_key(F.col("doc_id"), F.col("t")), "t")
    return keyed.mapInArrow(rows, f"__id {kind}, __th bigint, n int, h binary, s0 bigint, s1 bigint, p0 bigint, p1 bigint, words int, grams binary")


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (page, seen): 32 bits of the hash of every word pair, in order, cut into pages by their first bits."""
    starts = np.arange((1 << PAGE_BITS) + 1, dtype=np.int64) << (32 - PAGE_BITS)
    for b in batches:
        low = np.sort(_hashes(b.column("grams").to_pylist()) & (1 << 32) - 1)
        cut = np.searchsorted(low, starts)
        seen = pa.Array.from_buffers(pa.binary(), 1 << PAGE_BITS, [None, pa.py_buffer((cut * 4).astype(np.int32)), pa.py_buffer(low.astype(np.uint32))])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1 << PAGE_BITS, dtype=np.int32)), seen], ["page", "seen"]).filter(pa.array(np.diff(cut) > 0))


def _repeated(page: pd.DataFrame) -> pd.DataFrame:
    """Filter bits of the word pairs that a page holds more than once."""
    seen = np.sort(np.frombuffer(b"".join(page["seen"]), np.uint32))
    return pd.DataFrame({"bit": np.unique(seen[1:][seen[1:] == seen[:-1]]).astype(np.int64) & (1 << FILTER_BITS) - 1})


def _spread(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row (bucket, h) per word pair, without those that do not pass the filter."""
    for b in batches:
        g = b.column("grams").to_pylist()
        bucket = _hashes(g)
        line = np.repeat(np.arange(len(g)), [len(x) // WIDTH for x in g])
        stay = passes(bitmap, bucket & (1 << FILTER_BITS) - 1)
        bucket, line = bucket[stay], line[stay]
        for lo in range(0, len(bucket), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(bucket[lo:lo + (1 << 16)]), b.column("h").take(pa.array(line[lo:lo + (1 << 16)]))], ["bucket", "h"])


def _site(th: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Filter bit of a line's place: the hash of its text and its number."""
    return (hashing.mix64(th.astype(np.int64).view(np.uint64) + n.astype(np.uint64) * np.uint64(SECOND)) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)


def _site_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_site(b.column("x").to_numpy(), b.column("n").to_numpy()))], ["bit"])


def edit_similarity(a: list, b: list) -> float:
    """1 - edit distance / length of the longer, over words; the bit-parallel algorithm on whole integers."""
    longest = max(len(a), len(b))
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i:len(a) - j], b[i:len(b) - j]
    if not a or not b:
        return 1 - max(len(a), len(b)) / longest if longest else 1.0
    where: dict = {}
    for k, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << k
    top, full, plus, minus, score = 1 << len(a) - 1, (1 << len(a)) - 1, (1 << len(a)) - 1, 0, len(a)
    for w in b:
        eq = where.get(w, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | full & ~(xh | plus), plus & xh
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & full, down << 1 & full
        plus, minus = down | full & ~(xv | up), up & xv
    return 1 - score / longest


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = [edit_similarity(fold(x).split(), fold(y).split()) >= SIMILARITY for x, y in zip(b.column("la").to_pylist(), b.column("lb").to_pylist())]
        yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.IntegerType()), T.StructField("n_dropped", T.IntegerType())]))
def _rebuilt(texts: pd.Series, kept: pd.Series) -> pd.DataFrame:
    rows = []
    for t, ns in zip(texts, kept):
        lines, stay = (t or "").split("\n"), set() if ns is None else set(ns.tolist())
        left = [x for i, x in enumerate(lines) if i in stay or not fold(x).split()]
        rows.append((None if t is None else "\n".join(left), len(lines), len(lines) - len(left)))
    return pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"])


def _differing(a: Column, b: Column, columns: str) -> Column:
    return F.bit_count(a[f"{columns}0"].bitwiseXOR(b[f"{columns}0"])) + F.bit_count(a[f"{columns}1"].bitwiseXOR(b[f"{columns}1"]))


def _agreeing(a: Column, b: Column) -> Column:
    """Number of equal bits of two SimHashes; null where lengths or parities rule SIMILARITY out."""
    edits = F.floor(F.greatest(a["words"], b["words"]) / STEP)
    near = (F.abs(a["words"] - b["words"]) <= edits) & (_differing(a, b, "p") <= 2 * edits)
    return F.when(near, F.lit(128) - _differing(a, b, "s"))


def kept_lines(docs: DataFrame) -> DataFrame:
    """(__id, __th, n): the one occurrence of each group of lines that stays."""
    same = [F.min(c).alias(c) for c in ("s0", "s1", "p0", "p1", "words", "grams")]
    groups = saved(occurrences(docs, _levels(docs)).groupBy("h").agg(F.min(F.struct("__id", "__th", "n")).alias("first"), *same))
    shown = groups.where(F.col("words") >= STEP - 1)
    # word pairs of one line only are left behind in the scan, by a filter of fixed size; what passes is counted again
    bitmap = bit_filter(shown.select("grams").mapInArrow(_pages, "page int, seen binary").groupBy("page").applyInPandas(_repeated, "bit bigint"))
    met = shown.select("h", "grams").mapInArrow(lambda batches: _spread(batches, bitmap), "bucket bigint, h binary").toDF("bucket", "id")
    several = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("bucket").alias("k"))
    live = saved(met.join(several, F.col("bucket") == F.col("k"), "left_semi"))
    members = live.join(shown.select("h", F.struct("s0", "s1", "p0", "p1", "words").alias("sig")), F.col("id") == F.col("h"), "inner").select("bucket", "id", "sig")
    keyed = docs.select("doc_id", text_of().alias("t")).select(*row_key(F.col("doc_id"), F.col("t")), "t")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def verify(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        sites = groups.join(wanted, groups["h"] == wanted["id"], "left_semi").select("h", F.col("first.__id").alias("i"), F.col("first.__th").alias("x"), F.col("first.n").alias("n"))
        # lines that are not asked for are left behind in the scan, by two filters of fixed size
        near_sites = saved(sites)
        held = bit_filter(near_sites.select(bit_of(F.col("x")).alias("bit")))
        placed = bit_filter(near_sites.select("x", "n").mapInArrow(_site_bits, "bit bigint"))

        def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                b = b.filter(pa.array(passes(held, b.column("__th").to_numpy() & (1 << FILTER_BITS) - 1)))
                split = [t.split("\n") for t in b.column("t").to_pylist()]
                count = np.array([len(x) for x in split], np.int64)
                row = np.repeat(np.arange(len(split)), count)
                n = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                at = np.flatnonzero(passes(placed, _site(b.column("__th").to_numpy()[row], n)))
                pick = pa.array(row[at])
                yield pa.RecordBatch.from_arrays([b.column("__id").take(pick), b.column("__th").take(pick), pa.array(n[at].astype(np.int32)), pa.array([split[i][j] for i, j in zip(row[at], n[at])], pa.string())], ["__id", "__th", "m", "line"])

        read = keyed.mapInArrow(lines, f"__id {kind}, __th bigint, m int, line string")
        found = near_sites.join(read, F.col("i").eqNullSafe(F.col("__id")) & (F.col("x") == F.col("__th")) & (F.col("n") == F.col("m")), "inner")
        # rows alike in id and text hold the same line
        texts = saved(found.select("h", "line").dropDuplicates(["h"]))
        a, b = texts.toDF("ha", "la"), texts.toDF("hb", "lb")
        both = pairs.join(a, F.col("a") == F.col("ha"), "inner").join(b, F.col("b") == F.col("hb"), "inner")
        return both.select("a", "b", "la", "lb").mapInArrow(_similar, "a binary, b binary")

    near = grouped(members, verify, _agreeing, 0, rounds=1, counted=True)  # every round reads the texts again
    firsts = near.join(groups.select("h", "first"), F.col("id") == F.col("h"), "inner").select("id", "root", "first")
    best = firsts.groupBy("root").agg(F.min_by("id", "first").alias("best")).select(F.col("best"), F.col("root").alias("r"))
    gone = saved(firsts.join(best, F.col("root") == F.col("r"), "inner").where("id != best").select(F.col("id").alias("g")))
    return groups.join(gone, F.col("h") == F.col("g"), "left_anti").select("first.*")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with ``text`` reduced to the lines that stay, and n_lines and n_dropped added.

    Lines without a word always stay, and so does the text's line structure. A null text stays null. Rows alike in
    doc_id and text count as one document and come back alike; a null doc_id sorts before all others. A document whose
    lines all occur earlier comes back with what is left, possibly an empty text. An empty table gives no rows. Input
    columns named n_lines or n_dropped are replaced.
    """
    kept = kept_lines(docs).groupBy("__id", "__th").agg(F.collect_list("n").alias("ns"))
    keep = kept.select(F.col("__id").alias("i"), F.col("__th").alias("x"), "ns")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed = row.select("row", *row_key(F.col("row.doc_id"), F.coalesce("row.text", F.lit(""))))
    joined = keyed.join(keep, F.col("__id").eqNullSafe(F.col("i")) & (F.col("__th") == F.col("x")), "left")
    done = joined.withColumn("done", _rebuilt(F.col("row.text"), F.col("ns")))
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return done.select(*[F.col("done.text").alias(c) if c == "text" else F.col(f"row.`{c}`") for c in names], "done.n_lines", "done.n_dropped")
