"""Prefix trie of conversations by ROLLUP over positional turn-id columns.

A conversation is cut into blocks of four turns; a block is one row whose columns hold the ids of its turns, keyed by the
node that the block before it reached. One ROLLUP over the columns counts every prefix inside the blocks, with
grouping_id telling its depth, and blocks of any number make conversations of any length.

A turn id mixes position, role and text (two words of 60 bits), and a node is the sum of the ids on its path, so the node
before a block is a running sum: it is found by blocks of blocks, and no conversation is one task.

Subtree figures need no walk up the tree. The conversation that names a node (its smallest member) names a suffix of its
own path, so every node is owned by one conversation from some depth on. What a subtree holds is then a sum over its members
of what each owns, less what the namer owns above: a second ROLLUP.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridmend.functions.distributed import ordinal
from gridmend.llm.common import saved
from gridmend.llm.mixing import word_count

#: Turns in a block; five ids of 60 bits still add up within a long.
WIDTH = 4
MASK = (1 << 60) - 1
RUN = 1024  # blocks summed together before conversations are windowed, and turns of a conversation in one window
PACK = 4096
SPACING, HEADS = 20, 4
KEY = ("depth", "ka", "kb")


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, content, words): turns in order, counted from 0; role and text are reduced to a digest."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    content = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = saved(conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), content.alias("content"), word_count(text).alias("words")))
    # turns without a number come first, by content: so their blocks may be cut by content
    block = [F.shiftright("turn", 10), F.when(F.col("turn").isNull(), F.substring("content", 1, 3))]
    return ordinal(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), "content"], block, "pos").select("conv_id", "pos", "content", "words")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, content, words) of rebuilt conversations, and one row without content at position 0 for each of them,
    so that those without turns are there too."""
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % SPACING
    openings = (turns.where((F.col("conv_id") % SPACING == 0) & (F.col("pos") < HEADS - 1)).groupBy(F.col("conv_id").alias("base_id"))
                .agg(F.sort_array(F.collect_list(F.struct("pos", "content", "words"))).alias("opening")))  # three turns at most
    convs = saved(turns.groupBy("conv_id").agg(F.count("*").alias("n_own")).withColumn("base_id", base).join(openings, "base_id", "left")
                  .select("conv_id", F.slice(F.coalesce("opening", F.array().cast("array<struct<pos:bigint,content:string,words:bigint>>")), F.lit(1), head).alias("opening")))
    first = convs.select("conv_id", F.inline("opening"))
    shift = convs.select(F.col("conv_id").alias("shifted"), (F.size("opening") - head).cast("long").alias("by")).where("by <> 0")
    own = turns.where(F.col("pos") >= head)
    rest = own.join(shift, F.col("conv_id") == F.col("shifted"), "left").select("conv_id", (F.col("pos") + F.coalesce("by", F.lit(0))).alias("pos"), "content", "words")
    blank = convs.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("content"), F.lit(0).cast("long").alias("words"))
    return first.unionByName(rest).unionByName(blank)


def _added(*parts: Column) -> Column:
    total = F.lit(0).cast("long")
    for p in parts:
        total = total + F.coalesce(p, F.lit(0))
    return total.bitwiseAND(MASK)


def blocks(turns: DataFrame) -> DataFrame:
    """One row per conversation and block: conv_id, blk, pa and pb (node before it), before (words before it), a1.. b1..
    (ids), w1.. (words), n_turns (in the block)."""
    place = F.concat_ws(":", F.col("pos").cast("string"), F.col("content"))
    part = lambda start: F.when(F.col("content").isNotNull(), F.conv(F.substring(F.md5(place), start, 15), 16, 10).cast("long"))
    each = turns.select("conv_id", F.floor(F.col("pos") / WIDTH).cast("long").alias("blk"), (F.col("pos") % WIDTH).alias("slot"), part(1).alias("a"), part(17).alias("b"), "words")
    slots = range(1, WIDTH + 1)
    at = lambda c, j: F.max(F.when(F.col("slot") == j - 1, F.col(c)))
    rows = saved(each.groupBy("conv_id", "blk").agg(*[at(c, j).alias(f"{n}{j}") for n, c in (("a", "a"), ("b", "b"), ("w", "words")) for j in slots], F.count("a").alias("n_turns")))
    big = {n: F.col(n).cast("decimal(19,0)") for n in ("a", "b")}
    tagged = rows.withColumns({"run": F.floor(F.col("blk") / RUN).cast("long"), "a": _added(*[F.col(f"a{j}") for j in slots]), "b": _added(*[F.col(f"b{j}") for j in slots]),
                               "w": sum((F.coalesce(f"w{j}", F.lit(0)) for j in slots), F.lit(0).cast("long"))})
    sums = lambda over=None: [(F.sum(c) if over is None else F.coalesce(F.sum(c).over(over), F.lit(0))).alias(n) for n, c in (("sa", big["a"]), ("sb", big["b"]), ("sw", F.col("w")))]
    per_run = tagged.groupBy("conv_id", "run").agg(*sums())
    earlier = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("conv_id", "run").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_run.select(F.col("conv_id").alias("o_conv"), F.col("run").alias("o_run"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"o_{c}") for c in ("sa", "sb", "sw")])
    placed = tagged.select("*", *sums(inside)).join(offsets, (F.col("conv_id") == F.col("o_conv")) & (F.col("run") == F.col("o_run")), "inner")
    node = lambda c: ((F.col(f"s{c}") + F.col(f"o_s{c}")) % F.lit(MASK + 1).cast("decimal(19,0)")).cast("long").alias(f"p{c}")
    return placed.select("conv_id", "blk", node("a"), node("b"), (F.col("sw") + F.col("o_sw")).cast("long").alias("before"), *[f"{n}{j}" for n in "abw" for j in slots], "n_turns")


def rolled(rows: DataFrame, *aggregates: str) -> DataFrame:
    """Every prefix of the blocks: depth, ka and kb (its node), qa and qb (the node above), and the aggregates."""
    slots = range(1, WIDTH + 1)
    pairs = ", ".join(f"(a{j}, b{j})" for j in slots)
    level = f"{WIDTH} - CAST(bit_count(grouping_id()) / 2 AS INT)"
    node = lambda c, upto: f"(p{c} + " + " + ".join(f"IF(level {'>=' if not upto else '>'} {j}, coalesce({c}{j}, 0), 0)" for j in slots) + f") & {MASK}"
    # a prefix that ends beyond its conversation is no node; the empty one only counts before the first block
    last = "CASE level " + " ".join(f"WHEN {j} THEN a{j} IS NOT NULL" for j in slots) + " ELSE blk = 0 END"
    groups = rows.sparkSession.sql(f"SELECT blk, pa, pb, {', '.join(f'a{j}, b{j}' for j in slots)}, {level} AS level, {', '.join(aggregates)} FROM {{rows}} GROUP BY blk, pa, pb, ROLLUP ({pairs})", rows=rows)
    return groups.where(last).selectExpr(f"blk * {WIDTH} + level AS depth", f"{node('a', False)} AS ka", f"{node('b', False)} AS kb", f"{node('a', True)} AS qa", f"{node('b', True)} AS qb", "*")


def end_digests(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """(depth, ka, kb, ends_sha256) of nodes at which conversations end. A digest is a sequence: ids are packed in order into
    texts of up to 4096 ids by many tasks, and the few texts of a node stream through one hash."""
    slots = range(1, WIDTH + 1)
    last = rows.join(lengths.select(F.col("conv_id").alias("l_conv"), "length"), F.col("conv_id") == F.col("l_conv")).where(F.col("blk") == F.floor(F.greatest(F.col("length") - 1, F.lit(0)) / WIDTH))
    ends = last.select(F.col("length").alias("depth"), *[_added(F.col(f"p{c}"), *[F.col(f"{c}{j}") for j in slots]).alias(f"k{c}") for c in "ab"], "conv_id")
    packs = ends.groupBy(*KEY, F.floor(F.col("conv_id") / PACK).cast("long").alias("pack")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    ordered = packs.repartition(*KEY).sortWithinPartitions(*KEY, "pack")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for b in batches:
            done = []
            for *k, ids in zip(*(b.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
                if k == key:
                    digest.update(b"," + ids.encode())
                else:
                    if key is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256(ids.encode())
            yield _batch(done)
        if key is not None:
            yield _batch([(*key, digest.hexdigest())])

    return ordered.mapInArrow(hashed, "depth long, ka long, kb long, ends_sha256 string")


def _batch(rows: Sequence[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], [*KEY, "ends_sha256"])


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row per node of the trie
    of rebuilt conversations.

    Null role or text: empty. Null turn: first; turns of equal number are ordered by a digest of role and text, and rows
    repeated exactly are turns of their own. Rows without conv_id belong to no conversation and are left out. A conversation
    without turns ends at the root. An empty table has no root and gives no rows. Further columns are not read.
    """
    return nodes_of(rebuilt(turns_of(conversations)))


def nodes_of(turns: DataFrame) -> DataFrame:
    """The trie of given turns (conv_id, pos, content, words), every conversation with a row at 0 (content null if it has none)."""
    rows = saved(blocks(turns))
    lengths = saved(rows.groupBy("conv_id").agg(F.sum("n_turns").alias("length"), F.sum(sum((F.coalesce(f"w{j}", F.lit(0)) for j in range(1, WIDTH + 1)), F.lit(0).cast("long"))).alias("total")))
    known = rows.join(lengths.withColumnRenamed("conv_id", "l_conv"), F.col("conv_id") == F.col("l_conv"))
    counted = rolled(known, "count(*) AS n_convs", "min(conv_id) AS conv_id", "max(length) AS longest", "sum(total) AS totals", "max(before) AS before", *[f"max(w{j}) AS w{j}" for j in range(1, WIDTH)])
    above = sum((F.when(F.col("level") > j, F.coalesce(f"w{j}", F.lit(0))).otherwise(0) for j in range(1, WIDTH)), F.col("before"))
    nodes = saved(counted.select(*KEY, "qa", "qb", "conv_id", "n_convs", (F.col("longest") == F.col("depth")).cast("int").alias("leaf"), "totals", above.alias("above")))
    # from which words on a conversation owns its path, and whether it owns a leaf
    owners = saved(nodes.groupBy(F.col("conv_id").alias("owner")).agg(F.min_by("above", "depth").alias("shared"), F.max("leaf").alias("leaf")))
    owning = known.join(owners, F.col("conv_id") == F.col("owner")).withColumn("owned", F.col("total") - F.col("shared"))
    below = rolled(owning, "sum(owned) AS owned", "sum(leaf) AS n_leaves").select(*[F.col(k).alias(f"b_{k}") for k in KEY], "owned", "n_leaves")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("c_depth"), F.col("qa").alias("c_ka"), F.col("qb").alias("c_kb")).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("q_depth"), F.col("ka").alias("q_qa"), F.col("kb").alias("q_qb"), F.col("conv_id").alias("parent_conv_id"))
    ends = end_digests(rows, lengths).select(*[F.col(k).alias(f"e_{k}") for k in KEY], "ends_sha256")
    same = lambda prefix: (F.col("depth") == F.col(f"{prefix}_depth")) & (F.col("ka") == F.col(f"{prefix}_ka")) & (F.col("kb") == F.col(f"{prefix}_kb"))
    full = (nodes.drop("leaf").join(below, same("b")).join(children, same("c"), "left").join(ends, same("e"), "left").join(owners.drop("leaf"), F.col("conv_id") == F.col("owner"))
            .join(parents, (F.col("depth") == F.col("q_depth")) & (F.col("qa") == F.col("q_qa")) & (F.col("qb") == F.col("q_qb")), "left"))
    every = F.col("totals") - F.col("n_convs") * F.col("above")  # words of the subtree, each node as often as it has members
    once = F.col("owned") + F.col("shared") - F.col("above")  # and once
    return full.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
                       F.col("n_leaves").cast("long").alias("n_leaves"), (every - once).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


ORACLE = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS content,
           len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, xor(list_reduce([CAST(4294967295 AS BIGINT)] || flatten([[CAST((ascii(ch) >> k) & 1 AS BIGINT) FOR k IN range(8)] FOR ch IN string_split(CAST(conv_id AS VARCHAR), '')]),
      lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) % 4 AS h FROM t),
r AS (SELECT c.conv_id, b.pos, b.content, b.words, 0 AS part FROM c JOIN t b ON b.conv_id = c.conv_id - c.conv_id % 20 AND b.pos < c.h
      UNION ALL SELECT c.conv_id, t.pos, t.content, t.words, 1 FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos >= c.h),
l AS (SELECT c.conv_id, coalesce(list({'c': r.content, 'w': r.words} ORDER BY part, pos) FILTER (r.pos IS NOT NULL), []) AS path FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
p AS (SELECT conv_id, d.depth, len(path) AS length, [x.c FOR x IN path[1:d.depth]] AS key, [x.c FOR x IN path[1:d.depth - 1]] AS above, CASE WHEN d.depth > 0 THEN path[d.depth].w ELSE 0 END AS words
      FROM l, LATERAL (SELECT unnest(range(0, len(path) + 1)) AS depth) d),
n AS (SELECT key, any_value(above) AS above, any_value(words) AS words, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(length) = depth AS leaf,
      sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (length = depth), '')) AS ends_sha256 FROM p GROUP BY key, depth),
s AS (SELECT u.key, u.depth, sum((v.n_convs - 1) * v.words) AS saved_tokens, count(*) FILTER (v.leaf) AS n_leaves FROM n v JOIN p u ON u.conv_id = v.conv_id AND u.depth <= v.depth GROUP BY u.key, u.depth),
k AS (SELECT above, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY above, depth)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(k.n_children, 0) AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN s ON s.key = n.key AND s.depth = n.depth LEFT JOIN k ON k.above = n.key AND k.depth = n.depth LEFT JOIN n q ON q.depth = n.depth - 1 AND q.key = n.above
"""
