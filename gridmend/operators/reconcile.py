"""Several readings of the same cell become one value, with the way it was decided.

Votes depend on the texts alone, so they are taken once per distinct combination of readings; vocabulary hits of the
tokens involved are joined in beforehand. All but alignment merging is native.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from gridmend.functions import constants as K
from gridmend.functions import text as T
from gridmend.functions.distributed import first_n
from gridmend.functions.similarity import ratcliff_join, ratcliff_ratio
from gridmend.session import checkpoint, saved


def dict_score(texts: DataFrame, vocab: DataFrame, col: str = "text") -> DataFrame:
    """Share of a text's tokens (two letters or more) in the vocabulary, once per distinct text."""
    d = texts.select(col).filter(F.col(col).isNotNull()).distinct()
    toks = d.select(col, F.explode_outer(F.filter(T.tokens(T.fold(col, "alef")), lambda t: F.length(t) >= 2)).alias("token"))
    j = toks.join(vocab.select("token", F.lit(1).alias("__hit")), "token", "left")
    return j.groupBy(col).agg(F.coalesce(F.count("__hit") / F.nullif(F.count("token"), F.lit(0)), F.lit(0.0)).alias("score"))


def vote_cells(readings: DataFrame, vocab: DataFrame) -> DataFrame:
    """Winner and method per distinct (layout, vision, azure_read), joined back to the cells."""
    eng = ["layout", "vision", "azure_read"]
    d = readings.select(*[F.coalesce(F.trim(e), F.lit("")).alias(e) for e in eng]).distinct()
    every = d.select(F.explode(F.array(*eng)).alias("text"))
    sc = dict_score(every, vocab)
    for e in eng:
        d = d.join(sc.select(F.col("text").alias(e), F.col("score").alias(f"s_{e}")), e, "left")
    have = {e: F.col(e) != "" for e in eng}
    n = sum((have[e].cast("int") for e in eng), F.lit(0))
    nl, nv, na = (T.fold(e, "alef") for e in eng)
    score = {e: F.when(have[e], F.col(f"s_{e}")).otherwise(F.lit(-1.0)) for e in eng}
    top = F.greatest(*score.values())
    best = F.when(score["layout"] == top, "layout").when(score["vision"] == top, "vision").otherwise("azure_read")
    best_text = F.when(best == "layout", F.col("layout")).when(best == "vision", F.col("vision")).otherwise(F.col("azure_read"))
    same = (~have["vision"] | (nl == nv)) & (~have["azure_read"] | (nl == na))
    scored = T.mostly_arabic(F.col("layout")) & (top > 0)
    fill = F.when(score["vision"] >= score["azure_read"], F.col("vision")).otherwise(F.col("azure_read"))
    cases = [
        (n == 0, F.lit(""), F.lit("empty")),
        ((n == 1) & have["layout"], F.col("layout"), F.lit("single_layout")), ((n == 1) & have["vision"], F.col("vision"), F.lit("single_vision")),
        (n == 1, F.col("azure_read"), F.lit("single_azure_read")),
        (~have["layout"] & (nv == na), F.col("azure_read"), F.lit("fill_agree")), (~have["layout"], fill, F.lit("fill_score")),
        (same, F.col("layout"), F.lit("unanimous")),
        ((n == 3) & (nv == na), F.col("azure_read"), F.lit("majority_vision+azure_read")),
        ((n == 3) & (nl == na), F.col("layout"), F.lit("majority_layout+azure_read")),
        ((n == 3) & (nl == nv), F.col("layout"), F.lit("majority_layout+vision")),
        (scored, best_text, F.concat(F.lit("score_"), best)),
    ]
    winner, method = F.col("layout"), F.lit("layout_default")
    for cond, w, m in reversed(cases):
        winner, method = F.when(cond, w).otherwise(winner), F.when(cond, m).otherwise(method)
    voted = d.select(*eng, winner.alias("winner"), method.alias("method"))
    left = readings.withColumns({e: F.coalesce(F.trim(e), F.lit("")) for e in eng})
    return left.join(voted, eng)


def low_confidence_queue(votes: DataFrame, order: list, cap: int = 30) -> DataFrame:
    """Disputed cells that read like names, the first ``cap`` per document in scan order."""
    words = F.size(F.filter(T.tokens(F.col("winner")), lambda t: t.rlike(K.ARABIC)))
    doubt = (F.col("method").startswith("score_") | (F.col("method") == "layout_default")) & T.mostly_arabic(F.col("winner")) & (words >= 2)
    return first_n(votes.filter(doubt), ["job_id"], order, cap)


# --- fixed values: engine preference when engines agree, and when they do not --------------------------------------
AGREED, DISPUTED = ("gemini", "azure", "vision"), ("vision", "azure", "gemini")


def vote_name_tokens_positional(readings: DataFrame, vocab: DataFrame) -> DataFrame:
    """Token by token vote over gemini, azure and vision; adds ``winner`` and ``method``."""
    # a null reading and an empty one are the same reading; the three texts themselves are the key
    three = F.struct(*[F.coalesce(F.col(e), F.lit("")).alias(e) for e in AGREED])
    d = readings.select(three.alias("__id")).distinct().select("__id", "__id.*")
    toks = d.select(*AGREED, "__id", *[T.tokens(F.col(e)).alias(f"t_{e}") for e in AGREED])
    words = toks.select("__id", F.explode(F.array_distinct(F.transform(F.concat("t_gemini", "t_azure", "t_vision"), lambda t: T.fold(t, "alef")))).alias("token"))
    hits = words.join(vocab.select("token").distinct(), "token").groupBy("__id").agg(F.collect_list("token").alias("hits"))
    j = toks.join(hits, "__id", "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<string>")))
    blank = {e: F.size(f"t_{e}") == 0 for e in AGREED}
    n = sum(((~blank[e]).cast("int") for e in AGREED), F.lit(0))

    def at(i):
        tok = {e: F.get(f"t_{e}", i) for e in AGREED}
        fold = {e: T.fold(tok[e], "alef") for e in AGREED}
        have = {e: tok[e].isNotNull() for e in AGREED}

        def first(order, ok):
            return F.coalesce(*[F.when(ok[e], tok[e]) for e in order])

        def first_name(order, ok):
            return F.coalesce(*[F.when(ok[e], F.lit(e)) for e in order])

        pair = {}
        for e in AGREED:
            others = [o for o in AGREED if o != e]
            pair[e] = F.coalesce((fold[e] == fold[others[0]]) | (fold[e] == fold[others[1]]), F.lit(False))
        m = sum((have[e].cast("int") for e in AGREED), F.lit(0))
        known = {e: have[e] & F.array_contains("hits", fold[e]) for e in AGREED}
        k = sum((F.coalesce(known[e], F.lit(False)).cast("int") for e in AGREED), F.lit(0))
        agree = F.size(F.array_distinct(F.filter(F.array(*fold.values()), lambda x: x.isNotNull()))) == 1
        any_pair = pair["gemini"] | pair["azure"] | pair["vision"]
        token = (F.when(m == 1, first(AGREED, have)).when(agree, first(AGREED, have)).when(any_pair, first(AGREED, pair))
                 .when(k >= 1, first(DISPUTED, known)).otherwise(first(DISPUTED, have)))
        how = (F.when(m == 1, F.lit("single")).when(agree, "unanimous").when(any_pair, "majority").when(k == 1, "dict").when(k > 1, "dict_tie").otherwise("priority"))
        return F.struct(token.alias("t"), how.alias("h"))

    longest = F.greatest(*[F.size(f"t_{e}") for e in AGREED])
    voted = j.withColumn("__v", F.when(n >= 2, F.transform(F.sequence(F.lit(0), longest - 1), at)))
    how = F.transform("__v", lambda v: v["h"])
    summary = (F.when(n == 0, "empty").when(n == 1, F.concat(F.lit("single_"), F.coalesce(*[F.when(~blank[e], F.lit(e)) for e in AGREED])))
               .when(F.forall("__v", lambda v: v["h"] == "unanimous"), "unanimous").when(F.array_contains(how, "majority"), "token_majority")
               .when(F.array_contains(how, "priority"), "token_priority").otherwise("token_vote"))
    winner = F.when(n == 0, "").when(n == 1, F.coalesce(*[F.when(~blank[e], F.col(e)) for e in AGREED])).otherwise(
        F.array_join(F.transform("__v", lambda v: v["t"]), " "))
    out = voted.select("__id", winner.alias("winner"), summary.alias("method"))
    keyed = readings.withColumn("__id", three)
    return keyed.join(out, "__id").drop("__id")


def vote_participants(readings: DataFrame, vocab: DataFrame) -> DataFrame:
    """Voted names against the stored ones: replaced only when half the stored tokens occur in the winner.

    Needs ``current_value``; adds ``value`` and ``outcome``.
    """
    v = vote_name_tokens_positional(readings, vocab)
    current = F.trim(F.coalesce("current_value", F.lit("")))
    winner = F.when(F.col("winner") == "", current).otherwise(F.col("winner"))
    cur = F.filter(F.array_distinct(T.tokens(T.fold(current, "alef"))), lambda t: F.length(t) >= 2)
    shared = F.size(F.array_intersect(cur, T.tokens(T.fold("winner", "alef"))))
    aligned = (F.size(cur) == 0) | (shared / F.greatest(F.size(cur), F.lit(1)) >= 0.5)
    bucket = (F.when(F.col("method").startswith("token"), "token").when(F.col("method").startswith("single"), "single").otherwise(F.col("method")))
    changed = (winner != "") & (winner != current)
    outcome = F.when(~changed, "unchanged").when(~aligned, "rejected").otherwise(bucket)
    return v.withColumn("value", F.when(changed & aligned, winner).otherwise(F.col("current_value"))).withColumn("outcome", outcome)


def vote_stats(votes: DataFrame, col: str = "outcome") -> DataFrame:
    return votes.groupBy(col).agg(F.count("*").alias("n"))


# --- reference-length vote over four readings ---------------------------------------------------------------------

SOURCES4 = ["col_ocr", "azure", "gemini", "structured"]


def name_parts(c: Column) -> Column:
    """Tokens with a compound prefix joined to the word after it."""
    prefixes = T.any_of(K.COMPOUND_PREFIXES)
    state = "struct<done:array<string>,open:string>"

    def step(a, w):
        joined = F.concat(a["done"], F.array(F.concat_ws(" ", a["open"], w)))
        opens = a["open"].isNull() & F.array_contains(prefixes, w)
        return F.struct(F.when(opens, a["done"]).otherwise(joined), F.when(opens, w)).cast(state)

    first = F.struct(F.array().cast("array<string>"), F.lit(None).cast("string")).cast(state)
    # a fold's result that is read several times inside a lambda would be folded anew each time
    return F.aggregate(T.tokens(c), first, step, lambda end: F.when(end["open"].isNull(), end["done"]).otherwise(F.concat(end["done"], F.array(end["open"]))))


def vote_quadruples(d: DataFrame) -> DataFrame:
    """Vote of each row of four readings per position at the most common name length: ``votes``, ``assembled``, ``all_stable``.

    Ties go to the reading listed first. Every step is a column of its own, so that no lambda makes it anew per element.
    """
    read = F.filter(F.array(*[F.coalesce(F.trim(c), F.lit("")) for c in SOURCES4]), lambda x: x != "")
    s1 = d.withColumn("__r", read).withColumn("__p", F.transform("__r", name_parts))
    sizes = F.transform("__p", lambda p: F.size(p))
    s2 = s1.withColumn("__n", sizes)
    modal = F.array_min(F.transform("__n", lambda n, i: F.struct((-F.size(F.filter("__n", lambda m: m == n))).alias("c"), F.array_position("__n", n).alias("i"), n.alias("n"))))["n"]
    same_all = F.size(F.array_distinct(F.transform("__r", lambda r: T.fold(r, "full")))) == 1
    s3 = s2.withColumn("__ref", F.coalesce(modal, F.lit(0))).withColumn("__q", same_all)

    def tokens_at(pos):
        ref = F.col("__ref")

        def pick(p):
            size = F.size(p)
            return (F.when(size == ref, F.get(p, pos)).when(size > ref, F.lit(None)).when(pos == ref - 1, F.get(p, size - 1))
                    .when(pos < size - 1, F.get(p, pos)))

        return F.filter(F.transform("__p", pick), lambda t: t.isNotNull())

    where = F.filter(F.transform(F.when(F.col("__ref") > 0, F.sequence(F.lit(0), F.col("__ref") - 1)).otherwise(F.array().cast("array<int>")),
                                 lambda i: F.struct(i.alias("pos"), tokens_at(i).alias("toks"))), lambda x: F.size(x["toks"]) > 0)
    folded = F.transform("__w", lambda x: F.struct(x["pos"].alias("pos"), F.transform(x["toks"], lambda t: F.struct(T.fold(t, "full").alias("f"), t.alias("t"))).alias("toks")))

    def options(x):
        def option(f, i):
            same = F.filter(x["toks"], lambda y: y["f"] == f)
            form = F.array_min(F.transform(same, lambda y, k: F.struct(F.length(y["t"]).alias("l"), k.alias("k"), y["t"].alias("t"))))["t"]
            return F.struct((-F.size(same)).alias("c"), i.alias("i"), form.alias("token"))

        keys = F.array_distinct(F.transform(x["toks"], lambda y: y["f"]))
        return F.struct(x["pos"].alias("pos"), F.size(x["toks"]).alias("total"), F.transform(keys, option).alias("options"))

    def decide(x):
        best = F.array_min(x["options"])
        return F.struct(x["pos"].alias("pos"), best["token"].alias("winner"), (-best["c"]).alias("votes"), x["total"].alias("total"),
                        (best["c"] <= -2).alias("stable"), F.transform(x["options"], lambda o: o["token"]).alias("options"))

    s4 = s3.withColumn("__w", F.when(~F.col("__q"), where)).withColumn("__f", folded).withColumn("__o", F.transform("__f", options))
    lead = F.coalesce(F.nullif(F.trim("col_ocr"), F.lit("")), F.trim("structured"))
    return s4.withColumn("votes", F.transform("__o", decide)).select(
        *d.columns, "votes",
        F.when(F.size("__r") == 0, F.lit(None)).when(F.col("__q"), lead).otherwise(F.array_join(F.transform("votes", lambda v: v["winner"]), " ")).alias("assembled"),
        F.coalesce(F.col("__q") | F.forall("votes", lambda v: v["stable"]), F.lit(False)).alias("all_stable"))


def quadruples(readings: DataFrame) -> DataFrame:
    """The distinct quadruples of readings."""
    # few bytes but much work: a fixed number of tasks, which adaptive execution does not merge
    tasks = int(readings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return readings.select(*SOURCES4).distinct().repartition(tasks, *SOURCES4)


def with_quadruples(readings: DataFrame, facts: DataFrame) -> DataFrame:
    """``readings`` with the facts known of their quadruple; readings whose quadruple has none go."""
    cond = None
    for c in SOURCES4:
        eq = readings[c].eqNullSafe(facts[c])
        cond = eq if cond is None else cond & eq
    return readings.join(facts, cond).select(readings["*"], *[facts[c] for c in facts.columns if c not in SOURCES4])


def vote_names_reference_length(readings: DataFrame) -> DataFrame:
    """The vote of :func:`vote_quadruples`, taken once per distinct quadruple; adds ``votes`` (array), ``assembled``, ``all_stable``."""
    return with_quadruples(readings, vote_quadruples(quadruples(readings)))


def resolve_by_position_dictionary(voted: DataFrame, names: DataFrame, key: list[str]) -> DataFrame:
    """Unsettled positions settled by the name dictionaries; what stays open becomes a payload for a judge.

    ``names``: name, kind (given, male, family). Position 0 uses given names at 0.78, the last the family names at
    0.85 (overriding even a settled vote), the rest the male names at 0.80. Distinct tokens meet the dictionary. Every
    row with votes gives one row: rows that share a key are settled each on its own. What is settled depends on the
    votes alone, so give distinct votes where rows repeat them.
    """
    # read by the lookup and by the assembly: the vote is taken once
    v = checkpoint(voted.select(*key, "votes").withColumn("__b", F.monotonically_increasing_id()))
    each = v.select("__b", F.array_max(F.transform("votes", lambda x: x["pos"])).alias("last"), F.explode("votes").alias("v"))
    kind = F.when(F.col("v.pos") == F.col("last"), "family").when(F.col("v.pos") == 0, "given").otherwise("male")
    asked = each.withColumn("kind", kind).filter((F.col("kind") == "family") | ~F.col("v.stable")).select("__b", "v.pos", "kind", F.posexplode("v.options").alias("opt", "tok"))
    asked = asked.withColumn("f", T.fold("tok", "full"))
    folded = names.select("kind", T.fold("name", "full").alias("cand")).distinct()
    close = ratcliff_join(asked, folded, "f", "cand", 0.78, right_first=True)
    limit = F.when(F.col("kind") == "family", 0.85).when(F.col("kind") == "given", 0.78).otherwise(0.80)
    nearest = (close.join(folded, "cand").filter(F.col("ratio") >= limit).groupBy("f", "kind").agg(F.max(F.struct("ratio", "cand")).alias("m"))
               .select("f", "kind", F.col("m.cand").alias("cand")))
    scored = nearest.withColumn("score", ratcliff_ratio(F.col("f"), F.col("cand"))).filter(F.col("score") >= limit).drop("cand")
    # positions and options of one row are few
    picks = asked.join(scored, ["f", "kind"]).groupBy("__b").agg(F.collect_list(F.struct("pos", "score", (-F.col("opt")).alias("o"), "tok")).alias("__picks"))
    j = v.filter(F.size("votes") > 0).join(picks, "__b", "left")

    def settled(x):
        pick = F.array_max(F.filter("__picks", lambda p: p["pos"] == x["pos"]))["tok"]
        return F.struct(x["pos"].alias("pos"), F.coalesce(pick, x["winner"]).alias("value"), (x["stable"] | F.coalesce(pick.isNotNull(), F.lit(False))).alias("locked"), x["options"].alias("options"))

    per = j.withColumn("payload", F.transform("votes", settled)).withColumn("resolved", F.forall("payload", lambda p: p["locked"]))
    return per.select(*key, "payload", "resolved", F.array_join(F.transform("payload", lambda p: p["value"]), " ").alias("name"))


def judge(resolved: DataFrame) -> DataFrame:
    """A verdict (column ``verdict``) that alters a locked token is refused and the voted name kept."""
    j = resolved.withColumn("__parts", F.transform(name_parts(F.coalesce("verdict", F.lit(""))), lambda t: T.fold(t, "full")))
    broken = F.exists("payload", lambda p: p["locked"] & (p["pos"] < F.size("__parts")) & (T.fold(p["value"], "full") != F.get("__parts", p["pos"])))
    use = F.coalesce(F.trim("verdict"), F.lit("")) != ""
    how = F.when(F.col("resolved"), "settled").when(~use, "no_verdict").when(broken, "refused").otherwise("judged")
    return j.withColumn("outcome", how).withColumn("final_name", F.when(F.col("outcome") == "judged", F.trim("verdict")).otherwise(F.col("name"))).drop("__parts")


def apply_judgements(resolved: DataFrame, verdicts: DataFrame, key: list[str]) -> DataFrame:
    """:func:`judge` with verdicts from a table of their own: key, verdict."""
    return judge(resolved.join(verdicts, key, "left"))


# --- alignment merge of two readings ---------------------------------------------------------------------------------

def substitution_cost(x: str, y: str) -> float:
    if x == y:
        return 0.0
    known = K.CHAR_CONFUSION.get((x, y), K.CHAR_CONFUSION.get((y, x)))
    if known is not None:
        return known
    return 0.75 if "؀" <= x <= "ۿ" and "؀" <= y <= "ۿ" else 1.0


def _grid(a, b, gap: float, cost):
    """Cheapest alignment of two sequences as a list of index pairs; None marks a gap. A match wins ties, then a gap in b."""
    best = [[j * gap for j in range(len(b) + 1)]]
    for i in range(1, len(a) + 1):
        row = [i * gap]
        for j in range(1, len(b) + 1):
            row.append(min(best[i - 1][j - 1] + cost(a[i - 1], b[j - 1]), best[i - 1][j] + gap, row[j - 1] + gap))
        best.append(row)
    i, j, path = len(a), len(b), []
    while i or j:
        if i and j and best[i][j] == best[i - 1][j - 1] + cost(a[i - 1], b[j - 1]):
            i, j = i - 1, j - 1
            path.append((i, j))
        elif i and (not j or best[i][j] == best[i - 1][j] + gap):
            i -= 1
            path.append((i, None))
        else:
            j -= 1
            path.append((None, j))
    return best[-1][-1], path[::-1]


def weighted_distance(a: str, b: str) -> float:
    return _grid(a, b, 0.5, substitution_cost)[0]


def token_distance(a: str, b: str) -> float:
    return weighted_distance(a, b) / max(len(a), len(b), 1)


@F.pandas_udf(DoubleType())
def weighted_edit(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance of two folded texts where look-alike letters cost less."""
    return pd.Series([weighted_distance(x, y) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="float64")


def weighted_edit_distance(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Weighted distance and its share of the longer text, once per distinct pair of folded texts."""
    fa, fb = T.fold(a, "letter"), T.fold(b, "letter")
    d = pairs.select(fa.alias("__a"), fb.alias("__b")).distinct().withColumn("weighted", weighted_edit("__a", "__b"))
    d = d.withColumn("token_distance", F.col("weighted") / F.greatest(F.length("__a"), F.length("__b"), F.lit(1)))
    j = pairs.withColumn("__x", fa).withColumn("__y", fb)
    return j.join(d, (F.col("__x") == F.col("__a")) & (F.col("__y") == F.col("__b"))).drop("__x", "__y", "__a", "__b")


def _merge_letters(a: str, b: str) -> str:
    """The first reading letter by letter, taking the second's letter where the two are look-alikes."""
    out = [b[j] if j is not None and substitution_cost(a[i], b[j]) < 0.5 else a[i] for i, j in _grid(a, b, 0.5, substitution_cost)[1] if i is not None]
    return "".join(out)


def merge_tokens(a, b, fa, fb, near_a, near_b) -> str:
    """Aligned merge of two token lists. ``near_*`` are dictionary closeness pairs (given list, family list)."""
    _, path = _grid(list(range(len(fa))), list(range(len(fb))), 0.55, lambda i, j: token_distance(fa[i], fb[j]))
    out = []
    for n, (i, j) in enumerate(path):
        side = 1 if n == len(path) - 1 else 0
        if i is None:
            if near_b[j][side] >= 0.60:
                out.append(b[j])
        elif j is None:
            out.append(a[i])
        else:
            d = token_distance(fa[i], fb[j])
            if d < 0.30:
                out.append(b[j])
            elif d < 0.65:
                out.append((_merge_letters(fa[i], fb[j]) or a[i]) if fa[i] and fb[j] else (a[i] if fa[i] else b[j]))
            else:
                trusted = near_b[j][side] >= 0.70 and near_b[j][side] > near_a[i][side] + 0.15 and d < 0.85
                out.append(b[j] if trusted else a[i])
    return " ".join(out)


@F.pandas_udf(StringType())
def align_merge(a: pd.Series, b: pd.Series, fa: pd.Series, fb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
    def near(items):
        return [(x["given"], x["family"]) for x in items]
    return pd.Series([merge_tokens(list(p[0]), list(p[1]), list(p[2]), list(p[3]), near(p[4]), near(p[5])) for p in zip(a, b, fa, fb, na, nb)], dtype="object")


def dictionary_nearness(tokens: DataFrame, names: DataFrame) -> DataFrame:
    """Per distinct folded token: closeness to the given and the family names, 1 on a hit, 0 beyond reach.

    ``names``: name, kind ('family' or anything else for given).
    """
    folded = names.select(F.when(F.col("kind") == "family", "family").otherwise("given").alias("kind"), T.fold("name", "letter").alias("cand")).distinct()
    close = ratcliff_join(tokens.select("token").distinct(), folded, "token", "cand", 0.65, right_first=True)
    top = close.join(folded, "cand").groupBy("token", "kind").agg(F.max(F.struct("ratio", "cand")).alias("m")).select("token", "kind", F.col("m.cand").alias("cand"))
    d = top.withColumn("w", weighted_edit("token", "cand"))
    near = F.when(F.col("token") == F.col("cand"), F.lit(1.0)).otherwise(1 - F.col("w") / F.greatest(F.length("token"), F.length("cand"), F.lit(1)))
    return d.groupBy("token").agg(F.max(F.when(F.col("kind") == "given", near)).alias("given"), F.max(F.when(F.col("kind") == "family", near)).alias("family"))


def align_merge_names(pairs: DataFrame, names: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Merged name per distinct (a, b): tokens aligned, look-alike letters reconciled, the dictionary deciding disputes."""
    d = pairs.select(F.trim(a).alias("a"), F.trim(b).alias("b")).filter("a <> '' and b <> ''").distinct()
    ta, tb = T.tokens(F.col("a")), T.tokens(F.col("b"))
    d = d.select("a", "b", ta.alias("ta"), tb.alias("tb"), F.transform(ta, lambda t: T.fold(t, "letter")).alias("fa"), F.transform(tb, lambda t: T.fold(t, "letter")).alias("fb"))
    near = dictionary_nearness(d.select(F.explode(F.concat("fa", "fb")).alias("token")), names)

    def attach(df, side):
        toks = df.select("a", "b", F.posexplode(side).alias("pos", "token")).join(near, "token", "left")
        item = F.struct("pos", F.coalesce("given", F.lit(0.0)).alias("given"), F.coalesce("family", F.lit(0.0)).alias("family"))
        return toks.groupBy("a", "b").agg(F.array_sort(F.collect_list(item)).alias(f"n_{side}"))

    j = d.join(attach(d, "fa"), ["a", "b"]).join(attach(d, "fb"), ["a", "b"])
    return j.select("a", "b", align_merge("ta", "tb", "fa", "fb", "n_fa", "n_fb").alias("merged"))


def align_tables(a_cells: DataFrame, b_cells: DataFrame, key: str = "doc_id") -> DataFrame:
    """Full outer positional join of two readings of a table; a missing cell is an empty text."""
    pos = [key, "row_idx", "col_idx"]
    a, b = a_cells.select(*pos, F.col("value").alias("a")), b_cells.select(*pos, F.col("value").alias("b"))
    return trimmed(a.join(b, pos, "full_outer"))


def trimmed(aligned: DataFrame) -> DataFrame:
    return aligned.withColumns({"a": F.trim(F.coalesce("a", F.lit(""))), "b": F.trim(F.coalesce("b", F.lit("")))})


def header_types(aligned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Type of every column from the wider of the two header rows."""
    h = aligned.filter("row_idx = 0")
    wide = h.groupBy(key).agg((F.count_if(F.col("b") != "") >= F.count_if(F.col("a") != "")).alias("use_b"))
    head = F.trim(F.when(F.col("use_b"), F.col("b")).otherwise(F.col("a")))
    kind = (F.when(head.rlike(K.MERGE_PHONE), "phone").when(head.rlike(K.MERGE_DATE), "date").when(head.rlike(K.MERGE_NUMBER), "number")
            .when(head.rlike(K.MERGE_NAME), "name").otherwise("text"))
    return h.join(wide, key).select(key, "col_idx", kind.alias("col_type"))


def merge_tables(a_cells: DataFrame, b_cells: DataFrame, names: DataFrame, key: str = "doc_id") -> DataFrame:
    """One table from two readings, column type by column type, with the side each cell came from."""
    return merge_aligned(align_tables(a_cells, b_cells, key), names, key)


def merge_aligned(aligned: DataFrame, names: DataFrame, key: str = "doc_id") -> DataFrame:
    """:func:`merge_tables` of cells whose two readings (``a``, ``b``) stand beside each other already.

    Typed cells are written once: name and text pairs are read off them, only cells with two different readings in such a
    column meet their merged texts, and the rest stay where they are.
    """
    al = trimmed(aligned.select(key, "row_idx", "col_idx", "a", "b"))
    typed = al.join(header_types(al, key), [key, "col_idx"], "left").withColumn("col_type", F.coalesce("col_type", F.lit("text")))
    j = saved(typed)
    looked = (F.col("a") != "") & (F.col("b") != "") & (F.col("row_idx") > 0) & F.col("col_type").isin("name", "text")
    merged = align_merge_names(j.filter(looked & (F.col("col_type") == "name")), names).withColumn("col_type", F.lit("name"))
    dist = j.filter(looked & (F.col("col_type") == "text")).select("a", "b").distinct()
    dist = weighted_edit_distance(dist, "a", "b").select("a", "b", "token_distance", F.lit("text").alias("col_type"))
    facts = merged.unionByName(dist, allowMissingColumns=True)
    met = j.filter(looked).join(facts, ["a", "b", "col_type"], "left")
    rest = j.filter(~looked).withColumns({"merged": F.lit(None).cast("string"), "token_distance": F.lit(None).cast("double")})
    j = met.unionByName(rest)
    da, db = T.only_digits(F.col("a")), T.only_digits(F.col("b"))

    def ok(d):
        return (F.length(d) == 10) & F.substring(d, 1, 3).isin("059", "056")

    phone = F.when(ok(db) & ~ok(da), db).when(ok(da), da).when(F.length(db) > F.length(da), db).otherwise(F.col("a"))
    value = (F.when(F.col("row_idx") == 0, F.coalesce(F.nullif("b", F.lit("")), "a")).when(F.col("a") == "", F.col("b")).when(F.col("b") == "", F.col("a"))
             .when(F.col("col_type") == "phone", phone).when(F.col("col_type").isin("date", "number"), F.col("a"))
             .when(F.col("col_type") == "name", F.coalesce("merged", "a")).when(F.col("token_distance") < 0.70, F.col("b")).otherwise(F.col("a")))
    out = j.withColumn("value", value)
    side = F.when((F.col("row_idx") > 0) & (F.col("a") != F.col("b")), F.when(F.col("value") == F.col("a"), "azure").when(F.col("value") == F.col("b"), "gemini").otherwise("merged"))
    return out.select(key, "row_idx", "col_idx", "col_type", "value", side.alias("came_from"))


def rescue_names(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Weak names replaced by a fuller reading of the row when it is trustworthy and covers the document.

    ``rows``: job_id, row_idx, current, candidate. ``names``: name, kind. Adds ``value`` and ``rescued``.
    """
    cover = rows.groupBy("job_id").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.trim("candidate"), F.lit("")) != "").alias("m")).filter("m >= 0.7 * n").select("job_id", F.lit(True).alias("covered"))

    def arabic(c):
        return F.filter(T.tokens(F.coalesce(c, F.lit(""))), lambda t: T.arabic_chars(t) >= 2)

    s = rows.withColumn("__c", arabic(F.col("current"))).withColumn("__k", arabic(F.col("candidate")))
    last = F.get("__k", F.size("__k") - 1)
    s = s.withColumn("first_f", T.fold(F.get("__k", F.lit(0)), "match")).withColumn("last_f", T.fold(last, "match")).withColumn("last_n", T.arabic_chars(last))
    folded = names.select(T.fold("name", "match").alias("f"), "kind").distinct()
    given = folded.filter("kind <> 'family'").select(F.col("f").alias("first_f"), F.lit(True).alias("is_given")).distinct()
    family = folded.filter("kind = 'family'").select(F.col("f").alias("last_f"), F.lit(True).alias("is_family")).distinct()
    j = s.join(cover, "job_id", "left").join(given, "first_f", "left").join(family, "last_f", "left")
    ok = (F.col("covered") & (F.size("__k") > F.size("__c")) & (F.size("__k") >= 3) & F.col("is_given") & (F.coalesce("is_family", F.lit(False)) | (F.col("last_n") >= 4)))
    return j.select(*rows.columns, F.when(ok, F.trim("candidate")).otherwise(F.col("current")).alias("value"), F.coalesce(ok, F.lit(False)).alias("rescued"))


def flag_suspicious_rows(docs: DataFrame, names: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Separated lines whose name cells hold a token that cannot be a name, or repeat one.

    Tokens are judged once each; only unknown ones go through the similarity join.
    """
    lines = docs.select(key, F.posexplode(T.lines(F.col(text))).alias("line_no", "line")).filter(F.col("line").contains("|"))
    cols = F.filter(F.transform(F.slice(F.split("line", "\\|"), 1, 3), lambda c: F.trim(c)), lambda c: (c != "") & (T.arabic_chars(c) / F.length(c) >= 0.5))
    c = lines.select(key, "line_no", F.transform(cols, lambda x: T.tokens(x)).alias("cells"))
    particles = T.any_of(K.NAME_PARTICLES)
    content = F.transform("cells", lambda t: F.filter(t, lambda w: ~F.array_contains(particles, w) & (F.length(w) >= 2)))
    repeated = F.exists(content, lambda t: F.size(t) != F.size(F.array_distinct(t)))
    toks = F.filter(F.array_distinct(F.flatten("cells")), lambda w: (F.length(w) >= 2) & (T.arabic_chars(w) / F.length(w) >= 0.6))
    staged = c.select(key, "line_no", repeated.alias("repeated"), toks.alias("toks"))
    words = staged.select(F.explode("toks").alias("tok")).distinct()
    bad_word = F.col("tok").isin(*K.NON_NAME_WORDS)
    fixed = words.withColumn("state", F.when(bad_word, "bad").when(F.col("tok").isin(*K.NAME_PARTICLES), "fine").when(F.col("tok").rlike(f"[{K.PERSIAN_FROM}]"), "bad")
                             .when(~F.length("tok").between(3, 15), "fine"))
    open_ = fixed.filter("state is null").select("tok").join(names.select(F.col("name").alias("tok")).distinct(), "tok", "left_anti")
    similar = ratcliff_join(open_, names.select(F.col("name").alias("cand")), "tok", "cand", 0.72, right_first=True).select("tok").distinct()
    bad = fixed.filter("state = 'bad'").select("tok").unionByName(open_.join(similar, "tok", "left_anti"))
    hit = staged.select(key, "line_no", F.explode("toks").alias("tok")).join(bad, "tok").select(key, "line_no").distinct().withColumn("bad_token", F.lit(True))
    return staged.join(hit, [key, "line_no"], "left").select(key, "line_no", (F.coalesce("bad_token", F.lit(False)) | F.col("repeated")).alias("suspicious"))


def gate_line_corrections(pairs: DataFrame, names: DataFrame, key: str = "pair_id") -> DataFrame:
    """Whether a corrected line may replace the original, with the reason. ``pairs``: key, orig, corr."""
    # each row is read once and has a number of its own: two pairs of one key are judged apart
    named = pairs.select("*", F.monotonically_increasing_id().alias("__row"), T.strip(F.col("orig")).alias("__o"), T.strip(F.col("corr")).alias("__c"))
    o, c = F.col("__o"), F.col("__c")
    bars = lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit("")))
    first = (F.when(F.coalesce(c, F.lit("")) == "", "empty").when(o == c, "identical").when(T.fold(o, "skeleton") == T.fold(c, "skeleton"), "normalization_only")
             .when(bars(o) != bars(c), "column_count").when(T.only_digits(o) != T.only_digits(c), "digits"))
    oc, cc = F.slice(F.split(o, "\\|"), 1, 3), F.slice(F.split(c, "\\|"), 1, 3)
    fresh = F.flatten(F.transform(F.arrays_zip(oc.alias("o"), cc.alias("c")), lambda z: F.when(F.trim(z["o"]) == F.trim(z["c"]), F.array().cast("array<string>"))
                                  .otherwise(F.array_except(T.tokens(z["c"]), T.tokens(z["o"])))))
    s = named.withColumn("__first", first).withColumn("__new", F.when(F.col("__first").isNull(), F.array_distinct(fresh)))
    words = s.select(*pairs.columns, "__row", "__first", F.explode_outer("__new").alias("__w"))
    w = F.col("__w")
    asked = words.withColumn("__w", F.when((F.length(w) >= 2) & (T.arabic_chars(w) / F.length(w) >= 0.5) & ~w.isin(*K.NAME_PARTICLES), w))
    known = names.select("name").unionByName(names.filter(F.col("name").contains(" ")).select(F.explode(T.tokens(F.col("name"))).alias("name"))).distinct()
    met = asked.join(known.withColumnRenamed("name", "__known"), F.col("__w") == F.col("__known"), "left")
    row = F.struct(*[F.col(f"`{x}`") for x in pairs.columns], "__first")
    per = met.groupBy("__row").agg(F.any_value(row).alias("r"), F.bool_or(w.isNotNull() & F.col("__known").isNull()).alias("__u"))
    reason = F.coalesce("r.__first", F.when(F.col("__u"), "unverified_token"), F.lit("ok"))
    return per.select(*[F.col(f"r.`{x}`") for x in pairs.columns], (reason == "ok").alias("apply"), reason.alias("reason"))
