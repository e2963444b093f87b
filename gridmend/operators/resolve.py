"""Fuzzy lookups in lexicons, and building lexicons by clustering spellings. Distinct values only, blocked losslessly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmend.functions import constants as K
from gridmend.functions import text as T
from gridmend.functions.distributed import first_n, ordinal
from gridmend.functions.similarity import levenshtein_join, ratcliff_join, ratcliff_ratio
from gridmend.operators.standardize import split_plausible_places
from gridmend.session import checkpoint, saved


def known_token_antijoin(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    return tokens.join(vocab.select("token").distinct(), "token", "left_anti")


def near_match_join(tokens: DataFrame, vocab: DataFrame, max_norm: float = 0.20) -> DataFrame:
    """Nearest vocabulary entry of each token within ``max_norm`` of the longer length; ties by spelling."""
    near = levenshtein_join(tokens.select("token"), vocab.select(F.col("token").alias("entry")), "token", "entry", max_norm)
    return near.groupBy("token").agg(F.min(F.struct("norm_distance", "entry")).alias("m")).select("token", F.col("m.entry").alias("nearest"), F.col("m.norm_distance").alias("norm_distance"))


def _confidence(d: Column) -> Column:
    return F.bround(1 - d, 2)


def _candidate_pairs(tokens: DataFrame, names: DataFrame, short: int, mid: int, long: int, loosest: float) -> DataFrame:
    """Pairs within the edits a token of its length is allowed, measured against the token's own length."""
    pairs = levenshtein_join(tokens.select("token"), names.select("name"), "token", "name", loosest)
    n = F.length("token")
    edits = F.when(n <= 5, short).when(n >= 8, long).otherwise(mid)
    return pairs.filter(F.col("norm_distance") <= edits / n).withColumn("confidence", _confidence(F.col("norm_distance")))


def top_candidates(tokens: DataFrame, names: DataFrame, n: int = 3) -> DataFrame:
    """Up to n names per token, best first: close spellings, then look-alike spellings put in front at 0.90."""
    t, v = tokens.select("token").distinct(), names.select("name").distinct()
    close = _candidate_pairs(t, v, 1, 2, 3, 0.2858).filter((F.col("name") != F.col("token")) & (F.col("confidence") >= 0.72))
    primary = first_n(close, ["token"], ["norm_distance", "name"], n).select("token", "name", "confidence", F.col("rank").alias("ord"))
    count = primary.groupBy("token").agg(F.count("*").alias("have"))
    alike = (t.withColumn("k", T.fold("token", "confusion")).join(v.withColumn("k", T.fold("name", "confusion")), "k").filter("name <> token")
             .join(primary.select("token", "name"), ["token", "name"], "left_anti").join(count, "token", "left").withColumn("room", n - F.coalesce("have", F.lit(0))).filter("room > 0"))
    extra = first_n(alike.select("token", "name", "room"), ["token"], ["name"], n).filter("rank <= room").select("token", "name", F.lit(0.90).alias("confidence"), (-F.col("rank")).alias("ord"))
    return first_n(primary.unionByName(extra), ["token"], ["ord"], n).drop("ord")


def suggest_token(tokens: DataFrame, names: DataFrame, past: DataFrame, min_confidence: float) -> DataFrame:
    """Best correction per token: a past correction, nothing on an exact hit, else the nearest name."""
    t = tokens.select("token").distinct().join(past.select("token", "past"), "token", "left")
    by_past = t.filter("past is not null and past <> token").select("token", F.col("past").alias("suggested"), F.lit(0.99).alias("confidence"), F.lit("correction").alias("source"))
    rest = t.filter("past is null or past = token").select("token").join(names.select(F.col("name").alias("token")).distinct(), "token", "left_anti")
    # a confidence is rounded to two places, so distances up to half a hundredth more can still reach the least one
    pairs = _candidate_pairs(rest, names.select("name").distinct(), 1, 2, 2, min(1.0, 1 - min_confidence + 0.006))
    rank = F.struct("norm_distance", (~F.col("name").isin(*K.PRIORITY_NAMES)).alias("p"), "name")
    best = pairs.groupBy("token").agg(F.min_by(F.struct("name", "confidence"), rank).alias("b")).filter(F.col("b.confidence") >= min_confidence)
    return by_past.unionByName(best.select("token", F.col("b.name").alias("suggested"), F.col("b.confidence").alias("confidence"), F.lit("static").alias("source")))


def past_corrections(corrections: DataFrame) -> DataFrame:
    """Token by token memory of name corrections, the latest wins."""
    c = corrections.filter(F.col("field_name").rlike(K.KEY_NAME))
    zipped = F.arrays_zip(T.tokens(T.fold("original_value", "match")).alias("o"), T.tokens(T.fold("corrected_value", "match")).alias("c"))
    toks = c.select("created_at", "id", F.posexplode(F.filter(zipped, lambda z: z["o"].isNotNull() & z["c"].isNotNull())).alias("pos", "z"))
    return toks.groupBy(F.col("z.o").alias("token")).agg(F.max_by("z.c", F.struct("created_at", "id", "pos")).alias("past"))


def suggest_names(values: DataFrame, names: DataFrame, past: DataFrame, col: str = "value") -> DataFrame:
    """Suggestion per distinct name text; the place of a word decides its dictionary.

    ``names``: name, kind (female, male, family). Adds suggested, confidence, source, needs_review, pending, auto.
    """
    folded = names.select(T.fold("name", "match").alias("name"), "kind").distinct()
    d = values.select(F.col(col).alias("value")).filter("value <> ''").distinct()
    toks = d.select("value", F.size(T.tokens(F.col("value"))).alias("n"), F.posexplode(T.tokens(F.col("value"))).alias("pos", "orig")).withColumn("token", T.fold("orig", "match"))
    family_slot = (F.col("pos") >= 2) | ((F.col("pos") == F.col("n") - 1) & (F.col("pos") >= 1))
    toks = toks.withColumn("slot", F.when(family_slot, "family").when(F.col("pos") == 0, "first").otherwise("second"))
    usable = toks.filter((F.length("token") >= 3) & F.col("token").rlike("^[؀-ۿ]+$"))
    asked = usable.select("slot", "token").distinct()
    personal = folded.filter("kind <> 'family'").select(F.col("name").alias("token")).distinct()
    anyone = folded.select(F.col("name").alias("token")).distinct()
    fam = asked.filter("slot = 'family'").filter(~F.col("token").isin(*K.NAME_CONNECTORS)).select("token").join(anyone, "token", "left_anti")
    fam_past = fam.join(past, "token").filter("past <> token").select(F.lit("family").alias("slot"), "token", F.col("past").alias("suggested"), F.lit(0.99).alias("confidence"), F.lit("correction").alias("source"), F.lit(False).alias("review"), F.lit(False).alias("pend"))
    fam_rest = fam.join(fam_past.select("token"), "token", "left_anti")
    top = top_candidates(fam_rest, folded.filter("kind = 'family'").select("name")).filter("rank = 1")
    fam_fuzzy = fam_rest.join(top, "token", "left").select(
        F.lit("family").alias("slot"), "token", F.coalesce("name", F.lit(None).cast("string")).alias("suggested"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.lit("family_dict").alias("source"),
        (F.coalesce("confidence", F.lit(0.0)) < 0.75).alias("review"), (F.coalesce("confidence", F.lit(0.0)) >= 0.75).alias("pend"))

    def early(slot, kind, least):
        want = asked.filter(F.col("slot") == slot).select("token").join(personal, "token", "left_anti")
        got = suggest_token(want, folded.filter(F.col("kind") == kind).select("name"), past, least)
        return got.select(F.lit(slot).alias("slot"), "token", "suggested", "confidence", "source", F.lit(False).alias("review"), F.lit(False).alias("pend"))

    found = fam_past.unionByName(fam_fuzzy).unionByName(early("first", "female", 0.65)).unionByName(early("second", "male", 0.80))
    j = toks.join(found, ["slot", "token"], "left")
    # a word with no candidate stays as it is but still asks for review; words too short to judge never do
    judged = F.col("source").isNotNull() & (F.length("token") >= 3)
    item = F.struct("pos", F.coalesce("suggested", "orig").alias("w"))
    per = j.groupBy("value").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["w"]), " ").alias("suggested"), F.min(F.when(judged, F.col("confidence"))).alias("confidence"),
        F.bool_or(F.coalesce(F.col("source") == "correction", F.lit(False))).alias("c"), F.bool_or(F.coalesce(F.col("source") == "family_dict", F.lit(False))).alias("f"),
        F.bool_or(F.coalesce("review", F.lit(False))).alias("needs_review"), F.bool_or(F.coalesce("pend", F.lit(False))).alias("pending")).filter("confidence is not null")
    source = F.when(F.col("c"), "correction").when(F.col("f"), "family_dict").otherwise("static")
    auto = F.col("c") | (~F.col("needs_review") & (F.col("confidence") >= 0.82))
    return per.select("value", "suggested", "confidence", source.alias("source"), "needs_review", "pending", (auto & (F.col("suggested") != F.col("value"))).alias("auto"))


# --- places -------------------------------------------------------------------------------------------------------------

def _tail_agrees(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """(needed, tail of a, tail of b): whether the last words have to agree, and the words themselves."""
    ta, tb = F.split(a, " "), F.split(b, " ")
    return (F.size(ta) >= 2) & (F.size(tb) >= 2), F.element_at(ta, -1), F.element_at(tb, -1)


def correct_places(values: DataFrame, places: DataFrame, variants: DataFrame, col: str = "value") -> DataFrame:
    """Corrected spelling per distinct place text with the rule used; ``method`` is null where nothing was in doubt
    or nothing is certain. ``places``: canonical, ord. ``variants``: variant_folded, canonical, ord."""
    d = values.select(T.strip(F.col(col)).alias("value")).filter("value <> ''").distinct().withColumn("f", T.fold("value", "place"))
    # one spelling per fold: the first place in list order, the last variant recorded for a fold
    canon = places.withColumn("f", T.fold("canonical", "place")).groupBy("f").agg(F.min_by("canonical", "ord").alias("by_canon"))
    var = variants.groupBy(F.col("variant_folded").alias("f")).agg(F.max_by("canonical", "ord").alias("by_variant"))
    # the distinct texts feed four branches; they are read from the cells once
    looked = checkpoint(d.join(canon, "f", "left").join(var, "f", "left"))
    exact = looked.filter("by_canon is not null or by_variant is not null").select(
        "value", F.coalesce("by_canon", "by_variant").alias("after"), F.when(F.col("by_canon").isNotNull(), "canonical").otherwise("variant").alias("method"))
    rest = looked.filter("by_canon is null and by_variant is null").select("value", "f")
    # word by word: canonical folds first, in list order and with the last spelling of a fold, then variants
    lex = (places.select(T.fold("canonical", "place").alias("w"), "canonical", F.lit(0).alias("src"), "ord")
           .unionByName(variants.select(F.col("variant_folded").alias("w"), "canonical", F.lit(1).alias("src"), "ord")))
    lex = lex.groupBy("w").agg(F.min(F.struct("src", "ord")).alias("at"), F.max_by("canonical", F.struct(-F.col("src"), F.col("ord"))).alias("spelling"))
    many = rest.filter(F.size(T.tokens(F.col("value"))) > 1)
    words = many.select("value", F.posexplode(T.tokens(F.col("value"))).alias("pos", "word")).withColumn("w", T.fold("word", "place"))
    distinct_words = words.select("w").distinct()
    hit = distinct_words.join(lex.select("w", F.col("spelling").alias("known")), "w")
    open_ = distinct_words.filter(F.length("w") >= 3).join(hit.select("w"), "w", "left_anti")
    near = ratcliff_join(open_, lex.select(F.col("w").alias("cand")), "w", "cand", 0.82).filter(F.abs(F.length("w") - F.length("cand")) <= 2)
    near = near.join(lex.select(F.col("w").alias("cand"), "at", "spelling"), "cand").groupBy("w").agg(F.min_by("spelling", F.struct(-F.col("ratio"), "at")).alias("close"))
    sug = words.join(hit, "w", "left").join(near, "w", "left").withColumn("new", F.coalesce("known", "close", "word"))
    moved = (F.col("known").isNotNull() & (F.col("known") != F.col("word"))) | F.col("close").isNotNull()
    by_word = sug.groupBy("value").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "new"))), lambda x: x["new"]), " ").alias("after"), F.bool_or(moved).alias("m")).filter("m")
    by_word = by_word.select("value", "after", F.lit("words").alias("method"))
    left = rest.join(by_word.select("value"), "value", "left_anti")
    folds = places.select(T.fold("canonical", "place").alias("cand"), "canonical").distinct()
    # every place close enough to spoil the margin of an acceptable winner
    scored = ratcliff_join(left, folds, "f", "cand", 0.80).join(folds, "cand")
    ranked = first_n(scored.select("f", "cand", "canonical", "ratio").distinct(), ["f"], [F.desc("ratio"), F.desc("canonical")], 2)
    pair = ranked.groupBy("f").agg(F.max(F.when(F.col("rank") == 1, F.struct("ratio", "canonical", "cand"))).alias("b"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("ratio"))), F.lit(0.0)).alias("second"))
    pair = pair.filter((F.col("b.ratio") >= 0.86) & (F.col("b.ratio") - F.col("second") >= 0.06))
    need, ta, tb = _tail_agrees(F.col("f"), F.col("b.cand"))
    pair = pair.withColumn("need", need).withColumn("tail", ratcliff_ratio(ta, tb)).filter("not need or tail >= 0.70")
    whole = left.join(pair, "f").select("value", F.col("b.canonical").alias("after"), F.lit("whole").alias("method"))
    return exact.unionByName(by_word).unionByName(whole).filter("after <> value")


def correct_place_cells(cells: DataFrame, places: DataFrame, variants: DataFrame) -> DataFrame:
    is_place = ~F.col("field").startswith("_") & F.col("field").rlike(K.PLACE_HEADER)
    fixes = correct_places(cells.filter(is_place), places, variants).select(F.col("value").alias("__v"), "after", "method")
    j = cells.join(fixes, is_place & (T.strip(F.col("value")) == F.col("__v")), "left")
    return j.select(*[c for c in cells.columns if c != "value"], F.col("value").alias("before"), F.coalesce("after", "value").alias("value"), "method")


def anchor_to_seed(values: DataFrame, seed: DataFrame, threshold: float = 0.72) -> DataFrame:
    """Each value with the seed place it reads most like; the first seed wins ties. ``seed``: place, ord."""
    d = values.select("value").distinct().withColumn("f", T.fold("value", "place"))
    s = seed.withColumn("cand", T.fold("place", "place"))
    close = ratcliff_join(d, s, "f", "cand", threshold).join(s.select("cand", "place", "ord"), "cand")
    best = close.groupBy("f").agg(F.min_by(F.struct("place", "ratio"), F.struct(-F.col("ratio"), "ord")).alias("b"))
    return d.join(best, "f").select("value", F.col("b.place").alias("canonical"), F.col("b.ratio").alias("ratio"))


def leader_cluster(values: DataFrame, threshold: float = 0.82, every: int = 4) -> DataFrame:
    """Greedy clusters in order of (count, spelling): a value joins the first earlier leader it resembles, else leads.

    Equals the lexicographically first independent set of the similarity graph. The edges are found once; then in
    rounds every undecided value with no undecided or leading earlier neighbour becomes a leader and its later
    neighbours follow. Rounds touch edges only, and lineage is cut by reliable checkpoints.
    """
    base = ordinal(values.select("value", "n"), [], [F.desc("n"), "value"], [-F.col("n"), F.substring("value", 1, 3)], "ord").withColumn("f", T.fold("value", "place"))
    base = checkpoint(base)
    folds = base.select("f").distinct()
    close = ratcliff_join(folds, folds.select(F.col("f").alias("g")), "f", "g", threshold)
    later, earlier = base.select(F.col("ord").alias("late"), "f"), base.select(F.col("ord").alias("early"), F.col("f").alias("g"))
    edges = checkpoint(close.join(later, "f").join(earlier, "g").filter("early < late").select("early", "late"))
    leaders = base.select(F.col("ord").alias("v")).join(edges.select(F.col("late").alias("v")).distinct(), "v", "left_anti")
    live, rounds = edges, 0
    while True:
        followers = live.join(leaders.select(F.col("v").alias("early")), "early").select("late").distinct()
        # edges out of settled followers can no longer stop anyone; edges into them are done
        live = (live.join(followers, "late", "left_anti").join(followers.select(F.col("late").alias("early")), "early", "left_anti")
                .join(leaders.select(F.col("v").alias("early")), "early", "left_anti"))
        waiting = live.select(F.col("late").alias("v")).distinct()
        settled = followers.select(F.col("late").alias("v")) if rounds == 0 else settled.unionByName(followers.select(F.col("late").alias("v"))).distinct()
        leaders = base.select(F.col("ord").alias("v")).join(settled, "v", "left_anti").join(waiting, "v", "left_anti")
        rounds += 1
        if rounds % every == 0:
            live, leaders, settled = checkpoint(live), checkpoint(leaders), checkpoint(settled)
        if live.isEmpty():
            break
    leads = leaders.select(F.col("v").alias("early"))
    joined = edges.join(leads, "early").groupBy("late").agg(F.min("early").alias("lead"))
    own = base.join(joined.join(leads, joined.late == leads.early, "left_anti"), base.ord == F.col("late"), "left")
    out = own.withColumn("lead", F.coalesce("lead", "ord")).select("value", "n", "lead")
    names = base.select(F.col("ord").alias("lead"), F.col("value").alias("canonical"))
    return out.join(names, "lead").select("canonical", "value", "n")


def derive_place_draft(cells: DataFrame, seed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(draft: canonical, value, n, seeded; counters). Known places are anchored first, only the rest is clustered."""
    # cells are read once, and values meet the known places once
    vals = saved(split_plausible_places(cells))
    good = vals.filter("plausible")
    anchored = saved(anchor_to_seed(good, seed).join(good.select("value", "n"), "value").select("canonical", "value", "n", F.lit(True).alias("seeded")))
    rest = good.join(anchored.select("value"), "value", "left_anti").select("value", "n")
    clusters = leader_cluster(rest).withColumn("seeded", F.lit(False))
    counters = vals.agg(F.sum(F.when(F.col("plausible"), F.col("n")).otherwise(0)).alias("cells_seen"), F.sum(F.when(~F.col("plausible"), F.col("n")).otherwise(0)).alias("junk_rejected"))
    return anchored.unionByName(clusters), counters


def approve_places(draft: DataFrame) -> DataFrame:
    """The draft with a verdict per variant: kept, dropped_entry (no known place) or dropped_variant (too unlike)."""
    f, g = T.fold("value", "place"), T.fold("canonical", "place")
    d = saved(draft.withColumn("f", f).withColumn("g", g))
    need, ta, tb = _tail_agrees(F.col("f"), F.col("g"))
    pairs = d.filter("seeded and f <> g").select("f", "g").distinct()
    judged = pairs.select("f", "g", ratcliff_ratio(F.col("f"), F.col("g")).alias("r"), need.alias("need"), ratcliff_ratio(ta, tb).alias("tail"))
    j = d.join(judged, ["f", "g"], "left")
    verdict = (F.when(~F.col("seeded"), "dropped_entry").when(F.col("f") == F.col("g"), "kept")
               .when((F.col("r") >= 0.80) & (~F.col("need") | (F.col("tail") >= 0.70)), "kept").otherwise("dropped_variant"))
    return j.select("canonical", "value", "n", verdict.alias("verdict"))
