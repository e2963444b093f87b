"""Whole-text operators. A text is one row: line and cell work happens in its arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmend.functions import constants as K
from gridmend.functions import text as T
from gridmend.functions.distributed import ordinal, running_total
from gridmend.session import checkpoint


def line_violations(line: Column) -> Column:
    """Array of reasons for one separated line, in cell order."""
    def check(raw, i):
        c = F.trim(F.replace(F.trim(raw), F.lit("[?]"), F.lit("")))
        d = T.only_digits(c)
        phone = (F.length(d) == 10) & d.rlike("^[05]")
        date = c.contains("/") | c.rlike("[0-9]{4}-[0-9]{2}")
        reason = (F.when(F.trim(raw).isin("", "[?]"), F.lit(None))
                  .when(phone, F.when(~d.rlike(K.PHONE_OK), "phone_fmt"))
                  .when(date, F.when(~T.digits_ascii(c).rlike("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}$|^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "date_fmt"))
                  .when((i < 3) & (c != "") & ~c.rlike("^[؀-ۿ\\s‌‍،.]+$"), "non_arabic"))
        return F.when(reason.isNotNull(), F.concat(F.lit("col"), (i + 1).cast("string"), F.lit(":"), reason, F.lit("('"), c, F.lit("')")))

    return F.filter(F.transform(F.split(line, "\\|"), check), lambda r: r.isNotNull())


def annotate_line_violations(docs: DataFrame, text: str = "text") -> DataFrame:
    """Separated lines with format violations are prefixed and given their reasons; other lines pass through."""
    def mark(line):
        why = line_violations(line)
        return F.when(line.contains("|") & (F.size(why) > 0),
                      F.concat(F.lit("[!] "), line, F.lit("  # validation:"), F.array_join(why, ","))).otherwise(line)

    return docs.withColumn(text, F.array_join(F.transform(T.lines(F.col(text)), mark), "\n"))


def usable_rules(rules: DataFrame) -> DataFrame:
    """Rules that may run on raw text: a pattern, a replacement, and nothing shaped like a phone number."""
    d = F.length(T.only_digits(F.col("original_text")))
    phone = (d >= 7) & (d / F.greatest(F.length("original_text"), F.lit(1)) >= 0.6)
    return rules.filter((F.coalesce("original_text", F.lit("")) != "") & F.col("corrected_text").isNotNull() & ~phone)


#: Characters of rules that one automaton holds; a longer rule list takes another pass over the texts.
RULE_CHARS = 1 << 26
#: A replacement that would leave less than this share of a text is not made.
LEAST_LEFT = 0.7


class RuleBook:
    """Replacement rules in order of their pattern, and an automaton that finds all patterns that occur in a text in one reading."""

    def __init__(self, rules: list[tuple[str, str]]):
        import ahocorasick

        by_pattern: dict[str, list[str]] = {}
        for pattern, new in sorted(rules):
            by_pattern.setdefault(pattern, []).append(new)
        self.rules = list(by_pattern.items())
        self.longest = max(map(len, by_pattern))
        self.plain = re.compile("[" + re.escape("".join(sorted(set().union(*by_pattern)))) + "]+")
        self.finder = ahocorasick.Automaton()
        for i, pattern in enumerate(by_pattern):
            self.finder.add_word(pattern, i)
        self.finder.make_automaton()

    def _occurring(self, text: str) -> set[int]:
        return {i for _, i in self.finder.iter(text)}

    def apply(self, text: str, length: int) -> str:
        """All rules one after another, on a text that was ``length`` long at first. Patterns that do not occur are never looked
        at; those that a replacement brings about lie around the places where it was made. The rules of one pattern follow
        each other, so once the pattern is gone the rest of them are passed over together."""
        ahead = sorted(self._occurring(text), reverse=True)
        known = set(ahead)
        while ahead:
            i = ahead.pop()
            pattern, replacements = self.rules[i]
            parts, more = text.split(pattern), set()
            for new in replacements:
                if len(parts) == 1:
                    break
                if len(text) + (len(parts) - 1) * (len(new) - len(pattern)) < LEAST_LEFT * length:
                    continue
                text = new.join(parts)
                made: set[int] = set()
                for low, high in self._around(parts, new):
                    made |= self._occurring(text[low:high])
                more |= made
                if i not in made:
                    break
                parts = text.split(pattern)
            more = {j for j in more - known if j > i}
            if more:
                known |= more
                ahead = sorted([*ahead, *more], reverse=True)
        return text

    def _around(self, parts: list[str], new: str) -> Iterator[tuple[int, int]]:
        """Spans of the new text in which a pattern can touch a replacement; overlapping ones are one. No pattern reaches over
        a character that is in no pattern, so only the runs of other characters in the replacement are looked at."""
        runs = [(m.start(), m.end()) for m in self.plain.finditer(new)] if new else [(0, 0)]
        reach, width, at = self.longest - 1, len(new), 0
        # What touches a run after such a character starts inside it: a pattern there, or one that goes on with its end.
        runs = [(a - reach if a == 0 else a, b + reach if b == width else b) for a, b in runs
                if a == 0 or any(True for _ in self.finder.iter(new[a:b])) or b == width and any(self.finder.match(new[k:]) for k in range(a, b))]
        low = high = 0
        for part in parts[:-1] if runs else ():
            at += len(part)
            for a, b in runs:
                if at + a > high and high:
                    yield low, high
                    low = at + a
                elif not high:
                    low = max(at + a, 0)
                high = max(high, at + b)
            at += width
        if runs:
            yield low, high


def apply_text_rules(docs: DataFrame, rules: DataFrame, text: str = "text", chunk: int = 1_000_000) -> DataFrame:
    """Letter normalisation, then the rules one after another in order of their pattern.

    A rule is skipped when the pattern is absent or the result would be under 70 % of the original length. A text is read
    once by an automaton over all patterns, and only the rules that occur in it, or come to by a replacement, are applied:
    neither the plan nor the work on a text grows with the rules. The rules go to the tasks as one list of at most RULE_CHARS
    characters and ``chunk`` rules; what is beyond follows in another pass, in order. The texts are dealt out by their place
    in the input first: a file of one row group would be read, and worked on, by one task.
    """
    good = usable_rules(rules).select("original_text", "corrected_text").distinct()
    digits_from, digits_to = K.DIGITS_FROM[10:], K.DIGITS_TO[:10]
    out = docs.withColumn(text, F.translate(F.col(text), K.PERSIAN_FROM + digits_from, K.PERSIAN_TO + digits_to))
    order, block = ["original_text", "corrected_text"], [F.substring("original_text", 1, 3)]
    counted = ordinal(good, [], order, block, "ord")
    counted = running_total(counted, [], block, order, F.length("original_text") + F.length("corrected_text").cast("long"), "chars")
    part = F.struct(F.floor(F.col("ord") / chunk).alias("n"), F.floor(F.col("chars") / RULE_CHARS).alias("c"))
    numbered = checkpoint(counted.select(*order, part.alias("part")))
    parts = sorted(tuple(r.part) for r in numbered.select("part").distinct().collect())
    if not parts:
        return out
    out = out.withColumn("__at", F.monotonically_increasing_id()).repartition("__at").drop("__at").withColumn("__len", F.length(text))
    for n, c in parts:
        book = sorted((r[0], r[1]) for r in numbered.filter((F.col("part.n") == n) & (F.col("part.c") == c)).select(*order).collect())
        out = out.withColumn(text, _by_rules(docs.sparkSession.sparkContext.broadcast(book))(F.col(text), F.col("__len")))
    return out.drop("__len")


def _by_rules(book):
    @F.pandas_udf("string")
    def applied(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        rules = RuleBook(book.value)
        for texts, lengths in columns:
            yield pd.Series([None if t is None else rules.apply(t, int(n)) for t, n in zip(texts, lengths)])

    return applied


def _clean_line(line: Column) -> Column:
    bare = F.regexp_replace(T.digits_ascii(line), "[0-9]", "")
    bare = F.regexp_replace(bare, K.LINE_GENDER, "")
    return T.squeeze(F.regexp_replace(bare, "[/\\-.()\\[\\]:،,]", " "))


def clean_name_list(docs: DataFrame, n_rows: str = "n_rows", text: str = "text", key: str = "doc_id") -> DataFrame:
    """The last ``n_rows`` lines that read like names, front-padded with empty slots. One row per slot."""
    lines_ = F.filter(F.transform(T.lines(F.col(text)), lambda x: T.strip(x)), lambda x: (x != "") & ~x.rlike(K.LINE_SKIP) & ~x.rlike(K.LINE_APPROVAL))
    good = F.filter(F.transform(lines_, _clean_line), lambda c: (c != "") & (T.arabic_share(c) >= 0.72) & F.size(T.tokens(c)).between(2, 7))
    staged = docs.select(key, F.col(n_rows).cast("int").alias("n"), good.alias("g")).filter("n > 0")
    tail = F.when(F.size("g") >= F.col("n"), F.slice("g", F.size("g") - F.col("n") + 1, F.col("n"))).otherwise(F.col("g"))
    padded = F.concat(F.array_repeat(F.lit(""), F.col("n") - F.size("tail")), F.col("tail"))
    return staged.withColumn("tail", tail).select(key, F.posexplode(padded).alias("row_idx", "text"))


def name_line_candidates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The looser reader: mostly Arabic lines of one to eight words after removing digits and separators."""
    lines_ = F.filter(F.transform(T.lines(F.col(text)), lambda x: T.strip(x)), lambda x: (F.length(x) >= 2) & (T.arabic_share(x) >= 0.60))
    clean = F.transform(lines_, lambda x: T.squeeze(F.regexp_replace(T.digits_ascii(x), "[0-9|/\\\\\\-_()\\[\\]{}<>]", "")))
    good = F.filter(clean, lambda c: (c != "") & F.size(T.tokens(c)).between(1, 8))
    return docs.select(key, F.posexplode(good).alias("row_idx", "text"))


def parse_numbered_names(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``N. name`` lines to 0-based slots; blank words are null, a later line wins, gaps are null."""
    pat = "^([0-9]+)[.،\\-)]\\s*(.+)$"
    hits = F.filter(F.transform(T.lines(F.col(text)), lambda x: T.strip(x)), lambda x: T.digits_ascii(x).rlike(pat))
    rows = docs.select(key, F.posexplode(hits).alias("pos", "line")).select(
        key, "pos", (F.regexp_extract(T.digits_ascii(F.col("line")), pat, 1).try_cast("int") - 1).alias("slot"),
        T.strip(F.regexp_replace(F.col("line"), "(?U)^\\d+[.،\\-)]\\s*", "")).alias("name")).filter("slot >= 0")
    # struct keeps a null name as a winning value
    named = F.struct(F.when(~F.col("name").isin(*K.BLANK_NAME_WORDS), F.col("name")).alias("name"))
    best = rows.groupBy(key, "slot").agg(F.max_by(named, "pos").alias("b"))
    top = best.groupBy(key).agg(F.max("slot").alias("top"))
    spine = top.select(key, F.explode(F.sequence(F.lit(0), F.col("top"))).alias("slot"))
    return spine.join(best, [key, "slot"], "left").select(key, "slot", F.col("b.name").alias("name"))


def parse_key_values(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fallback reader: ``key: value`` lines through the synonym list, plus sweeps for phones, dates, gender and ages.

    The synonym list is fixed and small, so it is an array literal; distinct (field, value) pairs per text.
    """
    t = F.col(text)
    known = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in K.KEY_SYNONYMS])

    def canonical(raw):
        low = F.lower(raw)
        exact = F.filter(known, lambda s: s["k"] == low)
        part = F.filter(known, lambda s: F.contains(low, s["k"]))
        return F.when(F.size(exact) > 0, exact[0]["v"]).when(F.size(part) > 0, part[0]["v"]).otherwise(raw)

    pairs = F.filter(F.transform(F.filter(T.lines(t), lambda x: x.contains(":")), lambda x: F.struct(
        F.trim(F.substring_index(x, ":", 1)).alias("raw"), F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("value"))),
        lambda p: (p["value"] != "") & p["raw"].rlike(K.ARABIC))
    keyed = docs.select(key, F.explode(pairs).alias("p")).select(key, canonical(F.col("p.raw")).alias("field_name"), F.col("p.value").alias("value"))

    def sweep(field, found):
        return docs.select(key, F.lit(field).alias("field_name"), F.explode(found).alias("value"))

    genders = F.filter(F.array(F.when(t.contains("ذكر"), F.lit("ذكر")), F.when(t.contains("أنثى") | t.contains("انثى"), F.lit("أنثى"))), lambda x: x.isNotNull())
    parts = [keyed, sweep("رقم الهاتف", F.regexp_extract_all(t, F.lit("\\b0[5-9][0-9]{8}\\b"), F.lit(0))),
             sweep("تاريخ الميلاد", F.regexp_extract_all(t, F.lit("[٠-٩]{4}[/\\-][٠-٩]{1,2}[/\\-][٠-٩]{1,2}"), F.lit(0))),
             sweep("تاريخ الميلاد", F.regexp_extract_all(t, F.lit("\\b20[0-9]{2}[/\\-][0-9]{1,2}[/\\-][0-9]{1,2}\\b"), F.lit(0))),
             sweep("الجنس", genders), _ages(docs, text, key),
             docs.select(key, F.lit("النص الكامل").alias("field_name"), T.strip(t).alias("value"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("value", F.trim("value")).filter("value <> ''").distinct()


def _ages(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Two-digit numbers with an age word starting within the 50 characters before them, or inside them.

    The text is cut at every candidate number; the context of a number is the tail of everything before it, kept as
    a running 50-character window so no prefix of the text is ever copied whole.
    """
    t = F.col(text)
    pat = "\\b(1[0-9]|[2-9][0-9])\\b"
    nums = F.regexp_extract_all(t, F.lit(pat), F.lit(1))
    gaps = F.split(t, pat, -1)
    staged = docs.select(key, nums.alias("nums"), gaps.alias("gaps")).filter(F.size("nums") > 0)
    walk = F.aggregate(F.arrays_zip("nums", F.slice("gaps", 1, F.size("nums")).alias("gap")),
                       F.struct(F.lit("").alias("tail"), F.array().cast("array<struct<n:string,ctx:string>>").alias("out")),
                       lambda a, x: F.struct(
                           F.right(F.concat(a["tail"], x["gap"], x["nums"]), F.lit(52)).alias("tail"),
                           F.concat(a["out"], F.array(F.struct(x["nums"].alias("n"), F.right(F.concat(a["tail"], x["gap"]), F.lit(50)).alias("ctx")))).alias("out")))
    near = F.lit(False)
    for w in K.AGE_WORDS:
        near = near | F.col("ctx").contains(w)
    return (staged.select(key, F.inline(walk["out"])).filter(near).select(key, F.lit("العمر").alias("field_name"), F.col("n").alias("value")))
