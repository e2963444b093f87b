"""Cells in, cells out: header roles, value standardisation and row/column filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmend.functions import constants as K
from gridmend.functions import text as T
from gridmend.functions.distributed import block_of, ordinal

# role -> header pattern, tested on the folded header where the flag is set
HEADER_ROLES: dict[str, tuple[str, bool]] = {
    "phone": (K.KEY_PHONE, False), "id": (K.AUDIT_ID, False), "date": (K.KEY_DATE, False), "name": (K.NAME_HEADER, True),
    "entity": (K.ENTITY_HEADER, True), "signature": (K.SIGNATURE_HEADER, True), "guardian": (K.GUARDIAN_HEADER, False),
    "gender": (K.CHOICE_GENDER, False), "approval": (K.CHOICE_APPROVAL, False), "disability": (K.CHOICE_DISABILITY, False),
    "place": (K.PLACE_HEADER, False), "price": (K.AUDIT_PRICE, False), "qty": (K.AUDIT_QTY, False),
    "total": (K.AUDIT_TOTAL, False), "number": (K.MERGE_NUMBER, False),
}


def has(c: Column, pattern: str) -> Column:
    return c.rlike(pattern)


def classify_columns(cells: DataFrame) -> DataFrame:
    """Roles of every (job, field).

    One aggregate over the cells gives the share of date-shaped values per column; the patterns then run once per
    distinct header, not once per cell. A date header counts only when at least half of its filled cells look like
    dates; an id column is never a phone column; an approval column is never a date header.
    """
    filled = F.nullif(F.trim("value"), F.lit(""))
    # only a date header asks for the shape of its values
    shaped = F.col("field").rlike(K.KEY_DATE) & T.digits_ascii(filled).rlike(K.LOOKS_DATE)
    cols = cells.groupBy("job_id", "field").agg(F.min("col_idx").alias("col_idx"), F.count(filled).alias("filled"),
                                                F.count_if(shaped).alias("date_like"))
    headers = cells.select("field").distinct()
    flags = headers.select("field", F.col("field").rlike(K.GRID_DATE).alias("__dateish"), *[
        (T.fold("field", "header") if folded else F.col("field")).rlike(p).alias(role) for role, (p, folded) in HEADER_ROLES.items()])
    j = cols.join(flags, "field")
    is_date = F.col("date") & (F.col("filled") > 0) & (F.col("date_like") * 2 >= F.col("filled"))
    value = {r: F.col(r) for r in HEADER_ROLES}
    value["date"] = is_date
    value["id"] = F.col("id") & ~F.col("phone")
    value["approval"] = F.col("approval") & ~F.col("__dateish")
    roles = F.filter(F.array(*[F.when(value[r], F.lit(r)) for r in HEADER_ROLES]), lambda x: x.isNotNull())
    main = (F.when(F.col("field").rlike(K.MERGE_PHONE), "phone").when(F.col("field").rlike(K.MERGE_DATE), "date")
            .when(F.col("field").rlike(K.MERGE_NUMBER), "number").when(F.col("field").rlike(K.MERGE_NAME), "name").otherwise("text"))
    return j.select("job_id", "field", "col_idx", "filled", roles.alias("roles"), main.alias("main_role"))


def normalize_headers(cells: DataFrame) -> DataFrame:
    """Whitespace collapsed and alef unified in headers; cells with an empty header are dropped."""
    return cells.withColumn("field", T.alef(T.squeeze(F.col("field")))).filter("field <> ''")


def fold_text(df: DataFrame, col: str, profile: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, T.fold(col, profile))


def fold_digits(value: Column, numeric: Column) -> Column:
    """Eastern digits to ASCII; in phone and id columns inner whitespace goes too when only digits and stars remain."""
    ascii_ = T.digits_ascii(value)
    bare = F.regexp_replace(ascii_, "(?U)\\s+", "")
    return F.when(numeric & bare.rlike("^\\+?[0-9*]+$"), bare).otherwise(ascii_)


def is_phone_column(field: Column) -> Column:
    return field.rlike(K.GRID_PHONE) & ~field.rlike(K.GRID_ID)


# --- fixed values: mobile prefixes without their leading zero ---------------------------------------------
MOBILE = ("59", "56", "57", "58", "54")


def grid_phone(v: Column) -> Column:
    """Digits with a leading plus; country codes kept; a lost leading zero or a stray leading 2 repaired."""
    d = F.regexp_replace(T.digits_ascii(v), "[^0-9]", "")
    plus = F.when(F.regexp_replace(v, "(?U)^\\s+", "").startswith("+"), F.lit("+")).otherwise(F.lit(""))
    fixed = (F.when(F.substring(d, 1, 3).isin("970", "972"), d)
             .when((F.length(d) == 9) & F.substring(d, 1, 2).isin(*MOBILE), F.concat(F.lit("0"), d))
             .when((F.length(d) == 10) & d.startswith("2") & F.substring(d, 2, 2).isin(*MOBILE),
                   F.concat(F.lit("0"), F.substring(d, 2, 20)))
             .otherwise(d))
    return F.when(d != "", F.concat(plus, fixed))


def text_phone(v: Column) -> Column:
    d = F.regexp_replace(T.digits_ascii(v), "[^0-9]", "")
    d = F.when((F.length(d) == 9) & F.substring(d, 1, 2).isin("59", "56"), F.concat(F.lit("0"), d)).otherwise(d)
    return F.when(d == "", v).when((F.length(d) == 10) & F.substring(d, 1, 3).isin("059", "056"), d).when(
        F.length(d) >= 7, d).otherwise(v)


def standardize_phones(cells: DataFrame, mode: str = "grid") -> DataFrame:
    fix = grid_phone if mode == "grid" else text_phone
    applies = is_phone_column(F.col("field")) if mode == "grid" else F.col("field").rlike(K.KEY_PHONE)
    return cells.withColumn("value", F.when(applies, fix(F.col("value"))).otherwise(F.col("value")))


def clean_id(v: Column) -> Column:
    return F.nullif(F.regexp_replace(v, "[^0-9*]", ""), F.lit(""))


def standardize_ids(cells: DataFrame) -> DataFrame:
    """Digits and mask stars only; stars are data."""
    return cells.withColumn("value", F.when(F.col("field").rlike(K.GRID_ID), clean_id(F.col("value"))).otherwise(F.col("value")))


def _ymd(y: Column, m: Column, d: Column) -> Column:
    return F.concat_ws("/", y.cast("string"), m.cast("string"), d.cast("string"))


def _month(c):
    return c.between(1, 12)


def _day(c):
    return c.between(1, 31)


def with_grid_date(df: DataFrame, col: str, out: str, applies: Column) -> DataFrame:
    """Year/month/day without padding; out-of-range parts are tried swapped; what cannot be read stays as read.

    The four written shapes share their separators, so the text is split once and each shape is one pattern test.
    """
    v = F.col("__v")
    s1 = df.withColumn("__v", F.when(applies, T.strip(F.col(col))))
    s2 = s1.withColumn("__p", F.transform(F.split(v, "[-./]"), lambda x: x.try_cast("int"))).withColumn("__k", (
        F.when(v.rlike("^[0-9][./][0-9]{1,2}[/.][0-9]{1,2}[/.][0-9]{1,2}$"), "split_year")
        .when(v.rlike("^[0-9]{1,2}-[0-9]{5}$"), "joined")
        .when(v.rlike("^[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}$"), "year_first")
        .when(v.rlike("^[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4}$"), "year_last")))
    k, p = F.col("__k"), [F.get("__p", F.lit(i)) for i in range(4)]
    # bring every shape to (year, month, day); the suffix of a split year is written after "00"
    split_year = F.concat(p[0].cast("string"), F.lit("00"), F.split_part(F.translate(v, ".", "/"), F.lit("/"), F.lit(2))).try_cast("int")
    year = F.when(k == "split_year", split_year).when(k == "joined", p[1] % 10000).when(k == "year_first", p[0]).when(k == "year_last", p[2])
    month = F.when(k == "split_year", p[2]).when(k == "joined", F.floor(p[1] / 10000).cast("int")).otherwise(p[1])
    day = F.when(k == "split_year", p[3]).when(k == "year_first", p[2]).otherwise(p[0])
    s3 = s2.select("*", year.alias("__y"), month.alias("__m"), day.alias("__d"))
    y, m, d = F.col("__y"), F.col("__m"), F.col("__d")
    year_ok = k.isNotNull() & ((k != "split_year") | y.between(1990, 2025))
    fixed = (F.when(year_ok & _month(m) & _day(d), _ymd(y, m, d))
             .when(year_ok & (k != "joined") & _month(d) & _day(m), _ymd(y, d, m)).otherwise(v))
    return s3.withColumn(out, F.when(applies, fixed)).drop("__v", "__p", "__k", "__y", "__m", "__d")


# --- fixed values: years a text date may carry -----------------------------------------------------------
YEAR = "(19[0-9]{2}|20[012][0-9])"


def with_text_date(df: DataFrame, col: str, out: str) -> DataFrame:
    """Latin letters out, separators to slashes, a trailing year moved to the front.

    Built in steps so that each intermediate text is computed once per row.
    """
    year_pat = f"^{YEAR}$"
    s1 = df.withColumn("__st", T.strip(F.regexp_replace(F.col(col), "[A-Za-z]", "")))
    s2 = s1.withColumn("__nm", F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("__st"), "(?U)[\\-.\\s]+", "/"), "/+", "/"), "^/|/$", ""))
    s3 = s2.withColumn("__p", F.split("__nm", "/"))
    s4 = s3.select("*", *[F.trim(F.get("__p", F.lit(i))).alias(n) for i, n in enumerate(("__a", "__b", "__y"))])
    moved = (F.size("__p") == 3) & F.col("__y").rlike(year_pat) & ~F.col("__a").rlike(year_pat) & ~F.col("__b").rlike(year_pat)
    s5 = s4.select("*", moved.alias("__mv"), *[F.coalesce(F.col(c).try_cast("long"), F.lit(0)).alias(n) for c, n in (("__a", "__ai"), ("__b", "__bi"))])
    day_last = F.concat_ws("/", "__y", "__a", "__b")
    moved_out = (F.when(F.col("__mv") & (F.col("__bi") > 12) & (F.col("__ai") <= 12), day_last)
                 .when(F.col("__mv"), F.concat_ws("/", "__y", "__b", "__a")).otherwise(F.col("__nm")))
    s6 = s5.withColumn("__o", moved_out)
    new = F.when(F.col("__o").rlike(YEAR), F.col("__o")).when(F.col("__st").rlike(YEAR), F.col("__st")).otherwise(F.col(col))
    return s6.withColumn(out, new).drop("__st", "__nm", "__p", "__a", "__b", "__y", "__mv", "__ai", "__bi", "__o")


def standardize_dates(cells: DataFrame, mode: str = "grid") -> DataFrame:
    f = F.col("field")
    if mode == "grid":
        applies = f.rlike(K.GRID_DATE) & ~is_phone_column(f) & ~f.rlike(K.GRID_ID)
        fixed = with_grid_date(cells, "value", "__fixed", applies)
        return fixed.withColumn("value", F.when(applies, F.col("__fixed")).otherwise(F.col("value"))).drop("__fixed")
    applies = f.rlike(K.KEY_DATE) & ~f.rlike(K.KEY_PHONE)
    fixed = with_text_date(cells, "value", "__fixed")
    return fixed.withColumn("value", F.when(applies, F.col("__fixed")).otherwise(F.col("value"))).drop("__fixed")


def standardize_values(cells: DataFrame) -> DataFrame:
    """Phones, ids and dates in one pass; keeps the value before each change for the change log."""
    f, v = F.col("field"), F.col("value")
    is_phone, is_id = is_phone_column(f), f.rlike(K.GRID_ID)
    is_date = ~is_phone & ~is_id & f.rlike(K.GRID_DATE)
    dated = with_grid_date(cells, "value", "__date", is_date)
    out = F.when(is_phone, grid_phone(v)).when(is_id, clean_id(v)).when(is_date, F.col("__date")).otherwise(v)
    return dated.select(*[c for c in cells.columns if c != "value"], v.alias("before"), out.alias("value"))


def changes_of(cells: DataFrame, stage: str) -> DataFrame:
    """Change rows out of cells that carry ``before``.

    Written as a generator: a filter on ``value`` would be pushed below the standardiser and repeat its whole
    expression inside the condition.
    """
    row = F.struct(F.lit(stage).alias("stage"), F.col("before"), F.col("value").alias("after"))
    changed = F.filter(F.array(row), lambda x: ~x["before"].eqNullSafe(x["after"]))
    return cells.select("job_id", "row_idx", "field", F.inline(changed))


def choice_kind(field: Column) -> Column:
    """Which fixed answer set a header asks for, if any."""
    return (F.when(field.rlike(K.CHOICE_GENDER), "gender")
            .when(field.rlike(K.CHOICE_APPROVAL) & ~field.rlike(K.GRID_DATE), "approval")
            .when(field.rlike(K.CHOICE_DISABILITY), "disability"))


CHOICE_RULES = {"gender": (K.MALE, K.FEMALE), "approval": (K.AGREE, K.DISAGREE), "disability": (K.YES, K.NO)}


def recode_fixed_choice(cells: DataFrame) -> DataFrame:
    """Allowed answers only: kept, de-repeated, recognised after folding, or blanked. Lone marks stay.

    Adds ``method``: kept, normalised, mark, blanked, or null outside fixed-choice columns. A projection: every step is
    staged once, and a later one is only evaluated where the earlier, cheaper ones leave the answer open.
    """
    filled = T.strip(F.col("value")) != ""
    kind, raw, dedup, folded = F.col("__kind"), F.col("__raw"), F.col("__dedup"), F.col("__folded")
    known = F.lit(False)
    for k, rules in CHOICE_RULES.items():
        known = known | ((kind == k) & raw.isin(*[a for a, _ in rules]))
    staged = cells.withColumn("__kind", F.when(filled, choice_kind(F.col("field")))).withColumn("__raw", F.when(kind.isNotNull(), T.strip(F.col("value"))))
    staged = staged.withColumn("__open", kind.isNotNull() & ~known)
    staged = staged.withColumn("__dedup", F.when(F.col("__open"), F.array_join(F.array_distinct(T.tokens(raw)), " "))).withColumn("__folded", F.when(F.col("__open"), T.fold(raw, "choice")))
    answer, how = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, rules in CHOICE_RULES.items():
        allowed = [a for a, _ in rules]
        new = F.when(~F.col("__open"), F.col("value")).when(dedup.isin(*allowed), dedup).when(raw.rlike(K.LONE_MARK), F.col("value"))
        way = F.when(~F.col("__open"), "kept").when(dedup.isin(*allowed), "normalised").when(raw.rlike(K.LONE_MARK), "mark")
        for a, pattern in rules:
            hit = folded.rlike(pattern)
            new, way = new.when(hit, a), way.when(hit, "normalised")
        answer, how = F.when(kind == k, new).otherwise(answer), F.when(kind == k, way.otherwise("blanked")).otherwise(how)
    rest = [F.col(c) for c in cells.columns if c != "value"]
    return staged.select(*rest, F.col("value").alias("before"), F.when(kind.isNull(), F.col("value")).otherwise(answer).alias("value"), how.alias("method"))


def clean_selection_marks(v: Column) -> Column:
    return T.squeeze(F.regexp_replace(F.coalesce(v, F.lit("")), ":(un)?selected:", " "))


def drop_non_data_rows(grid: DataFrame) -> DataFrame:
    """Blank rows, second header lines and rows holding only their printed number go; the rest is renumbered.

    ``grid``: job_id, page, table_id, r, c, content (data rows only). Row flags are one aggregate; the new
    ``row_idx`` is a distributed ordinal over (page, table, r), so one long document never sits in one window.
    """
    v = F.nullif(F.trim("content"), F.lit(""))
    words = T.any_of(K.SUBHEADER_WORDS)
    known = F.array_contains(words, T.fold(v, "word"))
    rows = grid.groupBy("job_id", "page", "table_id", "r").agg(
        F.count(v).alias("n"), F.bool_or(T.digits_ascii(v).rlike("[0-9]")).alias("digits"), F.bool_and(F.when(v.isNotNull(), known)).alias("labels"),
        F.bool_and(F.when(v.isNotNull(), v.rlike(K.ROW_NUMBER_ONLY))).alias("number_only"))
    subheader = (F.col("n") <= 4) & ~F.col("digits") & F.col("labels")
    kept = rows.filter((F.col("n") > 0) & ~subheader & ~((F.col("n") == 1) & F.col("number_only"))).select(
        "job_id", "page", "table_id", "r")
    numbered = ordinal(kept, ["job_id"], ["page", "table_id", "r"], [F.col("page"), F.col("table_id"), block_of("r")], "row_idx")
    return grid.join(numbered, ["job_id", "page", "table_id", "r"])


def drop_empty_rows(cells: DataFrame) -> DataFrame:
    filled = F.nullif(F.trim("value"), F.lit(""))
    keep = cells.groupBy("job_id", "row_idx").agg(F.count(filled).alias("n")).filter("n > 0").drop("n")
    return cells.join(keep, ["job_id", "row_idx"], "left_semi")


def drop_empty_columns(cells: DataFrame) -> DataFrame:
    filled = F.nullif(F.trim("value"), F.lit(""))
    keep = cells.groupBy("job_id", "field").agg(F.count(filled).alias("n")).filter("n > 0").drop("n")
    return cells.join(keep, ["job_id", "field"], "left_semi")


def looks_like_name_text(v: Column) -> Column:
    return F.coalesce(T.letter_count(T.strip(v)) >= 2, F.lit(False))


def filter_name_text(cells: DataFrame) -> DataFrame:
    return cells.filter(looks_like_name_text(F.col("value")))


def plausible_place(v: Column) -> Column:
    t = T.strip(v)
    return (F.length(t) >= 3) & ~t.rlike("[A-Za-z]") & (T.arabic_chars(t) >= 3) & ~T.digits_ascii(t).rlike("[0-9]")


def split_plausible_places(cells: DataFrame) -> DataFrame:
    """Distinct place-column values with counts and a plausibility flag."""
    vals = (cells.filter(~F.col("field").startswith("_") & F.col("field").rlike(K.PLACE_HEADER))
            .select(T.strip(F.col("value")).alias("value")).filter("value <> ''"))
    return vals.groupBy("value").agg(F.count("*").alias("n")).withColumn("plausible", plausible_place(F.col("value")))


def swap_misplaced(cells: DataFrame) -> DataFrame:
    """A phone- or date-shaped value in the first name column trades places with the first phone or date column."""
    f, v = F.col("field"), F.coalesce(F.col("value"), F.lit(""))

    def first(pattern, tag):
        hit = F.when(f.rlike(pattern), F.col("col_idx"))
        return [F.min_by("field", hit).alias(f"{tag}_field"), F.min_by(v, hit).alias(f"{tag}_value")]

    phone_shape = "^[0-9]{9,11}$"
    date_shape = "[0-9]{4}[/\\-][0-9]{1,2}[/\\-][0-9]{1,2}|[0-9]{1,2}[/\\-][0-9]{1,2}[/\\-][0-9]{4}"

    def bare(c):
        return T.digits_ascii(F.replace(c, F.lit(" "), F.lit("")))

    # only a row with such a value in some name column can change; the others are not gathered
    digit = v.rlike(f"[0-9{K.DIGITS_FROM}]")
    asked = cells.filter(f.rlike(K.KEY_NAME) & digit & (bare(v).rlike(phone_shape) | T.digits_ascii(v).rlike(date_shape))).select("job_id", "row_idx").distinct()
    rows = cells.join(asked, ["job_id", "row_idx"], "left_semi").groupBy("job_id", "row_idx").agg(*first(K.KEY_NAME, "name"), *first(K.KEY_PHONE, "phone"), *first(K.KEY_DATE, "date"))
    swap_phone = bare(F.col("name_value")).rlike(phone_shape) & ~bare(F.col("phone_value")).rlike(phone_shape)
    swap_date = T.digits_ascii(F.col("name_value")).rlike(date_shape) & ~T.digits_ascii(F.col("date_value")).rlike(date_shape)
    moves = rows.withColumn("sp", F.coalesce(swap_phone, F.lit(False))).withColumn("sd", F.coalesce(swap_date, F.lit(False))).filter("sp or sd")

    def blank(c):
        return F.nullif(F.col(c), F.lit(""))

    new_name = F.when(F.col("sd"), blank("date_value")).otherwise(blank("phone_value"))
    patch = moves.select("job_id", "row_idx", F.inline(F.filter(F.array(
        F.struct(F.col("name_field").alias("field"), new_name.alias("new")),
        F.struct(F.when(F.col("sp"), F.col("phone_field")).alias("field"), F.col("name_value").alias("new")),
        F.struct(F.when(F.col("sd"), F.col("date_field")).alias("field"), F.col("name_value").alias("new"))),
        lambda x: x["field"].isNotNull()))).withColumn("hit", F.lit(True))
    j = cells.join(patch, ["job_id", "row_idx", "field"], "left")
    return j.withColumn("value", F.when(F.col("hit"), F.col("new")).otherwise(F.col("value"))).drop("new", "hit")


def clear_leaked_signatures(cells: DataFrame) -> DataFrame:
    """A participant signature equal to, or made only of words of, a name in its row is cleared."""
    f = F.col("field")
    is_sig = f.rlike(K.SIGNATURE_GUARD) & ~f.rlike(K.GUARDIAN_HEADER)
    folded = T.fold(F.col("value"), "alef")
    named = cells.filter(f.rlike("(?i)اسم|الاسم|name") & ~is_sig).select("job_id", "row_idx", folded.alias("n")).filter("n <> ''")
    sigs = cells.filter(is_sig).select("job_id", "row_idx", "field", folded.alias("s")).filter("s <> ''")
    st, nt = T.tokens(F.col("s")), T.tokens(F.col("n"))
    subset = (F.size(st) > 0) & (F.size(F.array_except(st, nt)) == 0) & F.exists(st, lambda t: F.length(t) >= 3)
    leaked = (sigs.join(named, ["job_id", "row_idx"]).filter((F.col("s") == F.col("n")) | subset)
              .select("job_id", "row_idx", "field").distinct().withColumn("leaked", F.lit(True)))
    j = cells.join(leaked, ["job_id", "row_idx", "field"], "left")
    return j.withColumn("value", F.when(F.col("leaked").isNull(), F.col("value"))).drop("leaked")


def strip_internal_fields(cells: DataFrame) -> DataFrame:
    return cells.filter(~F.col("field").startswith("_"))


def null_repeats(cells: DataFrame) -> DataFrame:
    """Second and later occurrences of a phone or date inside one column become null.

    The first row of each value comes from an aggregate; a repeated value never gathers its rows in a window.
    """
    once = F.col("field").rlike(K.KEY_PHONE) | F.col("field").rlike(K.KEY_DATE)
    firsts = (cells.filter(once & (F.col("value") != "")).groupBy("job_id", "field", "value")
              .agg(F.min("row_idx").alias("first_row")))
    j = cells.join(firsts, ["job_id", "field", "value"], "left")
    repeat = F.coalesce(F.col("row_idx") > F.col("first_row"), F.lit(False))
    return j.withColumn("value", F.when(~repeat, F.col("value"))).select(*cells.columns)
