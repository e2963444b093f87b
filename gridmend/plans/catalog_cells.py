"""Standardisation and audit queries over the long cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmend.functions import constants as K
from gridmend.functions import text as T
from gridmend.operators import audit
from gridmend.operators import standardize as S
from gridmend.plans.registry import query
from gridmend.plans.standins import cells, duck_cells, oracle, table, together

VALUES = ("person", "phone", "idno", "dob", "gender", "approval", "disability", "place", "signature")
LETTERS_ONLY = "regexp_replace({}, '[^؀-ۿݐ-ݿa-zA-Z]', '', 'g')"


def dig(c):
    return f"translate({c}, '{K.DIGITS_FROM}', '{K.DIGITS_TO}')"


def only(c):
    return f"regexp_replace({dig(c)}, '[^0-9]', '', 'g')"


def rx(p):
    return p.replace("\\\\", "\\").replace("'", "''")


def csv(words):
    return ", ".join("'" + w + "'" for w in words)


ROLE_SQL = ", roles AS (SELECT job_id, field, min(col_idx) AS col_idx, count(value) AS filled, " \
    f"count(*) FILTER (regexp_matches({dig('value')}, '{rx(K.LOOKS_DATE)}')) AS date_like FROM cells GROUP BY ALL)"


@query("classify_columns", oracle(duck_cells(*VALUES, "price", "qty", "total", "serial") + ROLE_SQL + f""",
 fr AS (SELECT *, regexp_replace(translate(field, 'أإآٱىئة', 'اااايئه'), 'ئ', 'ي', 'g') AS folded FROM roles)
SELECT job_id, field, filled,
 concat_ws(',', CASE WHEN regexp_matches(field, '{rx(K.KEY_PHONE)}') THEN 'phone' END,
  CASE WHEN regexp_matches(field, '{rx(K.AUDIT_ID)}') AND NOT regexp_matches(field, '{rx(K.KEY_PHONE)}') THEN 'id' END,
  CASE WHEN regexp_matches(field, '{rx(K.KEY_DATE)}') AND filled > 0 AND date_like * 2 >= filled THEN 'date' END,
  CASE WHEN regexp_matches(folded, '{rx(K.NAME_HEADER)}') THEN 'name' END,
  CASE WHEN regexp_matches(folded, 'توقيع|signature|imza') THEN 'signature' END,
  CASE WHEN regexp_matches(field, '{rx(K.CHOICE_GENDER)}') THEN 'gender' END,
  CASE WHEN regexp_matches(field, '{rx(K.CHOICE_APPROVAL)}') THEN 'approval' END,
  CASE WHEN regexp_matches(field, '{rx(K.CHOICE_DISABILITY)}') THEN 'disability' END,
  CASE WHEN regexp_matches(field, '{rx(K.PLACE_HEADER)}') THEN 'place' END,
  CASE WHEN regexp_matches(field, '{rx(K.AUDIT_PRICE)}') THEN 'price' END, CASE WHEN regexp_matches(field, '{rx(K.AUDIT_QTY)}') THEN 'qty' END,
  CASE WHEN regexp_matches(field, '{rx(K.AUDIT_TOTAL)}') THEN 'total' END, CASE WHEN regexp_matches(field, '{rx(K.MERGE_NUMBER)}') THEN 'number' END) AS roles,
 CASE WHEN regexp_matches(field, '{rx(K.MERGE_PHONE)}') THEN 'phone' WHEN regexp_matches(field, '{rx(K.MERGE_DATE)}') THEN 'date'
  WHEN regexp_matches(field, '{rx(K.MERGE_NUMBER)}') THEN 'number' WHEN regexp_matches(field, '{rx(K.MERGE_NAME)}') THEN 'name' ELSE 'text' END AS main_role
FROM fr""", "form_rows"))
def classify_columns(spark, sf):
    out = S.classify_columns(cells(spark, sf, *VALUES, "price", "qty", "total", "serial"))
    return out.select("job_id", "field", "filled", F.array_join("roles", ",").alias("roles"), "main_role")


@query("normalize_headers", oracle(""", h AS (SELECT job_id, row_idx, CASE WHEN line_no % 3 = 0 THEN '  رقم   الهاتف ' WHEN line_no % 3 = 1 THEN 'الإسم' ELSE '   ' END AS field, phone AS value FROM form_rows)
SELECT job_id, row_idx, trim(regexp_replace(translate(field, 'أإآٱ', 'اااا'), '\\s+', ' ', 'g')) AS field, value FROM h WHERE trim(field) <> ''""", "form_rows"))
def normalize_headers(spark, sf):
    h = table(spark, sf, "form_rows").selectExpr("job_id", "row_idx", "case when line_no % 3 = 0 then '  رقم   الهاتف ' when line_no % 3 = 1 then 'الإسم' else '   ' end as field", "phone as value")
    return S.normalize_headers(h)


@query("fold_text", oracle("""
SELECT job_id, row_idx, trim(regexp_replace(translate(person, 'أإآٱ', 'اااا'), '\\s+', ' ', 'g')) AS alef,
 trim(translate(person, 'أإآٱىئة', 'ااااييه')) AS "full", trim(regexp_replace(regexp_replace(translate(place, 'أإآٱىئةؤ', 'ااااييهو'), '[^\\p{L}\\p{N}_\\s؀-ۿ]', ' ', 'g'), '\\s+', ' ', 'g')) AS place,
 lower(trim(translate(gender, 'أإآٱىئة', 'ااااييه'))) AS choice, trim(translate(person, 'أإآٱة', 'ااااه')) AS "match",
 trim(translate(person, 'أإآٱىة', 'اااايه')) AS eval, replace(translate(person, 'أإآٱىة', 'اااايه'), ' ', '') AS skeleton, translate(person, 'رخج', 'دحح') AS confusion
FROM form_rows""", "form_rows"))
def fold_text(spark, sf):
    src = {"alef": "person", "full": "person", "place": "place", "choice": "gender", "match": "person", "eval": "person", "skeleton": "person", "confusion": "person"}
    return table(spark, sf, "form_rows").select("job_id", "row_idx", *[T.fold(c, p).alias(p) for p, c in src.items()])


@query("fold_digits", oracle(duck_cells("phone", "idno", "dob") + f""", a AS (SELECT *, {dig('value')} AS d, regexp_replace({dig('value')}, '\\s+', '', 'g') AS bare FROM cells)
SELECT job_id, row_idx, field, CASE WHEN field <> 'تاريخ الميلاد' AND regexp_matches(bare, '^\\+?[0-9*]+$') THEN bare ELSE d END AS value FROM a""", "form_rows"))
def fold_digits(spark, sf):
    c = cells(spark, sf, "phone", "idno", "dob")
    numeric = S.is_phone_column(F.col("field")) | F.col("field").rlike(K.GRID_ID)
    return c.select("job_id", "row_idx", "field", S.fold_digits(F.col("value"), numeric).alias("value"))


PHONE_SQL = f"""CASE WHEN d = '' THEN NULL ELSE (CASE WHEN starts_with(ltrim(value), '+') THEN '+' ELSE '' END) || CASE WHEN substr(d, 1, 3) IN ('970', '972') THEN d
  WHEN length(d) = 9 AND substr(d, 1, 2) IN ('59', '56', '57', '58', '54') THEN '0' || d
  WHEN length(d) = 10 AND d[1:1] = '2' AND substr(d, 2, 2) IN ('59', '56', '57', '58', '54') THEN '0' || substr(d, 2) ELSE d END END"""
TEXT_PHONE_SQL = """CASE WHEN d = '' THEN value WHEN length(d2) = 10 AND substr(d2, 1, 3) IN ('059', '056') THEN d2 WHEN length(d2) >= 7 THEN d2 ELSE value END"""


@query("standardize_phones_grid", oracle(duck_cells("phone", "idno") + f"""
SELECT job_id, row_idx, field, CASE WHEN field = 'رقم الهاتف' THEN {PHONE_SQL} ELSE value END AS value FROM (SELECT *, {only('value')} AS d FROM cells)""", "form_rows"))
def standardize_phones_grid(spark, sf):
    return S.standardize_phones(cells(spark, sf, "phone", "idno")).select("job_id", "row_idx", "field", "value")


@query("standardize_phones_text", oracle(duck_cells("phone", "idno") + f"""
, a AS (SELECT *, {only('value')} AS d FROM cells), b AS (SELECT *, CASE WHEN length(d) = 9 AND substr(d, 1, 2) IN ('59', '56') THEN '0' || d ELSE d END AS d2 FROM a)
SELECT job_id, row_idx, field, CASE WHEN field = 'رقم الهاتف' THEN {TEXT_PHONE_SQL} ELSE value END AS value FROM b""", "form_rows"))
def standardize_phones_text(spark, sf):
    return S.standardize_phones(cells(spark, sf, "phone", "idno"), "text").select("job_id", "row_idx", "field", "value")


@query("standardize_ids", oracle(duck_cells("idno", "phone") + """
SELECT job_id, row_idx, field, CASE WHEN field = 'رقم الهوية' THEN nullif(regexp_replace(value, '[^0-9*]', '', 'g'), '') ELSE value END AS value FROM cells""", "form_rows"))
def standardize_ids(spark, sf):
    return S.standardize_ids(cells(spark, sf, "idno", "phone")).select("job_id", "row_idx", "field", "value")


def _x(v, p, i):
    return f"try_cast(regexp_extract({v}, '{p}', {i}) as int)"


M1, M2 = "^([0-9])[./]([0-9]{1,2})[/.]([0-9]{1,2})[/.]([0-9]{1,2})$", "^([0-9]{1,2})-([0-9])([0-9]{4})$"
M3, M4 = "^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})$", "^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4})$"
DATE_PARTS = ", ".join(f"{_x('value', p, i)} AS m{k}_{i}" for k, p, n in ((1, M1, 4), (2, M2, 3), (3, M3, 3), (4, M4, 3)) for i in range(1, n + 1))
DATE_SQL = """CASE WHEN m1_4 IS NOT NULL AND y1 BETWEEN 1990 AND 2025 AND m1_3 BETWEEN 1 AND 12 AND m1_4 BETWEEN 1 AND 31 THEN concat_ws('/', y1, m1_3, m1_4)
 WHEN m1_4 IS NOT NULL AND y1 BETWEEN 1990 AND 2025 AND m1_4 BETWEEN 1 AND 12 AND m1_3 BETWEEN 1 AND 31 THEN concat_ws('/', y1, m1_4, m1_3)
 WHEN m2_3 IS NOT NULL AND m2_1 BETWEEN 1 AND 31 AND m2_2 BETWEEN 1 AND 12 THEN concat_ws('/', m2_3, m2_2, m2_1)
 WHEN m3_1 IS NOT NULL AND m3_2 BETWEEN 1 AND 12 AND m3_3 BETWEEN 1 AND 31 THEN concat_ws('/', m3_1, m3_2, m3_3)
 WHEN m3_1 IS NOT NULL AND m3_3 BETWEEN 1 AND 12 AND m3_2 BETWEEN 1 AND 31 THEN concat_ws('/', m3_1, m3_3, m3_2)
 WHEN m4_3 IS NOT NULL AND m4_2 BETWEEN 1 AND 12 AND m4_1 BETWEEN 1 AND 31 THEN concat_ws('/', m4_3, m4_2, m4_1)
 WHEN m4_3 IS NOT NULL AND m4_1 BETWEEN 1 AND 12 AND m4_2 BETWEEN 1 AND 31 THEN concat_ws('/', m4_3, m4_1, m4_2) ELSE value END"""
DATE_FROM = f"(SELECT *, try_cast(regexp_extract(value, '{M1}', 1) || '00' || regexp_extract(value, '{M1}', 2) as int) AS y1, {DATE_PARTS} FROM cells)"


@query("standardize_dates_grid", oracle(duck_cells("dob") + f" SELECT job_id, row_idx, field, {DATE_SQL} AS value FROM {DATE_FROM}", "form_rows"))
def standardize_dates_grid(spark, sf):
    return S.standardize_dates(cells(spark, sf, "dob")).select("job_id", "row_idx", "field", "value")


TEXT_DATE_CTE = """, a AS (SELECT *, trim(regexp_replace(value, '[A-Za-z]', '', 'g')) AS st FROM cells),
 b AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(st, '[-.\\s]+', '/', 'g'), '/+', '/', 'g'), '^/|/$', '', 'g') AS nm FROM a),
 c AS (SELECT *, len(string_split(nm, '/')) AS np, split_part(nm, '/', 1) AS pa, split_part(nm, '/', 2) AS pb, split_part(nm, '/', 3) AS pc FROM b),
 d AS (SELECT *, np = 3 AND regexp_matches(pc, '^(19[0-9]{2}|20[012][0-9])$') AND NOT regexp_matches(pa, '^(19[0-9]{2}|20[012][0-9])$') AND NOT regexp_matches(pb, '^(19[0-9]{2}|20[012][0-9])$') AS mv,
   coalesce(try_cast(pa as int), 0) AS ai, coalesce(try_cast(pb as int), 0) AS bi FROM c),
 e AS (SELECT *, CASE WHEN mv AND bi > 12 AND ai <= 12 THEN pc || '/' || pa || '/' || pb WHEN mv THEN pc || '/' || pb || '/' || pa ELSE nm END AS o FROM d)"""


@query("standardize_dates_text", oracle(duck_cells("dob") + TEXT_DATE_CTE + """
SELECT job_id, row_idx, field, CASE WHEN regexp_matches(o, '(19[0-9]{2}|20[012][0-9])') THEN o WHEN regexp_matches(st, '(19[0-9]{2}|20[012][0-9])') THEN st ELSE value END AS value FROM e""", "form_rows"))
def standardize_dates_text(spark, sf):
    return S.standardize_dates(cells(spark, sf, "dob"), "text").select("job_id", "row_idx", "field", "value")


@query("value_changes", oracle(duck_cells("phone", "idno", "dob", "place") + f""", o AS (SELECT *, CASE field WHEN 'رقم الهاتف' THEN {PHONE_SQL}
   WHEN 'رقم الهوية' THEN nullif(regexp_replace(value, '[^0-9*]', '', 'g'), '') WHEN 'تاريخ الميلاد' THEN {DATE_SQL} ELSE value END AS after
  FROM (SELECT *, {only('value')} AS d FROM {DATE_FROM}))
SELECT job_id, row_idx, field, 'standardise' AS stage, value AS before, after FROM o WHERE value IS DISTINCT FROM after""", "form_rows"))
def value_changes(spark, sf):
    return S.changes_of(S.standardize_values(cells(spark, sf, "phone", "idno", "dob", "place")), "standardise")


def _choice_sql(kind, rules):
    allowed = csv([a for a, _ in rules])
    pats = "".join(f" WHEN regexp_matches(folded, '(?i){p}') THEN '{a}'" for a, p in rules)
    how = "".join(f" WHEN regexp_matches(folded, '(?i){p}') THEN 'normalised'" for a, p in rules)
    return (f"WHEN k = '{kind}' THEN CASE WHEN value IN ({allowed}) THEN value WHEN dd IN ({allowed}) THEN dd WHEN regexp_matches(value, '{K.LONE_MARK}') THEN value{pats} END",
            f"WHEN k = '{kind}' THEN CASE WHEN value IN ({allowed}) THEN 'kept' WHEN dd IN ({allowed}) THEN 'normalised' WHEN regexp_matches(value, '{K.LONE_MARK}') THEN 'mark'{how} ELSE 'blanked' END")


_C = [_choice_sql(k, r) for k, r in S.CHOICE_RULES.items()]
CHOICE_CTE = f""", k AS (SELECT *, CASE field WHEN 'الجنس' THEN 'gender' WHEN 'الموافقة' THEN 'approval' WHEN 'هل لديك إعاقة' THEN 'disability' END AS k,
   lower(trim(translate(value, 'أإآٱىئة', 'ااااييه'))) AS folded,
   CASE WHEN len(list_distinct(string_split(value, ' '))) = 1 THEN string_split(value, ' ')[1] ELSE value END AS dd FROM cells),
 r AS (SELECT job_id, row_idx, field, CASE WHEN value IS NULL THEN NULL {' '.join(c[0] for c in _C)} ELSE value END AS value,
   CASE WHEN value IS NULL THEN NULL {' '.join(c[1] for c in _C)} END AS method FROM k)"""


@query("recode_fixed_choice", oracle(duck_cells("gender", "approval", "disability", "person") + CHOICE_CTE + " SELECT * FROM r", "form_rows"))
def recode_fixed_choice(spark, sf):
    return S.recode_fixed_choice(cells(spark, sf, "gender", "approval", "disability", "person")).select("job_id", "row_idx", "field", "value", "method")


@query("recode_counts", oracle(duck_cells("gender", "approval", "disability") + CHOICE_CTE + """
SELECT field, count(*) FILTER (method = 'normalised') AS normalised, count(*) FILTER (method = 'blanked') AS blanked FROM r GROUP BY field""", "form_rows"))
def recode_counts(spark, sf):
    r = S.recode_fixed_choice(cells(spark, sf, "gender", "approval", "disability"))
    return r.groupBy("field").agg(F.count_if(F.col("method") == "normalised").alias("normalised"), F.count_if(F.col("method") == "blanked").alias("blanked"))


MARK_EXPR = "CASE event_type WHEN 'click' THEN ':selected:' WHEN 'view' THEN ' :unselected: x :selected: ' WHEN 'error' THEN 'no  :selected: ' || event_id ELSE props END"


@query("clean_selection_marks", oracle(f"""
SELECT event_id, trim(regexp_replace(replace(replace({MARK_EXPR}, ':selected:', ' '), ':unselected:', ' '), '\\s+', ' ', 'g')) AS content FROM events"""))
def clean_selection_marks(spark, sf):
    return table(spark, sf, "events").selectExpr("event_id", f"{MARK_EXPR} as raw").select("event_id", S.clean_selection_marks(F.col("raw")).alias("content"))


GRID_ROWS = """SELECT job_id, cast(1 + part_key % 3 as int) AS page, cast(0 as int) AS table_id, cast(row_idx as bigint) AS r, c, content FROM (
  SELECT job_id, row_idx, part_key, cast(0 as int) AS c, CASE supp_key % 5 WHEN 0 THEN '' ELSE serial END AS content FROM form_rows
  UNION ALL SELECT job_id, row_idx, part_key, cast(1 as int), CASE WHEN supp_key % 5 < 2 THEN '' WHEN supp_key % 5 = 2 THEN 'من' ELSE person END FROM form_rows
  UNION ALL SELECT job_id, row_idx, part_key, cast(2 as int), CASE WHEN supp_key % 5 < 2 THEN ' ' WHEN supp_key % 5 = 2 THEN 'إلى' ELSE phone END FROM form_rows
  UNION ALL SELECT job_id, row_idx, part_key, cast(3 as int), CASE WHEN supp_key % 5 = 2 AND part_key % 2 = 0 THEN serial ELSE '' END FROM form_rows) g WHERE NOT (supp_key_zero)"""
GRID_ROWS = GRID_ROWS.replace(" WHERE NOT (supp_key_zero)", "")
# a second header line has an empty serial cell
GRID_ROWS = GRID_ROWS.replace("CASE supp_key % 5 WHEN 0 THEN ''", "CASE WHEN supp_key % 5 IN (0, 2) THEN ''")


def grid(spark, sf):
    rows = table(spark, sf, "form_rows")
    k = F.col("supp_key") % 5
    blank = F.lit("")
    contents = [F.when(k.isin(0, 2), blank).otherwise(F.col("serial")), F.when(k < 2, blank).when(k == 2, "من").otherwise(F.col("person")),
                F.when(k < 2, " ").when(k == 2, "إلى").otherwise(F.col("phone")),
                F.when((k == 2) & (F.col("part_key") % 2 == 0), F.col("serial")).otherwise(blank)]
    return rows.select("job_id", (1 + F.col("part_key") % 3).cast("int").alias("page"), F.lit(0).alias("table_id"), F.col("row_idx").alias("r"),
                       F.inline(F.array(*[F.struct(F.lit(i).alias("c"), x.alias("content")) for i, x in enumerate(contents)])))


@query("drop_non_data_rows", oracle(f""", grid AS ({GRID_ROWS}),
 f AS (SELECT job_id, page, table_id, r, count(nullif(trim(content), '')) AS n, bool_or(regexp_matches({dig("nullif(trim(content), '')")}, '[0-9]')) AS dg,
   bool_and(CASE WHEN trim(content) <> '' THEN lower(translate(trim(content), 'أإآٱى', 'ااااي')) IN ({csv(K.SUBHEADER_WORDS)}) END) AS lb,
   bool_and(CASE WHEN trim(content) <> '' THEN regexp_matches(trim(content), '{K.ROW_NUMBER_ONLY}') END) AS num FROM grid GROUP BY ALL),
 k AS (SELECT job_id, page, table_id, r, row_number() OVER (PARTITION BY job_id ORDER BY page, table_id, r) - 1 AS row_idx FROM f
   WHERE n > 0 AND NOT (n <= 4 AND NOT dg AND lb) AND NOT (n = 1 AND num))
SELECT g.job_id, g.page, g.r, g.c, g.content, k.row_idx FROM grid g JOIN k USING (job_id, page, table_id, r)""", "form_rows"))
def drop_non_data_rows(spark, sf):
    return S.drop_non_data_rows(grid(spark, sf)).select("job_id", "page", "r", "c", "content", "row_idx")


@query("drop_empty_rows", oracle(duck_cells("phone", "approval") + """
SELECT job_id, row_idx, field, value FROM cells c WHERE EXISTS (SELECT 1 FROM cells d WHERE d.job_id = c.job_id AND d.row_idx = c.row_idx AND trim(d.value) <> '')""", "form_rows"))
def drop_empty_rows(spark, sf):
    return S.drop_empty_rows(cells(spark, sf, "phone", "approval")).select("job_id", "row_idx", "field", "value")


@query("drop_empty_columns", oracle(duck_cells("phone", "approval", "disability") + """
SELECT job_id, row_idx, field, value FROM cells c WHERE (job_id, field) IN (SELECT (job_id, field) FROM cells WHERE trim(value) <> '')""", "form_rows"))
def drop_empty_columns(spark, sf):
    return S.drop_empty_columns(cells(spark, sf, "phone", "approval", "disability")).select("job_id", "row_idx", "field", "value")


@query("filter_name_text", oracle(duck_cells("person", "gender", "approval", "idno") + f"""
SELECT job_id, row_idx, field, value FROM cells WHERE length({LETTERS_ONLY.format('value')}) >= 2""", "form_rows"))
def filter_name_text(spark, sf):
    return S.filter_name_text(cells(spark, sf, "person", "gender", "approval", "idno")).select("job_id", "row_idx", "field", "value")


@query("split_plausible_places", oracle(duck_cells("place", "person") + f"""
SELECT value, count(*) AS n, (length(value) >= 3 AND NOT regexp_matches(value, '[A-Za-z]') AND length(regexp_replace(value, '[^؀-ۿ]', '', 'g')) >= 3
  AND NOT regexp_matches({dig('value')}, '[0-9]')) AS plausible FROM (SELECT trim(value) AS value FROM cells WHERE field = 'العنوان') WHERE value <> '' GROUP BY value""", "form_rows"))
def split_plausible_places(spark, sf):
    return S.split_plausible_places(cells(spark, sf, "place", "person"))


@query("swap_misplaced", oracle("""
, w AS (SELECT job_id, row_idx, person, coalesce(CASE WHEN trim(phone) <> '' THEN phone END, '') AS ph, dob,
   regexp_matches(replace(person, ' ', ''), '^[0-9]{9,11}$') AND NOT regexp_matches(translate(replace(coalesce(phone, ''), ' ', ''), '٠١٢٣٤٥٦٧٨٩', '0123456789'), '^[0-9]{9,11}$') AS sp FROM form_rows)
SELECT job_id, row_idx, 'الاسم الرباعي' AS field, CASE WHEN sp THEN nullif(ph, '') ELSE person END AS value FROM w
UNION ALL SELECT job_id, row_idx, 'رقم الهاتف', CASE WHEN sp THEN person ELSE nullif(ph, '') END FROM w
UNION ALL SELECT job_id, row_idx, 'تاريخ الميلاد', dob FROM w""", "form_rows"))
def swap_misplaced(spark, sf):
    return S.swap_misplaced(cells(spark, sf, "person", "phone", "dob")).select("job_id", "row_idx", "field", "value")


@query("clear_leaked_signatures", oracle(""", w AS (SELECT *, trim(translate(person, 'أإآٱ', 'اااا')) AS n, trim(translate(signature, 'أإآٱ', 'اااا')) AS s FROM form_rows),
 x AS (SELECT *, s <> '' AND n <> '' AND (s = n OR (list_has_all(string_split(n, ' '), string_split(s, ' ')) AND len([t for t in string_split(s, ' ') if length(t) >= 3]) > 0)) AS lk FROM w)
SELECT job_id, row_idx, 'التوقيع' AS field, CASE WHEN NOT lk THEN nullif(signature, '') END AS value FROM x UNION ALL
SELECT job_id, row_idx, 'الاسم الرباعي', person FROM x""", "form_rows"))
def clear_leaked_signatures(spark, sf):
    return S.clear_leaked_signatures(cells(spark, sf, "person", "signature")).select("job_id", "row_idx", "field", "value")


@query("strip_internal_fields", oracle("""
SELECT job_id, row_idx, 'الاسم' AS field, person AS value FROM form_rows""", "form_rows"))
def strip_internal_fields(spark, sf):
    c = table(spark, sf, "form_rows").selectExpr("job_id", "row_idx", "inline(array(struct('الاسم' as field, person as value), struct('_suggestions' as field, clean_name as value)))")
    return S.strip_internal_fields(c)


@query("null_repeats", oracle(duck_cells("phone", "dob", "gender") + """
SELECT job_id, row_idx, field, CASE WHEN field <> 'الجنس' AND value IS NOT NULL AND row_number() OVER (PARTITION BY job_id, field, value ORDER BY row_idx) > 1 THEN NULL ELSE value END AS value FROM cells""", "form_rows"))
def null_repeats(spark, sf):
    return S.null_repeats(cells(spark, sf, "phone", "dob", "gender")).select("job_id", "row_idx", "field", "value")


# --- audit ---------------------------------------------------------------------------------------------------

AUDITED = ("person", "phone", "idno", "dob")
AUDIT_CTE = ROLE_SQL + f""", v AS (SELECT c.*, {only('trim(value)')} AS d, regexp_matches({dig('trim(value)')}, '^[0-9]+$') AS cl, trim(value) AS t,
   (r.field = 'تاريخ الميلاد' AND r.filled > 0 AND r.date_like * 2 >= r.filled) AS isdate,
   len([x for x in string_split(regexp_replace(trim(value), '\\s+', ' ', 'g'), ' ') if regexp_matches(x, '[؀-ۿ]')]) AS parts
   FROM cells c JOIN roles r ON r.job_id = c.job_id AND r.field = c.field WHERE value IS NOT NULL),
 an AS (SELECT job_id, row_idx, field, 'phone_format' AS issue, CASE WHEN cl THEN d ELSE t END AS found FROM v WHERE field = 'رقم الهاتف' AND d <> '' AND NOT (regexp_matches(d, '{K.PHONE_OK}') AND cl)
  UNION ALL SELECT job_id, row_idx, field, 'id_format', CASE WHEN cl THEN d ELSE t END FROM v WHERE field = 'رقم الهوية' AND d <> '' AND NOT (regexp_matches(d, '{K.ID_OK}') AND cl)
  UNION ALL SELECT job_id, row_idx, field, 'name_incomplete', parts || ' parts: ' || t FROM v WHERE field = 'الاسم الرباعي' AND parts BETWEEN 1 AND 3
  UNION ALL SELECT job_id, row_idx, field, 'date_format', t FROM v WHERE isdate AND t <> '' AND NOT regexp_matches({dig('t')}, '{K.AUDIT_DATE_OK}'))"""


@query("audit_cells", oracle(duck_cells(*AUDITED) + AUDIT_CTE + " SELECT * FROM an", "form_rows"))
def audit_cells(spark, sf):
    c = cells(spark, sf, *AUDITED)
    return audit.audit_cells(c).drop("expected")


@query("audit_summary", oracle(duck_cells(*AUDITED) + AUDIT_CTE + """, ro AS (SELECT DISTINCT job_id, row_idx FROM cells), di AS (SELECT DISTINCT job_id, row_idx FROM an),
 cl AS (SELECT job_id, count(*) AS rows_clean FROM (SELECT job_id, row_idx FROM ro EXCEPT SELECT job_id, row_idx FROM di) GROUP BY job_id),
 cj AS (SELECT j.job_id, coalesce(rows_clean, 0) AS rows_clean FROM (SELECT DISTINCT job_id FROM ro) j LEFT JOIN cl USING (job_id) UNION ALL SELECT NULL, cast(sum(rows_clean) as bigint) FROM cl),
 ai AS (SELECT job_id, issue, count(*) AS anomaly_count FROM an GROUP BY ROLLUP (job_id, issue))
SELECT cj.job_id, ai.issue, coalesce(ai.anomaly_count, 0) AS anomaly_count, cj.rows_clean FROM cj LEFT JOIN ai ON ai.job_id IS NOT DISTINCT FROM cj.job_id""", "form_rows"))
def audit_summary(spark, sf):
    c = cells(spark, sf, *AUDITED)
    return audit.audit_summary(audit.audit_cells(c), c)


TOTALS_CTE = """, n AS (SELECT job_id, row_idx, try_cast(price as double) AS p, try_cast(qty as double) AS q, try_cast(total as double) AS t FROM form_rows),
 ck AS (SELECT * FROM n WHERE p IS NOT NULL AND q IS NOT NULL AND t IS NOT NULL),
 lr AS (SELECT job_id, max(row_idx) AS last_row, count(DISTINCT row_idx) AS nr FROM n GROUP BY job_id),
 lt AS (SELECT lr.*, n.t FROM lr JOIN n ON n.job_id = lr.job_id AND n.row_idx = lr.last_row),
 sm AS (SELECT job_id, count(*) AS c, sum(t) AS s, arg_max(t, row_idx) AS la FROM ck GROUP BY job_id),
 g AS (SELECT sm.job_id, c, last_row, t, nr, CASE WHEN c > 1 THEN round(s - la, 2) ELSE 0 END AS ls FROM sm LEFT JOIN lt ON lt.job_id = sm.job_id)"""


@query("reconcile_totals", oracle(TOTALS_CTE + """
SELECT job_id, row_idx, 'arithmetic_mismatch' AS issue, round(p * q, 2) AS expected, t AS found FROM ck WHERE abs(round(p * q, 2) - t) > 0.05
UNION ALL SELECT job_id, last_row, 'grand_total_mismatch', round(ls, 2), t FROM g WHERE nr > 2 AND t IS NOT NULL AND abs(ls - t) > 0.05 AND ls > 0""", "form_rows"))
def reconcile_totals(spark, sf):
    c = cells(spark, sf, "price", "qty", "total")
    bad, _ = audit.reconcile_totals(together(spark, c), S.classify_columns(c))
    return together(spark, bad.drop("field").withColumn("expected", F.round("expected", 2)))


@query("arithmetic_checks", oracle(TOTALS_CTE + """
SELECT job_id, c + CASE WHEN nr > 2 AND t IS NOT NULL THEN 1 ELSE 0 END AS arithmetic_checks FROM g""", "form_rows"))
def arithmetic_checks(spark, sf):
    c = cells(spark, sf, "price", "qty", "total")
    return together(spark, audit.reconcile_totals(together(spark, c), S.classify_columns(c))[1])


@query("validate_records", oracle(duck_cells("person", "phone", "dob") + f""", a AS (SELECT *, {only('value')} AS d FROM cells WHERE value <> ''),
 b AS (SELECT *, CASE WHEN length(d) = 9 AND substr(d, 1, 2) IN ('59', '56') THEN '0' || d ELSE d END AS d2 FROM a),
 x AS (SELECT *, {TEXT_PHONE_SQL} AS fx, regexp_extract({dig('value')}, '\\b(1[89][0-9]{{2}}|20[012][0-9])\\b', 1) AS yr FROM b),
 z AS (SELECT *, {only('fx')} AS fd FROM x)
SELECT job_id, row_idx, field, 'auto_corrected' AS issue, value AS original, fx AS corrected FROM z WHERE field = 'رقم الهاتف' AND fx <> value
UNION ALL SELECT job_id, row_idx, field, 'invalid_phone:len=' || length(fd) || ',prefix=' || CASE WHEN length(fd) >= 3 THEN substr(fd, 1, 3) ELSE '?' END, value, CASE WHEN fd <> '' THEN fx END
  FROM z WHERE field = 'رقم الهاتف' AND NOT (length(fd) = 10 AND substr(fd, 1, 3) IN ('059', '056'))
UNION ALL SELECT job_id, row_idx, field, CASE WHEN yr = '' THEN 'no_valid_year_in_date' ELSE 'suspect_birth_year:' || yr END, value, value FROM z
  WHERE field = 'تاريخ الميلاد' AND (yr = '' OR NOT try_cast(yr as int) BETWEEN 1940 AND 2020)
UNION ALL SELECT job_id, row_idx, field, 'name_field_contains_' || length(d) || '_digits_possible_misalignment', value, value FROM z WHERE field = 'الاسم الرباعي' AND length(d) >= 6""", "form_rows"))
def validate_records(spark, sf):
    return audit.validate_records(cells(spark, sf, "person", "phone", "dob"))


PROFILED = ("person", "phone", "gender", "place", "serial")
PROFILE_CTE = f""", f AS (SELECT job_id, field, row_idx, trim(value) AS v, replace(trim(value), ' ', '') AS b FROM cells WHERE trim(value) <> ''),
 o AS (SELECT *, CASE WHEN regexp_matches({dig('v')}, '^[0-9]{{1,3}}$') THEN try_cast({dig('v')} as int) END AS i FROM f),
 l AS (SELECT *, lag(i) OVER (PARTITION BY job_id, field ORDER BY row_idx) AS pi FROM o),
 prof AS (SELECT job_id, field, count(*) AS filled, count(DISTINCT v) / count(*) AS distinct_ratio, sum(len(string_split(regexp_replace(v, '\\s+', ' ', 'g'), ' '))) / count(*) AS avg_words,
  sum(length(regexp_replace(b, '[^\\p{{L}}]', '', 'g')) / length(b)) / count(*) AS avg_letters, count(*) FILTER (length({only('b')}) / length(b) > 0.3) / count(*) AS digit_heavy,
  count(*) FILTER (regexp_matches(regexp_replace({dig('v')}, '[\\s\\-+*./]', '', 'g'), '^[0-9]+$')) / count(*) >= 0.6 AS mostly_numeric,
  bool_and(i IS NOT NULL AND i BETWEEN 1 AND 999 AND (pi IS NULL OR i > pi)) AND count(DISTINCT v) = count(*) AS is_serial FROM l GROUP BY ALL)"""
PROFILE_OUT = "job_id, field, filled, round(distinct_ratio, 6) AS distinct_ratio, round(avg_words, 6) AS avg_words, round(avg_letters, 6) AS avg_letters, round(digit_heavy, 6) AS digit_heavy, filled >= 5 AND distinct_ratio < 0.3 AS near_constant, mostly_numeric, is_serial"


@query("profile_columns", oracle(duck_cells(*PROFILED) + PROFILE_CTE + f" SELECT {PROFILE_OUT} FROM prof", "form_rows"))
def profile_columns(spark, sf):
    p = audit.profile_columns(cells(spark, sf, *PROFILED))
    for c in ("distinct_ratio", "avg_words", "avg_letters", "digit_heavy"):
        p = p.withColumn(c, F.round(c, 6))
    return p


BLANKED = "CASE WHEN cast(substr(job_id, 2) as bigint) % 2 = 0 AND field = 'الاسم الرباعي' THEN 'عمود 2' ELSE field END"


@query("detect_name_columns", oracle(duck_cells("person", "phone", "gender", "place", "signature").replace("cells AS", "cells0 AS") +
    f", cells AS (SELECT job_id, row_idx, {BLANKED} AS field, value FROM cells0)" + PROFILE_CTE + """,
 sc AS (SELECT *, field = 'الاسم الرباعي' AND NOT (filled >= 5 AND distinct_ratio < 0.3) AS bh, CASE WHEN field IN ('التوقيع', 'الجنس') OR NOT (filled < 4 OR distinct_ratio >= 0.5) THEN -1
   WHEN filled >= 2 AND avg_letters >= 0.5 AND digit_heavy <= 0.3 THEN avg_words + distinct_ratio + avg_letters * 0.5 ELSE -1 END AS score FROM prof),
 bs AS (SELECT job_id, bool_or(bh) AS ah, max(score) AS best, last(field ORDER BY score, field) AS bf FROM sc GROUP BY job_id)
SELECT sc.job_id, field, CASE WHEN bh THEN 'header' ELSE 'content' END AS found_by FROM sc JOIN bs USING (job_id)
WHERE bh OR (NOT ah AND score > 0 AND (field = bf OR (score >= best * 0.85 AND score >= 2.5)))""", "form_rows"))
def detect_name_columns(spark, sf):
    c = cells(spark, sf, "person", "phone", "gender", "place", "signature")
    c = c.withColumn("field", F.expr(BLANKED))
    return audit.detect_name_columns(audit.profile_columns(c, serial=False))


HW = "CASE WHEN order_key % 7 = 0 THEN NULL ELSE (part_key * 7 + supp_key) % 5 < (order_key % 5) END"


@query("handwriting_gate", oracle(f""", h AS (SELECT job_id, {HW} AS hw FROM form_rows)
SELECT job_id, round(count(*) FILTER (hw) / count(*), 2) AS share, CASE WHEN count(hw) > 0 THEN count(*) FILTER (hw) / count(*) >= 0.4 END AS handwritten,
 coalesce(CASE WHEN count(hw) > 0 THEN count(*) FILTER (hw) / count(*) >= 0.4 END, true) AS keep FROM h GROUP BY job_id""", "form_rows"))
def handwriting_gate(spark, sf):
    c = table(spark, sf, "form_rows").selectExpr("job_id", "'الاسم' as field", f"{HW} as handwritten")
    return audit.handwriting_gate(c, c.select("job_id", "field").distinct())


@query("check_expectations", oracle("""
SELECT 'enum:kind' AS rule, count(*) FILTER (kind NOT IN ('grant', 'topup', 'charge')) AS violations FROM ledger
UNION ALL SELECT 'range:amount_cents', count(*) FILTER (NOT amount_cents BETWEEN -1000 AND 3000) FROM ledger
UNION ALL SELECT 'integral:amount_cents', count(*) FILTER (amount_cents <> floor(amount_cents)) FROM ledger
UNION ALL SELECT 'unique:job_id', count(*) FROM (SELECT job_id FROM ledger WHERE job_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'unique:id+kind', count(*) FROM (SELECT id, kind FROM ledger GROUP BY 1, 2 HAVING count(*) > 1)""", "ledger"))
def check_expectations(spark, sf):
    return audit.check_expectations(table(spark, sf, "ledger"), {"kind": ["grant", "topup", "charge"]}, [["job_id"], ["id", "kind"]],
                                    {"amount_cents": (-1000, 3000)}, ["amount_cents"])


@query("rule_conflicts", oracle(""", ru AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS o, split_part(p_name, ' ', 2) AS c FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2), split_part(p_name, ' ', 1) FROM part WHERE p_partkey % 3 = 0)
SELECT DISTINCT x.o AS a, x.c AS b FROM ru x JOIN ru y ON x.o = y.c AND x.c = y.o WHERE x.o < x.c"""))
def rule_conflicts(spark, sf):
    p = table(spark, sf, "part")
    a, b = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    rules = p.select(a.alias("original_text"), b.alias("corrected_text")).unionByName(
        p.filter("p_partkey % 3 = 0").select(b.alias("original_text"), a.alias("corrected_text")))
    return audit.rule_conflicts(rules)


@query("column_count_guard", oracle("""
, m AS (SELECT doc_id, list_sort([len(string_split(x, '|')) for x in string_split(text, chr(10)) if len(string_split(x, '|')) >= 3]) AS s FROM documents)
SELECT doc_id, cast(s[cast(floor(len(s) / 2) as bigint) + 1] as int) AS expected, cast(doc_id % 30 as int) AS returned, doc_id % 30 < s[cast(floor(len(s) / 2) as bigint) + 1] - 1 AS warn FROM m WHERE len(s) > 0"""))
def column_count_guard(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return audit.column_count_guard(d, d.select("doc_id", (F.col("doc_id") % 30).cast("int").alias("returned")))
