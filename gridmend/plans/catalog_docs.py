"""Source, sink, text and layout queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridmend.functions import constants as K
from gridmend.functions import text as T
from gridmend.operators import admin, layout, textdocs
from gridmend.plans.catalog_cells import csv, dig, only
from gridmend.plans.catalog_review import DTS, text_ts
from gridmend.plans.registry import query
from gridmend.plans.standins import Duck, Spark, ar, cells, duck_cells, oracle, own_rows, row_of, s, table, together
from gridmend.session import saved, shared_folder
from gridmend.sources import documents as D
from gridmend.sources import sinks
from gridmend.sources import tables as TB

# --- one layout chunk per order line: a header row and one data row of four cells --------------------------------
CHUNK = {
    "job_id": "'j' || l_orderkey", "off": "l_linenumber * 2",
    "cells": [("0", "0", "'#'", "columnHeader"), ("0", "1", "'name :selected:'", "columnHeader"), ("1", "0", "cast(l_partkey as string)", ""),
              ("1", "1", "':selected:'", ""), ("1", "2", "'cell ' || l_suppkey || '  :unselected:'", "")],
}


def _layout_json(spark, sf):
    li = table(spark, sf, "lineitem")
    items = [F.struct(F.lit(int(r)).alias("r"), F.lit(int(c)).alias("c"), F.expr(x).alias("content"), F.lit(k).alias("kind"), F.lit(1).alias("row_span"),
                      F.lit(1).alias("column_span"), F.lit(1 + int(r)).alias("page"), F.array(*[F.lit(float(v)) for v in (int(c) * 100, int(r) * 40, int(c) * 100 + 90, int(r) * 40, int(c) * 100 + 90, int(r) * 40 + 30, int(c) * 100, int(r) * 40 + 30)]).alias("polygon"),
                      F.array(F.struct((F.lit(1000 * i) + F.col("l_partkey") % 50).cast("int").alias("offset"), F.lit(40).alias("length"))).alias("spans"))
             for i, (r, c, x, k) in enumerate(CHUNK["cells"])]
    doc = F.struct(F.expr(CHUNK["job_id"]).alias("job_id"), F.expr(CHUNK["off"]).alias("page_offset"),
                   F.array(F.struct(F.lit(1).alias("page"), F.lit(8.5).alias("width"), F.lit(11.0).alias("height"), (F.col("l_partkey") % 4).cast("double").alias("angle"))).alias("pages"),
                   F.array(F.struct((F.col("l_suppkey") % 3 > 0).alias("is_handwritten"), F.array(F.struct((F.col("l_suppkey") % 60).cast("int").alias("offset"), F.lit(25).alias("length")),
                           F.struct(F.lit(2010).alias("offset"), F.lit(1200).alias("length"))).alias("spans"))).alias("styles"),
                   F.array(F.struct(F.lit(2).alias("row_count"), F.lit(3).alias("column_count"), F.array(*items).alias("cells"))).alias("tables"))
    raw = li.select(F.to_json(doc).alias("json"), F.struct("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_shipdate").alias("k"))
    return raw.select(F.from_json("json", D.LAYOUT_SCHEMA).alias("d"), "k").select("d.*", "k")


@query("explode_layout", oracle("""
SELECT 'j' || l_orderkey AS job_id, cast(r as int) AS r, cast(c as int) AS c, cast(l_linenumber * 2 + 1 + r as int) AS page, content, kind, cast(o as int) AS cell_ord FROM lineitem,
 LATERAL (VALUES (0, 0, '#', 'columnHeader', 0), (0, 1, 'name', 'columnHeader', 1), (1, 0, cast(l_partkey as varchar), '', 2), (1, 1, NULL, '', 3), (1, 2, 'cell ' || l_suppkey, '', 4)) v(r, c, content, kind, o)"""))
def explode_layout(spark, sf):
    return D.explode_layout(_layout_json(spark, sf))[0].select("job_id", "r", "c", "page", "content", "kind", "cell_ord")


@query("layout_pages", oracle("""
SELECT 'j' || l_orderkey AS job_id, cast(l_linenumber * 2 + 1 as int) AS page, cast(8.5 as double) AS width, cast(11 as double) AS height, cast(l_partkey % 4 as double) AS angle FROM lineitem"""))
def layout_pages(spark, sf):
    return D.explode_layout(_layout_json(spark, sf))[1]


@query("handwritten_cells", oracle("""
, sp AS (SELECT 'j' || l_orderkey AS job_id, l_partkey, l_suppkey, l_linenumber, cast(o as int) AS cell_ord, 1000 * o + l_partkey % 50 AS a, 1000 * o + l_partkey % 50 + 40 AS b FROM lineitem, range(5) t(o)),
 hw AS (SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, s, e FROM lineitem, LATERAL (VALUES (l_suppkey % 60, l_suppkey % 60 + 25), (2010, 3210)) v(s, e) WHERE l_suppkey % 3 > 0)
SELECT job_id, l_partkey AS part_key, cell_ord, coalesce((SELECT sum(greatest(0, least(b, e) - greatest(a, s))) FROM hw WHERE 'j' || hw.l_orderkey = sp.job_id AND hw.l_partkey = sp.l_partkey
   AND hw.l_linenumber = sp.l_linenumber AND hw.l_suppkey = sp.l_suppkey) / 40 >= 0.5, false) AS handwritten FROM sp"""))
def handwritten_cells(spark, sf):
    docs = _layout_json(spark, sf).withColumn("job_id", F.concat_ws("|", "job_id", "k.l_partkey", "k.l_linenumber", "k.l_suppkey"))
    lay, _ = D.explode_layout(docs)
    out = layout.handwritten_cells(lay, D.style_spans(docs))
    return out.select(F.split_part("job_id", F.lit("|"), F.lit(1)).alias("job_id"), F.split_part("job_id", F.lit("|"), F.lit(2)).cast("long").alias("part_key"), "cell_ord", "handwritten")


def _words_json(spark, sf):
    r = table(spark, sf, "form_rows")
    words = F.transform(F.split("clean_name", " "), lambda w, i: F.struct(w.alias("content"), ((F.col("part_key") * 7 + F.col("supp_key") * 3 + i * 11) % 100 / 100).alias("confidence"),
                        F.array(*[(i * 30 + v).cast("double") for v in (0, 25)]).alias("polygon")))
    doc = F.struct("job_id", F.lit("azure").alias("engine"), F.array(F.struct(F.col("row_idx").cast("int").alias("page"), F.lit(8.5).alias("width"), F.lit(11.0).alias("height"), words.alias("words"))).alias("pages"))
    return r.select(F.from_json(F.to_json(doc), D.WORDS_SCHEMA).alias("d")).select("d.*")


WORDS_CTE = ", w AS (SELECT job_id, cast(row_idx as int) AS page, i - 1 AS word_idx, tk[i] AS content, ((part_key * 7 + supp_key * 3 + (i - 1) * 11) % 100) / 100 AS confidence FROM (SELECT *, string_split(clean_name, ' ') AS tk FROM form_rows), LATERAL (SELECT unnest(range(1, len(tk) + 1)) AS i))"


@query("explode_words", oracle(WORDS_CTE + """
SELECT job_id, page, cast(word_idx as int) AS word_idx, content, confidence, CASE WHEN confidence < 0.8 THEN content || '[?]' ELSE content END AS annotated FROM w""", "form_rows"))
def explode_words(spark, sf):
    return D.explode_words(_words_json(spark, sf))[0].select("job_id", "page", "word_idx", "content", "confidence", "annotated")


@query("page_confidence", oracle(WORDS_CTE + " SELECT job_id, page, round(avg(confidence), 3) AS confidence FROM w GROUP BY ALL", "form_rows"))
def page_confidence(spark, sf):
    return D.explode_words(_words_json(spark, sf), digits=3)[1].select("job_id", "page", "confidence")


PIPE_CTE = """, p AS (SELECT doc_id, ri - 1 AS row_idx, trim(l) AS line FROM (SELECT doc_id, [x for x in string_split(text, chr(10)) if contains(x, '|')] AS ls FROM doc_text), LATERAL (SELECT unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS ri))"""


@query("parse_pipe_text", oracle(PIPE_CTE + """
SELECT doc_id, cast(row_idx as int) AS row_idx, cast(ci - 1 as int) AS col_idx, trim(v) AS value FROM (SELECT *, string_split(line, '|') AS cs FROM p WHERE row_idx = 0 OR NOT regexp_matches(replace(line, '|', ''), '^[-:\\s]+$')),
 LATERAL (SELECT unnest(cs) AS v, unnest(range(1, len(cs) + 1)) AS ci)""", "doc_text"))
def parse_pipe_text(spark, sf):
    return D.parse_pipe_text(table(spark, sf, "doc_text"))


@query("pipe_names", oracle(PIPE_CTE + """, n AS (SELECT doc_id, row_idx, [trim(x) for x in string_split(line, '|')[2:] if length(regexp_replace(trim(x), '[^؀-ۿ]', '', 'g')) >= 2] AS c FROM p)
SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY row_idx) - 1 as int) AS row_idx, c[1] AS text FROM n WHERE len(c) > 0""", "doc_text"))
def pipe_names(spark, sf):
    return D.pipe_names(table(spark, sf, "doc_text"))


STRUCTURED = """'[{"الاسم":"' || o_orderpriority || '","رقم":"' || o_custkey || '"},{"الاسم":' || CASE WHEN o_orderkey % 3 = 0 THEN 'null' WHEN o_orderkey % 3 = 1 THEN '"None"' ELSE '" x "' END || ',"_s":"1"}]'"""
STRUCT_SQL = """(SELECT 'j' || o_orderkey AS job_id, cast(0 as int) AS row_idx, 'الاسم' AS field, o_orderpriority AS value FROM orders WHERE o_orderstatus = 'F'
 UNION ALL SELECT 'j' || o_orderkey, 0, 'رقم', cast(o_custkey as varchar) FROM orders WHERE o_orderstatus = 'F'
 UNION ALL SELECT 'j' || o_orderkey, 1, 'الاسم', CASE WHEN o_orderkey % 3 = 2 THEN 'x' END FROM orders WHERE o_orderstatus = 'F'
 UNION ALL SELECT 'j' || o_orderkey, 1, '_s', '1' FROM orders WHERE o_orderstatus = 'F')"""


def _structured(spark, sf):
    o = table(spark, sf, "orders")
    j = table(spark, sf, "jobs").select("job_id", "order_key", "status", "user_id", "created_at")
    return j.join(o.select(F.col("o_orderkey").alias("order_key"), F.expr(STRUCTURED).alias("structured_data")), "order_key")


@query("explode_structured", oracle(f"SELECT * FROM {STRUCT_SQL}"))
def explode_structured(spark, sf):
    return D.explode_structured(_structured(spark, sf))


@query("extracted_names", oracle(f""", c AS (SELECT job_id, row_idx, field, value FROM {STRUCT_SQL} WHERE field = 'الاسم' AND value IS NOT NULL),
 co AS (SELECT 'j' || user_id * 7 AS job_id, cast(event_id % 2 as int) AS row_idx, 'الاسم' AS field, 'old ' || event_id AS o, CASE WHEN event_id % 5 <> 0 THEN 'new ' || event_id END AS n, ts, event_id FROM events),
 l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, row_idx, field ORDER BY ts DESC, event_id DESC) rn FROM co) WHERE rn = 1)
SELECT c.job_id, c.row_idx, c.field, coalesce(l.n, c.value) AS final_value, coalesce(l.o, c.value) AS ocr_output, l.n IS NOT NULL AS was_corrected FROM c LEFT JOIN l USING (job_id, row_idx, field)"""))
def extracted_names(spark, sf):
    from gridmend.operators.corrections import extracted_names as op
    co = table(spark, sf, "events").selectExpr("'j' || user_id * 7 as job_id", "cast(event_id % 2 as int) as row_idx", "'الاسم' as field_name", "'old ' || event_id as original_value",
                                              "case when event_id % 5 <> 0 then 'new ' || event_id end as corrected_value", "ts as created_at", "event_id as id")
    return op(D.explode_structured(_structured(spark, sf)), co).drop("corrected_at")


@query("scan_table", oracle("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'"))
def scan_table(spark, sf):
    df = TB.scan_table(spark, f"{sf}/orders.parquet")
    return df.filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


@query("export_lines", oracle("""
SELECT id, concat_ws(',', '"' || id || '"', '"' || job_id || '"', '"' || participant_index || '"', '"' || replace(regexp_replace(label, '\\r?\\n', ' ', 'g'), '"', '""') || '"',
 CASE WHEN context_path IS NULL THEN '' ELSE '"' || context_path || '"' END) AS line FROM training WHERE status = 'approved'""", "training"))
def export_lines(spark, sf):
    return sinks.export_lines(table(spark, sf, "training"), "approved", ["id", "job_id", "participant_index", "label", "context_path"]).select("id", "line")


@query("export_form_table", oracle("""
SELECT job_id, row_idx, person AS name, nullif(phone, '') AS phone, dob, nullif(gender, '') AS gender FROM form_rows""", "form_rows"))
def export_form_table(spark, sf):
    w = sinks.export_form_table(cells(spark, sf, "person", "phone", "dob", "gender", rows=own_rows(spark, sf)), ["الاسم الرباعي", "رقم الهاتف", "تاريخ الميلاد", "الجنس"])
    return row_of(w).select("job_id", "row_idx", F.col("الاسم الرباعي").alias("name"), F.col("رقم الهاتف").alias("phone"), F.col("تاريخ الميلاد").alias("dob"), F.col("الجنس").alias("gender"))


@query("column_order", oracle("""
SELECT job_id, cast(p as int) AS position, f AS field FROM (SELECT DISTINCT job_id FROM form_rows), (VALUES (0, 'الاسم الرباعي'), (1, 'رقم الهاتف'), (2, 'تاريخ الميلاد'), (3, '#'), (4, 'رقم الهوية'), (5, 'الجنس')) v(p, f)""", "form_rows"))
def column_order(spark, sf):
    return sinks.column_order(cells(spark, sf, "serial", "person", "phone", "idno", "dob", "gender"))


@query("load_vocab", oracle("""
, n AS (SELECT label AS name FROM training WHERE status = 'approved' UNION ALL SELECT person FROM form_rows UNION ALL SELECT canonical FROM places_seed)
SELECT DISTINCT unnest(string_split(trim(regexp_replace(translate(name, 'أإآٱ', 'اااا'), '\\s+', ' ', 'g')), ' ')) AS token FROM n QUALIFY length(token) >= 2""".replace(" QUALIFY length(token) >= 2", ""), "training", "form_rows", "places_seed").replace("SELECT DISTINCT unnest", "SELECT * FROM (SELECT DISTINCT unnest") + ") WHERE length(token) >= 2")
def load_vocab(spark, sf):
    t = table(spark, sf, "training").filter("status = 'approved'").select(F.col("label").alias("name"))
    return D.load_vocab(t, table(spark, sf, "form_rows").select(F.col("person").alias("name")), table(spark, sf, "places_seed").select(F.col("canonical").alias("name")))


@query("load_places", oracle("""
SELECT canonical, variant_folded, n AS count FROM (SELECT canonical, trim(translate(canonical || 'ة', 'أإآٱىئةؤ', 'ااااييهو')) AS variant_folded, length(canonical) AS n FROM places_seed
 UNION ALL SELECT canonical, trim(translate(substr(canonical, 2), 'أإآٱىئةؤ', 'ااااييهو')), 7 FROM places_seed)""".replace("variant_folded, n AS count FROM", "trim(regexp_replace(regexp_replace(variant_folded, '[^\\p{L}\\p{N}_\\s؀-ۿ]', ' ', 'g'), '\\s+', ' ', 'g')) AS variant_folded, n AS count FROM"), "places_seed"))
def load_places(spark, sf):
    seed = table(spark, sf, "places_seed")
    js = F.to_json(F.struct(F.array(F.struct("canonical", F.create_map(F.concat("canonical", F.lit("ة")), F.length("canonical").cast("long"), F.substring("canonical", 2, 500), F.lit(7).cast("long"),
                   F.translate("canonical", "ى", "ي") if False else F.concat(F.col("canonical"), F.lit(" ")), F.lit(1).cast("long")).alias("variants"))).alias("places")))
    lex = seed.select(F.from_json(js, D.LEXICON_SCHEMA).alias("l")).select("l.*")
    return D.load_places(lex)[1].select("canonical", "variant_folded", "count")


@query("merge_latest", oracle("""
, a AS (SELECT 'u' || user_id AS k, event_type AS f, ts, event_id AS id, value, 0 AS new FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 'u' || user_id, event_type, ts, event_id, value, 1 FROM events WHERE event_id % 2 = 1)
SELECT k, f, id, value FROM (SELECT *, row_number() OVER (PARTITION BY k, f ORDER BY ts DESC, id DESC, new DESC) rn FROM a) WHERE rn = 1"""))
def merge_latest(spark, sf):
    e = table(spark, sf, "events").selectExpr("'u' || user_id as k", "event_type as f", "ts", "event_id as id", "value")
    return TB.merge_latest(e.filter("id % 2 = 0"), e.filter("id % 2 = 1"), ["k", "f"], ["ts", "id"]).drop("ts")


@query("versioned_upsert", oracle("""
SELECT k, f, arg_max(event_id, (ts, event_id)) AS id, arg_max(value, (ts, event_id)) AS value FROM (SELECT 'u' || user_id AS k, event_type AS f, ts, event_id, value FROM events) GROUP BY k, f"""))
def versioned_upsert(spark, sf):
    """Three commits, the last of which repeats rows of the first."""
    e = table(spark, sf, "events").selectExpr("'u' || user_id as k", "event_type as f", "ts", "event_id as id", "value")
    root = f"{shared_folder(spark).rstrip('/')}/gridmend-table-{uuid.uuid4().hex}"
    for part in (e.filter("id % 2 = 0"), e.filter("id % 2 = 1"), e.filter("id % 4 = 0")):
        TB.versioned_upsert(spark, root, part, ["k", "f"], ["ts", "id"])
    return TB.read_current(spark, root).drop("ts")


@query("archive_manifest", oracle("SELECT crop_path AS path FROM training WHERE crop_path IS NOT NULL UNION SELECT context_path FROM training WHERE context_path IS NOT NULL", "training"))
def archive_manifest(spark, sf):
    return TB.archive_manifest(table(spark, sf, "training"))


LISTING = "CASE WHEN length(path) % 3 = 0 AND contains(path, '7') THEN NULL ELSE path END AS path, cast(CASE WHEN contains(path, '99') THEN 0 ELSE length(path) * 1000 END as bigint) AS length"


@query("verify_archive", oracle(f""", m AS (SELECT crop_path AS path FROM training UNION SELECT context_path FROM training WHERE context_path IS NOT NULL), l AS (SELECT {LISTING} FROM m)
SELECT count(*) AS images_expected, count(*) FILTER (l.length > 0) AS present, count(*) FILTER (l.length IS NULL) AS missing, count(*) FILTER (l.length = 0) AS empty,
 round(sum(l.length) / 1048576, 1) AS megabytes, count(*) FILTER (coalesce(l.length, 0) = 0) = 0 AS safe_to_purge FROM m LEFT JOIN l USING (path)""", "training"))
def verify_archive(spark, sf):
    m = TB.archive_manifest(table(spark, sf, "training"))
    return TB.verify_archive(m, m.selectExpr(*[x.strip() for x in LISTING.split(", cast(")][:1], "cast(" + LISTING.split(", cast(")[1]))


@query("purge_plan", oracle("""
SELECT path, min(reason) AS reason FROM (SELECT context_path AS path, 'context' AS reason FROM training WHERE context_path IS NOT NULL
 UNION ALL SELECT crop_path, 'approved crop' FROM training WHERE status = 'approved') GROUP BY path""", "training"))
def purge_plan(spark, sf):
    return TB.purge_plan(table(spark, sf, "training"))


@query("crop_manifest", oracle("""
SELECT job_id, row_idx, job_id || '/' || row_idx || '_field_' || substr(md5('الاسم الرباعي'), 1, 8) || '.png' AS crop_path, person AS label, 'pending' AS status FROM form_rows f
WHERE length(regexp_replace(person, '[^؀-ۿݐ-ݿa-zA-Z]', '', 'g')) >= 2 AND (part_key % 4 <> 0 OR supp_key % 3 = 0)""", "form_rows"))
def crop_manifest(spark, sf):
    r = table(spark, sf, "form_rows")
    c = r.select("job_id", "row_idx", F.lit("الاسم الرباعي").alias("field"), F.col("person").alias("value"), F.array_repeat(F.lit(1.0), 8).alias("polygon"))
    have = r.filter("part_key % 4 = 0").select("job_id", "row_idx", F.lit("الاسم الرباعي").alias("field"), F.when(F.col("supp_key") % 3 == 0, "pending").otherwise("verified").alias("status"))
    rows, _ = TB.crop_manifest(c, c.select("job_id", "field").distinct(), have, force=True)
    return rows.select("job_id", "row_idx", "crop_path", "label", "status")


@query("cascade_delete", oracle("""
, d AS (SELECT job_id, user_id FROM jobs WHERE order_key % 10 = 3)
SELECT 'form_rows' AS "table", 'deleted' AS effect, count(*) AS n FROM form_rows WHERE job_id IN (SELECT job_id FROM d)
UNION ALL SELECT 'ledger', 'nulled', count(*) FROM ledger WHERE job_id IN (SELECT job_id FROM d)""", "jobs", "form_rows", "ledger"))
def cascade_delete(spark, sf):
    gone = table(spark, sf, "jobs").filter("order_key % 10 = 3")
    _, counts = TB.cascade_delete(gone, "job_id", {"form_rows": (table(spark, sf, "form_rows"), "job_id")}, {"ledger": (table(spark, sf, "ledger"), "job_id")})
    return counts


@query("cascade_nulls", oracle("""
SELECT id, CASE WHEN job_id NOT IN (SELECT job_id FROM jobs WHERE order_key % 10 = 3) THEN job_id END AS job_id FROM ledger""", "jobs", "ledger"))
def cascade_nulls(spark, sf):
    gone = table(spark, sf, "jobs").filter("order_key % 10 = 3")
    out, _ = TB.cascade_delete(gone, "job_id", {}, {"ledger": (table(spark, sf, "ledger"), "job_id")})
    return out["ledger"].select("id", "job_id")


@query("audit_rows", oracle("""
SELECT 'u' || user_id AS actor_id, 'training.batch_labelled' AS action, 'training' AS target_type, cast(NULL as varchar) AS target_id,
 '{"requested":' || count(*) || ',"applied":' || count(*) FILTER (event_type <> 'error') || '}' AS details FROM events GROUP BY user_id"""))
def audit_rows(spark, sf):
    b = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("requested"), F.count_if(F.col("event_type") != "error").alias("applied"))
    return TB.audit_rows(b, F.concat(F.lit("u"), F.col("user_id").cast("string")), F.lit("training.batch_labelled"), "training", F.lit(None).cast("string"), F.struct("requested", "applied"))


# --- whole texts ---------------------------------------------------------------------------------------------------

def _viol(e, i):
    d = only(e)
    return f"""CASE WHEN {e} = '' THEN NULL WHEN length({d}) = 10 AND {d}[1:1] IN ('0', '5') THEN CASE WHEN NOT regexp_matches({d}, '{K.PHONE_OK}') THEN 'phone_fmt' END
 WHEN contains({e}, '/') OR regexp_matches({e}, '[0-9]{{4}}-[0-9]{{2}}') THEN CASE WHEN NOT regexp_matches({dig(e)}, '^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}$|^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN 'date_fmt' END
 WHEN {i} <= 3 AND NOT regexp_matches({e}, '^[؀-ۿ\\s‌‍،.]+$') THEN 'non_arabic' END"""


@query("annotate_line_violations", oracle(f"""
, l AS (SELECT doc_id, ln, li FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM doc_text), LATERAL (SELECT unnest(ls) AS ln, unnest(range(1, len(ls) + 1)) AS li)),
 c AS (SELECT doc_id, li, ci, trim(v) AS e FROM (SELECT *, string_split(ln, '|') AS cs FROM l WHERE contains(ln, '|')), LATERAL (SELECT unnest(cs) AS v, unnest(range(1, len(cs) + 1)) AS ci)),
 r AS (SELECT doc_id, li, string_agg('col' || ci || ':' || why || '(''' || e || ''')', ',' ORDER BY ci) AS why FROM (SELECT *, {_viol('e', 'ci')} AS why FROM c) WHERE why IS NOT NULL GROUP BY ALL)
SELECT l.doc_id, string_agg(CASE WHEN r.why IS NOT NULL THEN '[!] ' || ln || '  # validation:' || r.why ELSE ln END, chr(10) ORDER BY l.li) AS text FROM l LEFT JOIN r ON r.doc_id = l.doc_id AND r.li = l.li GROUP BY l.doc_id""", "doc_text"))
def annotate_line_violations(spark, sf):
    return textdocs.annotate_line_violations(table(spark, sf, "doc_text").select("doc_id", "text"))


def rules_sql(d):
    """A rule for every word of the benchmark items."""
    return f"SELECT {ar('w')} AS original_text, CASE WHEN item_id % 5 = 0 THEN '' ELSE 'ء' || item_id END AS corrected_text FROM ({d.words('item_id', 'text', 'benchmark')}) t"


@query("apply_text_rules", oracle(f"""
, ru AS (SELECT list({{'p': original_text, 'r': corrected_text, 'n': 0}} ORDER BY original_text, corrected_text) AS rules FROM (SELECT DISTINCT * FROM ({rules_sql(Duck)})) WHERE original_text <> '' AND length(regexp_replace(original_text, '[^0-9]', '', 'g')) < 7),
 d AS (SELECT doc_id, translate(text, 'یکہے۰۱۲۳۴۵۶۷۸۹', 'يكهي0123456789') AS text FROM doc_text)
SELECT doc_id, list_reduce(list_prepend({{'p': text, 'r': '', 'n': length(text)}}, rules), lambda a, b: {{'p': CASE WHEN contains(a.p, b.p) AND length(replace(a.p, b.p, b.r)) >= a.n * 0.7 THEN replace(a.p, b.p, b.r) ELSE a.p END, 'r': '', 'n': a.n}}).p AS text FROM d, ru""", "doc_text"))
def apply_text_rules(spark, sf):
    docs = table(spark, sf, "doc_text").select("doc_id", "text")
    return textdocs.apply_text_rules(docs, spark.sql(rules_sql(Spark)))


NAME_LINES = """, l AS (SELECT doc_id, n_rows, li, trim(regexp_replace(regexp_replace({digits}, '[/\\-.()\\[\\]:،,]', ' ', 'g'), '\\s+', ' ', 'g')) AS c FROM (SELECT doc_id, doc_id % 4 + 1 AS n_rows, string_split(text, chr(10)) AS ls FROM doc_text),
   LATERAL (SELECT unnest(ls) AS ln, unnest(range(1, len(ls) + 1)) AS li)),
 g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY li DESC) AS back FROM l WHERE c <> '' AND length(regexp_replace(replace(c, ' ', ''), '[^؀-ۿ]', '', 'g')) / length(replace(c, ' ', '')) >= 0.72 AND len(string_split(c, ' ')) BETWEEN 2 AND 7),
 sp AS (SELECT doc_id, n_rows, unnest(range(0, n_rows)) AS row_idx FROM (SELECT doc_id, doc_id % 4 + 1 AS n_rows FROM doc_text))""".replace("{digits}", "regexp_replace(ln, '[0-9]', '', 'g')")


@query("clean_name_list", oracle(NAME_LINES + """
SELECT sp.doc_id, cast(sp.row_idx as int) AS row_idx, coalesce(g.c, '') AS text FROM sp LEFT JOIN g ON g.doc_id = sp.doc_id AND g.back = sp.n_rows - sp.row_idx""", "doc_text"))
def clean_name_list(spark, sf):
    return textdocs.clean_name_list(table(spark, sf, "doc_text").withColumn("n_rows", F.col("doc_id") % 4 + 1))


@query("name_line_candidates", oracle("""
, l AS (SELECT doc_id, li, trim(ln) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM doc_text), LATERAL (SELECT unnest(ls) AS ln, unnest(range(1, len(ls) + 1)) AS li)),
 g AS (SELECT doc_id, li, trim(regexp_replace(regexp_replace(t, '[0-9|/\\\\\\-_()\\[\\]{}<>]', '', 'g'), '\\s+', ' ', 'g')) AS c FROM l WHERE length(t) >= 2 AND length(regexp_replace(replace(t, ' ', ''), '[^؀-ۿ]', '', 'g')) / length(replace(t, ' ', '')) >= 0.6)
SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY li) - 1 as int) AS row_idx, c AS text FROM g WHERE c <> '' AND len(string_split(c, ' ')) BETWEEN 1 AND 8""", "doc_text"))
def name_line_candidates(spark, sf):
    return textdocs.name_line_candidates(table(spark, sf, "doc_text"))


# every line of a text gets a number, some twice, and a few lines without one follow
NUMBERED = "array_join(transform(split(text, '\n'), (x, i) -> concat(i + 1 - int(i % 7 = 3), CASE i % 3 WHEN 0 THEN '. ' WHEN 1 THEN ') ' ELSE '- ' END, x)), '\n') || '\n3- فارغ\nx\n' || (doc_id % 3 + 1) || '. ' || source"
NUMBERED_DUCK = "array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: (i - CASE WHEN (i - 1) % 7 = 3 THEN 1 ELSE 0 END) || CASE (i - 1) % 3 WHEN 0 THEN '. ' WHEN 1 THEN ') ' ELSE '- ' END || x), chr(10)) || chr(10) || '3- فارغ' || chr(10) || 'x' || chr(10) || (doc_id % 3 + 1) || '. ' || source"


@query("parse_numbered_names", oracle(f"""
, l AS (SELECT doc_id, li, trim(ln) AS t FROM (SELECT doc_id, string_split({NUMBERED_DUCK}, chr(10)) AS ls FROM doc_text), LATERAL (SELECT unnest(ls) AS ln, unnest(range(1, len(ls) + 1)) AS li)),
 h AS (SELECT doc_id, li, cast(regexp_extract(t, '^([0-9]+)[.،\\-)]\\s*(.+)$', 1) as int) - 1 AS slot, trim(regexp_extract(t, '^([0-9]+)[.،\\-)]\\s*(.+)$', 2)) AS nm FROM l WHERE regexp_matches(t, '^([0-9]+)[.،\\-)]\\s*(.+)$')),
 b AS (SELECT doc_id, slot, last(CASE WHEN nm NOT IN ({csv(K.BLANK_NAME_WORDS)}) THEN nm END ORDER BY li) AS name FROM h GROUP BY ALL)
SELECT s.doc_id, cast(s.slot as int) AS slot, b.name FROM (SELECT doc_id, unnest(range(0, max(slot) + 1)) AS slot FROM b GROUP BY doc_id) s LEFT JOIN b USING (doc_id, slot)""", "doc_text"))
def parse_numbered_names(spark, sf):
    d = table(spark, sf, "doc_text").select("doc_id", F.expr(NUMBERED).alias("text"))
    return textdocs.parse_numbered_names(d)


KEYED = "'الاسم الكامل: ' || source || chr(10) || 'my name ' || lang || ': z' || chr(10) || 'رقم التواصل الخاص: 059' || (1000000 + doc_id) || chr(10) || 'العمر ' || (doc_id % 90 + 5) || chr(10) || text || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'ذكر' ELSE 'انثى' END || ' 0591' || (100000 + doc_id) || ' 20' || (10 + doc_id % 10) || '/1/17'"


@query("parse_key_values")
def parse_key_values(spark, sf):
    d = table(spark, sf, "doc_text").select("doc_id", F.expr(KEYED).alias("text"))
    return textdocs.parse_key_values(d)


ENGINES = """SELECT doc_id, 'azure' AS engine, doc_id % 3 <> 0 AS success, reverse(text) || ' y' AS text, cast(0 as bigint) AS tables FROM doc_text
 UNION ALL SELECT doc_id, 'vision', doc_id % 2 = 0, CASE WHEN doc_id % 12 = 0 THEN '' ELSE text END, 0 FROM doc_text
 UNION ALL SELECT doc_id, 'gemini', doc_id % 5 <> 0, text || ' x', 0 FROM doc_text UNION ALL SELECT doc_id, 'layout', true, '', doc_id % 7 FROM doc_text"""


@query("choose_engine", oracle(f""", e AS ({ENGINES}), sc AS (SELECT *, CASE WHEN trim(text) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) *
   (0.3 + 0.7 * (length(regexp_replace(text, '[^؀-ۿ]', '', 'g')) / length(replace(text, ' ', '')))) END AS score FROM e)
SELECT doc_id, arg_min(engine, CASE engine WHEN 'azure' THEN 1 WHEN 'vision' THEN 2 WHEN 'gemini' THEN 3 ELSE 4 END) FILTER (success AND CASE WHEN engine = 'layout' THEN tables > 0 ELSE score > 0 END) AS chosen,
 round(max(score), 4) AS best_score FROM sc GROUP BY doc_id""", "doc_text"))
def choose_engine(spark, sf):
    d = table(spark, sf, "doc_text")
    e = [d.select("doc_id", F.lit(n).alias("engine"), ok.alias("success"), t.alias("text"), k.cast("long").alias("tables")) for n, ok, t, k in (
        ("azure", F.col("doc_id") % 3 != 0, F.concat(F.reverse("text"), F.lit(" y")), F.lit(0)), ("vision", F.col("doc_id") % 2 == 0, F.when(F.col("doc_id") % 12 == 0, "").otherwise(F.col("text")), F.lit(0)),
        ("gemini", F.col("doc_id") % 5 != 0, F.concat("text", F.lit(" x")), F.lit(0)), ("layout", F.lit(True), F.lit(""), F.col("doc_id") % 7))]
    u = e[0].unionByName(e[1]).unionByName(e[2]).unionByName(e[3])
    return admin.choose_engine(u).withColumn("best_score", F.round("best_score", 4))


SOURCES = {"merged": "CASE WHEN doc_id % 4 = 0 THEN text END", "markdown": "CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE NULL END", "grid": "CASE WHEN doc_id % 5 = 1 THEN source END", "full": "text"}


@query("choose_text_source", oracle(f""", x AS (SELECT doc_id, {', '.join(f'{v} AS "{k}"' for k, v in SOURCES.items())} FROM doc_text)
SELECT doc_id, CASE WHEN trim(merged) <> '' THEN 'merged' WHEN trim(grid) <> '' THEN 'grid' ELSE 'full' END AS text_source, length(CASE WHEN trim(merged) <> '' THEN merged WHEN trim(grid) <> '' THEN grid ELSE "full" END) AS n FROM x""", "doc_text"))
def choose_text_source(spark, sf):
    d = table(spark, sf, "doc_text").select("doc_id", *[F.expr(v).alias(k) for k, v in SOURCES.items()])
    return admin.choose_text_source(d, list(SOURCES)).select("doc_id", "text_source", F.length("text").cast("long").alias("n"))


# --- layout ----------------------------------------------------------------------------------------------------------

def _layout_sql(poly):
    """Tables of the stand-in form: one per (order, page), one or two header rows, five columns, one row per line."""
    head = [("0", "0", "'#'", 1, 1, "true"), ("0", "1", "'الاسم'", "CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END", 1, "true"), ("0", "2", "'خط السير'", 1, 2, "true"),
            ("0", "4", "CASE WHEN k % 3 = 0 THEN NULL WHEN k % 3 = 1 THEN 'الاسم' ELSE 'رقم الهوية' END", 1, 1, "true"),
            ("1", "2", "'من'", 1, 1, "k % 2 = 0"), ("1", "3", "'إلى'", 1, 1, "k % 2 = 0"),
            ("1", "0", "'123456'", 1, 1, "k % 2 = 1")]
    arms = [f"SELECT 'j' || k AS job_id, page, cast(0 as int) AS table_id, cast({r} as bigint) AS r, cast({c} as int) AS c, {x} AS content, 'columnHeader' AS kind, cast({rs} as int) AS row_span, cast({cs} as int) AS column_span, k FROM tb WHERE {w}"
            for r, c, x, rs, cs, w in head]
    data = [(0, "serial"), (1, "person"), (2, "split_part(clean_name, ' ', 1)"), (3, "NULLIF(split_part(clean_name, ' ', 2), 'رود')"), (4, "idno")]
    arms += [f"SELECT job_id, cast(line_no % 2 + 1 as int), 0, row_idx + 2, {c}, {x}, '', 1, 1, order_key FROM form_rows" for c, x in data]
    union = "\n UNION ALL ".join(arms)
    return f"""tb AS (SELECT DISTINCT order_key AS k, cast(line_no % 2 + 1 as int) AS page FROM form_rows),
 lc0 AS ({union}), lc AS (SELECT *, r * 5 + c AS cell_ord, (CASE WHEN k % 4 = 1 THEN c ELSE 4 - c END) * 100.0 AS px, r * 40.0 AS py FROM lc0)"""


def _layout_cells(spark, sf):
    """Same rows as the SQL text, from one pass for the data rows and one for the headers."""
    rows = table(spark, sf, "form_rows")
    two = F.split_part("clean_name", F.lit(" "), F.lit(2))
    data = [F.col("serial"), F.col("person"), F.split_part("clean_name", F.lit(" "), F.lit(1)), F.nullif(two, F.lit("رود")), F.col("idno")]
    item = [F.struct(F.lit(c).alias("c"), x.alias("content"), F.lit("").alias("kind"), F.lit(1).alias("row_span"), F.lit(1).alias("column_span")) for c, x in enumerate(data)]
    page = (F.col("line_no") % 2 + 1).cast("int")
    body = rows.select("job_id", page.alias("page"), F.col("order_key").alias("k"), (F.col("row_idx") + 2).alias("r"), F.inline(F.array(*item)))
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") % 2 + 1).cast("int").alias("page")).distinct()
    even, k3 = F.col("k") % 2 == 0, F.col("k") % 3
    heads = [(0, 0, F.lit("#"), F.lit(1), 1, None), (0, 1, F.lit("الاسم"), F.when(even, 2).otherwise(1), 1, None), (0, 2, F.lit("خط السير"), F.lit(1), 2, None),
             (0, 4, F.when(k3 == 1, "الاسم").when(k3 == 2, "رقم الهوية"), F.lit(1), 1, None), (1, 2, F.lit("من"), F.lit(1), 1, even), (1, 3, F.lit("إلى"), F.lit(1), 1, even),
             (1, 0, F.lit("123456"), F.lit(1), 1, ~even)]
    hs = [F.when(F.lit(True) if w is None else w, F.struct(F.lit(r).cast("long").alias("r"), F.lit(c).alias("c"), x.alias("content"), F.lit("columnHeader").alias("kind"), rs.cast("int").alias("row_span"), F.lit(cs).alias("column_span")))
          for r, c, x, rs, cs, w in heads]
    head = li.select(F.concat(F.lit("j"), F.col("k").cast("string")).alias("job_id"), "page", "k", F.inline(F.filter(F.array(*hs), lambda h: h.isNotNull())))
    lc = head.unionByName(body).withColumn("table_id", F.lit(0)).withColumn("cell_ord", F.col("r") * 5 + F.col("c"))
    x, y = F.when(F.col("k") % 4 == 1, F.col("c")).otherwise(4 - F.col("c")) * 100.0, F.col("r") * 40.0
    return lc.select("job_id", "page", "table_id", "r", "c", "content", "kind", "row_span", "column_span", "cell_ord", F.array(x, y, x + 90, y, x + 90, y + 30, x, y + 30).alias("polygon"))


HEAD_SQL = f""", {_layout_sql(None)}, hc AS (SELECT DISTINCT job_id, page, table_id, k, cast(CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END as int) AS header_rows FROM lc)"""
PATH_SQL = HEAD_SQL + """, hp AS (SELECT job_id, page, table_id, cast(c as int) AS c, CASE c WHEN 0 THEN '#' WHEN 1 THEN 'الاسم' WHEN 2 THEN CASE WHEN k % 2 = 0 THEN 'خط السير - من' ELSE 'خط السير' END
  WHEN 3 THEN CASE WHEN k % 2 = 0 THEN 'خط السير - إلى' ELSE 'خط السير' END ELSE CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN 'الاسم' ELSE 'رقم الهوية' END END AS header, k FROM hc, range(5) t(c))"""


@query("header_row_count", oracle(HEAD_SQL + " SELECT job_id, page, header_rows FROM hc", "form_rows"))
def header_row_count(spark, sf):
    return layout.header_row_count(_layout_cells(spark, sf)).select("job_id", "page", "header_rows")


@query("header_paths", oracle(PATH_SQL + " SELECT job_id, page, c, header FROM hp", "form_rows"))
def header_paths(spark, sf):
    lc = _layout_cells(spark, sf)
    return together(spark, layout.header_paths(lc, layout.header_row_count(lc)).select("job_id", "page", "c", "header"))


@query("effective_headers", oracle(PATH_SQL + """
SELECT job_id, page, c, CASE WHEN header = '' THEN 'عمود ' || (c + 1) WHEN c = 4 AND k % 3 = 1 THEN 'الاسم (1)' WHEN c = 3 AND k % 2 = 1 THEN 'خط السير (1)' ELSE header END AS field FROM hp""", "form_rows"))
def effective_headers(spark, sf):
    lc = _layout_cells(spark, sf)
    return together(spark, layout.effective_headers(layout.header_paths(lc, layout.header_row_count(lc))).select("job_id", "page", "c", "field"))


STITCH_SQL = """, ta AS (SELECT job_id, page, table_id, k, cast(CASE WHEN page = 2 AND k % 5 = 0 THEN 4 ELSE 5 END as int) AS n_cols, count(DISTINCT r) FILTER (kind = '') AS data_rows FROM lc GROUP BY ALL),
 h2 AS (SELECT hp.*, lower(trim(translate(CASE WHEN page = 2 AND k % 10 = 0 THEN header || 'x' ELSE header END, 'أإآٱ', 'اااا'))) AS h FROM hp JOIN ta USING (job_id, page, table_id, k) WHERE hp.c < n_cols),
 mn AS (SELECT job_id, arg_min({'page': page, 'n': n_cols}, (-data_rows, page)) AS m FROM ta GROUP BY job_id)"""


def _stitch(spark, sf):
    lc = _layout_cells(spark, sf)
    k = F.substring("job_id", 2, 20).cast("long")
    cut = (F.col("page") == 2) & (k % 5 == 0)
    counts = saved(layout.header_row_count(lc))
    tabs = counts.select("job_id", "page", "table_id", "data_rows").withColumn("n_cols", F.when(cut, 4).otherwise(5))
    heads = layout.header_paths(lc, counts).filter(~cut | (F.col("c") < 4)).withColumn(
        "header", F.when((F.col("page") == 2) & (k % 10 == 0) & (F.col("header") != ""), F.concat("header", F.lit("x"))).otherwise(F.col("header")))
    return layout.stitch_pages(heads, tabs)


@query("stitch_verdicts", oracle(PATH_SQL + STITCH_SQL + """, sh AS (SELECT h.job_id, h.page, count(x.h) / count(*) AS share FROM h2 h LEFT JOIN (SELECT DISTINCT h2.job_id, h FROM h2 JOIN mn ON mn.job_id = h2.job_id AND mn.m.page = h2.page) x
   ON x.job_id = h.job_id AND x.h = h.h WHERE h.header <> '' GROUP BY ALL)
SELECT ta.job_id, ta.page, n_cols = mn.m.n OR share >= 0.6 AS included, n_cols = mn.m.n AS by_position FROM ta JOIN mn USING (job_id) JOIN sh ON sh.job_id = ta.job_id AND sh.page = ta.page""", "form_rows"))
def stitch_verdicts(spark, sf):
    return together(spark, _stitch(spark, sf)[1].drop("table_id"))


@query("stitch_columns")
def stitch_columns(spark, sf):
    return together(spark, _stitch(spark, sf)[0].drop("table_id"))


@query("reading_order", oracle(PATH_SQL + """, ex AS (SELECT job_id, page, c, avg(px) AS x, avg(py) AS y FROM lc GROUP BY ALL),
 en AS (SELECT job_id, page, CASE WHEN max(x) - min(x) >= max(y) - min(y) THEN arg_max(x, c) < arg_min(x, c) ELSE arg_max(y, c) < arg_min(y, c) END AS falls FROM ex GROUP BY ALL)
SELECT hp.job_id, hp.page, c, NOT falls AS flipped, cast(CASE WHEN falls THEN c ELSE 4 - c END as int) AS position FROM hp JOIN en ON en.job_id = hp.job_id AND en.page = hp.page""", "form_rows"))
def reading_order(spark, sf):
    lc = _layout_cells(spark, sf)
    h = layout.header_paths(lc, layout.header_row_count(lc))
    return together(spark, layout.reading_order(lc, h).select("job_id", "page", "c", "flipped", "position"))


@query("renumber_sequence", oracle("""
SELECT job_id, row_idx, '#' AS field, cast(row_number() OVER (PARTITION BY job_id ORDER BY row_idx) as varchar) AS value FROM form_rows UNION ALL SELECT job_id, row_idx, 'الاسم الرباعي', person FROM form_rows""", "form_rows"))
def renumber_sequence(spark, sf):
    return row_of(layout.renumber_sequence(cells(spark, sf, "serial", "person", rows=own_rows(spark, sf)))).select("job_id", "row_idx", "field", "value")


@query("sort_by_row_number", oracle("""
, g AS (SELECT job_id, count(*) = count(DISTINCT line_no) AS ok FROM form_rows GROUP BY job_id)
SELECT f.job_id, CASE WHEN ok THEN row_number() OVER (PARTITION BY f.job_id ORDER BY line_no) - 1 ELSE row_idx END AS row_idx, 'الاسم الرباعي' AS field, person AS value FROM form_rows f JOIN g ON g.job_id = f.job_id""", "form_rows"))
def sort_by_row_number(spark, sf):
    return layout.sort_by_row_number(cells(spark, sf, "serial", "person")).select("job_id", "row_idx", "field", "value")


@query("merge_duplicate_columns", oracle("""
SELECT job_id, row_idx, 'رقم الهاتف المحمول' AS field, coalesce(nullif(phone, ''), 'b' || supp_key) AS value FROM form_rows UNION ALL SELECT job_id, row_idx, 'تاريخ الموافقة', dob FROM form_rows
UNION ALL SELECT job_id, row_idx, 'الموافقة على البرنامج', nullif(approval, '') FROM form_rows""", "form_rows"))
def merge_duplicate_columns(spark, sf):
    r = own_rows(spark, sf)
    heads = [("رقم الهاتف المحمول", "nullif(phone, '')"), ("هاتف", "'b' || supp_key"), ("تاريخ الموافقة", "dob"), ("الموافقة على البرنامج", "nullif(approval, '')")]
    c = r.select("job_id", "row_idx", F.inline(F.array(*[F.struct(F.lit(h).alias("field"), F.lit(i).alias("col_idx"), F.expr(e).alias("value")) for i, (h, e) in enumerate(heads)])))
    return row_of(layout.merge_duplicate_columns(c)).select("job_id", "row_idx", "field", "value")


@query("order_columns_by_text", oracle("""
, t AS (SELECT job_id, CASE WHEN order_key % 3 = 0 THEN ['رقم الهاتف', 'الجنس', 'الاسم الرباعي'] WHEN order_key % 3 = 1 THEN ['الاسم الرباعي', 'رقم الهاتف', 'الجنس'] ELSE ['الجنس', 'الاسم الرباعي', 'رقم الهاتف'] END AS o FROM (SELECT DISTINCT job_id, order_key FROM form_rows))
SELECT job_id, cast(i - 1 as int) AS position, o[i] AS field FROM t, range(1, 4) r(i)""", "form_rows"))
def order_columns_by_text(spark, sf):
    r = table(spark, sf, "form_rows").select("job_id", "order_key").distinct()
    heads = r.select("job_id", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(i).alias("col_idx")) for i, f in enumerate(("الاسم الرباعي", "رقم الهاتف", "الجنس"))])))
    docs = r.select("job_id", F.expr("case when order_key % 3 = 0 then 'x الجنس\\nرقم الهاتف الجنس الاسم الرباعي' when order_key % 3 = 1 then 'الجنس' else 'الجنس الاسم الرباعي' end").alias("text"))
    return layout.order_columns_by_text(heads, docs).select("job_id", "position", "field")


EDIT = "supp_key % 20 = 3"


@query("fill_column_down", oracle(f"""
, c AS (SELECT job_id, row_idx, 'العنوان' AS field, nullif(place, '') AS value, CASE WHEN {EDIT} THEN 'edit ' || supp_key END AS ed FROM form_rows),
 d AS (SELECT *, last_value(ed IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fill FROM c)
SELECT job_id, row_idx, field, coalesce(ed, value, fill) AS value FROM d UNION ALL SELECT job_id, row_idx, 'رقم الهاتف', nullif(phone, '') FROM form_rows""", "form_rows"))
def fill_column_down(spark, sf):
    r = table(spark, sf, "form_rows")
    e = r.filter(EDIT).select("job_id", "row_idx", F.explode(F.array(F.lit("العنوان"), F.lit("رقم الهاتف"))).alias("field"), F.concat(F.lit("edit "), F.col("supp_key").cast("string")).alias("new_value"))
    return layout.fill_column_down(cells(spark, sf, "place", "phone"), e).select("job_id", "row_idx", "field", "value")


@query("diff_edits", oracle("""
SELECT job_id, row_idx, 'الاسم الرباعي' AS field, person AS original_value, clean_name AS corrected_value FROM form_rows WHERE person IS DISTINCT FROM clean_name""", "form_rows"))
def diff_edits(spark, sf):
    r = own_rows(spark, sf)
    a = cells(spark, sf, "person", rows=r)
    b = r.select("job_id", "row_idx", F.lit("الاسم الرباعي").alias("field"), F.col("clean_name").alias("value"))
    return row_of(layout.diff_edits(a, b))


def _words(spark, sf):
    r = table(spark, sf, "form_rows")
    tok = F.posexplode(F.split("clean_name", " ")).alias("i", "content")
    w = r.select("job_id", (F.col("line_no") % 2 + 1).cast("int").alias("page"), "row_idx", "order_key", tok)
    x = F.when(F.col("order_key") % 4 == 1, 100.0).otherwise(300.0) + F.col("i") * 22 + 5
    y = (F.col("row_idx") + 2) * 40.0 + F.col("i") * 12 - 3
    box = lambda s_: F.array(x * s_, y * s_, (x + 10) * s_, y * s_, (x + 10) * s_, (y + 6) * s_, x * s_, (y + 6) * s_)
    return w.select("job_id", F.lit("vision").alias("engine"), "page", (F.col("row_idx") * 8 + F.col("i")).alias("word_idx"), "content", box(F.lit(144.0)).alias("polygon"))


@query("assign_words_to_cells", oracle(HEAD_SQL + """, w AS (SELECT job_id, cast(line_no % 2 + 1 as int) AS page, row_idx * 8 + i AS word_idx, tk[i + 1] AS content, CASE WHEN order_key % 4 = 1 THEN 100.0 ELSE 300.0 END + i * 22 + 10 AS cx, (row_idx + 2) * 40.0 + i * 12 AS cy
   FROM (SELECT *, string_split(clean_name, ' ') AS tk FROM form_rows), LATERAL (SELECT unnest(range(0, len(tk))) AS i)),
 m AS (SELECT w.*, lc.r, lc.c, row_number() OVER (PARTITION BY w.job_id, w.page, w.word_idx ORDER BY cell_ord) AS rn FROM w JOIN lc ON lc.job_id = w.job_id AND lc.page = w.page AND cx BETWEEN px - 0.04 AND px + 90.04 AND cy BETWEEN py - 0.04 AND py + 30.04)
SELECT job_id, page, r, c, string_agg(content, ' ' ORDER BY word_idx) AS text FROM m WHERE rn = 1 GROUP BY ALL""", "form_rows"))
def assign_words_to_cells(spark, sf):
    words = _words(spark, sf)
    pages = table(spark, sf, "lineitem").select(F.concat(F.lit("j"), F.col("l_orderkey").cast("string")).alias("job_id"), (F.col("l_linenumber") % 2 + 1).cast("int").alias("page")).distinct()
    scale = pages.select("job_id", F.lit("vision").alias("engine"), "page", F.lit(1 / 144).alias("sx"), F.lit(1 / 144).alias("sy"))
    return together(spark, layout.assign_words_to_cells(words, _layout_cells(spark, sf), scale).drop("engine"))


GAP_BOX = """SELECT job_id, line_no AS page, row_idx * 4 + c AS cell_id, c * 1e2 + supp_key % 17 AS x0, (part_key % 40) * 4e1 + supp_key % 5 AS y0, c * 1e2 + 80 + supp_key % 40 AS x1, (part_key % 40) * 4e1 + 36 + part_key % 9 AS y1
 FROM form_rows, {r}"""


@query("neighbour_gaps", oracle(f""", b AS ({GAP_BOX.format(r='range(4) t(c)')}), p AS (SELECT *, 12 + (x1 - x0) * 3e-2 AS px, 10 + (y1 - y0) * 3e-2 AS pt, 18 + (y1 - y0) * 3e-2 AS pb FROM b),
 g AS (SELECT p.job_id, p.page, p.cell_id, p.x0, p.y0, p.x1, p.y1, p.px, p.pt, p.pb,
   min(CASE WHEN least(p.y1, n.y1) > greatest(p.y0, n.y0) AND n.x0 + n.x1 < p.x0 + p.x1 THEN p.x0 - n.x1 END) AS gl, min(CASE WHEN least(p.y1, n.y1) > greatest(p.y0, n.y0) AND n.x0 + n.x1 >= p.x0 + p.x1 THEN n.x0 - p.x1 END) AS gr,
   min(CASE WHEN least(p.x1, n.x1) > greatest(p.x0, n.x0) AND n.y0 + n.y1 < p.y0 + p.y1 THEN p.y0 - n.y1 END) AS gt, min(CASE WHEN least(p.x1, n.x1) > greatest(p.x0, n.x0) AND n.y0 + n.y1 >= p.y0 + p.y1 THEN n.y0 - p.y1 END) AS gb
  FROM p LEFT JOIN b n ON n.job_id = p.job_id AND n.page = p.page AND NOT (abs(n.x0 - p.x0) < 1 AND abs(n.y0 - p.y0) < 1) GROUP BY ALL)
SELECT job_id, cast(page as bigint) AS page, cell_id, cast(greatest(0, floor(x0 - CASE WHEN gl IS NULL THEN px ELSE least(px, greatest(0, gl / 2)) END)) as bigint) AS "left",
 cast(greatest(0, floor(y0 - CASE WHEN gt IS NULL THEN pt ELSE least(pt, greatest(0, gt / 2)) END)) as bigint) AS top,
 cast(least(2000, ceil(x1 + CASE WHEN gr IS NULL THEN px ELSE least(px, greatest(0, gr / 2)) END)) as bigint) AS "right",
 cast(least(2000, ceil(y1 + CASE WHEN gb IS NULL THEN pb ELSE least(pb, greatest(0, gb / 2)) END)) as bigint) AS bottom FROM g""", "form_rows"))
def neighbour_gaps(spark, sf):
    r = table(spark, sf, "form_rows").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(3))))
    x0, y0 = F.col("c") * 100.0 + F.col("supp_key") % 17, (F.col("part_key") % 40) * 40.0 + F.col("supp_key") % 5
    x1, y1 = F.col("c") * 100.0 + 80 + F.col("supp_key") % 40, (F.col("part_key") % 40) * 40.0 + 36 + F.col("part_key") % 9
    b = r.select("job_id", F.col("line_no").cast("long").alias("page"), (F.col("row_idx") * 4 + F.col("c")).alias("cell_id"), F.array(x0, y0, x1, y0, x1, y1, x0, y1).alias("polygon"),
                 F.lit(20.0).alias("page_w_in"), F.lit(20.0).alias("page_h_in"), F.lit(100).alias("dpi"), F.lit(0.01).alias("unit_scale"))
    out = layout.neighbour_gaps(b)
    return together(spark, out.select("job_id", "page", "cell_id", *[F.col(c).cast("long").alias(c) for c in ("left", "top", "right", "bottom")]))


@query("page_extents", oracle(HEAD_SQL + """
SELECT job_id, page, cast(max(px) + 90 as double) AS max_x, cast(max(py) + 30 as double) AS max_y, count(*) AS polygons, CASE WHEN page = 1 THEN cast(850 as double) END AS width, CASE WHEN page = 1 THEN round(1700.0 / 850 / 200, 6) END AS unit_scale FROM lc GROUP BY ALL""", "form_rows"))
def page_extents(spark, sf):
    lc = _layout_cells(spark, sf)
    pages = lc.filter("page = 1").select("job_id", "page").distinct().withColumn("width", F.lit(850.0)).withColumn("height", F.lit(1100.0)).withColumn("angle", F.lit(0.0))
    return layout.page_extents(lc, pages).select("job_id", "page", "max_x", "max_y", "polygons", "width", F.round("unit_scale", 6).alias("unit_scale"))


@query("spatial_name_rows", oracle("""
, l AS (SELECT job_id, line_no AS page, row_idx, CASE supp_key % 5 WHEN 0 THEN 'الاسم ' || person WHEN 1 THEN person || ' 12345' WHEN 2 THEN split_part(person, ' ', 1) || ' / ' || split_part(person, ' ', 2) ELSE person END AS content,
   (supp_key % 9) * 100.0 AS cx, (part_key % 50) * 40.0 AS cy FROM form_rows),
 f AS (SELECT *, len([t for t in string_split(content, ' ') if length(regexp_replace(t, '[^؀-ۿ]', '', 'g')) >= 2]) AS nw FROM l WHERE cx >= 580 AND NOT contains(content, 'الاسم ') AND length(regexp_replace(content, '[^0-9]', '', 'g')) <= 4)
SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY page, cy, row_idx) - 1 AS row_idx, page, content FROM f WHERE nw >= 2 AND (NOT contains(content, '/') OR nw >= 3)""", "form_rows"))
def spatial_name_rows(spark, sf):
    r = table(spark, sf, "form_rows")
    k = F.col("supp_key") % 5
    p1, p2 = F.split_part("person", F.lit(" "), F.lit(1)), F.split_part("person", F.lit(" "), F.lit(2))
    content = F.when(k == 0, F.concat(F.lit("الاسم "), "person")).when(k == 1, F.concat("person", F.lit(" 12345"))).when(k == 2, F.concat(p1, F.lit(" / "), p2)).otherwise(F.col("person"))
    cx, cy = (F.col("supp_key") % 9) * 100.0, (F.col("part_key") % 50) * 40.0
    lines = r.select("job_id", F.col("line_no").alias("page"), F.col("row_idx").alias("line_no"), content.alias("content"), F.array(cx - 5, cy - 5, cx + 5, cy - 5, cx + 5, cy + 5, cx - 5, cy + 5).alias("polygon"))
    pages = lines.select("job_id", "page").distinct().withColumn("width", F.lit(1000.0))
    return layout.spatial_name_rows(lines, pages)
