"""Literal cases for value, header, place and layout rules."""

import pytest
from pyspark.sql import functions as F

from gridmend.functions import text as T
from gridmend.operators import audit, layout, resolve, textdocs
from gridmend.operators import corrections as C
from gridmend.operators import standardize as S
from gridmend.sources import documents as D
from gridmend.sources import sinks, tables

CELL = "job_id string, row_idx long, field string, col_idx int, value string"


def one(spark, field, values):
    return spark.createDataFrame([("j", i, field, 0, v) for i, v in enumerate(values)], CELL)


def values(df):
    return [r.value for r in sorted(df.collect(), key=lambda r: r.row_idx)]


@pytest.mark.parametrize("raw,want", [("0591112223", "0591112223"), ("591112223", "0591112223"), ("2591112223", "0591112223"), ("+970 591112223", "+970591112223"),
                                      ("٠٥٩١١١٢٢٢٣", "0591112223"), ("---", None), ("12", "12")])
def test_grid_phone(spark, raw, want):
    assert values(S.standardize_phones(one(spark, "رقم الهاتف", [raw]))) == [want]


def test_id_keeps_mask(spark):
    assert values(S.standardize_ids(one(spark, "رقم الهوية", ["960 *** 549", "abc"]))) == ["960***549", None]


@pytest.mark.parametrize("raw,want", [("2.8/7/1", "2008/7/1"), ("26-22008", "2008/2/26"), ("2006-13-5", "2006/5/13"), ("13/6/2006", "2006/6/13"), ("6/13/2006", "2006/6/13"), ("40/40/2006", "40/40/2006"), ("؟", "؟")])
def test_grid_date(spark, raw, want):
    assert values(S.standardize_dates(one(spark, "تاريخ الميلاد", [raw]))) == [want]


@pytest.mark.parametrize("raw,want", [("15-5-2005", "2005/5/15"), ("5.15.2005", "2005/5/15"), ("198K4/1/2", "1984/1/2"), ("none", "none")])
def test_text_date(spark, raw, want):
    assert values(S.standardize_dates(one(spark, "تاريخ الميلاد", [raw]), "text")) == [want]


def test_fixed_choice(spark):
    got = values(S.recode_fixed_choice(one(spark, "الجنس", ["ذكر", "أنتى", "زلر", "8", "✓", "✓ نعم", "أنثى أنثى", "FEMALE"])))
    assert got == ["ذكر", "أنثى", "ذكر", None, "✓", None, "أنثى", "أنثى"]
    assert values(S.recode_fixed_choice(one(spark, "هل لديك إعاقة", ["لحم", "كلا", "podéis!"]))) == ["نعم", "لا", None]
    assert values(S.recode_fixed_choice(one(spark, "تاريخ الموافقة", ["1/2/2020"]))) == ["1/2/2020"]


def test_signature_dates_are_not_dates(spark):
    c = one(spark, "تاريخ اليوم (1)", ["سعيد", "هدى"])
    assert audit.audit_cells(c, S.classify_columns(c)).count() == 0


def test_grand_total_parity_and_strict(spark):
    rows = [("2", "3", "6"), ("1", "4", "4"), ("", "", "10")]
    c = spark.createDataFrame([("j", i, f, k, r[k]) for i, r in enumerate(rows) for k, f in enumerate(("سعر", "كمية", "مجموع"))], CELL)
    roles = S.classify_columns(c)
    assert [r.issue for r in audit.reconcile_totals(c, roles)[0].collect()] == ["grand_total_mismatch"]
    assert audit.reconcile_totals(c, roles, strict=True)[0].count() == 0


def test_places(spark):
    places = spark.createDataFrame([("دير البلح", 0), ("الوسطى", 1), ("غزة", 2), ("النصر", 3), ("خانيونس", 4)], "canonical string, ord long")
    variants = spark.createDataFrame([("خانونس", "خانيونس", 4)], "variant_folded string, canonical string, ord long")
    v = spark.createDataFrame([(x,) for x in ("الوسطي", "الوسطى", "خانونس", "دير البلج", "غزة - النص", "قطر")], "value string")
    got = {r.value: r.after for r in resolve.correct_places(v, places, variants).collect()}
    assert got == {"الوسطي": "الوسطى", "خانونس": "خانيونس", "دير البلج": "دير البلح", "غزة - النص": "غزة - النصر"}


def test_learned_rule_never_reopens_a_choice(spark):
    rules = spark.createDataFrame([("آنثى", "انثى", 1, "a"), ("رياض", "رياضي", 2, "b"), ("محمود", "سمير", 3, "c")], "original_text string, corrected_text string, created_at int, id string")
    own = spark.createDataFrame([("الاسم", "", "مجهول", 1, "x")], "field_name string, original_value string, corrected_value string, created_at int, id string")
    cells = spark.createDataFrame([("j", 0, "الجنس", 0, "أنثى"), ("j", 1, "الاسم", 1, "رياض احمد"), ("j", 2, "الاسم", 1, None), ("j", 3, "الاسم", 1, "محمود علي")], CELL)
    assert values(C.apply_corrections(cells, rules, own)) == ["أنثى", "رياضي احمد", "مجهول", "محمود علي"]


LC = "job_id string, page int, table_id int, r long, c int, content string, kind string, row_span int, column_span int, cell_ord long"


def grid(spark, head, rows):
    out, o = [], 0
    for r, c, t, rs, cs in head:
        out.append(("j", 1, 0, r, c, t, "columnHeader", rs, cs, o)); o += 1
    for r, c, t in rows:
        out.append(("j", 1, 0, r, c, t, "", 1, 1, o)); o += 1
    return spark.createDataFrame(out, LC)


def test_two_tier_header(spark):
    g = grid(spark, [(0, 0, "A", 2, 1), (0, 1, "B", 1, 2), (1, 1, "x", 1, 1), (1, 2, "y", 1, 1)], [(2, 0, "1"), (2, 1, "2"), (2, 2, "3")])
    n = layout.header_row_count(g)
    assert n.first().header_rows == 2
    assert [r.header for r in sorted(layout.header_paths(g, n).collect(), key=lambda r: r.c)] == ["A", "B - x", "B - y"]


def test_tall_header_and_long_digits(spark):
    tall = grid(spark, [(0, 0, "A", 2, 1)], [(1, 0, "x"), (2, 0, "y")])
    assert layout.header_row_count(tall).first().header_rows == 1
    digits = grid(spark, [(0, 0, "A", 1, 1), (1, 0, "٤٠٧٩٤١٣٧٦", 1, 1)], [(2, 0, "x")])
    assert layout.header_row_count(digits).first().header_rows == 1
    assert layout.header_row_count(grid(spark, [(0, 0, "A", 1, 1)], [])).first().header_rows == 0


def test_blank_and_repeated_headers(spark):
    h = spark.createDataFrame([("j", 1, 0, i, x) for i, x in enumerate(["", "a", "a", "", "a"])], "job_id string, page int, table_id int, c int, header string")
    got = [r.field for r in sorted(layout.effective_headers(h).collect(), key=lambda r: r.c)]
    assert got == ["عمود 1", "a", "a (1)", "عمود 4", "a (2)"]


def test_selection_marks(spark):
    df = spark.createDataFrame([(":selected:",), ("لا :selected:",), ("X",), (None,)], "v string")
    assert [r[0] for r in df.select(S.clean_selection_marks(F.col("v"))).collect()] == ["", "لا", "X", ""]


def test_key_values(spark):
    text = "الاسم الكامل: هدى\nname: x\nرقم التواصل: 0591112223\nالعمر 25 سنة\nأنثى 0561112223"
    got = {(r.field_name, r.value) for r in textdocs.parse_key_values(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()}
    assert got == {("الاسم", "هدى"), ("رقم الهاتف", "0591112223"), ("رقم الهاتف", "0561112223"), ("العمر", "25"), ("الجنس", "أنثى"), ("النص الكامل", text)}


def test_text_rules_in_chunks_equal_one_chunk(spark):
    docs = spark.createDataFrame([(1, "aa bb cc dd ee ff")], "doc_id int, text string")
    rules = spark.createDataFrame([(x * 2, x.upper()) for x in "abcdef"] + [("0591234567", "x")], "original_text string, corrected_text string")
    one_, many = (textdocs.apply_text_rules(docs, rules, chunk=n).first().text for n in (100, 2))
    assert one_ == many


def test_ordinal_is_independent_of_blocks(spark):
    from gridmend.functions.distributed import block_of, ordinal
    df = spark.range(500).selectExpr("'k' || (id % 2) as k", "id * 7 % 1009 as pos")
    a = {(r.k, r.pos): r.o for r in ordinal(df, ["k"], ["pos"], [block_of("pos", 16)], "o").collect()}
    b = {(r.k, r.pos): r.o for r in ordinal(df.repartition(3), ["k"], ["pos"], [block_of("pos", 1 << 20)], "o").collect()}
    assert a == b and sorted(v for (k, _), v in a.items() if k == "k0") == list(range(250))


def test_versioned_upsert(spark, tmp_path):
    root = str(tmp_path / "t")
    v0 = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, ts int")
    v1 = spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "id int, v string, ts int")
    assert tables.versioned_upsert(spark, root, v0, ["id"], ["ts"]) == 0
    assert tables.versioned_upsert(spark, root, v1, ["id"], ["ts"]) == 1
    tables.versioned_upsert(spark, root, v1, ["id"], ["ts"])
    assert {tuple(r) for r in tables.read_current(spark, root).collect()} == {(1, "a", 1), (2, "c", 2), (3, "d", 2)}


def test_label_export(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "q"\nb', None, 2, "approved"), ("0", "x", "y", 1, "approved"), ("2", "z", "z", 3, "pending")], "id string, label string, ocr_output string, created_at int, status string")
    sinks.export_labels_csv(df, str(tmp_path / "o"), "approved", ["id", "label", "ocr_output"])
    files = sorted((tmp_path / "o").glob("part-*"))
    assert "".join(f.read_text() for f in files).splitlines() == ["id,label,ocr_output", '"0","x","y"', '"1","a ""q"" b",']


def test_layout_file(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"job_id":"j","page_offset":2,"pages":[{"page":1,"width":8.0,"height":11.0,"angle":0.0}],"tables":[{"row_count":1,"column_count":1,"cells":[{"r":0,"c":0,"content":"x","page":1,"polygon":[0,0,1,0,1,1,0,1]}]}]}')
    cells, pages = D.explode_layout(D.read_layout(spark, str(tmp_path)))
    assert cells.first().page == 3 and pages.first().page == 3
