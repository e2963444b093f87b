"""Form operators read their cells once, measure a value only where it is asked for, and keep rows of one key apart."""

from pyspark.sql import functions as F

from gridmend.operators import audit, evaluate, layout, reconcile, standardize
from gridmend.plans import standins
from gridmend.sources import sinks

CELLS = "job_id string, row_idx long, field string, col_idx int, value string"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _leaves(df):
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def _cells(spark):
    return spark.createDataFrame([("a", 1, "رقم الهاتف", 1, "12"), ("a", 1, "الاسم", 0, "سارة علي"), ("a", 2, "الاسم", 0, "x"), ("b", 1, "رقم الهاتف", 1, "0591234567"),
                                  ("a", 1, "تاريخ", 2, "1/2/2001"), ("a", 2, "تاريخ", 2, "2.1.1"), ("b", 1, "تاريخ", 2, "soon"), ("b", 1, "رقم الهوية", 3, "77")], CELLS)


def test_own_roles_give_what_classified_ones_give(spark):
    c = _cells(spark)
    key = lambda df: sorted((r.job_id, r.row_idx, r.field, r.issue, r.found) for r in df.collect())
    assert key(audit.audit_cells(c)) == key(audit.audit_cells(c, standardize.classify_columns(c)))
    assert sorted(x[3] for x in key(audit.audit_cells(c))) == ["date_format", "id_format", "name_incomplete", "phone_format"]


def test_audit_summary_reads_anomalies_once(spark):
    c = _cells(spark)
    an = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", 1, "x")], "job_id string, row_idx long, issue string")
    out = audit.audit_summary(an, c)
    assert {(r.job_id, r.issue, r.anomaly_count, r.rows_clean) for r in out.collect()} == {("a", None, 3, 1), ("a", "x", 2, 1), ("a", "y", 1, 1), ("b", None, 0, 1), (None, None, 3, 2)}
    assert _leaves(out) == 2


def test_name_columns_read_the_profile_once(spark):
    out = audit.detect_name_columns(audit.profile_columns(_cells(spark), serial=False))
    assert _leaves(out) == 1 and {(r.job_id, r.field) for r in out.collect()} == {("a", "الاسم")}


def test_pairs_of_one_key_are_judged_apart(spark):
    pairs = spark.createDataFrame([("k", "سارة | 1", "سارة خالد | 1"), ("k", "سارة | 1", "سارة منىل | 1")], "pair_id string, orig string, corr string")
    out = reconcile.gate_line_corrections(pairs, spark.createDataFrame([("خالد",)], "name string"))
    assert {(r.corr, r.reason) for r in out.collect()} == {("سارة خالد | 1", "ok"), ("سارة منىل | 1", "unverified_token")}


def test_cells_of_one_name_have_their_own_handwriting(spark):
    cells = spark.createDataFrame([("a", 1, 0, 0, [(0, 40)], "p"), ("a", 1, 0, 0, [(0, 40)], "q"), ("a", 1, 0, 1, [], "r"), ("a", 1, 0, 2, [(2000, 100)], "s")],
                                  "job_id string, page int, table_id int, cell_ord int, spans array<struct<offset: int, length: int>>, content string")
    styles = spark.createDataFrame([("a", 0, 10), ("a", 2000, 2090)], "job_id string, start int, end int")
    got = {r.content: r.handwritten for r in layout.handwritten_cells(cells, styles).collect()}
    assert got == {"p": False, "q": False, "r": False, "s": True}


def test_equal_readings_are_scored_once(spark):
    rows = [("ab cd", "ab cd", True, 0)] * 3 + [("ab cd", "ab xx", False, 1)]
    out = evaluate.evaluate_readings(spark.createDataFrame(rows, "truth string, pick string, agree boolean, unknown long"))
    r = out.first()
    assert (r.n, r.exact, r.words, r.words_ok, r.one_word_off, r.unknown_wrong) == (4, 3, 8, 7, 4, 1.0) and r.cer == 0.1
    assert _plan(out).count("Aggregate [") == 2


def test_each_pin_meets_a_header_once(spark):
    c = spark.createDataFrame([("a", 0, "رقم", 0, ""), ("a", 0, "اسم الجوال", 1, ""), ("a", 0, "هاتف", 2, ""), ("a", 0, "ميلاد", 3, "")], CELLS)
    out = sinks.column_order(c)
    assert [r.field for r in out.orderBy("position").collect()] == ["اسم الجوال", "هاتف", "ميلاد", "رقم"]
    assert _plan(out).count(f", {sinks.PINNED[0]})") + _plan(out).count(f"RLIKE {sinks.PINNED[0]}") == 1


def test_only_rows_that_may_swap_are_gathered(spark):
    c = spark.createDataFrame([("a", 1, "اسم", 0, "0591234567"), ("a", 1, "هاتف", 1, "سارة"), ("a", 2, "اسم", 0, "علي"), ("a", 2, "هاتف", 1, "x")], CELLS)
    out = standardize.swap_misplaced(c)
    assert {(r.row_idx, r.field, r.value) for r in out.collect()} == {(1, "اسم", "سارة"), (1, "هاتف", "0591234567"), (2, "اسم", "علي"), (2, "هاتف", "x")}
    assert "LeftSemi" in _plan(out)


def test_cells_without_a_reader_are_pruned(spark):
    rows = spark.range(2).select(F.lit("j").alias("job_id"), F.col("id").alias("row_idx"), F.lit(" ").alias("person"), F.upper(F.col("id").cast("string")).alias("phone"))
    c = standins.cells(spark, "", "person", "phone", rows=rows)
    assert sorted((r.field, r.col_idx, r.value) for r in c.filter("row_idx = 0").collect()) == sorted([(standins.HEADER["person"], 1, None), (standins.HEADER["phone"], 2, "0")], key=lambda x: x[0])
    assert "upper" not in _plan(c.select("field").distinct())
