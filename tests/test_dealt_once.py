"""Rows are dealt no more often than a query needs, and what it needs again is written once."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridmend.operators import audit, layout, reconcile
from gridmend.plans import standins

DATA = "/root/testdata/sf0.001"


def plans(spark, name):
    q = entry.queries()[name](spark, DATA)._jdf.queryExecution()
    return q.optimizedPlan().toString(), q.executedPlan().toString()


def dealt(plan):
    return [re.sub(r"#\d+L?", "", x) for x in re.findall(r"Exchange hashpartitioning\((.*?)\)", plan)]


def test_part_texts_are_not_dealt_with_their_lines(spark):
    # Lines meet their buyers first, so no exchange lies between the part's texts and form_rows
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = standins.table(spark, DATA, "form_rows").select("clean_name")._jdf.queryExecution().executedPlan().toString()
        keys = dealt(plan)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "l_orderkey, 4" in keys and keys.index("l_partkey, 4") < keys.index("l_orderkey, 4")


@pytest.mark.parametrize("name", ["assign_words_to_cells", "neighbour_gaps"])
def test_boxes_are_dealt_by_page_alone(spark, name):
    # grid bins are compared where the page lies
    assert not [keys for keys in dealt(plans(spark, name)[1]) if "bx" in keys or "word_idx" in keys or "cell_id" in keys]


def test_headers_are_read_off_few_cells(spark, tmp_path):
    # Header rows are counted once and cells below them are left out where they are read
    rows = [("a", 1, 0, r, c, f"{r}{c}", "columnHeader" if r == 0 else "", 1, 1, r * 5 + c) for r in range(40) for c in range(3)]
    rows += [("b", 1, 0, 0, 0, "x", "", 1, 1, 0), ("b", 1, 0, 1, 1, "y", "", 1, 2, 1)]
    spark.createDataFrame(rows, "job_id string, page int, table_id int, r int, c int, content string, kind string, row_span int, column_span int, cell_ord int").write.parquet(f"{tmp_path}/cells")
    cells = spark.read.parquet(f"{tmp_path}/cells")
    paths = layout.header_paths(cells, layout.header_row_count(cells))
    plan = paths._jdf.queryExecution().optimizedPlan().toString()
    assert "columnHeader" not in plan and re.search(r"\(r#\d+ < 1\)", plan)
    assert sorted((r.job_id, r.c, r.header) for r in paths.collect()) == [("a", 0, "00"), ("a", 1, "01"), ("a", 2, "02"), ("b", 0, "x"), ("b", 1, ""), ("b", 2, "")]


def test_long_and_short_documents_settle_handwriting_alike(spark):
    # documents with many ranges meet block by block, all others take their ranges along
    def styles(job, n):
        return [(job, i * 30, i * 30 + 10 + i % 13) for i in range(n)]
    cell = [(i, [(i * 37, 25), (i * 37 + 1000, 40)] if i % 5 else []) for i in range(60)]
    cells = spark.createDataFrame([(j, i, s) for j in ("few", "many", "none", None) for i, s in cell], "job_id string, cell_ord int, spans array<struct<offset: int, length: int>>")
    ranges = spark.createDataFrame(styles("few", 60) + styles("many", 200), "job_id string, start int, end int")
    got = {(r.job_id, r.cell_ord): r.handwritten for r in layout.handwritten_cells(cells, ranges).collect()}
    want = {(r.job_id, r.cell_ord): r.handwritten for r in layout.handwritten_by_block(cells, ranges).collect()}
    assert got == want and len(got) == 240 and {got[k] for k in got if k[0] == "many"} == {True, False}
    short = layout.handwritten_cells(cells, ranges.filter("job_id = 'few'"))
    assert [k for k in dealt(short._jdf.queryExecution().executedPlan().toString()) if "__row" in k] == []


def test_both_readings_of_a_line_stay_together(spark):
    # readings of one line are not joined to each other again, and lines need no number of their own
    optimized, _ = plans(spark, "merge_tables")
    assert "FullOuter" not in optimized and "Window" not in optimized
    pairs = spark.createDataFrame([("d", 0, 0, "الاسم", "الاسم"), ("d", 1, 0, "احمد", "أحمد"), ("d", 1, 0, "x", ""), ("d", 0, 1, "رقم", "رقم"), ("d", 1, 1, "1", "2")],
                                  "doc_id string, row_idx long, col_idx int, a string, b string")
    names = spark.createDataFrame([("احمد", "given")], "name string, kind string")
    got = sorted((r.row_idx, r.col_idx, r.col_type, r.came_from or "") for r in reconcile.merge_aligned(pairs, names).collect())
    assert [g[:2] for g in got] == [(0, 0), (0, 1), (1, 0), (1, 0), (1, 1)] and got[2][3] == "azure"


@pytest.mark.parametrize("name", ["accept_repairs", "repair_stats"])
def test_repairs_stay_with_their_cells(spark, name):
    # an anomaly takes its cell's value and its reply along
    optimized, _ = plans(spark, name)
    assert "Window" not in optimized and "LeftOuter" not in optimized


def test_columns_are_profiled_in_one_pass(spark):
    # the order of serial numbers is checked in the aggregate that makes the profile
    optimized, _ = plans(spark, "profile_columns")
    assert "Window" not in optimized and optimized.count("LeftSemi") == 0
    cells = spark.createDataFrame([("a", i, "n", str(v)) for i, v in enumerate((1, 2, 10, 30))] + [("b", i, "n", str(v)) for i, v in enumerate((1, 3, 2))]
                                  + [("c", i, "n", v) for i, v in enumerate(("1", "٠١", "2"))] + [("d", 0, "n", "1"), ("d", 1, "n", "x")], "job_id string, row_idx long, field string, value string")
    assert {r.job_id: r.is_serial for r in audit.profile_columns(cells).collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_totals_are_read_once(spark):
    # lines and sums are read off the same written rows
    optimized, _ = plans(spark, "reconcile_totals")
    assert "l_partkey" not in optimized


def test_places_are_drafted_once(spark):
    # cells are counted once, values meet the known places once
    optimized, _ = plans(spark, "approve_places")
    assert "l_partkey" not in optimized and "levenshtein" not in optimized
