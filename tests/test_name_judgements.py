"""Names settled by the dictionary and judged: order lines that share job and row number are settled each on its own."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from gridmend.operators import reconcile

DATA = "/root/testdata/sf0.001"


def test_rows_of_one_key_are_settled_apart(spark):
    rows = [("j", 1, "سامي هدى", "سامي هدى", "سامي هدي", "علي هدى"), ("j", 1, "محمد سعيد", "محمد سعيد", "محمود سعيد", "محمد سعيد"), ("j", 2, "علي", "علي", "علي", "علي")]
    df = spark.createDataFrame(rows, "job_id string, row_idx int, col_ocr string, azure string, gemini string, structured string")
    names = spark.createDataFrame([("هدى", "family"), ("سعيد", "family"), ("محمد", "given")], "name string, kind string")
    got = reconcile.resolve_by_position_dictionary(reconcile.vote_names_reference_length(df), names, ["job_id", "row_idx"]).collect()
    assert Counter((r.row_idx, r.name, len(r.payload)) for r in got) == {(1, "سامي هدى", 2): 1, (1, "محمد سعيد", 2): 1}


@pytest.mark.parametrize("name", ["resolve_by_dictionary", "apply_judgements"])
def test_doubled_lines_double_the_answers(spark, tmp_path, name):
    for t in os.listdir(DATA):
        if t != "lineitem.parquet":
            os.symlink(f"{DATA}/{t}", tmp_path / t)
    src = f"'{DATA}/lineitem.parquet'"
    duckdb.execute(f"COPY (SELECT * FROM {src} UNION ALL SELECT * FROM {src}) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    once, twice = (Counter(map(tuple, entry.queries()[name](spark, sf).collect())) for sf in (DATA, str(tmp_path)))
    assert once and twice == {row: 2 * n for row, n in once.items()}
