"""Cases that once gave wrong answers: null readings, colliding header lists, long merge chains, long header words."""

from pyspark.sql import functions as F

from gridmend.operators import audit, corrections, layout, reconcile, resolve, standardize
from gridmend.sources import documents


def test_null_and_empty_readings_are_one(spark):
    r = spark.createDataFrame([(1, "سارة", None, ""), (2, "سارة", "", None), (3, None, None, None)], "n int, gemini string, azure string, vision string")
    v = spark.createDataFrame([("سارة",)], "token string")
    out = {x.n: (x.winner, x.method) for x in reconcile.vote_name_tokens_positional(r, v).collect()}
    assert out == {1: ("سارة", "single_gemini"), 2: ("سارة", "single_gemini"), 3: ("", "empty")}
    assert reconcile.vote_name_tokens_positional(r, v).count() == 3


def _grid(spark, forms):
    rows = [(job, 0, h, i, v) for job, cols in forms.items() for i, (h, v) in enumerate(cols)]
    return spark.createDataFrame(rows, "job_id string, row_idx int, field string, col_idx int, value string")


def test_header_lists_that_join_alike_stay_apart(spark):
    g = _grid(spark, {"a": [("phone", ""), ("هاتف", "1")], "b": [("phon", "2"), ("eهاتف", "3")]})
    got = {(r.job_id, r.field): r.value for r in layout.merge_duplicate_columns(g).collect()}
    assert got[("a", "phone")] == "1" and len([k for k in got if k[0] == "a"]) == 1


def test_merge_chain_of_nine_headers_ends_in_one(spark):
    words = [f"word{c}" for c in "abcdefghij"]
    cols = [(f"{words[i + 1]} {words[i]}", str(i)) for i in range(9)]
    out = layout.merge_duplicate_columns(_grid(spark, {"a": cols})).collect()
    left = {r.field for r in out}
    # what is left is alive: no header of the result was itself merged away, and no value was lost to a dead header
    facts = [{"h": h, "tok": h.split(), "roots": [False] * len(layout.SAME_COLUMN), "guardian": False, "date": False} for h, _ in cols]
    merged = layout._merge_headers(facts)
    assert left == {h for h, _ in cols} - {m["gone"] for m in merged}
    assert all(m["kept"] in left for m in merged)


def test_gaps_fill_in_merge_order(spark):
    facts = [{"h": h, "tok": t, "roots": [False] * len(layout.SAME_COLUMN), "guardian": False, "date": False} for h, t in (("aa", ["x"]), ("bbb", ["x"]), ("cccc", ["x"]))]
    assert [(m["gone"], m["kept"], m["turn"]) for m in layout._merge_headers(facts)] == [("bbb", "cccc", 0), ("aa", "cccc", 1)]


def test_long_header_words_are_not_cut(spark):
    long = "ال" + "ب" * 150
    df = spark.createDataFrame([(long + "ج",), (long + "د",)], "h string")
    a, b = [r.t for r in df.select(layout.header_tokens(F.col("h")).alias("t")).collect()]
    assert a != b


def test_lines_keep_all_cells(spark):
    d = spark.createDataFrame([("d", "1|x|سارة علي")], "doc_id string, text string")
    assert [r.text for r in documents.pipe_names(d).collect()] == ["سارة علي"]


def test_low_confidence_is_not_cut_short(spark):
    t, n = spark.createDataFrame([("ابجدهو",)], "token string"), spark.createDataFrame([("ابجدزح",)], "name string")
    past = spark.createDataFrame([], "token string, past string")
    got = resolve.suggest_token(t, n, past, 0.5).collect()
    assert [r.suggested for r in got] == ["ابجدزح"]


def test_subheader_words_match_the_folded_list(spark):
    g = spark.createDataFrame([("a", 1, 0, 0, 0, "بداية"), ("a", 1, 0, 1, 0, "بدايه")], "job_id string, page int, table_id int, r int, c int, content string")
    assert [r.content for r in standardize.drop_non_data_rows(g).collect()] == ["بدايه"]


def _joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_repeated_rules_meet_once(spark):
    # n copies of a rule and of its reverse are one conflict, found without n * n rows
    r = spark.createDataFrame([("a", "b"), ("b", "a")] * 50, "original_text string, corrected_text string")
    out = audit.rule_conflicts(r)
    assert [tuple(x) for x in out.collect()] == [("a", "b")]
    plan = _joins(out)
    assert plan.index("Join Inner") < plan.index("Aggregate")  # the join stands above the distinct rules


def test_column_defaults_go_to_every_task(spark):
    # all cells of one column would otherwise meet in one task
    c = spark.createDataFrame([("a", 0, "h", 0, None)], "job_id string, row_idx int, field string, col_idx int, value string")
    rules = spark.createDataFrame([], "original_text string, corrected_text string, created_at int, id string")
    own = spark.createDataFrame([("h", "", "x", 1, "1")], "field_name string, original_value string, corrected_value string, created_at int, id string")
    out = corrections.apply_corrections(c, rules, own)
    assert [(r.value, r.method) for r in out.collect()] == [("x", "default")]
    assert "strategy=broadcast" in _joins(out)
