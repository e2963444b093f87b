"""Nulls, empty and very long texts, repeated rows, empty tables and clashing extra columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from gridmend.llm import decontaminate, line_dedup, minhash, mixing, pii, quality_classifier, quality_rules, secret_scan, tokens, url_filter

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = "piece_bpe_32k.model"
RULES = (("com/", "allow"), ("example.com/en/", "block"))


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame([(1, "seven stone bridges before it meets the sea near a small harbour town"), (None, None), (3, ""), (4, "too short")], "item_id long, text string")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(0, 1), (1, 1), (2, 0), (5, None), (None, 1), (9, 0), (9, 1)], "doc_id long, quality int")


def per_row(edge, benchmark, labels):
    return {"mix": mixing.mix(edge), "lines": line_dedup.dedup_lines(edge), "classes": minhash.classes(edge), "rules": quality_rules.judge(edge), "tokens": tokens.token_counts(edge, public_tokenizers.path(MODEL)),
            "secrets": secret_scan.secrets(edge), "pii": pii.personal_data(edge), "scores": quality_classifier.quality_scores(edge, labels)}


@pytest.mark.parametrize("name", ["mix", "lines", "classes", "rules", "tokens", "secrets", "pii", "scores"])
def test_one_row_for_each_row(name, edge, nothing, benchmark, labels):
    made = {"mix": lambda d: mixing.mix(d), "lines": line_dedup.dedup_lines, "classes": minhash.classes, "rules": quality_rules.judge, "tokens": lambda d: tokens.token_counts(d, public_tokenizers.path(MODEL)),
            "secrets": secret_scan.secrets, "pii": pii.personal_data, "scores": lambda d: quality_classifier.quality_scores(d, labels)}[name]
    out = made(edge).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r.doc_id) for r in edge.select("doc_id").collect())
    again = [r for r in out if r.doc_id == 8]
    assert again[0] == again[1]
    assert made(nothing).count() == 0


@pytest.mark.parametrize("name", ["good", "one", "clean", "sample"])
def test_filters_return_rows_unchanged(name, edge, nothing, benchmark):
    made = {"good": quality_rules.keep_good, "one": minhash.keep_one, "clean": lambda d: decontaminate.clean(d, benchmark), "sample": mixing.sample}[name]
    out = made(edge)
    own = [c for c in edge.columns if c in out.columns and c not in ("size", "copies")]
    kept, given = {str(r) for r in out.select(*own).collect()}, {str(r) for r in edge.select(*own).collect()}
    assert kept <= given and kept
    assert made(nothing).count() == 0


def test_near_copies(edge):
    by = {}
    for r in minhash.classes(edge).collect():
        by.setdefault(r.doc_id, []).append((r.class_id, r.kept))
    assert by[0] == [(0, True)] and by[1] == [(0, False)] and by[2] == [(0, False)] and by[8] == [(0, False)] * 2
    assert by[3] == [(3, True)] and by[4] == [(4, True)] and (0, False) in by[None] and (None, True) in by[None]


def test_leaks(edge, nothing, benchmark):
    found = {(r.doc_id, r.item_id, r.coverage) for r in decontaminate.leaks(edge, benchmark).collect()}
    assert found == {(d, 1, 1.0) for d in (0, 1, 2, 8, None)}
    assert decontaminate.leaks(nothing, benchmark).count() == 0
    assert decontaminate.leaks(edge, benchmark.limit(0)).count() == 0


def test_line_texts(edge):
    by = {r.doc_id: r for r in line_dedup.dedup_lines(edge).collect() if r.doc_id is not None}
    # the null id sorts first and keeps the line; doc 2 differs from it by one word in 22 and is the same line
    assert by[0].text == "" and by[1].text == "" and by[3].text is None and by[5].text == " \n\t "
    assert by[10].text == "a\nb\nc" and by[10].n_dropped == 2


def test_urls(spark):
    urls = [(1, "http://A.Example.COM/en/x?y=/fr/"), (2, "https://example.com/de/"), (3, None), (4, "no scheme"), (5, ""), (None, "http://com/"), (6, "http://com"), (7, "http://xexample.com/en/"), (8, "x" * 50_000 + "://h.net/" + "p/" * 1000),
            (1, "http://A.Example.COM/en/x?y=/fr/")]
    pages = spark.createDataFrame([(p, u, "h", "z", "z", "z") for p, u in urls], "page_id long, url string, html string, host string, u string, rule string")
    got = {(r.page_id, r.host, r.path[:6], r.rule, r.verdict) for r in url_filter.judge(pages, RULES).where("rule is not null or page_id in (3, 4, 5, 6, 8)").collect()}
    assert (1, "a.example.com", "/en/x", "example.com/en/", "block") in got and (2, "example.com", "/de/", "com/", "allow") in got
    assert (7, "xexample.com", "/en/", "com/", "allow") in got and (None, "com", "/", "com/", "allow") in got
    assert all(any(g[:4] == (p, h, q, None) for g in got) for p, h, q in ((3, "", ""), (4, "", ""), (5, "", ""), (6, "com", ""), (8, "h.net", "/p/p/p")))
    assert url_filter.judge(pages.limit(0), RULES).count() == 0


def test_scores_are_probabilities(edge, labels):
    out = quality_classifier.quality_scores(edge, labels)
    assert out.where((F.col("score") < 0) | (F.col("score") > 1) | F.col("score").isNull()).count() == 0
    assert {r.score for r in quality_classifier.quality_scores(edge, labels.limit(0)).collect()} == {0.5}
