"""Search by postings gives the rows of the plain scan."""

import random

import pytest

from gridmend.operators import admin, search


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(2)
    said = lambda: rnd.choice([None, "", "ab", "".join(rnd.choice("abÄäß 1%_") for _ in range(rnd.randrange(14)))])
    return spark.createDataFrame([(i, said(), said(), rnd.choice(["x", "y"])) for i in range(3000)], "id long, a string, b string, kind string").cache()


@pytest.fixture(scope="module")
def root(rows):
    return search.build_index(rows, ["a", "b"], "id")


@pytest.mark.parametrize("term", ["aba", "ABAB", "äÄ", "ab", "", None, "a%b a", "%", "ab_ab", "ä 1%", "zzz", "bbbbbbbb"])
def test_same_rows(spark, rows, root, term):
    got = search.search_index(spark, root, ["a", "b"], term, {"kind": "x"}).collect()
    want = admin.search(rows, ["a", "b"], term, {"kind": "x"}).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)


def test_blocks_without_the_term_are_not_read(spark, rows):
    """Rows of 40 blocks; the term occurs in one row, and the join leaves one block."""
    many = spark.range(40 * 32_768).selectExpr("id", "CASE WHEN id = 77777 THEN 'needle' ELSE concat('hay', id % 50) END AS a")
    root = search.build_index(many, ["a"], "id")
    assert [r.id for r in search.search_index(spark, root, ["a"], "NEEDLE").collect()] == [77777]
    assert spark.read.parquet(f"{root}/postings").filter("gram = 'nee'").count() == 1
    assert spark.read.parquet(f"{root}/rows").select("__shelf").distinct().count() >= 3


def test_no_rows(spark, rows):
    root = search.build_index(rows.limit(0), ["a", "b"], "id")
    for term in ("aba", "a", None):
        found = search.search_index(spark, root, ["a", "b"], term)
        assert found.count() == 0 and found.columns == rows.columns
