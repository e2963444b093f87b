"""Rules by automaton against trying every rule on every text."""

import random

import pytest

from gridmend.operators import textdocs


def one_by_one(text, rules):
    least = textdocs.LEAST_LEFT * len(text)
    for pattern, new in sorted(rules):
        if pattern in text and len(text.replace(pattern, new)) >= least:
            text = text.replace(pattern, new)
    return text


@pytest.mark.parametrize("letters", ["ab", "abc", "abcdef"])
def test_rules_in_order(letters):
    """Patterns overlap, hold each other, and are made by earlier replacements, also across their borders."""
    rnd = random.Random(letters)
    said = lambda low, high: "".join(rnd.choice(letters) for _ in range(rnd.randint(low, high)))
    for _ in range(400):
        rules = sorted({(said(1, 4), said(0, 5)) for _ in range(rnd.randint(1, 25))})
        book = textdocs.RuleBook(rules)
        for _ in range(5):
            text = said(0, 60)
            assert book.apply(text, len(text)) == one_by_one(text, rules), (rules, text)


def test_plan_does_not_grow(spark):
    docs = spark.createDataFrame([(1, "w7 w77 w4999 x"), (2, None), (3, "")], "doc_id long, text string")
    rules = spark.createDataFrame([(f"w{i}", f"v{i}") for i in range(5000)], "original_text string, corrected_text string")
    out = textdocs.apply_text_rules(docs, rules)
    assert {r.doc_id: r.text for r in out.collect()} == {1: one_by_one("w7 w77 w4999 x", [(f"w{i}", f"v{i}") for i in range(5000)]), 2: None, 3: ""}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("applied(") == 1
    split = textdocs.apply_text_rules(docs, rules, chunk=1999)
    assert sorted(map(str, split.collect())) == sorted(map(str, out.collect()))


@pytest.mark.parametrize("letters, made", [("ab", "abx"), ("abc", "xy"), ("abc1", "ab1xx"), ("a-]^\\", "axy-]")])
def test_characters_in_no_pattern(letters, made):
    """Replacements hold characters that no pattern has, at their ends and inside."""
    rnd = random.Random(letters + made)
    said = lambda of, low, high: "".join(rnd.choice(of) for _ in range(rnd.randint(low, high)))
    for _ in range(400):
        rules = sorted({(said(letters, 1, 4), said(made, 0, 5)) for _ in range(rnd.randint(1, 25))})
        book = textdocs.RuleBook(rules)
        for _ in range(5):
            text = said(letters + made, 0, 50)
            assert book.apply(text, len(text)) == one_by_one(text, rules), (rules, text)


def test_rules_of_one_pattern_are_read_once(monkeypatch):
    class Text(str):
        cuts = 0

        def split(self, *args):
            Text.cuts += 1
            return super().split(*args)

    short = textdocs.RuleBook([("abcdefghij", str(i)) for i in range(50)])
    assert short.apply(Text("abcdefghij k"), 12) == "abcdefghij k" and Text.cuts == 1
    read = []
    book = textdocs.RuleBook([("a", f"x{i}y") for i in range(50)] + [("ab", "b")])
    occurring = book._occurring
    monkeypatch.setattr(book, "_occurring", lambda *args: read.append(args) or occurring(*args))
    assert book.apply("a ab a", 6) == "x0y x0yb x0y" and len(read) == 1


def test_texts_of_one_file_are_dealt_out(spark):
    docs = spark.range(100).selectExpr("id AS doc_id", "'a b' AS text").coalesce(1)
    rules = spark.createDataFrame([("a", "c")], "original_text string, corrected_text string")
    out = textdocs.apply_text_rules(docs, rules)
    assert "RepartitionByExpression" in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.text for r in out.collect()} == {"c b"} and out.count() == 100
