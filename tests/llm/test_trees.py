"""What the boosted trees of personal data and URLs add, on planted cases that no rule decides."""

import random

from pyspark.sql import functions as F

from gridmend.llm import pii, url_filter

WORDS = "river mill bridge stone harbour town road field market house garden window letter winter summer".split()


def _account(rnd):
    body = "".join(rnd.choice("0123456789") for _ in range(18))
    turned = body + "131400"  # DE and two zeros
    return f"DE{98 - int(turned) % 97:02d}{body}"


def test_checks_of_the_wider_kinds(spark):
    rnd = random.Random(3)
    good = [_account(rnd) for _ in range(20)] + ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"]
    bad = [a[:-1] + str((int(a[-1]) + 1) % 10) for a in good]
    rows = spark.createDataFrame([(a, True) for a in good] + [(a, False) for a in bad], "m string, want boolean")
    assert rows.where(pii.account_ok(F.col("m")) != F.col("want")).count() == 0
    said = [("joe (at) mail.example (dot) com", True), ("joe [at] mail [dot] com", True), ("joe @ mail.com", True), ("joe @ mail.The", False), ("%% @ mail.com", False)]
    rows = spark.createDataFrame(said, "m string, want boolean")
    assert rows.where(pii.address_ok(F.col("m")) != F.col("want")).count() == 0


def _planted(rnd, d):
    """A text, and the spans in it that no base rule finds."""
    say = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    text, planted = say(8), []
    kind = d % 5
    if kind == 0:
        secret = _account(rnd)
        text += " account "
    elif kind == 1:
        secret = f"{rnd.choice(WORDS)}{d} (at) mail{d % 7}.example (dot) com"
        text += " "
    elif kind == 2:
        secret = None
        text += f" mail {rnd.choice(WORDS)}{d}@mail{d % 7}.example.com or tel +1 743 555 {1000 + d} "
    elif kind == 3:
        secret = None
        text += f" sold {rnd.randint(100, 999)} {rnd.randint(100, 999)} {rnd.randint(100, 999)} pieces "
    else:
        secret = None
    if secret:
        planted.append((len(text), len(text) + len(secret)))
        text += secret + " "
    return text + say(6), planted


def test_planted_personal_data_is_added_and_plain_numbers_stay(spark):
    rnd = random.Random(5)
    rows = [(d, *_planted(rnd, d)) for d in range(1000)]
    found = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    caught = {0: 0, 1: 0}
    for d, text, planted in rows:
        spans = [tuple(map(int, s.split(":")[1:])) for s in found[d].spans.split(",") if s]
        for s, e in planted:
            caught[d % 5] += any(a <= s and e <= b for a, b in spans)
        if d % 5 == 4:
            assert not spans
    assert caught[0] >= 190 and caught[1] >= 190
    wrong = sum(bool(found[d].n_more) for d in range(1000) if d % 5 == 3)
    assert wrong <= 20


def test_rare_kinds_without_a_model_stay_base_only(spark):
    rows = spark.createDataFrame([(1, "DE89370400440532013000")], "doc_id long, text string")
    assert [r.spans for r in pii.personal_data(rows).collect()] == [""]


def test_trees_are_fitted_on_the_candidates_of_all_documents(spark, monkeypatch):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("sold 123 456 789 pieces").alias("text"))
    seen = []
    monkeypatch.setattr(pii, "fit", lambda rows, features, by=None, weight=None: seen.append(rows.agg(F.sum(weight) if weight else F.count("*")).first()[0]))
    pii.train(docs)
    assert seen == [30_000]


def test_a_row_weighs_as_much_as_the_rows_it_stands_for(spark):
    from gridmend.llm.boosting import fit
    rows = [(float(i % 7), i % 7 // 4 ^ (i % 11 == 0), i % 5 == 0) for i in range(2000)]
    each = spark.createDataFrame(rows, "size double, label int, held_out boolean")
    once = each.groupBy("size", "label", "held_out").agg(F.count("*").alias("n"))
    a, b = fit(each, ["size"]), fit(once, ["size"], weight="n")
    assert (a.threshold, a.figures) == (b.threshold, b.figures)


def test_trees_decide_urls_by_form(spark):
    rnd = random.Random(7)
    rules, rows = [("good.org/", "allow"), ("good.org/x/", "block"), ("bad.org/", "block"), ("one.net/", "block")], []
    for i in range(1500):
        h, clean = f"h{rnd.randint(0, 400)}", f"/{rnd.choice(WORDS)}/{rnd.choice(WORDS)}"
        spam = "/" + "".join(rnd.choice("0123456789abcdef") for _ in range(40)) + "?a=1&b=2&c=3&d=4"
        rows += [(4 * i, f"http://{h}.good.org{clean}"), (4 * i + 1, f"http://{h}.bad.org{spam}"), (4 * i + 2, f"http://{h}.other.org{clean}"), (4 * i + 3, f"http://{h}.other.org{spam}")]
        rows.append((100_000 + i, f"http://{h}.two.net{clean}"))
        rows.append((200_000 + i, f"http://{h}.one.net{spam}"))
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()
    said = lambda keep: [r.verdict for r in got if keep(r.page_id)]
    assert said(lambda p: p < 100_000 and p % 4 == 2).count("allow") >= 1350
    assert said(lambda p: p < 100_000 and p % 4 == 3).count("block") >= 1350
    # every labelled net URL is blocked, which is no verdict on the suffix
    assert said(lambda p: 100_000 <= p < 200_000).count("allow") >= 1350


def test_suffix_rates_see_every_row_and_leave_out_suffixes_of_one_class(spark):
    rows = spark.createDataFrame([("com", i % 4 == 0) for i in range(400)] + [("net", True)] * 100 + [("org", False)] * 300, "suffix string, blocked boolean").select("suffix", F.col("blocked").cast("int").alias("label"))
    per, overall = url_filter.suffix_rates(rows)
    assert overall == 0.25
    assert [(r.s, round(r.rate, 6)) for r in per.collect()] == [("com", round((100 + 20 * 0.25) / 420, 6))]
