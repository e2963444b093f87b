"""Templates, and the exact round trip of formatted conversations."""

import hashlib
import random

import pytest

from gridmend.llm import chat_format, templates
from gridmend.llm.templates import TemplateError, compiled, fold, parse

FILTERS = {"upper": lambda v: str(v).upper()}


def rendered(source, messages=(), controls=chat_format.CONTROLS):
    return "".join(t for t, _ in compiled(source, controls)(messages))


@pytest.mark.parametrize("source, want", [
    ("plain { } % text", "plain { } % text"), ("{{ 'a' ~ 1 ~ none ~ true }}", "a1true"), ("{{ 1 + 2 - 4 }}", "-1"), ("{{ 'a\\n\\'b' }}", "a\n'b"), ("{# gone #}x", "x"), ("a {{- 'b' -}} c", "abc"),
    ("{% if 1 > 2 %}a{% elif 'x' in 'xyz' %}b{% else %}c{% endif %}", "b"), ("{% if not ('a' == 'b' or false) and 2 <= 2 %}y{% endif %}", "y"), ("{% set n = 'v' %}{{ n }}{{ n.a }}", "v"), ("{{ 'x' not in 'abc' }}", "true"),
])
def test_expressions(source, want):
    assert rendered(source) == want


def test_loops():
    said = [{"role": "user", "text": "1"}, {"role": "assistant", "text": "2"}, {"role": "user", "text": "3"}]
    source = "{% for m in messages %}{{ loop.index }}{{ m['role'] | upper }}{% if loop.previous.role == 'assistant' %}<{% endif %}{{ m.text }}{% if not loop.last %},{% endif %}{% endfor %}"
    assert rendered(source, iter(said)) == "1USER1,2ASSISTANT2,3USER<3"
    assert rendered("{% for m in messages %}{{ m.nothing }}{% endfor %}", iter(said)) == ""


def test_constants_are_folded():
    assert fold(parse("{% if 1 == 1 %}a{{ 'b' ~ 'c' | upper }}{% else %}{{ x }}{% endif %}d"), FILTERS) == [("text", "abCd")]
    assert fold(parse("{% if 'a' == 'b' %}gone{% endif %}"), FILTERS) == []
    assert fold(parse("{% if x %}{% elif true %}{{ 'y' }}{% else %}z{% endif %}"), FILTERS) == [("if", [(("name", "x"), [])], [("text", "y")])]


@pytest.mark.parametrize("source", ["{{ x }}", "{% for m in messages %}", "{{ messages }}", "{% if true %}", "{% endfor %}", "{{ open('f') }}", "{{ 1 + 'a' }}", "{{ 'a' | nothing }}", "{{ }}", "{{ 'a }}", "{% frob %}", "a {{ b",
                                    "{% for m in messages %}{% endfor %}{% for m in messages %}{% endfor %}", "{% for a in messages %}{% for b in messages %}{% endfor %}{% endfor %}", "{{ loop.index }}"])
def test_sandbox(source):
    with pytest.raises(TemplateError):
        rendered(source)


def test_no_python_attributes():
    assert rendered("{% for m in messages %}{{ m.__class__ }}{{ m.text.__class__ }}{{ m.keys }}{% endfor %}", [{"text": "t"}]) == ""


def test_unfit_controls():
    for controls in (("<a", "<b<"), ("a\\",), ("",)):
        with pytest.raises(TemplateError):
            templates.escaper(controls)


def digests(turns):
    every, learned = "".join(f"{r}\n{t}\n" for r, t in turns), "".join(t for r, t in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha(every), len(learned), sha(learned)


def read(frame):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in frame.collect()}


def test_round_trip(spark):
    rnd = random.Random(1)
    bits = ["<turn>", "</turn>", "<says>", "\\", "\\\\", "<", "turn>", "\n", "ok", "ä", "𝄞", " ", "### Assistant:", "</tu"]
    said = lambda: "".join(rnd.choice(bits) for _ in range(rnd.randrange(12)))
    rows = [(c, t, rnd.choice(["user", "assistant", "assistant", "system", said()]), said()) for c in range(60) for t in range(rnd.randrange(1, 7))]
    rows += [(100, None, None, None), (100, 0, "assistant", "x" * 300_000), (100, None, "assistant", "\\"), (100, 0, "assistant", "x" * 300_000), (None, 1, "assistant", "lost"), (None, 0, "user", "and"), (101, 5, "assistant", None)]
    df = spark.createDataFrame([(*r, "z", "z", 9) for r in rows], "conv_id long, turn long, role string, text string, part string, loss string, n int")
    by = {}
    for c, t, r, x in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((r or "", x or ""))
    want = {c: digests(turns) for c, turns in by.items()}
    for part_chars in (1 << 20, 40):
        formatted = chat_format.format_conversations(df, part_chars=part_chars).cache()
        assert read(chat_format.read_back(formatted)) == want
        assert read(chat_format.read_back(chat_format.in_order(formatted.orderBy("part")))) == want
        if part_chars == 40:
            assert formatted.where("part > 0").count() > 60
    lengths = {r.conv_id: r.formatted_chars for r in chat_format.read_back(formatted).collect()}
    assert lengths == {r.conv_id: r.n for r in formatted.selectExpr("conv_id", "length(text) AS n").groupBy("conv_id").sum("n").toDF("conv_id", "n").collect()}


def test_masks_hold_answers_only(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a <turn>"), (1, 2, "assistant", "b")], "conv_id long, turn long, role string, text string")
    (row,) = chat_format.format_conversations(df).collect()
    assert row.text == "<turn>user<says>q</turn>\n<turn>assistant<says>a \\<turn></turn>\n<turn>assistant<says>b</turn>\n"
    assert [row.text[s.start:s.end] for s in row.loss] == ["a \\<turn>", "b"]


def test_other_template(spark):
    source = "{% for m in messages %}[{{ m.role | escape }}|{% generation %}{{ m.text | escape }}{% endgeneration %}]{% endfor %}"
    df = spark.createDataFrame([(1, 0, "u|]", "[q]"), (1, 1, "a", "\\|")], "conv_id long, turn long, role string, text string")
    out = read(chat_format.read_back(chat_format.format_conversations(df, source, ("[", "|", "]")), ("[", "|", "]")))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert out == {1: (2, sha("u|]\n[q]\na\n\\|\n"), 5, sha("[q]\\|"))}


def test_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.read_back(chat_format.format_conversations(df)).count() == 0
    with pytest.raises(TemplateError):
        chat_format.format_conversations(df, "{% for %}")
