"""Tokens of whole texts and the gates they stop at."""

from gridmend.operators import learning


def test_tokens_of_a_text_are_counted_once(spark):
    """Beside the explode, the text would be cut up and counted again for each of its tokens."""
    names = spark.createDataFrame([("j1", "احمد سالم كريم"), ("j2", "احمد"), ("j3", "  "), ("j4", None)], "job_id string, name string")
    vocab = spark.createDataFrame([("كريم",)], "token string")
    out = learning.gated_tokens(names, vocab)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(tokens" in plan and "posexplode(filter(" not in plan
    got = {(r.job_id, r.token, r.name_type, r.gate) for r in out.collect()}
    assert got == {("j1", "احمد", "given", None), ("j1", "سالم", "given", None), ("j1", "كريم", "family", "known"), ("j2", "احمد", "given", None)}
