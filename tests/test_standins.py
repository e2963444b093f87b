"""Stand-in tables are cheap to derive."""

from gridmend.plans import standins


def test_names_are_mapped_below_the_joins(spark):
    # One mapping per part and customer, none per order line
    rows = standins.table(spark, "/root/testdata/sf0.001", "form_rows").select("clean_name", "signature")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "translate" in plan and plan.index("Join") < plan.index("translate")
