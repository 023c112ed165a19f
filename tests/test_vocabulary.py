"""Merged vocabularies: order, spelling, cap, and what is sorted."""

from parley.operators.vocabulary import merge_terms

TERM = "meeting_id string, pos long, term string"
DEFAULTS = ["Kubernetes", " Spark ", "spark", "", "Flink"]


def merged(spark, cap=100):
    meetings = spark.createDataFrame([("a",), ("a",), ("b",)], "meeting_id string")
    user = spark.createDataFrame([("a", 5, "delta"), ("a", 2, " Delta"), ("a", 3, "KUBERNETES"), ("a", 4, " ")], TERM)
    names = spark.createDataFrame([("a", 1, "DELTA"), ("a", 0, "Ana"), ("c", 1, "Bo"), ("a", 9, "x" * 90)], TERM)
    return merge_terms(meetings, user, names, DEFAULTS, cap)


def test_order_spelling_and_cap(spark):
    want = {"a": ["Delta", "KUBERNETES", "Ana", "x" * 80, "Spark", "Flink"], "b": ["Kubernetes", "Spark", "Flink"], "c": ["Bo"]}
    for cap in (100, 5, 3, 1):
        rows = sorted(tuple(r) for r in merged(spark, cap).collect())
        assert rows == [(m, i + 1, t) for m in sorted(want) for i, t in enumerate(want[m][:cap])]


def test_defaults_are_no_rows_before_the_last_step(spark):
    plan = merged(spark)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange") and plan.count("Generate") == 1
