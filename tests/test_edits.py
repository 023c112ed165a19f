"""Edits of a stored transcript."""

from parley.registry import edits


def test_operations_are_stored_before_they_are_used_by_turns_speakers_and_folds(spark, sf_dir):
    ops = edits._stored(spark, sf_dir)[1]
    assert "Aggregate" not in ops._jdf.queryExecution().optimizedPlan().toString() and ops.count() > 0
