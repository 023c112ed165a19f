"""Budgeted chunks over blocks against the plain fold."""

import random

import pytest

from parley.operators import windows


def fold(sizes, limit, extra):
    out, chunk, size = [], -1, None
    for n in sizes:
        if size is None or size + n > limit:
            chunk, size = chunk + 1, 0
        size += n + extra
        out.append(chunk)
    return out


def chunks(spark, meetings, limit, extra, blocks):
    rows = [(m, i * step, "x" * n) for m, (sizes, step) in meetings.items() for i, n in enumerate(sizes)]
    random.Random(0).shuffle(rows)
    frame = spark.createDataFrame(rows, "meeting_id string, at long, line string")
    found = windows.budget_groups(frame, "at", "line", limit, extra, blocks)
    assert found.columns == ["meeting_id", "at", "line", "chunk"]
    got = {(r["meeting_id"], r["at"]): r["chunk"] for r in found.collect()}
    want = {(m, i * step): c for m, (sizes, step) in meetings.items() for i, c in enumerate(fold(sizes, limit, extra))}
    assert got == want


@pytest.mark.parametrize("limit,extra,blocks", [(50, 1, 1), (50, 2, 3), (37, 1, 64)])
def test_same_as_the_fold(spark, limit, extra, blocks):
    rng = random.Random(limit)
    meetings = {f"m{k}": ([rng.randrange(0, rng.choice([3, 20, 60, 400])) for _ in range(rng.randrange(1, 400))], 1 + k % 3)
                for k in range(8)}
    meetings |= {"one": ([5], 1), "long": ([1000, 1000, 0, 1000], 1), "blank": ([0] * 300, 1),
                 "even": ([49] * 100, 1), "full": ([50] * 100, 1), "over": ([51] * 100, 7)}
    chunks(spark, meetings, limit, extra, blocks)


def test_one_very_long_meeting_goes_to_many_tasks(spark):
    lines = spark.range(300_000).selectExpr("'m' AS meeting_id", "id AS turn_id", "repeat('x', CAST(hash(id) & 63 AS INT)) AS line")
    found = windows.budget_groups(lines, "turn_id", "line", 1_000)
    sizes = [r["n"] for r in lines.selectExpr("length(line) AS n", "turn_id").orderBy("turn_id").select("n").collect()]
    want = fold(sizes, 1_000, 1)
    got = [r["chunk"] for r in found.orderBy("turn_id").select("chunk").collect()]
    assert got == want


def test_no_rows(spark):
    frame = spark.createDataFrame([], "meeting_id string, at long, line string")
    assert windows.budget_groups(frame, "at", "line").collect() == []
