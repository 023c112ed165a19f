"""Blocked scans against loops, with blocks so small that everything crosses them."""

import random

import pytest
from pyspark.sql import functions as F

from parley.operators.scans import around, islands, numbered, running, time_block
from parley.operators.turns import build_turns, display_groups, merge_turns

ROWS = "meeting_id string, speaker string, track string, seg_id long, start_ms long, end_ms long, text string"


def make_segments(seed, n=400, meetings=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        # a third of the rows lie in one meeting
        meeting = "hot" if rng.random() < 0.34 else f"m{rng.randrange(meetings)}"
        start = rng.randrange(0, 200_000, 100)
        length = rng.choice([0, 100, 500, 2000, 2000, 40_000])
        speaker = rng.choice(["you", "s1", "s1"])
        rows.append((meeting, speaker, "mic" if speaker == "you" else "system", i, start, start + length, f"t{i}"))
    return rows


def loop_turns(rows, same, gap, sort):
    out = {}
    for row in sorted(rows, key=sort):
        turns = out.setdefault(row[0], [])
        last = turns[-1] if turns else None
        if last and last["same"] == same(row) and (gap is None or row[4] - last["end"] <= gap):
            last["text"] += " " + row[6]
            last["end"] = max(last["end"], row[5])
        else:
            turns.append({"same": same(row), "start": row[4], "end": row[5], "text": row[6]})
    return sorted((m, i, t["start"], t["end"], t["text"]) for m, ts in out.items() for i, t in enumerate(ts))


def order(row):
    return row[4], row[2] != "mic", row[3]


@pytest.mark.parametrize("block_ms", [700, 5_000, 600_000])
def test_turns(spark, block_ms):
    rows = make_segments(block_ms)
    got = build_turns(spark.createDataFrame(rows, ROWS), block_ms=block_ms)
    assert loop_turns(rows, lambda r: (r[1], r[2]), 3000, order) == sorted(
        tuple(r) for r in got.select("meeting_id", "turn_id", "start_ms", "end_ms", "text").collect())


def test_turns_without_numbers(spark):
    rows = make_segments(5)
    frame = spark.createDataFrame(rows, ROWS)
    plain = build_turns(frame, number=False).drop("turn_id")
    assert sorted(plain.collect()) == sorted(build_turns(frame).drop("turn_id").collect())


@pytest.mark.parametrize("late", [100, 0, -100])
def test_gap_edge(spark, late):
    """Exactly 3.0 s still joins, seen from the furthest end and not the last one."""
    rows = [("m", "you", "mic", 0, 0, 9000, "a"), ("m", "you", "mic", 1, 1000, 2000, "b"),
            ("m", "you", "mic", 2, 12_000 + late, 13_000, "c")]
    got = build_turns(spark.createDataFrame(rows, ROWS), block_ms=1000)
    assert got.count() == (2 if late > 0 else 1)


def test_merge_and_display(spark):
    rows = [(m, s, t, i, a, b, x) for i, (m, s, t, _, a, b, x) in enumerate(sorted(make_segments(9), key=lambda r: r[4]))]
    frame = spark.createDataFrame(rows, ROWS).withColumnRenamed("seg_id", "turn_id")
    by_turn = lambda r: r[3]
    merged = merge_turns(frame, block_ms=3000).select("meeting_id", "turn_id", "start_ms", "end_ms", "text")
    assert loop_turns(rows, lambda r: r[1], 3000, by_turn) == sorted(tuple(r) for r in merged.collect())
    shown = display_groups(frame, block_ms=3000).select("meeting_id", "start_ms", "text")
    assert sorted((m, s, x) for m, _, s, _, x in loop_turns(rows, lambda r: r[1], None, by_turn)) == sorted(
        tuple(r) for r in shown.collect())


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("inclusive", [False, True])
def test_running(spark, descending, inclusive):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 2}", rng.randrange(1000), i, rng.choice([None, i])) for i in range(300)]
    frame = spark.createDataFrame(rows, "k string, t long, i long, v long")
    got = running(frame, ["k"], ["t", "i"], time_block("t", 50), {
        "total": ("sum", F.col("v")), "top": ("max", F.col("v")), "last": ("last", F.col("v"))},
        inclusive=inclusive, descending=descending)
    want, state = [], {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[1], r[2]), reverse=descending):
        seen = state.setdefault(k, [])
        if inclusive:
            seen.append(v)
        known = [x for x in seen if x is not None]
        want.append((k, t, i, v, sum(known), max(known, default=None), known[-1] if known else None))
        if not inclusive:
            seen.append(v)
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())


def test_around_and_numbers(spark):
    rng = random.Random(4)
    rows = [("a", rng.randrange(500), i, rng.choice([None, None, i])) for i in range(200)]
    frame = spark.createDataFrame(rows, "k string, t long, i long, v long")
    got = {r["i"]: (r["before"], r["after"]) for r in around(
        frame, ["k"], ["t", "i"], time_block("t", 20), F.col("v")).collect()}
    line = sorted(rows, key=lambda r: (r[1], r[2]))
    for at, (_, _, i, _) in enumerate(line):
        before = [r[3] for r in line[:at] if r[3] is not None]
        after = [r[3] for r in line[at + 1:] if r[3] is not None]
        assert got[i] == (before[-1] if before else None, after[0] if after else None)
    numbers = numbered(frame, ["k"], ["t", "i"], time_block("t", 20), "n").orderBy("t", "i").collect()
    assert [r["n"] for r in numbers] == list(range(200))


def test_rows_are_gathered_by_block(spark):
    """No exchange or sort of the wide rows by meeting alone."""
    frame = spark.createDataFrame(make_segments(1), ROWS)
    plan = islands(frame, ["meeting_id"], ["speaker"], ["start_ms", "seg_id"], "end_ms", 3000, 5000)
    text = plan._jdf.queryExecution().executedPlan().toString()
    wide = [line for line in text.splitlines() if "Exchange hashpartitioning(meeting_id" in line and "_block" not in line.split("),")[0]]
    assert all("text" not in line for line in wide)
