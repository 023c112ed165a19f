"""The current calendar entry against a loop: short and long entries, equal starts, owners without a name."""

import random

import pytest

from parley.operators.calendar import current_event

EVENTS = "team string, event_pos long, title string, start_s long, end_s long, all_day boolean"
PROBES = "team string, probe_id long, now_s long"


def make_rows(seed):
    rng = random.Random(seed)
    teams = ["a", "a", "b", None]
    events = []
    for i in range(300):
        start = rng.randrange(-9_000, 60_000, rng.choice([1, 600, 4096]))
        length = rng.choice([-5, 0, 1, 2, 59, 600, 1800, 4096, 9_000, 40_000])
        events.append((rng.choice(teams), i, f"e{i}", start, start + length, rng.choice([True, False, False, None])))
    return events, [(rng.choice(teams), i, rng.choice([None, *[rng.randrange(-10_000, 90_000)] * 20])) for i in range(500)]


def loop(events, probes, lead):
    out = []
    for team, probe, now in probes:
        hits = [e for e in events if team is not None and now is not None and e[0] == team and not e[5] and e[4] > e[3]
                and e[3] - lead * 60 <= now < e[4]]
        if hits:
            e = max(hits, key=lambda e: (e[3], -e[1]))
            out.append((team, probe, *e[1:5]))
    return sorted(out)


@pytest.mark.parametrize("lead", [0, 1, 15])
def test_current_event(spark, lead):
    events, probes = make_rows(lead)
    got = current_event(spark.createDataFrame(probes, PROBES), spark.createDataFrame(events, EVENTS), ["team"], lead_min=lead)
    assert loop(events, probes, lead) == sorted(tuple(r) for r in got.collect())


def test_no_entries(spark):
    none = spark.createDataFrame([], EVENTS)
    assert current_event(spark.createDataFrame([("a", 1, 5)], PROBES), none, ["team"]).collect() == []


def test_no_probe_meets_the_entries_one_by_one(spark):
    """400 entries run at once and 400 probes ask: no step has anything like 160,000 rows."""
    events = spark.range(400).selectExpr("'a' AS team", "id AS event_pos", "'t' AS title", "id AS start_s", "id + 3000 AS end_s")
    probes = spark.range(400).selectExpr("'a' AS team", "id AS probe_id", "id + 500 AS now_s")
    found = current_event(probes, events, ["team"], lead_min=0)
    assert sorted(r.event_pos for r in found.collect()) == [399] * 400
    joins = [line for line in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in line]
    assert not any("<" in line for line in joins)
