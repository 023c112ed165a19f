"""Scans as a stream against a comparison of whole snapshots, and live windows over several batches."""

import datetime as dt
import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from parley.operators import activity
from parley.streaming import folders, run
from test_streams import BASE, stream_of

NOON = dt.datetime(2024, 1, 2, 12)


def listing(spark, found):
    rows = [(f, NOON + dt.timedelta(seconds=t)) for f, t in found.items()]
    return spark.createDataFrame(rows, "folder string, modified timestamp")


def compared(before, now, scan):
    return ({(f, scan, "new" if f not in before else "changed") for f, t in now.items() if before.get(f) != t}
            | {(f, scan, "gone") for f in before if f not in now})


def read(spark, path, checkpoint, known, batches=1):
    run.use_state_store(spark)
    found = folders.folder_changes(folders.scans(spark, path, batches), known)
    found.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", checkpoint + "-out").trigger(
        availableNow=True).start().awaitTermination()
    return [(r["folder"], r["scan"], r["state"]) for r in spark.read.parquet(checkpoint + "-out").collect()]


def test_scans(spark, tmp_path):
    """Small batches, one run after the other: folders come, change, go and come back; one scan is empty, one is
    recorded twice."""
    rng = random.Random(3)
    names = [f"f{i}" for i in range(12)]
    path, checkpoint = str(tmp_path / "scans"), str(tmp_path / "state")
    before = {f: rng.randrange(3) for f in names[:6]}
    known = listing(spark, before).withColumn("scan", F.lit(0))
    want = set()
    for scan in range(1, 6):
        now = {} if scan == 3 else {f: rng.randrange(3) for f in names if rng.random() < 0.6}
        for _ in range(2 if scan == 2 else 1):
            folders.record_scan(listing(spark, now), path, scan)
        want |= compared(before, now, scan)
        before = now
        if scan in (2, 5):
            got = read(spark, path, checkpoint, known)
            assert len(got) == len(set(got)) and set(got) == want


def test_nothing_known_and_one_batch(spark, tmp_path):
    path = str(tmp_path / "scans")
    for scan, now in ((1, {"a": 1, "b": 1}), (2, {"b": 2}), (3, {"a": 1, "b": 2})):
        folders.record_scan(listing(spark, now), path, scan)
    got = read(spark, path, str(tmp_path / "state"), None, 1000)
    assert sorted(got) == [("a", 1, "new"), ("a", 2, "gone"), ("a", 3, "new"), ("b", 1, "new"), ("b", 2, "changed")]


def test_session_totals(spark, tmp_path):
    """Two stateful steps: sessions of a minute's silence, counted by the hour they end in."""
    rng = random.Random(4)
    at, rows = BASE, []
    for i in range(240):
        at += rng.choice([1000, 30_000, 61_000, 400_000])
        rows.append((rng.choice("abc"), at, i))
    rows.append(("end", at + 10_000_000, 240))
    stream = stream_of(spark, str(tmp_path), rows, "user_id string, ts_ms long, event_id long", 4)
    timed = stream.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", "1 second")
    got = run.to_table(activity.session_totals(timed, ["user_id"], "1 minute", "1 hour"), "totals").collect()
    ends, open_ = [], {}
    for user, t, _ in rows:
        if user in open_ and t - open_[user][0] <= 60_000:
            open_[user] = (t, open_[user][1] + 1)
        else:
            ends += [open_[user]] if user in open_ else []
            open_[user] = (t, 1)
    ends += open_.values()
    want, last = {}, rows[-1][1] - 1000
    for t, n in ends:
        hour = (t + 60_000 - 1) // 3_600_000 * 3600
        if (hour + 3600) * 1000 <= last:
            want[hour] = tuple(map(sum, zip(want.get(hour, (0, 0)), (1, n))))
    assert {r["start_s"]: (r["sessions"], r["n"]) for r in got} == want and len(want) > 3


class Calls:
    """A handle with one value and timers that counts what is asked of it."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def __getattr__(self, name):
        def called(*given):
            self.calls += 1
            if name == "update":
                self.value = given[0]
            elif name == "clear":
                self.value = None
            elif name == "registerTimer":
                self.timers.add(given[0])
            elif name == "deleteTimer":
                self.timers.discard(given[0])
            return {"get": self.value, "exists": self.value is not None, "listTimers": iter(set(self.timers))}.get(name)
        return called


def test_a_folder_takes_few_calls_and_has_one_timer():
    handle, state, out = Calls(), folders.FolderState(), []
    state.init(handle)
    state.handleInitialState(("a",), Row(folder="a", scan=0, modified=5), None)
    assert handle.calls <= 3
    for batch, calls in (([(2, 6), (1, 5)], 4), ([(2, 6)], 2), ([(4, 6), (4, 7)], 4)):
        before = handle.calls
        out += [tuple(r) for r in state.handleInputRows(("a",), iter([Row(folder="a", scan=s, modified=m) for s, m in batch]), None)]
        assert handle.calls - before <= calls and len(handle.timers) == 1
    out += [tuple(r) for r in state.handleExpiredTimer(("a",), None, None)]
    assert out == [("a", 2, "changed", 6), ("a", 3, "gone", 6), ("a", 4, "new", 6), ("a", 4, "changed", 7), ("a", 5, "gone", 7)]
    assert handle.value is None
