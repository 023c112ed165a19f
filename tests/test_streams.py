"""Stateful streams over several batches against loops."""

import hashlib
import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from parley.streaming import captions, jobs, nudges, run

SAMPLE = ("user_id string, ts_ms long, event_id long, busy boolean, recording boolean, app string, cal_title string, "
          "cal_start_s long, nudge_id string, action string, kind string")
BASE = 1_700_000_000_000


def stream_of(spark, folder, rows, schema, batches):
    """Writes the rows as one file per batch; the stream reads one file at a time."""
    size = -(-len(rows) // batches)
    for i in range(batches):
        part = rows[i * size:(i + 1) * size]
        if part:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/part")
    return run.file_stream(spark, f"{folder}/part", "*.parquet", files_per_trigger=1)


MIN = 60_000
#: (minutes since the start, what happens, expected event): a user's decisions one after the other.
TABLE = [
    (0, "free", None), (1, "busy", None), (1.1, "busy", None), (1.2, "busy", "offered call"), (2, "busy", None),
    (3, "dismiss", "dismiss call"), (4, "busy", None), (30, "busy", None), (62, "busy", None), (63, "busy", "offered call"),
    (73.5, "accept", None), (74, "busy", "offered call"), (75, "record", None), (75.1, "busy", None),
    (75.3, "busy", "offered call"), (76, "accept", "accept call"), (77, "weekly", "offered calendar"),
    (78, "dismiss", "dismiss calendar"), (79, "weekly", None), (80, "standup", "offered calendar"), (85, "free", None),
    (95, "standup", "offered calendar"), (96, "other", None), (97, "accept", "accept calendar"), (98, "standup", None),
    (140, "busy", None), (140.2, "busy", "offered call"), (141, "record", None), (142, "free", None), (143, "busy", None),
    (143.1, "free", None), (143.3, "busy", None), (143.5, "busy", "offered call")]


START = {"a": 0, "b": 7_001, "c": 3_600_500}
#: Minute of an answer to a call offer, and the minute since which its microphone was busy.
BUSY_SINCE = {3: 1, 73.5: 4, 76: 75.1}
CALLS = {(u, at): f"call-{(BASE + s + int(since * MIN)) // 1000}" for u, s in START.items() for at, since in BUSY_SINCE.items()}


def table_rows(user, start):
    """Input rows of the table, with the ids of the offers that are answered, and the events wanted."""
    rows, want, since, standing = [], [], None, None
    for minutes, what, event in TABLE:
        at = BASE + start + int(minutes * MIN)
        title = {"weekly": "Weekly", "standup": "Standup"}.get(what)
        answer = what in ("accept", "dismiss", "other")
        rows.append(dict(
            user_id=user, ts_ms=at, event_id=0, kind="action" if answer else "sample", busy=what == "busy",
            recording=what == "record", app="zoom.us", cal_title=title, cal_start_s=7 if title else None,
            nudge_id=("no such" if what == "other" else standing) if answer else None, action=what if answer else None))
        if event and event.startswith("offered"):
            key = hashlib.sha1(f"{title}|7".encode()).hexdigest()[:12]
            standing = f"cal-{key}" if title else "call"
        if event:
            want.append((user, at, event.split()[0], event.split()[1]))
    return rows, want


def test_nudges(spark, tmp_path):
    """The decision table for three users over several batches."""
    rows, want = [], []
    for user, start in START.items():
        more, events = table_rows(user, start)
        rows += more
        want += events
    rows.sort(key=lambda r: r["ts_ms"])
    for r in rows:  # a call's id names the second its microphone became busy
        if r["nudge_id"] == "call":
            r["nudge_id"] = CALLS[r["user_id"], round((r["ts_ms"] - BASE - START[r["user_id"]]) / MIN, 1)]
    for i, r in enumerate(rows):
        r["event_id"] = i
    names = [c.split()[0] for c in SAMPLE.split(", ")]
    frame = stream_of(spark, str(tmp_path), [tuple(r[n] for n in names) for r in rows], SAMPLE, 5)
    out = run.to_table(nudges.nudges(frame.withColumn("ts", F.timestamp_millis("ts_ms"))), "nudges").collect()
    assert sorted((r["user_id"], r["ts_ms"], r["event"], r["kind"]) for r in out) == sorted(want)
    assert {r["title"] for r in out if r["kind"] == "call"} == {"In a Zoom call?"}


def test_captions(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b"]), rng.choice(["mic", "system"]), rng.choice(["final", "partial", "done"]), float(i),
             i + 1.0, f"text {i}", BASE + i * 10, i) for i in range(300)]
    schema = "meeting_id string, track string, t string, start double, end double, text string, arrival_ms long, event_id long"
    frame = stream_of(spark, str(tmp_path), rows, schema, 5).withColumn("arrival", F.timestamp_millis("arrival_ms"))
    out = run.to_table(captions.caption_lines(frame), "captions").collect()
    finals = sorted((r["meeting_id"], r["seq"], r["text"], r["who"]) for r in out if r["kind"] == "final")
    want, seq = [], {}
    for r in rows:
        if r[2] == "final":
            seq[r[0]] = seq.get(r[0], 0) + 1
            want.append((r[0], seq[r[0]], r[5], "You" if r[1] == "mic" else "Them"))
    assert finals == sorted(want)


def test_caption_lines_skip_noise(spark):
    lines = spark.createDataFrame([('{"t":"final","start":1.0,"end":2.0,"text":"hi"}',), ("noise",), ('{"x":1}',)], "value string")
    assert [r["text"] for r in captions.parse_lines(lines).collect()] == ["hi"]


def test_jobs(spark, tmp_path):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b"]), "transcript", rng.choice(["processing", "done", "error"]), BASE + i, i) for i in range(200)]
    frame = stream_of(spark, str(tmp_path), rows, "meeting_id string, kind string, state string, ts_ms long, event_id long", 6)
    out = run.to_table(jobs.finished_jobs(frame.withColumn("ts", F.timestamp_millis("ts_ms"))), "jobs").collect()
    want, last = set(), {}
    for m, _, state, _, i in rows:
        if last.get(m) == "processing" and state != "processing":
            want.add((m, i, state == "done"))
        last[m] = state
    assert {(r["meeting_id"], r["event_id"], r["ok"]) for r in out} == want


def test_late_rows_are_dropped(spark, tmp_path):
    """A sample far behind the watermark changes nothing."""
    make = lambda at, i: ("u", at, i, True, False, None, None, None, None, None, "sample")
    rows = [make(BASE + 3_600_000, 0), make(BASE + 3_700_000, 1), make(BASE, 2)]
    frame = stream_of(spark, str(tmp_path), rows, SAMPLE, 3).withColumn("ts", F.timestamp_millis("ts_ms"))
    out = run.to_table(nudges.nudges(frame), "nudges").collect()
    assert [r["nudge_id"] for r in out] == [f"call-{(BASE + 3_600_000) // 1000}"]


def test_sessions_of_table_and_stream(spark, tmp_path):
    """The blocked sessions of a table are those Spark's session windows close."""
    from parley.operators import activity
    rng = random.Random(9)
    at, rows = BASE, []
    for i in range(300):
        at += rng.choice([500, 1000, 59_000, 60_000, 61_000])
        rows.append((rng.choice(["hot", "hot", "u"]), at, i))
    rows.append(("end", at + 10_000_000, 300))
    frame = spark.createDataFrame(rows, "user_id string, ts_ms long, event_id long")
    table = activity.sessions(frame, ["user_id"], 60_000, block_ms=20_000).filter("user_id <> 'end'")
    stream = stream_of(spark, str(tmp_path), rows, frame.schema, 3).withColumn("ts", F.timestamp_millis("ts_ms"))
    closed = run.to_table(activity.session_stream(stream.withWatermark("ts", "1 second"), ["user_id"], "1 minute"), "sessions")
    columns = ["user_id", "start_s", "end_s", "n"]
    assert sorted(map(tuple, table.select(*columns).collect())) == sorted(map(tuple, closed.select(*columns).collect()))


def test_a_job_takes_two_state_calls_and_no_frames():
    from test_folders import Calls  # which imports this module
    handle, state, out = Calls(), jobs.LeftProcessing(), []
    state._last = handle
    row = lambda n, ts, s: Row(event_id=n, ts_ms=ts, state=s)
    for batch in ([row(1, 20, "done"), row(0, 10, "processing")], [row(3, 30, "processing"), row(2, 30, "error")],
                  [row(4, 40, "error"), row(5, None, "processing")]):
        before = handle.calls
        out += [(r["event_id"], r["state"], r["ok"]) for r in state.handleInputRows(("m", "k"), iter(batch), None)]
        assert handle.calls - before == 2
    assert out == [(1, "done", True), (4, "error", False)] and handle.value == ("processing",)
