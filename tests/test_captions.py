"""Caption lines from growing files, and the ring of newest lines in the stream's state."""

import json

import pandas as pd
from pyspark.sql import functions as F

from parley.operators import captions as batch
from parley.sources import captions as source
from parley.streaming import captions, run


def write(root, meeting, track, events, mode="a", end=True):
    folder = root / f"meeting_id={meeting}" / f"track={track}"
    folder.mkdir(parents=True, exist_ok=True)
    with open(folder / "lines.ndjson", mode) as f:
        for i, e in enumerate(events):
            f.write(e if isinstance(e, str) else json.dumps(e))
            f.write("\n" if end or i < len(events) - 1 else "")
    return folder


def take(spark, root, out, **options):
    """One run over what is there; the checkpoint remembers what was read."""
    stream = source.caption_stream(spark, str(root), **options)
    query = (stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/cp").option("path", f"{out}/t")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return sorted((r["meeting_id"], r["track"], r["t"], r["text"]) for r in spark.read.parquet(f"{out}/t").collect())


def test_files_grow_between_batches(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "out")
    write(root, "a", "mic", [{"t": "partial", "start": 0, "end": 1, "text": "h"}, "{broken", '{"t": "other"}', "[1]", ""])
    folder = write(root, "a", "mic", ['{"t": "final", "sta'], end=False)
    first = take(spark, root, out)
    assert first == [("a", "mic", "bad", "[1]"), ("a", "mic", "bad", '{"t": "other"}'), ("a", "mic", "bad", "{broken"),
                     ("a", "mic", "partial", "h")]
    write(root, "a", "mic", ['rt": 0, "end": 1, "text": "hé"}'])
    write(root, "b", "system", [{"t": "final", "text": 7}])
    assert take(spark, root, out) == sorted(first + [("a", "mic", "final", "hé"), ("b", "system", "final", "7")])
    assert len(take(spark, root, out)) == 6
    (folder / source.END).write_text("")
    assert take(spark, root, out).count(("a", "mic", "done", None)) == 1
    assert take(spark, root, out).count(("a", "mic", "done", None)) == 1


def test_ranges_cut_no_line(spark, tmp_path):
    texts = [f"{i} " + "ü" * (i % 13) for i in range(200)]
    write(tmp_path / "in", "m", "mic", [{"t": "final", "start": i, "end": i + 1, "text": t, "at": 1000 + i, "n": i} for i, t in enumerate(texts)])
    found = take(spark, tmp_path / "in", str(tmp_path / "out"), ended=True, bytes_per_task=37)
    assert [r[3] for r in found if r[2] == "final"] == sorted(texts) and sum(r[2] == "done" for r in found) == 1


def test_ring_after_several_batches(spark, tmp_path):
    rows = [(m, "mic" if i % 3 else "system", "final" if i % 4 else "partial", float(i), f"{m}{i}", i * 1000, i)
            for m, n in (("a", 90), ("b", 5)) for i in range(n)]
    frame = spark.createDataFrame(rows, "meeting_id string, track string, t string, start double, text string, arrival_ms long, event_id long")
    frame = frame.withColumn("end", F.col("start")).withColumn("arrival", F.timestamp_millis("arrival_ms"))
    for k in range(3):
        frame.filter(f"event_id % 90 >= {30 * k} AND event_id % 90 < {30 * k + 30}").coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    feed = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed"))
    run.use_state_store(spark)
    checkpoint = str(tmp_path / "cp")
    query = captions.caption_lines(feed, ring=10).writeStream.format("noop").option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()
    query.awaitTermination()
    got = sorted(tuple(r) for r in captions.ring_of(spark, checkpoint).select("meeting_id", "seq", "track", "text").collect())
    want = batch.ring(batch.finals(frame), 10).select("meeting_id", "seq", "track", "text")
    assert got == sorted(tuple(r) for r in want.collect()) and len(got) == 13


class Kept:
    """A map state that counts its calls."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def getMapState(self, *args):
        return self

    def getValue(self, key):
        self.calls += 1
        return self.held.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.held[key] = value


def test_a_group_takes_one_frame_and_two_calls_a_meeting():
    kept, state = Kept(), captions.CaptionState(ring=3)
    state.init(kept)
    event = lambda m, t, track, at: (m, t, track, 0.0, 1.0, f"{m}{at}", at, at)
    frame = lambda *rows: pd.DataFrame(rows, columns=captions.EVENT)
    first = [frame(event("b", "partial", "mic", 2), event("a", "final", "mic", 3)),
             frame(event("a", "final", "system", 1), event("a", "partial", "system", 4), event("b", "final", "mic", 5))]
    out = list(state.handleInputRows((0,), iter(first), None))
    assert len(out) == 1 and kept.calls == 4
    assert [tuple(r) for r in out[0][["meeting_id", "kind", "seq", "track", "text"]].itertuples(index=False)] == [
        ("a", "final", 1, "system", "a1"), ("a", "final", 2, "mic", "a3"), ("a", "partial", 2, "system", "a4"),
        ("a", "partial", 2, "mic", None), ("b", "final", 1, "mic", "b5"), ("b", "partial", 1, "mic", None)]
    second = frame(*[event("a", "final", "mic", n) for n in (8, 7)], event("c", "done", "mic", 9))
    list(state.handleInputRows((0,), iter([second]), None))
    assert kept.calls == 8 and [(r[0], r[4]) for r in kept.held["a",][1]] == [(2, "a3"), (3, "a7"), (4, "a8")]
    assert kept.held["a",][2] == [("system", 0.0, 1.0, "a4")] and kept.held["c",] == (0, [], [])


def test_meetings_of_one_group_stay_apart(spark, tmp_path, monkeypatch):
    """All meetings in one group, one without a name; several batches give what the table gives."""
    monkeypatch.setattr(captions, "GROUPS", 1)
    rows = [(("a", "b", None)[i * 7 % 3], "mic" if i % 2 else "system", ("final", "partial", "done")[(i * i + i // 7) % 3], float(i), f"t{i}",
             i * 1000, i) for i in range(120)]
    frame = spark.createDataFrame(rows, "meeting_id string, track string, t string, start double, text string, arrival_ms long, event_id long")
    frame = frame.withColumn("end", F.col("start")).withColumn("arrival", F.timestamp_millis("arrival_ms"))
    for k in range(4):
        frame.filter(f"event_id >= {30 * k} AND event_id < {30 * k + 30}").coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    feed = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed"))
    run.use_state_store(spark)
    place, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    captions.caption_lines(feed, ring=5).writeStream.format("parquet").option("checkpointLocation", checkpoint).option(
        "path", place).trigger(availableNow=True).start().awaitTermination()
    said = lambda df: sorted(map(str, df.select("meeting_id", "seq", "track", "who", "start", "end", "text").fillna("?").collect()))
    lines = spark.read.parquet(place).fillna("?", ["meeting_id"])
    frame = frame.fillna("?", ["meeting_id"])  # the table's way leaves out a meeting without a name
    want = batch.finals(frame)
    assert said(lines.filter("kind = 'final'")) == said(want) and want.count() > 30
    assert said(captions.ring_of(spark, checkpoint)) == said(batch.ring(want, 5))
    last = lines.filter("kind = 'partial'").groupBy("meeting_id", "track").agg(
        F.max_by("text", F.struct("arrival_ms", "event_id")).alias("text")).filter("text IS NOT NULL")
    found = sorted(map(str, last.select("meeting_id", "track", "text").collect()))
    assert found == sorted(map(str, batch.partials(frame).select("meeting_id", "track", "text").collect()))
