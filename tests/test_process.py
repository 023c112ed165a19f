"""A whole run: resumed after a failure, seen only when it is done."""

import json

import pytest
from pyspark.sql import functions as F

from parley.plans import process
from parley.sources import store


def segment(start, words):
    return {"start": start, "end": start + 0.4 * len(words), "text": " ".join(words), "no_speech_prob": 0.0,
            "words": [{"w": " " + w, "s": start + 0.4 * i, "e": start + 0.4 * (i + 1)} for i, w in enumerate(words)]}


def inputs(spark):
    """One online meeting whose microphone repeats what the system track says, and one in person."""
    far = "we should move the launch to friday because of the tests".split()
    own = "i think that is a very good idea indeed".split()
    parts = [("a", "system", 0, [segment(0.0, far)]), ("a", "mic", 0, [segment(0.9, far), segment(20.0, own)]),
             ("a", "mic", 1, [segment(40.0, ["..."])]), ("b", "mic", 0, [segment(0.0, own), segment(6.0, far)])]
    output = spark.createDataFrame([(m, t, p, json.dumps({"language": "en", "segments": s})) for m, t, p, s in parts],
                                   "meeting_id string, track string, part int, output string")
    meetings = spark.createDataFrame(
        [("a", "online", None, ["Mic audio contained speaker echo: removed 9", "kept"]), ("b", "inperson", 1, None)],
        "meeting_id string, mode string, expected_speakers int, warnings array<string>")
    stopped = spark.createDataFrame([("a", "mic", 1000, 60_000, "en", None), ("a", "system", 1000, 60_000, "en", None),
                                     ("b", "mic", 1000, 30_000, "en", "d"), ("b", "system", 1000, 200, "en", None)],
                                    "meeting_id string, track string, started_ms long, recorded_ms long, language string, device string")
    known = spark.createDataFrame([("a", "mic", "old")], "meeting_id string, track string, old_device string")
    return output, meetings, stopped, known


def embed(windows):
    return windows.withColumn("embedding", F.array(F.lit(1.0).cast("float"), F.lit(0.0).cast("float")))


def rows(spark, path, table, *columns):
    return sorted(tuple(r) for r in store.read(spark, path, table).select(*columns).collect())


def test_run_is_resumed_and_seen_at_once(spark, tmp_path):
    path, made = str(tmp_path), []

    def breaks(windows):
        made.append("embed")
        raise RuntimeError("model is gone")
    with pytest.raises(RuntimeError, match="model is gone"):
        process.process(spark, path, "r", *inputs(spark), breaks)
    assert store.current(path)["version"] == 0 and store.staged(path, "r", "segments") is not None
    before = store.staged(path, "r", "segments")

    output, *rest = inputs(spark)
    nothing = output.filter("false")  # stages that are written are not made again
    assert process.process(spark, path, "r", nothing, *rest, embed) == 1
    assert store.staged(path, "r", "segments") == before
    assert set(store.current(path)["tables"]) == set(process.TABLES)
    assert rows(spark, path, "turns", "meeting_id", "speaker", "text") == [
        ("a", "s1", "we should move the launch to friday because of the tests"),
        ("a", "you", "i think that is a very good idea indeed"),
        ("b", "s1", "i think that is a very good idea indeed we should move the launch to friday because of the tests")]
    told = {r["meeting_id"]: r for r in store.read(spark, path, "meetings").collect()}
    assert told["a"]["warnings"] == ["kept", "Mic audio contained speaker echo: removed 1 echo segment(s) "
                                             "(tip: headphones avoid this entirely)."]
    assert told["b"]["warnings"] == [] and told["b"]["n_turns"] == 1 and told["a"]["status"] == "done"
    assert process.process(spark, path, "r", nothing, *rest, embed) == 1  # published once


def test_second_run_keeps_names_and_other_meetings(spark, tmp_path):
    path = str(tmp_path)
    output, meetings, stopped, known = inputs(spark)
    process.process(spark, path, "one", output, meetings, stopped, known, embed)
    named = store.read(spark, path, "speakers").withColumn("name", F.concat(F.lit("N "), "speaker"))
    store.replace(named, path, "speakers")
    only = [f.filter("meeting_id = 'a'") for f in (output, meetings, stopped, known)]
    process.process(spark, path, "two", *only, embed)
    assert rows(spark, path, "speakers", "meeting_id", "speaker", "name") == [
        ("a", "s1", "N s1"), ("a", "you", "N you"), ("b", "s1", "N s1")]
    assert {r[0] for r in rows(spark, path, "turns", "meeting_id")} == {"a", "b"}
    assert [r[0] for r in rows(spark, path, "speaker_stats", "meeting_id")].count("a") == 2
