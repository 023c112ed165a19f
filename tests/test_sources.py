"""Files in, files out."""

import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.functions import text as X
from parley.operators import audio, catalog
from parley.operators.stats import speaker_stats
from parley.sources import analysis, meetings, wav


def write(root, folder, body):
    path = root / folder
    path.mkdir()
    (path / "meeting.json").write_text(body if isinstance(body, str) else json.dumps(body, indent=1))


def test_scan(spark, tmp_path):
    write(tmp_path, "Plan — 20240102-030405", {"id": "20240102-030405", "title": "Plan", "speakers": {"you": "You", "s1": "Ana"}})
    write(tmp_path, "20240102-030406", {"id": "20240102-030406", "title": "Other"})
    write(tmp_path, "20240102-030407", "{broken")
    write(tmp_path, "no meeting", {"id": "x"})
    rows = {r["meeting_id"]: r["title"] for r in meetings.scan_meetings(spark, str(tmp_path)).collect()}
    assert rows == {"20240102-030405": "Plan", "20240102-030406": "Other"}
    with pytest.raises(Exception):
        meetings.scan_meetings(spark, str(tmp_path), safe=False).collect()


def test_saving_one_meeting_keeps_the_others(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.createDataFrame([(str(i), "old") for i in range(50)], "meeting_id string, title string")
    meetings.write_meetings(rows, path)
    one = rows.filter("meeting_id = '7'").withColumn("title", F.lit("new"))
    meetings.write_meetings(one, path)
    again = meetings.read_meetings(spark, path)
    assert again.count() == 50 and [r["meeting_id"] for r in again.filter("title = 'new'").collect()] == ["7"]


def test_saved_analysis_is_replaced_per_meeting(spark, tmp_path):
    rows = spark.createDataFrame([(f"m{i}", "mic", w, [float(i), float(w)]) for i in range(20) for w in range(3)],
                                 "meeting_id string, track string, win_id int, embedding array<double>")
    analysis.save_analysis(str(tmp_path), {"voice_windows": rows})
    fewer = rows.filter("meeting_id = 'm7' AND win_id = 1").withColumn("embedding", F.array(F.lit(9.0)))
    analysis.save_analysis(str(tmp_path), {"voice_windows": fewer})
    saved = analysis.load_analysis(spark, str(tmp_path))["voice_windows"]
    want = rows.filter("meeting_id <> 'm7'").unionByName(fewer)
    assert sorted(map(repr, saved.select(*want.columns).collect())) == sorted(map(repr, want.collect()))


def test_a_document_that_breaks_is_not_gone(spark, tmp_path):
    for i in (6, 7, 8):
        write(tmp_path, f"20240102-03040{i}", {"id": f"20240102-03040{i}", "title": "T"})
    known = spark.createDataFrame(meetings.scan_meetings(spark, str(tmp_path)).select("folder", "modified").collect())
    (tmp_path / "20240102-030406" / "meeting.json").write_text("{broken")
    (tmp_path / "20240102-030407" / "meeting.json").unlink()
    _, gone = meetings.scan_changed(spark, str(tmp_path), known)
    assert [r["folder"] for r in gone.collect()] == ["20240102-030407"]


def test_exports_of_other_meetings_stay(spark, tmp_path):
    lines = spark.createDataFrame([(m, 0, m) for m in "abc"], "meeting_id string, line_no int, line string")
    meetings.write_exports(lines, str(tmp_path / "out"), ["line_no"])
    meetings.write_exports(lines.filter("meeting_id = 'b'").withColumn("line", F.lit("new")), str(tmp_path / "out"), ["line_no"])
    assert {r["meeting_id"]: r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()} == {"a": "a", "b": "new", "c": "c"}


def test_words_move_with_their_track(spark):
    segs = spark.createDataFrame([("m", "mic", 1, 1000, 2000, [("hi", 1100, 1200)])],
                                 "meeting_id string, track string, seg_id int, start_ms long, end_ms long, "
                                 "words array<struct<w:string,s_ms:long,e_ms:long>>")
    tracks = spark.createDataFrame([("m", "mic", 500, True)], "meeting_id string, track string, offset_ms long, usable boolean")
    row = audio.shift_segments(segs, tracks).first()
    assert (row["start_ms"], row["end_ms"], row["words"][0].asDict()) == (1500, 2500, {"w": "hi", "s_ms": 1600, "e_ms": 1700})


def test_phrases_are_texts(spark):
    table = spark.createDataFrame([("a.b and a b, sort of sort out",)], "t string")
    row = table.select(X.filler_hits(F.col("t"), ["a.b", "sort of", "of sort"]).alias("hits"),
                       X.fix_mishearings(F.col("t"), {"a.b": "$1\\x"}).alias("fixed")).first()
    assert sorted(row["hits"]) == ["a.b", "of sort", "sort of"] and row["fixed"] == "$1\\x and a b, sort of sort out"


def test_exports_keep_line_order(spark, tmp_path):
    talks = spark.createDataFrame([("m", "Talk")], "meeting_id string, title string")
    named = spark.createDataFrame([("m", i, f"N{i}", i * 61_000, f"t{i}") for i in range(40)],
                                  "meeting_id string, turn_id long, name string, start_ms long, text string")
    meetings.write_exports(catalog.text_lines(talks, named), str(tmp_path / "out"), ["line_no"])
    files = sorted((tmp_path / "out" / "meeting_id=m").glob("part-*.txt"))
    lines = [line for f in files for line in f.read_text().split("\n")[:-1]]
    assert lines[:4] == ["Talk", "====", "", "[00:00] N0: t0"] and lines[-1] == "[39:39] N39: t39" and len(lines) == 43


def test_wav(spark, tmp_path):
    samples = np.arange(-3000, 3000, dtype="<i2")
    with wave.open(str(tmp_path / "mic.wav"), "wb") as f:
        f.setnchannels(2)
        f.setsampwidth(2)
        f.setframerate(16000)
        f.writeframes(samples.tobytes())
    rows = wav.audio_chunks(wav.wav_files(spark, str(tmp_path))).orderBy("start_frame").collect()
    assert [r["start_frame"] for r in rows] == [0, 1024, 2048]
    assert [x for r in rows for x in r["samples"]] == samples.tolist()


def test_rounded_figures(spark):
    """Share and pace divide rounded seconds; a silent speaker has zeros; strangers do not count."""
    turns = spark.createDataFrame([("m", 0, "you", 0, 61_240, "um, yes? you know like-minded"), ("m", 1, "zz", 0, 9_000, "no")],
                                  "meeting_id string, turn_id long, speaker string, start_ms long, end_ms long, text string")
    people = spark.createDataFrame([("m", "you", 0), ("m", "s1", 1)], "meeting_id string, speaker string, ord int")
    you, s1 = speaker_stats(turns, people).orderBy("ord").collect()
    assert (you["seconds"], you["share"], you["words"], you["wpm"], you["questions"], you["fillers"]) == (61.2, 0.999, 5, 5, 1, 3)
    assert (s1["turns"], s1["seconds"], s1["share"], s1["wpm"]) == (0, 0.0, 0.0, 0)


def test_text_rules(spark):
    row = spark.createDataFrame([("Get Hub and POOL REQUEST, forget hubs", 3_725_000, "  a/b: c\n d.. ")], "t string, ms long, title string")
    got = row.select(
        X.fix_mishearings(F.col("t")).alias("fixed"), X.clock(F.col("ms")).alias("clock"),
        X.minutes_seconds(F.col("ms")).alias("ms"), X.duration_label(F.col("ms")).alias("length"),
        X.safe_folder_title(F.col("title")).alias("safe"), X.clean_due(F.lit(" N/A ")).alias("due"),
        X.norm_text(F.lit("Ünïcode, Text 9!")).alias("plain"), X.norm_text(F.lit("Ünïcode, Text 9!"), unicode=True).alias("wide"),
        X.language_choice(F.lit("auto")).alias("lang")).first()
    assert got["fixed"] == "GitHub and pull request, forget hubs"
    assert (got["clock"], got["ms"], got["length"]) == ("1:02:05", "62:05", "1 h 2 min")
    assert got["safe"] == "ab c d" and got["due"] == "" and got["lang"] is None
    assert (got["plain"], got["wide"]) == ("ncode text 9", "ünïcode text 9")
