"""Queries that read files Spark wrote from the given tables, and whole jobs."""

import io
import json
import wave

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from parley.functions import text as X
from parley.functions.constants import CHUNK_CHARS
from parley.operators import speakers, turns, windows
from parley.plans import summarize
from parley.plans.summarize import Overflow, Refused
from parley.registry import sql as S
from parley.registry.catalog import MEETINGS
from parley.registry.conversation import build_turns
from parley.registry.events import AUDIO
from parley.session import cut_lineage, run_dir
from parley.sources import analysis, folders, meetings, recognizer, wav
from parley.sources import derived as D


def _documents(spark, sf):
    """Meeting documents as JSON text; every eleventh is cut off."""
    rows = D.meetings(spark, sf)
    people = F.map_from_entries(F.transform("speakers", lambda s: F.struct(s["speaker"], s["name"])))
    body = F.to_json(F.struct(
        F.col("meeting_id").alias("id"), "title", F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss").alias("created"),
        (F.col("duration_ms") / 1000).alias("duration"), "mode", "status", people.alias("speakers"), "warnings"))
    broken = F.when(F.col("doc_id") % 11 == 0, body.substr(F.lit(1), F.length(body) - 9)).otherwise(body)
    folder = F.when(F.col("doc_id") % 7 == 0, "notes").otherwise(
        X.folder_name(F.concat(F.lit("Talk "), F.col("doc_id").cast("string")), F.col("meeting_id")))
    return rows.select("doc_id", folder.alias("folder"), broken.alias("value"))


def scan_meetings(spark, sf):
    """Documents of one folder per meeting, written as text and scanned as JSON."""
    root = run_dir(spark, "documents")
    folders.write_text(_documents(spark, sf), root, "folder")
    rows = meetings.scan_meetings(spark, root, document="*.txt")
    return rows.select("meeting_id", "title", F.size("speakers").cast("bigint").alias("speakers"), "status")


def scan_changed(spark, sf):
    """What a second scan finds: a fifth of the documents was never there, a third was
    seen in an older state."""
    root = run_dir(spark, "documents")
    rows = _documents(spark, sf)
    folders.write_text(rows.filter("doc_id % 5 <> 0"), root, "folder")
    seen = meetings.scan_meetings(spark, root, document="*.txt").select("folder", "modified", "meeting_id")
    ids = D.meetings(spark, sf).select("meeting_id", "doc_id")
    older = F.when(F.col("doc_id") % 3 == 0, F.col("modified") - F.expr("INTERVAL 1 HOUR")).otherwise(F.col("modified"))
    gone = rows.filter("doc_id % 5 = 0").select("folder", F.current_timestamp().alias("modified"))
    known = cut_lineage(seen.join(ids, "meeting_id").select("folder", older.alias("modified")).unionByName(gone))
    changed, forgotten = meetings.scan_changed(spark, root, known, document="*.txt")
    return changed.select("folder", F.lit("changed").alias("state")).unionByName(
        forgotten.select("folder", F.lit("gone").alias("state")).distinct())


def ingest_segments(spark, sf):
    return recognizer.ingest_segments(_recognized(spark, sf)).select(
        "meeting_id", "track", "seg_id", "start_ms", "end_ms", "text", F.size("words").cast("bigint").alias("words"))


def _recognized(spark, sf):
    """Recognizer output per conversation turn. Some pieces are only marks, and some
    words have no start."""
    rows = D.table(spark, sf, "conversations").withColumn("p", F.split("text", r"\. "))
    segment = F.transform("p", lambda piece, i: F.struct(
        (F.col("turn") * 90 + i * 9).cast("double").alias("start"), (F.col("turn") * 90 + i * 9 + 4.5).alias("end"),
        F.when(i % 6 == 5, " …? ").otherwise(F.concat(F.lit("  "), piece)).alias("text"),
        F.transform(F.split(piece, " "), lambda w, j: F.struct(
            w.alias("w"), F.when((j + i) % 9 != 0, (j * 0.4).cast("double")).alias("s"),
            (j * 0.4 + 0.4).cast("double").alias("e"))).alias("words")))
    return rows.select(
        F.col("conv_id").cast("string").alias("meeting_id"),
        F.when(F.col("role") == "user", "mic").otherwise("system").alias("track"), F.col("turn").alias("part"),
        F.to_json(F.struct(F.lit("en").alias("language"), segment.alias("segments"))).alias("output"))


def load_analysis(spark, sf):
    path = run_dir(spark, "analysis")
    said = D.segments(spark, sf).drop("tokens")
    windows_ = speakers.speech_windows(D.segments(spark, sf))
    analysis.save_analysis(path, {"segments": said, "words": D.words(spark, sf), "voice_windows": windows_})
    saved = analysis.load_analysis(spark, path)
    count = lambda name: saved[name].groupBy("meeting_id").agg(F.count(F.lit(1)).alias(name))
    return count("segments").join(count("words"), "meeting_id").join(count("voice_windows"), "meeting_id")


@F.pandas_udf(BinaryType())
def _wav(samples: pd.Series, channels: pd.Series) -> pd.Series:
    def encode(values, n):
        out = io.BytesIO()
        with wave.open(out, "wb") as f:
            f.setnchannels(int(n))
            f.setsampwidth(2)
            f.setframerate(1)
            f.writeframes(np.asarray(values, dtype="<i2").tobytes())
        return out.getvalue()
    return pd.Series([encode(v, n) for v, n in zip(samples, channels)])


def audio_chunks(spark, sf):
    """Every event's samples packed as a WAV file and read back in chunks of three
    frames."""
    files = D.audio_chunks(D.events(spark, sf)).select(
        F.col("chunk_id").cast("string").alias("path"), _wav("samples", "channels").alias("content"))
    return wav.audio_chunks(files, chunk_frames=3).select(
        "path", "chunk_id", "start_frame", F.col("channels").cast("bigint").alias("channels"),
        F.array_join("samples", ",").alias("samples"))


def _titles(spark, sf):
    people = D.speakers(spark, sf).groupBy("meeting_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda s: s["name"]), ", ").alias("participants"))
    return people.select("meeting_id", F.concat(F.lit("Meeting "), "meeting_id").alias("title"), "participants")


def summarize_chunks(spark, sf):
    named = turns.named_turns(build_turns(spark, sf), D.speakers(spark, sf))
    lines = cut_lineage(windows.transcript_lines(named))
    return summarize.sources(lines, _titles(spark, sf), limit=CHUNK_CHARS // 5)


def _note(text, title):
    """Stands in for a model: the beginnings of a portion's lines. Long portions overflow, some are refused."""
    if len(text) > CHUNK_CHARS // 6:
        raise Overflow
    if len(text) % 7 == 0:
        raise Refused
    return "\n".join("- " + line[:80] for line in text.split("\n"))


def _reply(source, title):
    """Stands in for a model: the lines of the source by turns as points, decisions and actions, in an object that
    stands alone, in a fence, or is cut off."""
    head, _, notes = source.partition("\n\n")
    if len(notes) % 11 == 0:
        raise Refused
    lines = notes.split("\n")
    body = json.dumps({"headline": title, "tldr": head, "key_points": lines, "decisions": lines[::2],
                       "action_items": [{"owner": title[-1:], "task": x, "due": "TBD"} for x in lines[1::3]]})
    return (body, f"```json\n{body}\n```", body[:-1] if len(notes) % 5 == 0 else body)[len(notes) % 3]


def summarize_meetings(spark, sf):
    """From named turns to stored summaries: chunks, notes, condensed notes, the last call, its reply's fields, and
    no thought twice."""
    named = turns.named_turns(build_turns(spark, sf), D.speakers(spark, sf))
    lines = cut_lineage(windows.transcript_lines(named))
    found = summarize.summarize_meetings(lines, _titles(spark, sf), _reply, _note, limit=CHUNK_CHARS // 5)
    joined = lambda name: F.array_join(name, "|").alias(name)
    return found.select("meeting_id", "chunks", "cut", "state", "headline", joined("key_points"), joined("decisions"),
                        F.array_join(F.transform("action_items", lambda a: F.concat_ws("/", a["owner"], a["task"], a["due"])),
                                     "|").alias("action_items"))


QUERIES = {f.__name__: f for f in (
    scan_meetings, scan_changed, ingest_segments, load_analysis, audio_chunks, summarize_chunks,
    summarize_meetings)}

ORACLE = {
    "scan_meetings": f"""WITH {MEETINGS} SELECT meeting_id, title, len(names) AS speakers, status FROM meetings
WHERE doc_id % 11 <> 0 AND doc_id % 7 <> 0""",
    "scan_changed": f"""WITH {MEETINGS},
f AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'notes' ELSE 'Talk ' || doc_id || ' — ' || meeting_id END AS folder FROM meetings)
SELECT folder, 'changed' AS state FROM f WHERE doc_id % 5 <> 0 AND doc_id % 11 <> 0 AND doc_id % 7 <> 0 AND doc_id % 3 = 0
UNION ALL SELECT DISTINCT folder, 'gone' FROM f WHERE doc_id % 5 = 0""",
    "ingest_segments": f"""WITH p AS (
  SELECT conv_id, turn, role, generate_subscripts(string_split(text, '. '), 1) - 1 AS i, unnest(string_split(text, '. ')) AS piece
  FROM conversations),
s AS (SELECT *, CASE WHEN i % 6 = 5 THEN '…?' ELSE {S.strip('piece')} END AS text FROM p)
SELECT conv_id::VARCHAR AS meeting_id, CASE WHEN role = 'user' THEN 'mic' ELSE 'system' END AS track, turn * 1000000 + i AS seg_id,
  (turn * 90 + i * 9) * 1000 AS start_ms, (turn * 90 + i * 9) * 1000 + 4500 AS end_ms, text,
  len(list_filter(range(len(string_split(piece, ' '))), lambda j: (j + i) % 9 <> 0)) AS words
FROM s WHERE regexp_matches(text, '[{S.LETTER}]')""",
    "load_analysis": f"""WITH {S.WORDS},{S.WINDOWS}
SELECT s.meeting_id, s.n AS segments, w.n AS words, v.n AS voice_windows
FROM (SELECT meeting_id, count(*) AS n FROM segments GROUP BY 1) s JOIN (SELECT meeting_id, count(*) AS n FROM words GROUP BY 1) w USING (meeting_id)
JOIN (SELECT meeting_id, count(*) AS n FROM windows GROUP BY 1) v USING (meeting_id)""",
    "audio_chunks": f"""WITH {AUDIO}
SELECT event_id::VARCHAR AS path, (f - f0) // 3 AS chunk_id, (f - f0) // 3 * 3 AS start_frame, any_value(ch)::BIGINT AS channels,
       string_agg(x, ',' ORDER BY j) AS samples FROM sample GROUP BY event_id, (f - f0) // 3""",
}
