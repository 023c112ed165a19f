"""Streaming queries, run over everything the tables hold now."""

from pyspark.sql import functions as F

from parley.operators import activity, calendar
from parley.registry import events as E
from parley.registry.catalog import MEETINGS
from parley.session import cut_lineage, run_dir
from parley.sources import captions as files
from parley.sources import derived as D
from parley.sources import folders as text
from parley.streaming import captions, folders, jobs, nudges, run
from parley.streaming import sync as pushing

HOUR_MS = 3_600_000


def _events(spark, sf):
    return D.timed(run.file_stream(spark, sf, "events.parquet"))


def _lines(spark, sf):
    return run.to_table(captions.caption_lines(D.captions(_events(spark, sf))), "captions")


def captions_live(spark, sf):
    return _lines(spark, sf).filter("kind = 'final'").drop("kind", "arrival_ms", "event_id")


def captions_live_partial(spark, sf):
    """The last state of each track's partial; the events come in several batches."""
    last = _lines(spark, sf).filter("kind = 'partial'").groupBy("meeting_id", "track").agg(
        F.max_by(F.struct("start", "end", "text", "who"), F.struct("arrival_ms", "event_id")).alias("e"))
    return last.filter("e.text IS NOT NULL").select("meeting_id", "track", "e.who", "e.start", "e.end", "e.text")


def captions_ndjson(spark, sf):
    """Every event as a line of its track's file, and a line that is no event beside every fiftieth; read as a
    stream from the files."""
    root = run_dir(spark, "ndjson")
    rows = D.captions(D.events(spark, sf))
    line = F.to_json(F.struct("t", "start", "end", "text", F.col("arrival_ms").alias("at"), F.col("event_id").alias("n")))
    broken = F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("{"), "text"))
    place = F.concat(F.lit("meeting_id="), "meeting_id", F.lit("/track="), "track").alias("place")
    text.write_text(rows.select(place, F.explode(F.array_compact(F.array(line, broken))).alias("value")).repartition("place"),
                    root, "place")
    stream = files.events(files.caption_stream(spark, root, ended=True))
    lines = run.to_table(captions.caption_lines(stream), "ndjson-lines")
    return lines.filter("kind = 'final'").drop("kind", "arrival_ms", "event_id")


def captions_ring_live(spark, sf):
    """The newest lines of every meeting, as the stream's state has them in the end."""
    run.use_state_store(spark)
    checkpoint = run_dir(spark, "ring")
    lines = captions.caption_lines(D.captions(_events(spark, sf)), ring=10)
    lines.writeStream.format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return captions.ring_of(spark, checkpoint).select("meeting_id", "seq", "track", "who", "start", "end", "text")


def job_transitions_live(spark, sf):
    return run.to_table(jobs.finished_jobs(D.jobs(_events(spark, sf))), "jobs")


def _entries(spark, sf):
    """The calendar entry of the user's team at the moment of each event, as a table: the stream meets it in a
    stream-static join."""
    batch = D.events(spark, sf)
    moments = batch.select((F.col("user_id") % 15).cast("string").alias("team"), F.col("event_id").alias("probe_id"),
                           F.floor(F.col("ts_ms") / 1000).cast("bigint").alias("now_s"))
    return cut_lineage(calendar.current_event(moments, D.calendar(batch), ["team"], lead_min=1).select(
        F.col("probe_id").alias("event_id"), F.col("title").alias("cal_title"), F.col("start_s").alias("cal_start_s")))


def _offers(spark, sf, entries, actions=None):
    samples = D.mic_samples(_events(spark, sf)).join(entries, "event_id", "left")
    rows = nudges.inputs(samples, actions)
    return run.to_table(nudges.nudges(rows, persist_ms=6 * HOUR_MS, cooldown_ms=48 * HOUR_MS, ttl_ms=3 * HOUR_MS), "nudges")


def nudge_call(spark, sf):
    return _offers(spark, sf, _entries(spark, sf)).select("user_id", "ts_ms", "nudge_id", "kind", "title", "meeting_title")


def nudge_actions(spark, sf):
    """Every other first offer is answered a minute later."""
    entries = _entries(spark, sf)
    offers = _offers(spark, sf, entries)
    later = F.col("ts_ms") + 60_000
    answers = offers.filter(F.col("ts_ms") % 2 == 0).select(
        "user_id", F.timestamp_millis(later).alias("ts"), later.alias("ts_ms"), F.lit(-1).cast("bigint").alias("event_id"),
        "nudge_id", F.when(F.col("ts_ms") % 4 == 0, "accept").otherwise("dismiss").alias("action"))
    path = run_dir(spark, "answers")
    answers.write.parquet(f"{path}/answers.parquet")
    stream = run.file_stream(spark, f"{path}/answers.parquet", "*.parquet")
    return _offers(spark, sf, entries, stream).select("user_id", "ts_ms", "event", "nudge_id", "kind")


def announce_once_live(spark, sf):
    shown = _events(spark, sf).select(F.concat(F.lit("n-"), F.sha1("props")).alias("nudge_id"), "ts")
    return run.to_table(nudges.announced(shown, "60 days"), "announced").select("nudge_id")


def tumbling_activity_live(spark, sf):
    """Closed hours only: the watermark ends with the last event, so the hour it falls
    in stays open and is left out on both sides."""
    rows = _events(spark, sf).withWatermark("ts", "0 seconds")
    return run.to_table(activity.windowed(rows, ["event_type"], "1 hour"), "activity")


def sliding_activity_live(spark, sf):
    rows = _events(spark, sf).withWatermark("ts", "0 seconds")
    return run.to_table(activity.windowed(rows, ["event_type"], "6 hours", "2 hours"), "sliding")


def _users(spark, sf):
    return _events(spark, sf).withColumn("user_id", F.col("user_id").cast("string")).withWatermark("ts", "0 seconds")


def session_activity_live(spark, sf):
    return run.to_table(activity.session_stream(_users(spark, sf), ["user_id"], "4 hours"), "sessions")


def session_days_live(spark, sf):
    return run.to_table(activity.session_totals(_users(spark, sf), ["user_id"], "4 hours", "1 day"), "session-days")


def scan_live(spark, sf):
    """Every document as a folder of three scans, some folders known before; each scan leaves a fifth of them
    out and finds a third of them changed."""
    path = run_dir(spark, "scans")
    docs = D.table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("folder")).filter(
        "doc_id IS NOT NULL").distinct()
    at = lambda k: F.timestamp_seconds(F.floor((F.col("doc_id") + k) / 3))
    known = docs.filter("doc_id % 2 = 0").select("folder", F.lit(0).alias("scan"), at(0).alias("modified"))
    for k in (1, 2, 3):
        folders.record_scan(docs.filter((F.col("doc_id") + k) % 5 != 0).select("folder", at(k).alias("modified")), path, k)
    found = run.to_table(folders.folder_changes(folders.scans(spark, path), known), "folders")
    return found.select("folder", "scan", "state", F.unix_seconds("modified").alias("modified_s"))


def sync_push_live(spark, sf):
    """A change feed pushed in batches; one target in nine refuses and is queued."""
    path = run_dir(spark, "push")
    D.synced_meetings(spark, sf).filter("status = 'done' AND n_turns > 0").write.parquet(f"{path}/changes")
    changes = run.file_stream(spark, f"{path}/changes", "*.parquet", files_per_trigger=2)

    def push(rows, batch_id):
        refused = F.pmod(F.substring("meeting_id", -2, 2).cast("int"), F.lit(9)) == 0
        rows.filter(~refused).select("meeting_id").write.mode("overwrite").parquet(f"{path}/target/batch={batch_id}")
        return rows.filter(refused)
    current = lambda: spark.read.parquet(f"{path}/changes")
    pushing.push_changes(changes, push, f"{path}/queue", f"{path}/checkpoint", current).awaitTermination()
    queued = pushing.read_queue(spark, f"{path}/queue")
    return spark.read.parquet(f"{path}/target").select("meeting_id", F.lit("pushed").alias("state")).unionByName(
        queued.withColumn("state", F.lit("queued")))


def sync_retry(spark, sf):
    """Every synced meeting, fed in three batches and two ticks; a push fails by turns. Says in which
    batch each was pushed, null while it waits."""
    folder = run_dir(spark, "sync")
    rows = D.synced_meetings(spark, sf)
    saved = lambda: spark.read.schema(rows.schema).parquet(f"{folder}/feed").filter("meeting_id IS NOT NULL")

    def push(sent, batch_id):
        told = sent.select("meeting_id").join(saved().select("meeting_id", "doc_id"), "meeting_id").withColumn(
            "failed", (F.col("doc_id") + batch_id) % 4 < 3)
        told.write.mode("overwrite").parquet(f"{folder}/pushed/batch={batch_id}")
        return spark.read.parquet(f"{folder}/pushed/batch={batch_id}").filter("failed")
    for k in range(5):  # the stream goes on with whatever has come since as one batch, in as many files as it takes
        part = rows.filter(F.col("doc_id") % 3 == k) if k < 3 else spark.range(1).select(
            *[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])
        part.write.mode("append").parquet(f"{folder}/feed")
        feed = spark.readStream.schema(rows.schema).parquet(f"{folder}/feed")
        pushing.push_changes(feed, push, f"{folder}/queue", f"{folder}/checkpoint", saved).awaitTermination()
    done = spark.read.parquet(f"{folder}/pushed").filter("NOT failed").groupBy("meeting_id").agg(
        F.min("batch").cast("bigint").alias("batch"))
    waits = pushing.read_queue(spark, f"{folder}/queue").withColumn("waits", F.lit(True))
    return saved().filter("sync_enabled").select("meeting_id").join(done, "meeting_id", "left").join(
        waits, "meeting_id", "left").select("meeting_id", "batch", F.coalesce("waits", F.lit(False)).alias("waits"))


QUERIES = {f.__name__: f for f in (
    captions_live, captions_live_partial, job_transitions_live, nudge_call, nudge_actions, announce_once_live,
    tumbling_activity_live, sliding_activity_live, session_activity_live, session_days_live, scan_live, sync_push_live,
    sync_retry, captions_ndjson, captions_ring_live)}

_SAMPLES = f"""{E.CALENDAR},
entry AS (SELECT e.event_id, c.title, c.start_s,
          row_number() OVER (PARTITION BY e.event_id ORDER BY c.start_s DESC, c.event_pos) AS rn
          FROM ev e JOIN cal c ON c.team = (e.user_id % 15)::VARCHAR AND NOT all_day AND start_s - 60 <= e.sec AND e.sec < end_s),
samples AS (SELECT user_id::VARCHAR AS user_id, ts_ms, e.event_id, 'sample' AS what, NULL AS nudge_id, NULL AS action,
            event_type IN ('click', 'view', 'purchase') AS busy, event_type = 'signup' AS recording,
            (['Zoom', 'Teams', 'Teams', 'Slack', 'FaceTime', 'Webex'])[e.event_id % 8 + 1] AS app, n.title AS cal_title,
            'cal-' || substring(sha1(n.title || '|' || n.start_s), 1, 12) AS cal_id
            FROM ev e LEFT JOIN entry n ON n.event_id = e.event_id AND n.rn = 1)"""


def _walked(name, rows):
    """A user's rows one after the other: the state after each, and its event. 6 h of a busy
    microphone are a call, an answered call rests for 48 h, an offer stands for 3 h."""
    return f"""{name}_rows AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS rn FROM ({rows})),
{name} AS (
  SELECT DISTINCT user_id, 0::BIGINT AS rn, 0::BIGINT AS ts_ms, NULL::BIGINT AS since, NULL::BIGINT AS rests, NULL::VARCHAR AS oid,
         NULL::VARCHAR AS okind, NULL::BIGINT AS lapses, []::VARCHAR[] AS done, NULL::VARCHAR AS event, NULL::VARCHAR AS nudge_id,
         NULL::VARCHAR AS kind, NULL::VARCHAR AS title, NULL::VARCHAR AS meeting_title FROM {name}_rows
  UNION ALL
  SELECT user_id, rn, ts_ms,
    CASE WHEN hit OR recording THEN NULL WHEN what = 'action' OR standing OR cal THEN since WHEN busy THEN coalesce(since, ts_ms) END,
    CASE WHEN hit AND okind = 'call' THEN ts_ms + 172800000 ELSE rests END,
    CASE WHEN hit OR recording THEN NULL WHEN what = 'action' OR standing THEN oid WHEN cal THEN cal_id WHEN call THEN call_id END,
    CASE WHEN hit OR recording THEN NULL WHEN what = 'action' OR standing THEN okind WHEN cal THEN 'calendar' WHEN call THEN 'call' END,
    CASE WHEN hit OR recording THEN NULL WHEN what = 'action' OR standing THEN lapses WHEN cal OR call THEN ts_ms + 10800000 END,
    CASE WHEN hit THEN list_append(done, oid) ELSE done END,
    CASE WHEN hit THEN action WHEN cal OR call THEN 'offered' END, CASE WHEN hit THEN oid WHEN cal THEN cal_id WHEN call THEN call_id END,
    CASE WHEN hit THEN okind WHEN cal THEN 'calendar' WHEN call THEN 'call' END,
    CASE WHEN cal THEN '“' || cal_title || '” is starting' WHEN call THEN coalesce('In a ' || app || ' call?', 'In a call?') END,
    CASE WHEN cal THEN cal_title ELSE '' END
  FROM (SELECT *, open AND NOT cal AND busy AND ts_ms - coalesce(since, ts_ms) >= 21600000 AND coalesce(ts_ms >= rests, true) AS call,
               'call-' || coalesce(since, ts_ms) // 1000 AS call_id
        FROM (SELECT *, open AND cal_id IS NOT NULL AND NOT list_contains(done, cal_id) AS cal
              FROM (SELECT q.user_id, q.rn, q.ts_ms, q.what, q.action, q.cal_title, q.cal_id, q.app, coalesce(q.busy, false) AS busy,
                           coalesce(q.recording, false) AS recording, s.since, s.rests, s.oid, s.okind, s.lapses, s.done,
                           q.what = 'action' AND coalesce(s.oid = q.nudge_id AND q.ts_ms <= s.lapses, false) AS hit,
                           q.what = 'sample' AND NOT coalesce(q.recording, false) AND coalesce(q.ts_ms <= s.lapses, false) AS standing,
                           q.what = 'sample' AND NOT coalesce(q.recording, false) AND NOT coalesce(q.ts_ms <= s.lapses, false) AS open
                    FROM {name} s JOIN {name}_rows q ON q.user_id = s.user_id AND q.rn = s.rn + 1))))"""


#: Sessions whose end the newest event has reached; later ones are still open.
_CLOSED = f"""WITH {E.EVENTS},
f AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY user_id ORDER BY ts_ms) <= 14400000 THEN 0 ELSE 1 END AS f FROM ev),
g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts_ms) AS g FROM f),
s AS (SELECT min(ts_ms) // 1000 AS start_s, max(ts_ms) + 14400000 AS end_ms, user_id::VARCHAR AS user_id, count(*) AS n
      FROM g GROUP BY g.user_id, g)
SELECT *, end_ms // 1000 AS end_s FROM s WHERE end_ms <= (SELECT max(ts_ms) FROM ev)"""

_OFFERS = f"WITH RECURSIVE {_SAMPLES},{_walked('first', 'SELECT * FROM samples')}"

ORACLE = {
    "nudge_call": f"""{_OFFERS}
SELECT user_id, ts_ms, nudge_id, kind, title, meeting_title FROM first WHERE event = 'offered'""",
    "nudge_actions": f"""{_OFFERS},
answers AS (SELECT user_id, ts_ms + 60000 AS ts_ms, -1 AS event_id, 'action' AS what, nudge_id,
            CASE WHEN ts_ms % 4 = 0 THEN 'accept' ELSE 'dismiss' END AS action, NULL::BOOLEAN AS busy, NULL::BOOLEAN AS recording,
            NULL AS app, NULL AS cal_title, NULL AS cal_id FROM first WHERE event = 'offered' AND ts_ms % 2 = 0),
{_walked('second', 'SELECT * FROM samples UNION ALL SELECT * FROM answers')}
SELECT user_id, ts_ms, event, nudge_id, kind FROM second WHERE event IS NOT NULL""",
    "captions_live": E.ORACLE["captions_final"],
    "captions_ndjson": E.ORACLE["captions_final"],
    "captions_ring_live": E.ORACLE["captions_ring"],
    "captions_live_partial": E.ORACLE["captions_partial"],
    "job_transitions_live": E.ORACLE["job_transitions"],
    "announce_once_live": "SELECT DISTINCT 'n-' || sha1(props) AS nudge_id FROM events",
    "tumbling_activity_live": E.ORACLE["tumbling_activity"].replace(
        "FROM ev GROUP", "FROM ev WHERE sec // 3600 < (SELECT max(sec) // 3600 FROM ev) GROUP"),
    "sliding_activity_live": f"""SELECT * FROM ({E.ORACLE["sliding_activity"]})
WHERE end_s * 1000 <= (SELECT max(epoch_us(ts) // 1000) FROM events)""",
    "session_activity_live": f"SELECT start_s, end_s, user_id, n FROM ({_CLOSED})",
    "session_days_live": f"""SELECT (end_ms - 1) // 86400000 * 86400 AS start_s, (end_ms - 1) // 86400000 * 86400 + 86400 AS end_s,
count(*) AS sessions, sum(n)::BIGINT AS n FROM ({_CLOSED})
GROUP BY (end_ms - 1) // 86400000 HAVING ((end_ms - 1) // 86400000 + 1) * 86400000 <= (SELECT max(epoch_us(ts) // 1000) FROM events)""",
    "scan_live": """WITH l AS (
  SELECT DISTINCT doc_id, k, (doc_id + k) // 3 AS v FROM documents, range(4) AS r(k)
  WHERE CASE WHEN k = 0 THEN doc_id % 2 = 0 ELSE (doc_id + k) % 5 <> 0 END),
p AS (SELECT *, lag(k) OVER f AS k0, lag(v) OVER f AS v0, lead(k) OVER f AS k1 FROM l WINDOW f AS (PARTITION BY doc_id ORDER BY k))
SELECT doc_id::VARCHAR AS folder, k AS scan, CASE WHEN k0 = k - 1 THEN 'changed' ELSE 'new' END AS state, v AS modified_s
FROM p WHERE k > 0 AND (k0 IS NULL OR k0 < k - 1 OR v <> v0)
UNION ALL SELECT doc_id::VARCHAR, k + 1, 'gone', v FROM p WHERE k < 3 AND (k1 IS NULL OR k1 > k + 1)""",
    "sync_push_live": f"""WITH {MEETINGS}
SELECT meeting_id, CASE WHEN substring(meeting_id, -2, 2)::INT % 9 = 0 THEN 'queued' ELSE 'pushed' END AS state
FROM meetings WHERE status = 'done' AND n_turns > 0 AND sync_enabled""",
    "sync_retry": f"""WITH {MEETINGS}, t AS (
  SELECT meeting_id, doc_id % 3 + (7 - (doc_id + doc_id % 3) % 4) % 4 AS b FROM meetings WHERE sync_enabled)
SELECT meeting_id, CASE WHEN b < 5 THEN b END::BIGINT AS batch, b >= 5 AS waits FROM t""",
}
