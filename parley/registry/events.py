"""Queries over event tables: calendar, captions, nudges, jobs, activity, audio."""

from pyspark.sql import functions as F


from parley.operators import activity, audio, calendar, captions, nudges
from parley.registry import sql as S
from parley.sources import derived as D

HOUR_MS = 3_600_000


def _current(spark, sf):
    rows = D.events(spark, sf)
    return calendar.current_event(D.moments(rows), D.calendar(rows), ["team"])


def calendar_current(spark, sf):
    return _current(spark, sf).select("team", "probe_id", "event_pos", "title", "start_s", "end_s")


def calendar_days(spark, sf):
    return calendar.events_of_days(D.calendar(D.events(spark, sf))).select(
        "team", "day", "event_pos", "title", "start_s")


def expected_speakers(spark, sf):
    rows = D.events(spark, sf)
    found = _current(spark, sf).select("probe_id", "event_pos", F.col("title").alias("event_title")).join(
        D.calendar(rows).select("event_pos", "attendees"), "event_pos")
    asked = D.moments(rows).join(found, "probe_id", "left")
    started = F.expr("timestampadd(SECOND, now_s, TIMESTAMP_NTZ '1970-01-01 00:00:00')")
    return asked.select(
        "probe_id", calendar.expected_speakers(F.col("given"), F.col("attendees"), F.col("in_person")).alias("expected"),
        calendar.default_title(F.col("title"), F.col("event_title"), started).alias("title"))


def captions_final(spark, sf):
    return captions.finals(D.captions(D.events(spark, sf)))


def captions_partial(spark, sf):
    return captions.partials(D.captions(D.events(spark, sf)))


def captions_since(spark, sf):
    lines = captions_final(spark, sf)
    return captions.since(lines, F.col("meeting_id").cast("bigint") % 20)


def captions_ring(spark, sf):
    return captions.ring(captions_final(spark, sf), size=10)


def busy_sessions(spark, sf):
    return nudges.busy_sessions(D.mic_samples(D.events(spark, sf)), persist_ms=6 * HOUR_MS)


def _offered(spark, sf):
    rows = D.events(spark, sf)
    return nudges.calendar_nudges(D.moments(rows), D.calendar(rows), ["team"])


def nudge_calendar(spark, sf):
    return _offered(spark, sf)


def nudge_app(spark, sf):
    running = D.mic_samples(D.events(spark, sf)).filter("busy").groupBy(
        "user_id", F.floor(F.col("ts_ms") / 86_400_000).alias("day")).agg(F.collect_set("app").alias("apps"))
    return running.select("user_id", "day", nudges.app_label(F.col("apps")).alias("label"))


def announce_once(spark, sf):
    shown = D.events(spark, sf).select(F.concat(F.lit("n-"), F.sha1("props")).alias("nudge_id"), "ts_ms")
    return nudges.announce_once(shown)


def nudge_state(spark, sf):
    done = D.events(spark, sf).filter("event_type = 'purchase'").select(
        F.col("user_id").cast("string").alias("user_id"), F.col("props").alias("nudge_id"), F.col("ts_ms").alias("done_ms"))
    return nudges.remembered(done, keep=5)


def job_transitions(spark, sf):
    return nudges.transitions(D.jobs(D.events(spark, sf)))


def tumbling_activity(spark, sf):
    return activity.windowed(D.events(spark, sf), ["event_type"], "1 hour")


def sliding_activity(spark, sf):
    return activity.windowed(D.events(spark, sf), ["event_type"], "6 hours", "2 hours")


def session_activity(spark, sf):
    rows = D.events(spark, sf).withColumn("user_id", F.col("user_id").cast("string"))
    return activity.sessions(rows, ["user_id"], 4 * HOUR_MS)


def _peaks(spark, sf):
    rows = D.events(spark, sf)
    return audio.waveform_peaks(D.audio_chunks(rows), D.audio_tracks(rows), bins=50)


def waveform_peaks(spark, sf):
    return _peaks(spark, sf)


def waveform_mix(spark, sf):
    return audio.waveform_mix(_peaks(spark, sf))


def audio_levels(spark, sf):
    return audio.levels(D.audio_chunks(D.events(spark, sf))).withColumn("level", F.round("level", 6))


def silence_filter(spark, sf):
    rows = D.events(spark, sf)
    return audio.silence_filter(D.audio_segments(rows), D.audio_chunks(rows)).select(
        "meeting_id", "track", "seg_id", F.round("peak", 6).alias("peak"))


def align_tracks(spark, sf):
    stopped, old = D.stopped_tracks(D.events(spark, sf))
    return audio.align_tracks(old, stopped)


def shift_segments(spark, sf):
    rows = D.events(spark, sf)
    stopped, old = D.stopped_tracks(rows)
    segs = D.audio_segments(rows).select("meeting_id", "track", "seg_id", (F.col("start_frame") * 1000).alias("start_ms"),
                                         (F.col("end_frame") * 1000).alias("end_ms"))
    word = lambda w, s, e: F.struct(F.lit(w).alias("w"), s.alias("s_ms"), e.alias("e_ms"))
    words = F.array(word("a", F.col("start_ms"), F.col("start_ms") + 400), word("b", F.col("end_ms") - 400, F.col("end_ms")))
    moved = audio.shift_segments(segs.withColumn("words", words), audio.align_tracks(old, stopped))
    times = F.flatten(F.transform("words", lambda w: F.array(w["s_ms"], w["e_ms"])))
    return moved.withColumn("word_times", F.array_join(times.cast("array<string>"), ",")).drop("words")


QUERIES = {f.__name__: f for f in (
    calendar_current, calendar_days, expected_speakers, captions_final, captions_partial, captions_since, captions_ring,
    busy_sessions, nudge_calendar, nudge_app, announce_once, nudge_state, job_transitions, tumbling_activity,
    sliding_activity, session_activity, waveform_peaks, waveform_mix, audio_levels, silence_filter, align_tracks,
    shift_segments)}

EVENTS = "ev AS (SELECT *, epoch_us(ts) // 1000 AS ts_ms, epoch_us(ts) // 1000000 AS sec FROM events)"

CALENDAR = f"""{EVENTS},
cal AS (SELECT (user_id % 15)::VARCHAR AS team, event_id AS event_pos, 'Event ' || props AS title, sec AS start_s,
        sec + (1 + event_id % 8) * 3600 AS end_s, event_id % 6 = 0 AS all_day, event_id % 11 AS attendees
        FROM ev WHERE event_type = 'signup'),
probe AS (SELECT (user_id % 15)::VARCHAR AS team, event_id AS probe_id, sec AS now_s,
          CASE event_id % 4 WHEN 0 THEN (event_id % 13)::VARCHAR WHEN 1 THEN 'many' WHEN 2 THEN '' END AS given,
          event_id % 3 = 0 AS in_person, CASE WHEN event_id % 5 = 0 THEN props ELSE '' END AS title
          FROM ev WHERE event_type = 'click')"""


def _running(lead):
    return f"""{CALENDAR},
hit AS (SELECT p.team, probe_id, now_s, event_pos, c.title, start_s, end_s, attendees,
        row_number() OVER (PARTITION BY probe_id ORDER BY start_s DESC, event_pos) AS rn
        FROM probe p JOIN cal c ON c.team = p.team AND NOT all_day AND start_s - {lead * 60} <= now_s AND now_s < end_s),
cur AS (SELECT * FROM hit WHERE rn = 1)"""


CAPTIONS = f"""{EVENTS},
cap AS (SELECT user_id::VARCHAR AS meeting_id, CASE WHEN event_id % 2 = 0 THEN 'mic' ELSE 'system' END AS track,
        CASE WHEN event_id % 2 = 0 THEN 'You' ELSE 'Them' END AS who,
        ['final', 'partial', 'done'][event_id % 3 + 1] AS t, value AS "start", value + 1 AS "end", props AS text, ts_ms, event_id FROM ev),
lines AS (SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY ts_ms, event_id) AS seq, track, who,
          "start", "end", text FROM cap WHERE t = 'final')"""

AUDIO = f"""{EVENTS},
chunk AS (SELECT user_id::VARCHAR AS meeting_id, CASE WHEN event_id % 2 = 0 THEN 'mic' ELSE 'system' END AS track, event_id,
          event_id % 2 + 1 AS ch, sec - {D.ORIGIN_S} AS f0, floor(value * 20)::BIGINT AS loud FROM ev),
sample AS (SELECT *, (loud * (j + 1)) % 32768 * (1 - 2 * (j % 2)) AS x, f0 + j // ch AS f
           FROM (SELECT *, unnest(range(ch * {D.FRAMES})) AS j FROM chunk))"""

_PEAKS = f"""{AUDIO},
track AS (SELECT DISTINCT meeting_id, track, CASE WHEN track = 'mic' THEN 0 ELSE 3600 END AS off FROM chunk),
bin AS (SELECT b, b * 3456000 // 50 AS lo, (b + 1) * 3456000 // 50 AS hi FROM range(50) r(b)),
loudest AS (SELECT s.meeting_id, s.track, b, max(abs(x)) AS amp FROM sample s JOIN track t USING (meeting_id, track)
            JOIN bin ON f + off >= lo AND f + off < hi GROUP BY 1, 2, 3),
tops AS (SELECT meeting_id, track, max(amp) AS top FROM loudest GROUP BY 1, 2),
peaks AS (SELECT t.meeting_id, t.track, bin.b::BIGINT AS bin,
          CASE WHEN top > 0 THEN {S.div_round('coalesce(amp, 0)::BIGINT * 1000', 'top::BIGINT')} ELSE 0 END / 1000 AS peak
          FROM track t CROSS JOIN bin LEFT JOIN loudest l ON l.meeting_id = t.meeting_id AND l.track = t.track AND l.b = bin.b
          LEFT JOIN tops ON tops.meeting_id = t.meeting_id AND tops.track = t.track)"""

_STOPPED = f"""{EVENTS},
own AS (SELECT *, user_id::VARCHAR AS meeting_id, CASE WHEN event_id % 2 = 0 THEN 'mic' ELSE 'system' END AS track FROM ev),
stopped AS (SELECT meeting_id, track, min(ts_ms) AS s, max(trunc(value * 40)::BIGINT) AS r, min(event_type) AS l,
            max(props) FILTER (WHERE event_type = 'error') AS d, min(props) AS o FROM own GROUP BY 1, 2),
aligned AS (SELECT meeting_id, track, s - min(s) OVER (PARTITION BY meeting_id) AS offset_ms, coalesce(d, o) AS device,
            max(r) OVER (PARTITION BY meeting_id) AS duration_ms,
            string_agg(track || '=' || l, ',') OVER (PARTITION BY meeting_id ORDER BY track
              ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS languages, r >= 300 AS usable FROM stopped)"""

ORACLE = {
    "calendar_current": f"WITH {_running(15)} SELECT team, probe_id, event_pos, title, start_s, end_s FROM cur",
    "calendar_days": f"""WITH {CALENDAR} SELECT team, unnest(range(start_s // 86400, (end_s - 1) // 86400 + 1)) AS day, event_pos, title, start_s
FROM cal WHERE NOT all_day""",
    "expected_speakers": f"""WITH {_running(15)},
g AS (SELECT p.probe_id, try_cast(p.given AS INTEGER) AS n, p.in_person, p.title, c.title AS ev, c.attendees, p.now_s
      FROM probe p LEFT JOIN cur c USING (probe_id))
SELECT probe_id, CASE WHEN n IS NOT NULL THEN greatest(least(n, 8), 1)
  WHEN attendees > 0 THEN greatest(least(attendees + in_person::INT, 8), 1) END::BIGINT AS expected,
  CASE WHEN title <> '' THEN title WHEN ev IS NOT NULL THEN ev
       ELSE 'Meeting ' || strftime(make_timestamp(now_s * 1000000), '%d %b %Y, %H:%M') END AS title FROM g""",
    "captions_final": f"WITH {CAPTIONS} SELECT * FROM lines",
    "captions_partial": f"""WITH {CAPTIONS},
r AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, track ORDER BY ts_ms DESC, event_id DESC) AS rn FROM cap)
SELECT meeting_id, track, who, "start", "end", text FROM r WHERE rn = 1 AND t = 'partial'""",
    "captions_since": f"WITH {CAPTIONS} SELECT * FROM lines WHERE seq > meeting_id::BIGINT % 20",
    "captions_ring": f"""WITH {CAPTIONS},
n AS (SELECT *, max(seq) OVER (PARTITION BY meeting_id) AS top FROM lines) SELECT * EXCLUDE (top) FROM n WHERE seq > top - 10""",
    "busy_sessions": f"""WITH {EVENTS},
s AS (SELECT user_id, ts_ms, event_id, event_type IN ('click', 'view', 'purchase') AS busy FROM ev),
g AS (SELECT *, sum(CASE WHEN busy THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS g FROM s)
SELECT user_id::VARCHAR AS user_id, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, count(*) AS samples FROM g WHERE busy
GROUP BY g.user_id, g HAVING max(ts_ms) - min(ts_ms) >= 21600000""",
    "nudge_calendar": f"""WITH {_running(1)}
SELECT team, 'cal-' || substring(sha1(title || '|' || start_s), 1, 12) AS nudge_id,
       arg_min(title, {{'n': now_s, 'p': probe_id}}) AS meeting_title, min(now_s) AS offered_s FROM cur GROUP BY 1, 2""",
    "nudge_app": f"""WITH {EVENTS},
a AS (SELECT user_id::VARCHAR AS user_id, ts_ms // 86400000 AS day, event_id % 8 AS i FROM ev WHERE event_type IN ('click', 'view', 'purchase'))
SELECT user_id, day, (['Zoom', 'Teams', 'Teams', 'Slack', 'FaceTime', 'Webex'])[min(i) + 1] AS label FROM a GROUP BY 1, 2""",
    "announce_once": f"""WITH {EVENTS} SELECT 'n-' || sha1(props) AS nudge_id, min(ts_ms) AS first_ms, count(*) AS shown FROM ev GROUP BY 1""",
    "nudge_state": f"""WITH {EVENTS},
d AS (SELECT user_id::VARCHAR AS user_id, props AS nudge_id, max(ts_ms) AS done_ms FROM ev WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY done_ms DESC, nudge_id) <= 5""",
    "job_transitions": f"""WITH {EVENTS},
j AS (SELECT user_id::VARCHAR AS meeting_id, CASE WHEN event_id % 2 = 0 THEN 'transcript' ELSE 'summary' END AS kind, event_id, ts_ms,
      CASE event_type WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'done' ELSE 'error' END AS state
      FROM ev WHERE event_type IN ('view', 'purchase', 'error')),
p AS (SELECT *, lag(state) OVER (PARTITION BY meeting_id, kind ORDER BY ts_ms, event_id) AS before FROM j)
SELECT meeting_id, kind, event_id, ts_ms, state, state = 'done' AS ok FROM p WHERE before = 'processing' AND state <> 'processing'""",
    "tumbling_activity": f"""WITH {EVENTS} SELECT sec // 3600 * 3600 AS start_s, sec // 3600 * 3600 + 3600 AS end_s, event_type, count(*) AS n,
sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM ev GROUP BY 1, 2, 3""",
    "sliding_activity": f"""WITH {EVENTS},
w AS (SELECT *, unnest([0, 1, 2]) AS k FROM ev)
SELECT (sec // 7200 - k) * 7200 AS start_s, (sec // 7200 - k) * 7200 + 21600 AS end_s, event_type, count(*) AS n,
sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM w GROUP BY 1, 2, 3""",
    "session_activity": f"""WITH {EVENTS},
f AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY user_id ORDER BY ts_ms) <= 14400000 THEN 0 ELSE 1 END AS f FROM ev),
g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts_ms) AS g FROM f)
SELECT min(ts_ms) // 1000 AS start_s, (max(ts_ms) + 14400000) // 1000 AS end_s, user_id::VARCHAR AS user_id, count(*) AS n
FROM g GROUP BY g.user_id, g""",
    "waveform_peaks": f"WITH {_PEAKS} SELECT * FROM peaks",
    "waveform_mix": f"WITH {_PEAKS} SELECT meeting_id, bin, max(peak) AS peak FROM peaks GROUP BY 1, 2",
    "audio_levels": f"""WITH {AUDIO} SELECT meeting_id, track, event_id AS chunk_id,
round(least(1.0, sqrt(sum(x * x)::DOUBLE / count(*)) / 6000), 6)::DOUBLE AS level FROM sample GROUP BY 1, 2, 3""",
    "silence_filter": f"""WITH {AUDIO},
mono AS (SELECT meeting_id, track, f, event_id, abs(sum(x))::DOUBLE / any_value(ch) AS amp FROM sample GROUP BY 1, 2, 3, 4),
seg AS (SELECT user_id::VARCHAR AS meeting_id, CASE WHEN event_id % 2 = 0 THEN 'mic' ELSE 'system' END AS track, event_id AS seg_id,
        sec - {D.ORIGIN_S} - event_id % 5 AS a, sec - {D.ORIGIN_S} - event_id % 5 + event_id % 9 AS b FROM ev
        WHERE event_type IN ('view', 'click') AND event_id % 100 / 100 <= 0.85)
SELECT s.meeting_id, s.track, seg_id, round(max(amp) / 32768, 6) AS peak FROM seg s JOIN mono m
ON m.meeting_id = s.meeting_id AND m.track = s.track AND f >= a AND f < b GROUP BY 1, 2, 3 HAVING max(amp) / 32768 >= 0.004""",
    "align_tracks": f"WITH {_STOPPED} SELECT * FROM aligned",
    "shift_segments": f"""WITH {_STOPPED},
seg AS (SELECT user_id::VARCHAR AS meeting_id, CASE WHEN event_id % 2 = 0 THEN 'mic' ELSE 'system' END AS track, event_id AS seg_id,
        (sec - {D.ORIGIN_S} - event_id % 5) * 1000 AS a, (sec - {D.ORIGIN_S} - event_id % 5 + event_id % 9) * 1000 AS b FROM ev
        WHERE event_type IN ('view', 'click'))
SELECT meeting_id, track, seg_id, a + offset_ms AS start_ms, b + offset_ms AS end_ms,
  concat_ws(',', a + offset_ms, a + 400 + offset_ms, b - 400 + offset_ms, b + offset_ms) AS word_times FROM seg JOIN aligned USING (meeting_id, track) WHERE usable""",
}
