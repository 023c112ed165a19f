"""Queries over transcripts: turns, statistics, speakers and echo."""

from pyspark.sql import functions as F

from parley.functions import text as X
from parley.functions.constants import ALIASES, FILLER_PHRASES
from parley.operators import echo, speakers, stats, turns
from parley.registry import sql as S
from parley.sources import derived as D


def norm_text(spark, sf):
    t = F.col("text")
    return D.segments(spark, sf).select(
        "meeting_id", "seg_id", X.norm_text(t).alias("norm"),
        F.array_join(X.tokens(t), "|").alias("tokens"), X.word_count(t).alias("words"))


def format_times(spark, sf):
    rows = D.segments(spark, sf)
    late = F.col("start_ms") * 60 - 60000
    return rows.select("meeting_id", "seg_id", X.clock(F.col("start_ms") * 60).alias("clock"),
                       X.minutes_seconds(late).alias("m_ss"),
                       X.duration_label(F.col("end_ms") * 30).alias("length"))


def fix_mishearings(spark, sf):
    return D.segments(spark, sf).select(
        "meeting_id", "seg_id", X.fix_mishearings(F.col("text")).alias("text"))


def build_turns(spark, sf):
    return turns.build_turns(D.segments(spark, sf))


def display_groups(spark, sf):
    return turns.display_groups(build_turns(spark, sf)).select(
        "meeting_id", "first_turn", "speaker", "start_ms", "pieces", "text")


def _counted(spark, sf):
    return turns.build_turns(D.segments(spark, sf), number=False)


def speaker_stats(spark, sf):
    return stats.speaker_stats(_counted(spark, sf), D.speakers(spark, sf))


def meeting_totals(spark, sf):
    """Some meetings have no turns; every second of these lists a speaker."""
    modes = D.modes(spark, sf).select("meeting_id", "mode")
    silent = modes.filter(F.col("meeting_id").cast("bigint") % 10 == 0).withColumn(
        "meeting_id", F.concat(F.lit("empty-"), "meeting_id"))
    listed = silent.filter(F.substring("meeting_id", 7, 20).cast("bigint") % 20 == 0).select(
        "meeting_id", F.lit("s9").alias("speaker"))
    meetings = modes.unionByName(silent).withColumn(
        "duration_ms", F.when(F.col("mode") == "online", 600_000).cast("bigint"))
    people = D.speakers(spark, sf).select("meeting_id", "speaker").unionByName(listed)
    return stats.meeting_totals(_counted(spark, sf), people, meetings)


def filler_counts(spark, sf):
    return stats.filler_counts(build_turns(spark, sf))


def filler_top3(spark, sf):
    return stats.filler_top(filler_counts(spark, sf))


def named_turns(spark, sf):
    return turns.named_turns(build_turns(spark, sf), D.speakers(spark, sf)).select(
        "meeting_id", "turn_id", "speaker", "name", "start_ms")


def speech_windows(spark, sf):
    return speakers.speech_windows(D.segments(spark, sf))


def _voices(spark, sf):
    return D.voice_labels(speech_windows(spark, sf))


def _labelled(spark, sf):
    return speakers.label_words(D.words(spark, sf), _voices(spark, sf))


def asof_speaker(spark, sf):
    return _labelled(spark, sf).select("meeting_id", "track", "seg_id", "word_id", "label")


def asof_midpoint(spark, sf):
    rows = D.segments(spark, sf).drop("tokens", "text", "speaker")
    return speakers.label_segments(rows, _voices(spark, sf)).select(
        "meeting_id", "track", "seg_id", "label")


def split_segments(spark, sf):
    return speakers.split_segments(_labelled(spark, sf))


def renumber_speakers(spark, sf):
    return speakers.renumber(_voices(spark, sf), split_segments(spark, sf))


def _track_labels(spark, sf):
    rows = D.segments(spark, sf).withColumn("speaker_idx", F.col("seg_id") % 3).drop("speaker", "tokens")
    return speakers.label_tracks(rows, D.modes(spark, sf))


def label_tracks(spark, sf):
    return _track_labels(spark, sf).select("meeting_id", "track", "seg_id", "speaker", "name")


def carry_names(spark, sf):
    found = speakers.speaker_list(_track_labels(spark, sf))
    return speakers.carry_names(found, _old_names(spark, sf))


def _old_names(spark, sf):
    """Names of an earlier run: the same labels for two meetings in three."""
    found = speakers.speaker_list(_track_labels(spark, sf))
    extra = F.col("meeting_id").cast("bigint") % 3 == 1
    return found.select("meeting_id", F.when(extra & (F.col("speaker") != "you"),
                                             F.concat(F.lit("x"), "speaker")).otherwise(F.col("speaker"))
                        .alias("speaker"), F.concat(F.lit("Named "), "speaker").alias("name"))


def _mic_and_system(spark, sf):
    words = D.words(spark, sf)
    # one system segment in five comes without words
    spoken = words.filter(F.col("seg_id") % 5 != 0)
    return D.echo_mic(spark, sf), echo.system_tokens(D.segments(spark, sf), spoken)


def echo_window(spark, sf):
    return echo.echo_window(*_mic_and_system(spark, sf)).select("meeting_id", "seg_id", "window")


def echo_containment(spark, sf):
    return echo.containment(echo.echo_window(*_mic_and_system(spark, sf))).select(
        "meeting_id", "seg_id", "n_tokens", F.round("ratio", 6).alias("ratio"))


def echo_drop(spark, sf):
    return echo.drop_echo(*_mic_and_system(spark, sf)).select(
        "meeting_id", "seg_id", "action", "start_ms", "end_ms", "text")


def echo_trim(spark, sf):
    mic, system = _mic_and_system(spark, sf)
    rows = echo.containment(echo.echo_window(mic, system))
    cut = echo.edge_trim(rows, F.lit(True)).filter("cut IS NOT NULL")
    return cut.select("meeting_id", "seg_id", F.size("cut").cast("bigint").alias("kept_words"),
                      F.array_join(F.transform("cut", lambda w: X.strip(w["w"])), " ").alias("text"))


def echo_report(spark, sf):
    return echo.echo_report(echo.drop_echo(*_mic_and_system(spark, sf)))


QUERIES = {f.__name__: f for f in (
    norm_text, format_times, fix_mishearings, build_turns, display_groups, speaker_stats,
    meeting_totals, filler_counts, filler_top3, named_turns, speech_windows, asof_speaker,
    asof_midpoint, split_segments, renumber_speakers, label_tracks, carry_names, echo_window,
    echo_containment, echo_drop, echo_trim, echo_report)}

#: Labels of any `words` by the nearest of `voices`.
NEAREST = """
probe AS (
  SELECT meeting_id, track, seg_id, word_id, w, s_ms, e_ms, s_ms + e_ms AS at2 FROM words),
centre AS (SELECT meeting_id, track, win_id, label, start_ms + end_ms AS c2 FROM voices),
mixed AS (
  SELECT meeting_id, track, at2, 0 AS kind, 0 AS tie, seg_id, word_id, w, s_ms, e_ms, NULL AS mark FROM probe
  UNION ALL SELECT meeting_id, track, c2, 1, win_id, NULL, NULL, NULL, NULL, NULL,
                   {'c2': c2, 'label': label} FROM centre),
sided AS (
  SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY meeting_id, track ORDER BY at2, kind, tie
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
            first_value(mark IGNORE NULLS) OVER (PARTITION BY meeting_id, track ORDER BY at2, kind, tie
              ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM mixed),
labelled AS (
  SELECT meeting_id, track, seg_id, word_id, w, s_ms, e_ms,
         CASE WHEN a IS NULL OR at2 - b.c2 <= a.c2 - at2 THEN b.label ELSE a.label END AS label
  FROM sided WHERE kind = 0)"""

_LABELLED = f"{S.WORDS},{S.WINDOWS},{NEAREST}"

#: Runs of one label in any `labelled`.
RUNS_OF = f"""
flagged AS (SELECT *, CASE WHEN label <> lag(label) OVER (PARTITION BY meeting_id, track, seg_id ORDER BY word_id)
                      THEN 1 ELSE 0 END AS f FROM labelled),
runs AS (SELECT *, sum(f) OVER (PARTITION BY meeting_id, track, seg_id ORDER BY word_id) AS run FROM flagged),
split AS (
  SELECT meeting_id, track, seg_id, run::BIGINT AS run, min(label) AS label, min(s_ms) AS start_ms,
         max(e_ms) AS end_ms, {S.strip("string_agg(w, '' ORDER BY word_id)")} AS text
  FROM runs GROUP BY 1, 2, 3, 4)"""

_SPLIT = f"{_LABELLED},{RUNS_OF}"

_TRACKS = f"""{S.SEGMENTS},{S.MODES},
tracked AS (
  SELECT s.meeting_id, track, seg_id, start_ms, mode,
    CASE WHEN mode = 'online' AND track = 'mic' THEN 'you'
         WHEN mode = 'online' OR track = 'mic' THEN 's' || (seg_id % 3 + 1)
         ELSE 'r' || (seg_id % 3 + 1) END AS speaker,
    CASE WHEN mode = 'online' AND track = 'mic' THEN 'You'
         WHEN mode = 'online' OR track = 'mic' THEN 'Speaker ' || (seg_id % 3 + 1)
         ELSE 'Remote ' || (seg_id % 3 + 1) END AS name
  FROM segments s JOIN modes m USING (meeting_id))"""

_WINDOW = f"""{S.WORDS},
mic0 AS (
  SELECT conv_id::VARCHAR AS meeting_id, turn * 1000000 + pos + CASE WHEN role = 'user' THEN 0 ELSE 500000 END AS seg_id,
         start_ms + CASE WHEN role = 'user' THEN 0 ELSE 800 END AS start_ms, tokens,
         list_transform(tokens, lambda w: reverse(w)) AS own,
         CASE WHEN role = 'user' THEN 0 ELSE (conv_id + turn + pos) % 4 END AS k
  FROM pieces WHERE role = 'user' OR len(tokens) >= 4),
mic AS (
  SELECT meeting_id, seg_id, start_ms, start_ms + len(said) * 400 AS end_ms, said FROM (
    SELECT *, CASE k WHEN 0 THEN tokens WHEN 1 THEN tokens || own
      WHEN 2 THEN flatten(list_transform(range(len(tokens)), lambda i: [tokens[i + 1], own[i + 1]])) ELSE own END AS said FROM mic0)),
sys AS (
  SELECT meeting_id, seg_id, word_id, s_ms, e_ms, {S.norm('w')} AS token FROM words WHERE track = 'system' AND seg_id % 5 <> 0
  UNION ALL SELECT meeting_id, seg_id, 0, start_ms, end_ms, {S.norm('text')} FROM segments WHERE track = 'system' AND seg_id % 5 = 0),
win AS (
  SELECT m.meeting_id, m.seg_id, coalesce(string_agg(token, ' ' ORDER BY s_ms, s.seg_id, word_id), '') AS "window"
  FROM mic m LEFT JOIN sys s ON s.meeting_id = m.meeting_id AND s_ms BETWEEN start_ms - 31500 AND end_ms + 1500
    AND e_ms >= start_ms - 1500 AND token <> '' GROUP BY 1, 2)"""


def _matching(name, source):
    """Matching blocks (r, s, e) of the lists a and b of `source`: the longest run of equal tokens of a
    rectangle, the first in a and then in b, and again what lies before and behind it."""
    return f"""
{name}_runs AS MATERIALIZED (
  SELECT r, d, min(i) AS s, max(i) + 1 AS e FROM (
    SELECT r, i, j - i AS d, i - row_number() OVER (PARTITION BY r, j - i ORDER BY i) AS g
    FROM (SELECT r, unnest(a) AS t, generate_subscripts(a, 1) - 1 AS i FROM {source})
    JOIN (SELECT r, unnest(b) AS t, generate_subscripts(b, 1) - 1 AS j FROM {source}) USING (r, t)) GROUP BY r, d, g),
{name}_rect AS (
  SELECT r, 0::BIGINT AS a0, 1000000000::BIGINT AS a1, 0::BIGINT AS b0, 1000000000::BIGINT AS b1, NULL::BIGINT AS s, NULL::BIGINT AS e
  FROM (SELECT DISTINCT r FROM {name}_runs)
  UNION ALL
  SELECT r, CASE WHEN before THEN a0 ELSE s + n END, CASE WHEN before THEN s ELSE a1 END,
         CASE WHEN before THEN b0 ELSE s + n + d END, CASE WHEN before THEN s + d ELSE b1 END,
         CASE WHEN before THEN s END, CASE WHEN before THEN s + n END
  FROM (
    SELECT r, a0, a1, b0, b1, best.n AS n, -best.i AS s, -best.d AS d FROM (
      SELECT r, a0, a1, b0, b1, max({{'n': hi - lo, 'i': -lo, 'd': -d}}) AS best FROM (
        SELECT q.r, a0, a1, b0, b1, d, greatest(u.s, a0, b0 - d) AS lo, least(u.e, a1, b1 - d) AS hi
        FROM {name}_rect q JOIN {name}_runs u ON u.r = q.r) WHERE hi > lo GROUP BY r, a0, a1, b0, b1)),
    (VALUES (true), (false)) v(before)),
{name} AS (SELECT r, s, e FROM {name}_rect WHERE s IS NOT NULL)"""


_RATIO = f"""{_WINDOW},
heard AS MATERIALIZED (
  SELECT row_number() OVER () AS r, m.*, {S.split_words(S.norm("array_to_string(said, ' ')"))} AS a,
         {S.split_words('"window"')} AS b FROM mic m JOIN win USING (meeting_id, seg_id)),
{_matching("block", "heard")},
told AS MATERIALIZED (
  SELECT h.*, len(a) AS n_tokens, CASE WHEN len(a) > 0 THEN coalesce(n, 0) / len(a) ELSE 0 END AS ratio
  FROM heard h LEFT JOIN (SELECT r, sum(e - s) AS n FROM block GROUP BY r) USING (r))"""

_TRIMMED = f"""{_RATIO},
usable AS MATERIALIZED (
  SELECT r, b, list_filter(list_transform(range(len(said)), lambda i: {{'w': {S.strip('said[i + 1]')}, 't': {S.norm('said[i + 1]')},
           's': start_ms + i * 400, 'e': start_ms + (i + 1) * 400}}), lambda w: w.t <> '') AS u FROM told),
edge_of AS MATERIALIZED (SELECT r, u, list_transform(u, lambda w: w.t) AS a, b FROM usable WHERE len(u) >= 7 AND len(b) > 0),
{_matching("echoed", "edge_of")},
free AS (
  SELECT r, u, list_filter(range(len(u)), lambda i: NOT list_contains(coalesce(h, []), i)) AS f
  FROM edge_of LEFT JOIN (SELECT r, flatten(list(range(s, e))) AS h FROM echoed GROUP BY r) USING (r)),
edges AS (SELECT r, u, CASE WHEN len(f) = 0 THEN len(u) ELSE f[1] END AS lead, CASE WHEN len(f) = 0 THEN 0 ELSE len(u) - 1 - f[-1] END AS tail FROM free),
trim AS (
  SELECT t.*, CASE WHEN len(u) - lead - tail >= 3 AND greatest(lead, tail) >= 4 THEN u[lead + 1:len(u) - tail] END AS cut
  FROM told t LEFT JOIN edges USING (r))"""

_DECIDED = f"""{_TRIMMED},
ruled AS (
  SELECT *, CASE WHEN n_tokens >= 4 THEN 0.7 ELSE 0.999 END AS most,
         {S.strip("array_to_string(list_transform(cut, lambda w: w.w), ' ')")} AS short FROM trim),
decided AS (
  SELECT meeting_id, seg_id, CASE WHEN ratio >= most THEN 'drop' WHEN cuts THEN 'trim' ELSE 'keep' END AS action,
         CASE WHEN cuts THEN cut[1].s ELSE start_ms END AS start_ms, CASE WHEN cuts THEN cut[-1].e ELSE end_ms END AS end_ms,
         CASE WHEN cuts THEN short ELSE array_to_string(said, ' ') END AS text
  FROM (SELECT *, coalesce(ratio >= 0.35 AND ratio < most AND cut IS NOT NULL AND short <> '', false) AS cuts FROM ruled))"""

FIXED = "text"
for _wrong, _right in ALIASES.items():
    FIXED = (f"regexp_replace({FIXED}, '(^|[^{S.LETTER}]){_wrong}($|[^{S.LETTER}])', "
              f"'\\1{_right}\\2', 'gi')")

ORACLE = {
    "norm_text": f"""WITH {S.SEGMENTS}
SELECT meeting_id, seg_id, {S.norm('text')} AS norm,
       array_to_string(regexp_extract_all(lower(text), '[{S.LETTER}'']+'), '|') AS tokens,
       len(regexp_extract_all(text, '[{S.LETTER}''-]+')) AS words FROM segments""",
    "format_times": f"""WITH {S.SEGMENTS}
SELECT meeting_id, seg_id, {S.clock('start_ms * 60')} AS clock, {S.mmss('start_ms * 60 - 60000')} AS m_ss,
  CASE WHEN (end_ms * 30 + 30000) // 60000 < 60 THEN ((end_ms * 30 + 30000) // 60000) || ' min'
       ELSE ((end_ms * 30 + 30000) // 60000 // 60) || ' h ' || ((end_ms * 30 + 30000) // 60000 % 60) || ' min' END AS length
FROM segments""",
    "fix_mishearings": f"WITH {S.SEGMENTS} SELECT meeting_id, seg_id, {FIXED} AS text FROM segments",
    "build_turns": f"WITH {S.TURNS} SELECT * FROM turns",
    "display_groups": f"""WITH {S.TURNS},
f AS (SELECT *, CASE WHEN speaker IS DISTINCT FROM lag(speaker) OVER (PARTITION BY meeting_id ORDER BY turn_id)
      THEN 1 ELSE 0 END AS f FROM turns),
g AS (SELECT *, sum(f) OVER (PARTITION BY meeting_id ORDER BY turn_id) AS g FROM f)
SELECT meeting_id, min(turn_id) AS first_turn, min(speaker) AS speaker, min(start_ms) AS start_ms,
       count(*) AS pieces, string_agg(text, ' ' ORDER BY turn_id) AS text FROM g GROUP BY meeting_id, g""",
    "speaker_stats": f"WITH {S.MEASURED},{S.STATS} SELECT * FROM stats",
    "meeting_totals": f"""WITH {S.MEASURED},{S.MODES},
every AS (SELECT meeting_id, mode FROM modes
          UNION ALL SELECT 'empty-' || meeting_id, mode FROM modes WHERE meeting_id::BIGINT % 10 = 0),
people AS (SELECT meeting_id, speaker FROM speakers
           UNION ALL SELECT 'empty-' || meeting_id, 's9' FROM modes WHERE meeting_id::BIGINT % 20 = 0),
listed AS (
  SELECT coalesce(m.meeting_id, p.meeting_id) AS meeting_id, coalesce(m.speaker, p.speaker) AS speaker, m.end_ms,
         CASE WHEN p.speaker IS NOT NULL THEN m.ms END AS ms, CASE WHEN p.speaker IS NOT NULL THEN m.words END AS words,
         p.speaker IS NOT NULL AND m.speaker IS NOT NULL AS known
  FROM measured m FULL JOIN people p ON m.meeting_id = p.meeting_id AND m.speaker = p.speaker
  UNION ALL SELECT meeting_id, NULL, NULL, NULL, NULL, false FROM every
  WHERE meeting_id NOT IN (SELECT meeting_id FROM measured UNION ALL SELECT meeting_id FROM people)),
sets AS (
  SELECT meeting_id, speaker, grouping(speaker) AS is_total, coalesce(sum(ms), 0)::BIGINT AS ms,
         coalesce(sum(words), 0)::BIGINT AS words, count(*) FILTER (WHERE known) AS turns, max(end_ms) AS last_ms
  FROM listed GROUP BY GROUPING SETS ((meeting_id, speaker), (meeting_id))
  HAVING grouping(speaker) = 1 OR speaker IS NOT NULL)
SELECT meeting_id, speaker, is_total::BIGINT AS is_total, {S.tenths('ms')} / 10 AS spoken_seconds, words, turns,
       {S.tenths("CASE WHEN mode = 'online' THEN 600000 ELSE coalesce(last_ms, 0) END")} / 10 AS duration
FROM sets JOIN every USING (meeting_id)""",
    "filler_counts": f"""WITH {S.TURNS},
hit AS ({' UNION ALL '.join(f"SELECT meeting_id, speaker, turn_id, '{p}' AS phrase, {S.phrase_hits('text', p)} AS n FROM turns" for p in FILLER_PHRASES)})
SELECT meeting_id, speaker, phrase, sum(n)::BIGINT AS hits, min(turn_id) AS first_turn
FROM hit WHERE n > 0 GROUP BY 1, 2, 3""",
    "filler_top3": f"""WITH {S.TURNS},
hit AS ({' UNION ALL '.join(f"SELECT meeting_id, speaker, turn_id, {i} AS o, '{p}' AS phrase, {S.phrase_hits('text', p)} AS n FROM turns" for i, p in enumerate(FILLER_PHRASES))}),
c AS (SELECT meeting_id, speaker, phrase, o, sum(n)::BIGINT AS hits, min(turn_id) AS ft FROM hit WHERE n > 0 GROUP BY 1, 2, 3, 4),
r AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, speaker ORDER BY hits DESC, ft, o) AS rn FROM c)
SELECT meeting_id, speaker, string_agg(phrase || '×' || hits, ', ' ORDER BY rn) FILTER (WHERE rn <= 3) AS top,
       sum(hits)::BIGINT AS filler_total FROM r GROUP BY 1, 2""",
    "named_turns": f"""WITH {S.TURNS},{S.SPEAKERS}
SELECT t.meeting_id, turn_id, t.speaker, coalesce(name, t.speaker) AS name, start_ms
FROM turns t LEFT JOIN speakers s USING (meeting_id, speaker)""",
    "speech_windows": f"WITH {S.SEGMENTS},{S.WINDOWS} SELECT * FROM windows",
    "asof_speaker": f"WITH {_LABELLED} SELECT meeting_id, track, seg_id, word_id, label FROM labelled",
    "asof_midpoint": "WITH " + _LABELLED.replace(
        "SELECT meeting_id, track, seg_id, word_id, w, s_ms, e_ms, s_ms + e_ms AS at2 FROM words",
        "SELECT meeting_id, track, seg_id, 0 AS word_id, '' AS w, start_ms AS s_ms, end_ms AS e_ms, "
        "start_ms + end_ms AS at2 FROM segments") + " SELECT meeting_id, track, seg_id, label FROM labelled",
    "split_segments": f"WITH {_SPLIT} SELECT * FROM split WHERE text <> ''",
    "renumber_speakers": f"""WITH {_SPLIT},
c AS (SELECT meeting_id, track, label, row_number() OVER (PARTITION BY meeting_id, track ORDER BY f) AS n FROM (
        SELECT meeting_id, track, label, min({{'s': start_ms, 'w': win_id}}) AS f FROM voices GROUP BY 1, 2, 3)),
s AS (SELECT meeting_id, track, label, min(start_ms) AS first_ms FROM split WHERE text <> '' GROUP BY 1, 2, 3)
SELECT c.meeting_id, c.track, c.label, 's' || n AS speaker, 'Speaker ' || n AS name,
       CASE WHEN first_ms IS NOT NULL THEN row_number() OVER (
         PARTITION BY c.meeting_id, c.track ORDER BY first_ms NULLS LAST, n) END AS ord
FROM c LEFT JOIN s USING (meeting_id, track, label)""",
    "label_tracks": f"WITH {_TRACKS} SELECT meeting_id, track, seg_id, speaker, name FROM tracked",
    "carry_names": f"""WITH {_TRACKS},
new AS (SELECT meeting_id, speaker, name, row_number() OVER (PARTITION BY meeting_id ORDER BY f) - 1 AS ord FROM (
  SELECT meeting_id, speaker, name, min({{'r': track <> 'mic', 's': start_ms, 'g': seg_id}}) AS f FROM tracked GROUP BY 1, 2, 3)),
old AS (SELECT meeting_id, CASE WHEN meeting_id::BIGINT % 3 = 1 AND speaker <> 'you' THEN 'x' || speaker ELSE speaker END AS speaker,
               'Named ' || speaker AS name FROM new),
sets AS (SELECT n.meeting_id, n.s = o.s AS same
         FROM (SELECT meeting_id, list_sort(list(speaker)) AS s FROM new GROUP BY 1) n
         JOIN (SELECT meeting_id, list_sort(list(speaker)) AS s FROM old GROUP BY 1) o USING (meeting_id))
SELECT n.meeting_id, n.speaker, CASE WHEN same OR n.speaker = 'you' THEN coalesce(o.name, n.name) ELSE n.name END AS name, n.ord
FROM new n JOIN sets USING (meeting_id) LEFT JOIN old o USING (meeting_id, speaker)""",
    "echo_window": f"""WITH {_WINDOW} SELECT meeting_id, seg_id, "window" FROM win""",
    "echo_containment": f"""WITH RECURSIVE {_RATIO}
SELECT meeting_id, seg_id, n_tokens, round(ratio, 6) AS ratio FROM told""",
    "echo_trim": f"""WITH RECURSIVE {_TRIMMED}
SELECT meeting_id, seg_id, len(cut) AS kept_words, array_to_string(list_transform(cut, lambda w: w.w), ' ') AS text
FROM trim WHERE cut IS NOT NULL""",
    "echo_drop": f"""WITH RECURSIVE {_DECIDED} SELECT meeting_id, seg_id, action, start_ms, end_ms, text FROM decided""",
    "echo_report": f"""WITH RECURSIVE {_DECIDED},
n AS (SELECT meeting_id, count(*) AS segments, count(*) FILTER (action = 'drop') AS dropped,
             count(*) FILTER (action = 'trim') AS trimmed FROM decided GROUP BY 1)
SELECT *, CASE WHEN dropped + trimmed > 0 THEN 'Mic audio contained speaker echo: ' || concat_ws(' and ',
    CASE WHEN dropped > 0 THEN 'removed ' || dropped || ' echo segment(s)' END,
    CASE WHEN trimmed > 0 THEN 'trimmed echoed words from ' || trimmed || ' segment(s)' END)
  || ' (tip: headphones avoid this entirely).' END AS warning FROM n""",
}
