"""Shared parts of the checking SQL: the derived tables and a few formulas."""

from parley.functions.constants import ALIASES, FILLER_PHRASES

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LETTER = r"\p{L}\p{N}_"


def strip(x):
    return f"trim({x}, {BLANKS})"


def quoted(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def div_round(num, den):
    """Nearest integer, ties to even."""
    q, r = f"(({num}) // ({den}))", f"(2 * (({num}) % ({den})))"
    return f"({q} + CASE WHEN {r} > ({den}) OR ({r} = ({den}) AND {q} % 2 = 1) THEN 1 ELSE 0 END)"


def tenths(ms):
    return div_round(ms, "100")


def norm(x):
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9 ]+', '', 'g'))"


def split_words(x):
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"


def clock(ms):
    s = f"(({ms}) // 1000)"
    return (f"CASE WHEN {s} >= 3600 THEN printf('%d:%02d:%02d', {s} // 3600, {s} % 3600 // 60, {s} % 60) "
            f"ELSE printf('%02d:%02d', {s} // 60, {s} % 60) END")


def mmss(ms):
    s = f"(greatest(coalesce({ms}, 0), 0) // 1000)"
    return f"printf('%d:%02d', {s} // 60, {s} % 60)"


def phrase_hits(x, phrase):
    """Whole-phrase hits: every character that is no letter is doubled first."""
    padded = f"regexp_replace(' ' || lower({x}) || ' ', '([^{LETTER}])', '\\1\\1', 'g')"
    inner = phrase.replace(" ", "  ")
    return f"len(regexp_extract_all({padded}, '[^{LETTER}]{inner}[^{LETTER}]'))"


PIECES = f"""
sentence AS (
  SELECT conv_id, turn, role, generate_subscripts(string_split(text, '. '), 1) - 1 AS pos,
         unnest(string_split(text, '. ')) AS piece FROM conversations),
pieces AS (
  SELECT conv_id, turn, role, pos, {strip('piece')} AS raw,
         {split_words(strip('piece'))} AS tokens,
         turn * 90000 + pos * 9000 + (conv_id * 31 + turn * 17 + pos * 13) % 11 * 500 AS start_ms
  FROM sentence WHERE {strip('piece')} <> '')"""

SEGMENTS = f"""{PIECES},
segments AS (
  SELECT conv_id::VARCHAR AS meeting_id, CASE WHEN role = 'user' THEN 'mic' ELSE 'system' END AS track,
         turn * 1000000 + pos AS seg_id,
         CASE role WHEN 'user' THEN 'you' WHEN 'assistant' THEN 's1' ELSE 's2' END AS speaker,
         start_ms, start_ms + len(tokens) * 400 AS end_ms, tokens,
         raw || CASE WHEN (conv_id + turn + pos) % 4 = 0 THEN '?' ELSE '' END
         || coalesce(' ' || ({quoted(FILLER_PHRASES)})[(conv_id * 7 + turn * 3 + pos) % 20 + 1], '')
         || coalesce(' ' || ({quoted([' '.join(w.capitalize() for w in a.split(' ')) for a in ALIASES])})[(conv_id * 5 + turn * 11 + pos * 3) % 40 + 1], '')
         AS text
  FROM pieces)"""

WORDS = f"""{SEGMENTS},
words AS (
  SELECT meeting_id, track, seg_id, i AS word_id, ' ' || tokens[i + 1] AS w,
         start_ms + i * 400 AS s_ms, start_ms + (i + 1) * 400 AS e_ms
  FROM (SELECT *, unnest(range(len(tokens))) AS i FROM segments))"""

#: Turns of any `segments`.
TURNS_OF = """
marked AS (
  SELECT *, CASE WHEN speaker IS DISTINCT FROM lag(speaker) OVER w
                   OR track IS DISTINCT FROM lag(track) OVER w THEN 1 ELSE 0 END AS chg
  FROM segments WINDOW w AS (PARTITION BY meeting_id ORDER BY start_ms, track <> 'mic', seg_id)),
run AS (
  SELECT *, sum(chg) OVER (PARTITION BY meeting_id ORDER BY start_ms, track <> 'mic', seg_id) AS run FROM marked),
reach AS (
  SELECT *, max(end_ms) OVER (PARTITION BY meeting_id, run ORDER BY start_ms, track <> 'mic', seg_id
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM run),
island AS (
  SELECT *, sum(CASE WHEN far IS NULL OR start_ms - far > 3000 THEN 1 ELSE 0 END) OVER (
    PARTITION BY meeting_id ORDER BY start_ms, track <> 'mic', seg_id) - 1 AS turn_id FROM reach),
turns AS (
  SELECT meeting_id, turn_id::BIGINT AS turn_id, min(speaker) AS speaker, min(track) AS track,
         min(start_ms) AS start_ms, max(end_ms) AS end_ms,
         string_agg(text, ' ' ORDER BY start_ms, track <> 'mic', seg_id) AS text
  FROM island GROUP BY 1, 2)"""

TURNS = f"{SEGMENTS},{TURNS_OF}"

SPEAKERS = """
speakers AS (
  SELECT c.conv_id::VARCHAR AS meeting_id, s.speaker,
         CASE s.speaker WHEN 'you' THEN 'You' WHEN 's1' THEN 'Guest ' || c.conv_id ELSE 'Silent' END AS name, s.ord
  FROM (SELECT DISTINCT conv_id FROM conversations) c,
       (VALUES ('you', 0), ('s1', 1), ('s9', 2)) s(speaker, ord))"""

#: What counts in each of any `turns`.
MEASURES = f"""
measured AS (
  SELECT meeting_id, speaker, turn_id, end_ms, greatest(0, end_ms - start_ms) AS ms, text,
         len(regexp_extract_all(text, '[{LETTER}''-]+')) AS words,
         length(text) - length(replace(text, '?', '')) AS questions,
         {' + '.join(phrase_hits('text', p) for p in FILLER_PHRASES)} AS fillers
  FROM turns)"""

MEASURED = f"{TURNS},{SPEAKERS},{MEASURES}"

#: Statistics of any `speakers` and `measured`.
STATS = f"""
agg AS (
  SELECT s.meeting_id, s.speaker, s.ord, coalesce(sum(ms), 0)::BIGINT AS ms, count(m.turn_id) AS turns,
         coalesce(sum(words), 0)::BIGINT AS words, coalesce(sum(questions), 0)::BIGINT AS questions,
         coalesce(sum(fillers), 0)::BIGINT AS fillers, coalesce(max(ms), 0) AS longest
  FROM speakers s LEFT JOIN measured m USING (meeting_id, speaker) GROUP BY 1, 2, 3),
tot AS (SELECT *, sum(ms) OVER (PARTITION BY meeting_id)::BIGINT AS total, {tenths('ms')} AS t FROM agg),
stats AS (
  SELECT meeting_id, speaker, ord::BIGINT AS ord, t / 10 AS seconds, turns, words, questions, fillers,
         {tenths('longest')} / 10 AS longest_turn_seconds,
         CASE WHEN total > 0 THEN {div_round('t * 100000', 'total')} / 1000 ELSE 0 END AS share,
         CASE WHEN t > 30 THEN {div_round('words * 600', 't')} ELSE 0 END::BIGINT AS wpm FROM tot)"""

#: Windows over any `segments`.
WINDOWS_OF = """
windows AS (
  SELECT meeting_id, track, seg_id, seg_id * 100000 + i AS win_id, start_ms + i * 1000 AS start_ms,
         least(start_ms + i * 1000 + 2000, end_ms) AS end_ms
  FROM (SELECT *, unnest(range((greatest(end_ms - start_ms - 2000, 0) + 999) // 1000 + 1)) AS i
        FROM segments WHERE end_ms - start_ms >= 400))"""

WINDOWS = f"""{WINDOWS_OF},
voices AS (SELECT *, (start_ms // 5000 + meeting_id::BIGINT) % 3 AS label FROM windows)"""

MODES = """
modes AS (SELECT DISTINCT conv_id::VARCHAR AS meeting_id,
                 CASE WHEN conv_id % 3 = 0 THEN 'inperson' ELSE 'online' END AS mode FROM conversations)"""
