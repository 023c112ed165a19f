"""Queries over edits and summary material."""

from pyspark.sql import functions as F

from parley.functions import text as X
from parley.functions.constants import NO_DUE
from parley.operators import summaries, tidy, turns, windows
from parley.registry import sql as S
from parley.registry.conversation import build_turns
from parley.session import cut_lineage
from parley.sources import derived as D


def _stored(spark, sf):
    """Edits work on a stored transcript: turns and the operations proposed for them."""
    before = cut_lineage(build_turns(spark, sf))
    return before, cut_lineage(tidy.merge_window_ops(D.tidy_ops(before)))


def tidy_merge_ops(spark, sf):
    return tidy.merge_window_ops(D.tidy_ops(build_turns(spark, sf)))


def merge_labels(spark, sf):
    return tidy.resolve_merges(*D.voice_merges(spark, sf))


def _folds(spark, sf, ops):
    merges = ops.filter("op = 'merge'").select("meeting_id", "label", F.col("value").alias("target"))
    return tidy.resolve_merges(merges, D.speakers(spark, sf))


def tidy_apply(spark, sf):
    before, ops = _stored(spark, sf)
    return tidy.apply_turns(before, ops, _folds(spark, sf, ops))


def tidy_speakers(spark, sf):
    before, ops = _stored(spark, sf)
    after = tidy.edited_turns(before, ops, _folds(spark, sf, ops))
    return tidy.apply_speakers(after, D.speakers(spark, sf), ops).withColumn(
        "ord", F.col("ord").cast("bigint"))


def tidy_report(spark, sf):
    before, ops = _stored(spark, sf)
    folds = _folds(spark, sf, ops)
    after = tidy.apply_speakers(tidy.edited_turns(before, ops, folds), D.speakers(spark, sf), ops)
    return tidy.tidy_report(before, ops, folds, after)


def ordered_subset(spark, sf):
    words = X.tokens(F.col("text"))
    rows = D.segments(spark, sf).select("meeting_id", "seg_id", words.alias("big"))
    k = F.col("seg_id") % 3
    small = (F.when(k == 0, F.filter("big", lambda w, i: i % 2 == 0)).when(k == 1, F.reverse("big"))
             .otherwise(F.concat(F.slice("big", 2, 3), F.slice("big", 1, 1))))
    return rows.select("meeting_id", "seg_id", X.ordered_subset(small, F.col("big")).alias("subset"))


def tidy_windows(spark, sf):
    return windows.edit_windows(build_turns(spark, sf))


def _lines(spark, sf):
    named = turns.named_turns(build_turns(spark, sf), D.speakers(spark, sf))
    return windows.transcript_lines(named)


def transcript_lines(spark, sf):
    return _lines(spark, sf)


def chunk_lines(spark, sf):
    return windows.chunk_lines(_lines(spark, sf), limit=2000)


def clean_due(spark, sf):
    k = F.col("line_no") % 16
    due = F.get(F.array(*[F.lit(x) for x in NO_DUE], F.lit("by Friday"), F.lit("Omit if none"),
                        F.lit("tbd soon")), k.cast("int"))
    due = F.when(F.col("doc_id") % 2 == 1, F.upper(due)).otherwise(due)
    return D.document_lines(spark, sf).select(
        "doc_id", "line_no", X.clean_due(F.coalesce(due, F.col("line"))).alias("due"))


def excerpt_fallback(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", X.excerpt(F.col("text")).alias("note"))


def render_notes(spark, sf):
    lines = F.split("text", "\n")
    pick = lambda n: F.filter(F.transform(lines, lambda x, i: F.when(i % 4 == n, x)), lambda x: x.isNotNull())
    actions = F.transform(pick(2), lambda x, i: F.struct(
        F.when(i % 2 == 0, F.col("lang")).otherwise("").alias("owner"), x.alias("task"),
        F.when(i % 3 == 0, "Monday").otherwise("").alias("due")))
    return D.table(spark, sf, "documents").select(
        "doc_id", summaries.render_notes(pick(0), pick(1), actions, pick(3)).alias("notes"))


def dedup_exact(spark, sf):
    return summaries.dedup_exact(D.table(spark, sf, "documents"), "doc_id", "text")


def similar_pairs(spark, sf):
    """Every document line against the next one of the same document."""
    rows = D.document_lines(spark, sf)
    after = rows.select("doc_id", (F.col("line_no") - 1).alias("line_no"), F.col("line").alias("b"))
    return summaries.similar_pairs(rows.withColumnRenamed("line", "a").join(after, ["doc_id", "line_no"])).select(
        "doc_id", "line_no", "similar")


def dedup_items(spark, sf):
    return summaries.dedup_items(D.items(spark, sf))


def extract_json(spark, sf):
    return summaries.extract_json(D.replies(spark, sf)).select(
        "meeting_id", F.col("json").isNotNull().alias("found"), F.length("json").cast("bigint").alias("chars"))


def coerce_summary(spark, sf):
    rows = summaries.coerce_summary(
        summaries.extract_json(D.replies(spark, sf)).drop("reply"))
    joined = lambda name: F.array_join(name, "|").alias(name)
    return rows.select(
        "meeting_id", "headline", "tldr", joined("key_points"), joined("decisions"),
        F.array_join(F.transform("action_items", lambda a: F.concat_ws("/", a["owner"], a["task"], a["due"])),
                     "|").alias("action_items"),
        joined("follow_ups"), joined("open_questions"), "email_subject", "email_body")


QUERIES = {f.__name__: f for f in (
    tidy_merge_ops, merge_labels, tidy_apply, tidy_speakers, tidy_report, ordered_subset, tidy_windows,
    transcript_lines, chunk_lines, clean_due, excerpt_fallback, render_notes, dedup_exact, similar_pairs,
    dedup_items, extract_json, coerce_summary)}

_TOKENS = f"regexp_extract_all(lower(text), '[{S.LETTER}'']+')"


def _subset(small, big):
    """Ordered subset as one linear pattern over '|a|b|c|'."""
    return (f"(len({small}) = 0 OR regexp_matches('|' || array_to_string({big}, '|') || '|', "
            f"'\\|' || array_to_string({small}, '\\|([^|]+\\|)*') || '\\|'))")


def _opened(kind, cond, label="NULL", target="NULL", turn="NULL::BIGINT", keep="NULL"):
    return (f"SELECT meeting_id, turn_id // 30 AS window_no, turn_id * 100 + {{}} AS pos, '{kind}' AS op, "
            f"{label} AS label, {target} AS target, {turn} AS turn_id, {keep} AS keep FROM worded WHERE {cond}")


_PROPOSED = [
    _opened("drop", "k = 0", turn="turn_id"),
    _opened("trim", "k = 1", turn="turn_id",
            keep="array_to_string(list_filter(words, lambda w, i: i % 2 = 1), ' ')"),
    _opened("trim", "k = 2", turn="turn_id", keep="array_to_string(list_reverse(words), ' ')"),
    _opened("merge", "turn_id % 5 = 0 AND d = 0 AND conv % 2 = 0", "'s9'", "'s1'"),
    _opened("merge", "turn_id % 5 = 0 AND d = 1 AND conv % 2 = 1", "'s1'", "'s9'"),
    _opened("merge", "turn_id % 5 = 0 AND d = 2", "'you'", "'s1'"),
    _opened("merge", "turn_id % 5 = 0 AND d = 3", "'s2'", "'s1'"),
    _opened("rename", "turn_id % 11 = 0", "'s1'", "' Name ' || turn_id"),
    _opened("rename", "turn_id % 13 = 0", "'you'", "'  '")]

_OPS = f"""{S.TURNS},{S.SPEAKERS},
worded AS (SELECT *, {_TOKENS} AS words, meeting_id::BIGINT AS conv,
           (meeting_id::BIGINT * 3 + turn_id) % 7 AS k, turn_id // 5 % 4 AS d FROM turns),
proposed AS ({' UNION ALL '.join(p.format(i) for i, p in enumerate(_PROPOSED))}),
texted AS (SELECT *, CASE op WHEN 'merge' THEN target WHEN 'rename' THEN trim(target) WHEN 'trim' THEN keep END AS value
           FROM proposed),
ops AS (SELECT meeting_id, op, label, turn_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY meeting_id, op, label, turn_id ORDER BY window_no, pos) AS rn
  FROM texted WHERE op = 'drop' OR trim(coalesce(value, '')) <> '') WHERE rn = 1)"""


def _closure(edges, speakers):
    return f"""
flat AS (SELECT DISTINCT e.meeting_id, label, target FROM {edges} e
  JOIN {speakers} a ON a.meeting_id = e.meeting_id AND a.speaker = label
  JOIN {speakers} b ON b.meeting_id = e.meeting_id AND b.speaker = target
  WHERE label <> 'you' AND target <> 'you' AND label <> target),
walk AS (
  SELECT meeting_id, label, target, [label] AS seen FROM flat
  UNION ALL
  SELECT w.meeting_id, w.label, f.target, list_append(w.seen, w.target) FROM walk w
  JOIN flat f ON f.meeting_id = w.meeting_id AND f.label = w.target WHERE NOT list_contains(w.seen, w.target)),
folds AS (SELECT meeting_id, label, target FROM walk w WHERE NOT EXISTS (
  SELECT 1 FROM flat f WHERE f.meeting_id = w.meeting_id AND f.label = w.target))"""


_EDITED = f"""{_OPS},
merges AS (SELECT meeting_id, label, value AS target FROM ops WHERE op = 'merge'),{_closure('merges', 'speakers')},
trims AS (SELECT meeting_id, turn_id, trim(value) AS keep FROM ops WHERE op = 'trim'),
cut AS (
  SELECT w.*, t.keep, regexp_extract_all(lower(t.keep), '[{S.LETTER}'']+') AS small
  FROM worded w LEFT JOIN trims t USING (meeting_id, turn_id)
  WHERE NOT EXISTS (SELECT 1 FROM ops o WHERE o.op = 'drop' AND o.meeting_id = w.meeting_id AND o.turn_id = w.turn_id)),
ok AS (SELECT *, coalesce(len(small) > 0 AND {_subset('small', 'words')}, false) AS fits FROM cut),
edited AS (
  SELECT o.meeting_id, o.turn_id, coalesce(f.target, o.speaker) AS speaker, o.track, o.start_ms, o.fits,
    CASE WHEN fits AND len(small) < len(words)
      THEN {S.div_round('start_ms * len(words) + greatest(end_ms - start_ms, 0) * len(small)', 'len(words) * 10')} * 10
      ELSE end_ms END AS end_ms, CASE WHEN fits THEN keep ELSE text END AS text
  FROM ok o LEFT JOIN folds f ON f.meeting_id = o.meeting_id AND f.label = o.speaker)"""

_RESPOKEN = """
after AS (
  SELECT s.meeting_id, s.speaker, coalesce(r.new, s.name) AS name, s.ord::BIGINT AS ord, r.new IS NOT NULL AS renamed
  FROM speakers s LEFT JOIN (SELECT meeting_id, label AS speaker, substring(value, 1, 60) AS new FROM ops WHERE op = 'rename') r
    USING (meeting_id, speaker)
  WHERE EXISTS (SELECT 1 FROM edited e WHERE e.meeting_id = s.meeting_id AND e.speaker = s.speaker))"""

_LINED = f"""{S.TURNS},{S.SPEAKERS},
lines AS (
  SELECT meeting_id, turn_id, '[' || {S.mmss('start_ms')} || '] ' || coalesce(name, t.speaker) || ': ' || text AS line
  FROM turns t LEFT JOIN speakers s USING (meeting_id, speaker))"""

_DOC_LINES = f"""
doc_lines AS (
  SELECT doc_id, line_no, {S.strip('raw')} AS line FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
           generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)
  WHERE {S.strip('raw')} <> '')"""

_DUES = S.quoted(NO_DUE + ["by Friday", "Omit if none", "tbd soon"])

_REPLIES = f"""r AS (
  SELECT doc_id::VARCHAR AS meeting_id, doc_id % 6 AS k, text, lang, source, string_split(text, chr(10)) AS lines FROM documents),
items AS (
  SELECT *, list_transform(lines, lambda x, i: {{'owner': CASE WHEN (i - 1) % 3 = 0 THEN '' ELSE ' You ' END, 'task': x,
                                                 'due': CASE WHEN (i - 1) % 2 = 0 THEN 'TBD' ELSE 'Friday' END}}) AS tasks FROM r)"""
#: The first texts of a list that are not empty, each cut.
_FIRST_LINES = f"array_to_string(list_filter(list_transform(lines, lambda x: substring({S.strip('x')}, 1, 600)), lambda x: x <> '')[1:25], '|')"

ORACLE = {
    "extract_json": f"""WITH {_REPLIES}
SELECT meeting_id, k <> 5 AS found, CASE WHEN k <> 5 THEN length(
  '{{"headline":' || to_json('  {{' || lines[1] || '}}') || ',"tldr":' || to_json(text) || ',"key_points":' || to_json(lines)
  || CASE WHEN k <> 3 THEN ',"decisions":' || to_json(lines) ELSE '' END
  || CASE WHEN k <> 4 THEN ',"action_items":' || to_json(tasks) ELSE '' END
  || CASE WHEN k = 4 THEN ',"follow_ups":' || to_json(lang) ELSE '' END
  || ',"follow_up_email":' || to_json({{'subject': source, 'body': text}}) || '}}') END AS chars FROM items""",
    "coerce_summary": f"""WITH {_REPLIES}
SELECT meeting_id, CASE WHEN k = 5 THEN '' ELSE substring({S.strip("('  {' || lines[1] || '}')")}, 1, 90) END AS headline,
  CASE WHEN k = 5 THEN '' ELSE substring({S.strip('text')}, 1, 1500) END AS tldr,
  CASE WHEN k = 5 THEN '' ELSE {_FIRST_LINES} END AS key_points,
  CASE WHEN k IN (3, 5) THEN '' ELSE {_FIRST_LINES} END AS decisions,
  CASE WHEN k IN (4, 5) THEN '' ELSE array_to_string(list_transform(list_filter(tasks, lambda t: {S.strip('t.task')} <> '')[1:25],
    lambda t: CASE WHEN t.owner = '' THEN '—' ELSE 'You' END || '/' || substring({S.strip('t.task')}, 1, 400) || '/'
    || CASE WHEN t.due = 'TBD' THEN '' ELSE t.due END), '|') END AS action_items,
  '' AS follow_ups, '' AS open_questions,
  CASE WHEN k = 5 THEN '' ELSE substring({S.strip('source')}, 1, 200) END AS email_subject,
  CASE WHEN k = 5 THEN '' ELSE substring({S.strip('text')}, 1, 4000) END AS email_body FROM items""",
    "tidy_merge_ops": f"WITH {_OPS} SELECT * FROM ops",
    "merge_labels": f"""WITH RECURSIVE node AS (SELECT (vec_id // 50)::VARCHAR AS meeting_id, vec_id % 50 AS n, label AS l FROM embeddings),
speakers AS (SELECT meeting_id, CASE WHEN n = 0 THEN 'you' ELSE 'v' || n END AS speaker FROM node),
merges AS (SELECT meeting_id, CASE WHEN n = 0 THEN 'you' ELSE 'v' || n END AS label,
  CASE WHEN (n * 7 + l * 11 + 3) % 50 = 0 THEN 'you' ELSE 'v' || ((n * 7 + l * 11 + 3) % 50) END AS target FROM node WHERE l <> 9),
{_closure('merges', 'speakers')} SELECT * FROM folds""",
    "tidy_apply": f"""WITH RECURSIVE {_EDITED},
m AS (SELECT *, CASE WHEN speaker IS DISTINCT FROM lag(speaker) OVER (PARTITION BY meeting_id ORDER BY turn_id) THEN 1 ELSE 0 END AS chg FROM edited),
r AS (SELECT *, sum(chg) OVER (PARTITION BY meeting_id ORDER BY turn_id) AS rn FROM m),
f AS (SELECT *, max(end_ms) OVER (PARTITION BY meeting_id, rn ORDER BY turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM r),
i AS (SELECT *, sum(CASE WHEN far IS NULL OR start_ms - far > 3000 THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id ORDER BY turn_id) - 1 AS island FROM f)
SELECT meeting_id, island::BIGINT AS turn_id, min(speaker) AS speaker, arg_min(track, turn_id) AS track, min(start_ms) AS start_ms,
       max(end_ms)::BIGINT AS end_ms, string_agg(text, ' ' ORDER BY turn_id) AS text, false AS refused FROM i GROUP BY 1, 2
UNION ALL SELECT meeting_id, turn_id, speaker, track, start_ms, end_ms, text, true FROM turns t
WHERE NOT EXISTS (SELECT 1 FROM edited e WHERE e.meeting_id = t.meeting_id)""",
    "tidy_speakers": f"WITH RECURSIVE {_EDITED},{_RESPOKEN} SELECT * FROM after",
    "tidy_report": f"""WITH RECURSIVE {_EDITED},{_RESPOKEN}
SELECT t.meeting_id,
  (SELECT count(*) FROM ops o WHERE o.meeting_id = t.meeting_id AND op = 'drop') AS dropped_turns,
  (SELECT count(*) FROM edited e WHERE e.meeting_id = t.meeting_id AND fits) AS trimmed_turns,
  (SELECT count(*) FROM folds f WHERE f.meeting_id = t.meeting_id) AS merged_speakers,
  (SELECT count(*) FROM after a WHERE a.meeting_id = t.meeting_id AND renamed) AS renamed_speakers
FROM (SELECT DISTINCT meeting_id FROM turns) t""",
    "ordered_subset": f"""WITH {S.SEGMENTS},
b AS (SELECT meeting_id, seg_id, {_TOKENS} AS big FROM segments),
s AS (SELECT *, CASE seg_id % 3 WHEN 0 THEN list_filter(big, lambda w, i: i % 2 = 1) WHEN 1 THEN list_reverse(big)
                ELSE list_concat(big[2:4], big[1:1]) END AS small FROM b)
SELECT meeting_id, seg_id, {_subset('small', 'big')} AS subset FROM s""",
    "tidy_windows": f"""WITH RECURSIVE {S.TURNS},
cost AS (SELECT meeting_id, turn_id, length(text) + 40 AS c, count(*) OVER (PARTITION BY meeting_id) AS n FROM turns),
sized AS (
  SELECT a.meeting_id, a.turn_id, any_value(a.n) AS n, greatest(1, count(*) FILTER (WHERE used <= 8000)) AS size FROM (
    SELECT a.meeting_id, a.turn_id, a.n, sum(b.c) OVER (PARTITION BY a.meeting_id, a.turn_id ORDER BY b.turn_id) AS used
    FROM cost a JOIN cost b ON b.meeting_id = a.meeting_id AND b.turn_id BETWEEN a.turn_id AND a.turn_id + 35) a GROUP BY 1, 2),
steps AS (
  SELECT * FROM sized WHERE turn_id = 0
  UNION ALL SELECT r.* FROM steps s JOIN sized r ON r.meeting_id = s.meeting_id AND r.turn_id = s.turn_id + greatest(1, s.size - 6)
  WHERE s.turn_id + s.size < s.n)
SELECT meeting_id, turn_id AS first_turn, size AS turns FROM steps""",
    "transcript_lines": f"WITH {_LINED} SELECT * FROM lines",
    "chunk_lines": f"""WITH RECURSIVE {_LINED},
step AS (
  SELECT meeting_id, turn_id, length(line) + 1 AS size, 0 AS chunk, line FROM lines WHERE turn_id = 0
  UNION ALL
  SELECT l.meeting_id, l.turn_id, CASE WHEN s.size + length(l.line) > 2000 THEN 0 ELSE s.size END + length(l.line) + 1,
         CASE WHEN s.size + length(l.line) > 2000 THEN 1 ELSE 0 END + s.chunk, l.line
  FROM step s JOIN lines l ON l.meeting_id = s.meeting_id AND l.turn_id = s.turn_id + 1)
SELECT meeting_id, chunk::BIGINT AS chunk, string_agg(line, chr(10) ORDER BY turn_id) AS line, count(*) AS lines
FROM step GROUP BY 1, 2""",
    "clean_due": f"""WITH {_DOC_LINES},
d AS (SELECT doc_id, line_no, line, ({_DUES})[line_no % 16 + 1] AS due FROM doc_lines),
t AS (SELECT doc_id, line_no, substring({S.strip('coalesce(CASE WHEN doc_id % 2 = 1 THEN upper(due) ELSE due END, line)')}, 1, 80) AS due FROM d)
SELECT doc_id, line_no, CASE WHEN list_contains({S.quoted(NO_DUE)}, lower(due)) OR length(due) > 40
  OR regexp_matches(due, 'stated timing|empty string|omit|never invent', 'i') THEN '' ELSE due END AS due FROM t""",
    "excerpt_fallback": f"""SELECT doc_id, '- (portion kept verbatim — could not be auto-summarized): '
|| substring(regexp_replace({S.strip('text')}, '\\s+', ' ', 'g'), 1, 500) || '…' AS note FROM documents""",
    "render_notes": """WITH l AS (SELECT doc_id, lang, string_split(text, chr(10)) AS a FROM documents),
p AS (SELECT doc_id, lang, list_filter(a, lambda x, i: i % 4 = 1) AS p0, list_filter(a, lambda x, i: i % 4 = 2) AS p1,
      list_filter(a, lambda x, i: i % 4 = 3) AS p2, list_filter(a, lambda x, i: i % 4 = 0) AS p3 FROM l)
SELECT doc_id, array_to_string(list_concat(list_concat(list_transform(p0, lambda x: '- ' || x),
  list_transform(p1, lambda x: '- DECISION: ' || x)), list_concat(
  list_transform(p2, lambda x, i: '- ACTION: ' || CASE WHEN i % 2 = 1 THEN lang ELSE '—' END || ' — ' || x
    || CASE WHEN i % 3 = 1 THEN ' (due Monday)' ELSE '' END),
  list_transform(p3, lambda x: '- OPEN QUESTION: ' || x))), chr(10)) AS notes FROM p""",
    "dedup_exact": f"""SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents
WHERE {S.norm('text')} <> '' GROUP BY {S.norm('text')}""",
}
