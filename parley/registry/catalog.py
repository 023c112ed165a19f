"""Queries over the meeting catalogue, its exports and its synced copies."""

from pyspark.sql import functions as F

from parley.functions import constants as c
from parley.functions import text as X
from parley.operators import catalog, stats, sync, turns, vocabulary
from parley.registry import sql as S
from parley.registry.conversation import build_turns
from parley.session import cut_lineage
from parley.sources import derived as D

SEARCH = "SRC1"
PROBE = "20240101-010000"


def _stamp(name):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def _listed(df):
    return df.select("meeting_id", "title", _stamp("created"), "duration_ms", "status", "mode", "sync_enabled", "speakers")


def list_meetings(spark, sf):
    return _listed(catalog.page(catalog.list_items(D.meetings(spark, sf))))


def list_total(spark, sf):
    found = catalog.search(D.meetings(spark, sf), SEARCH)
    return found.agg(F.count(F.lit(1)).alias("total"))


def search_meetings(spark, sf):
    return _listed(catalog.list_items(catalog.search(D.meetings(spark, sf), SEARCH)))


def meeting_detail(spark, sf):
    newest = D.meetings(spark, sf).agg(F.max("meeting_id").alias("meeting_id"))
    return _listed(catalog.list_items(D.meetings(spark, sf).join(newest, "meeting_id", "left_semi")))


def page_lookahead(spark, sf):
    return catalog.page_lookahead(D.meetings(spark, sf), ["user_id"], size=10).select(
        "user_id", "meeting_id", _stamp("created"), F.col("rank").cast("bigint").alias("rank"), "has_more")


def page_labels(spark, sf):
    return catalog.page_rows(D.meetings(spark, sf), 2024).select("meeting_id", "date")


def sync_eligible(spark, sf):
    return catalog.eligible(D.meetings(spark, sf)).select("meeting_id", "status", "n_turns")


def recover_interrupted(spark, sf):
    return catalog.recover_interrupted(D.meetings(spark, sf)).select("meeting_id", "status", "error")


def refresh_warnings(spark, sf):
    new = F.array(F.concat(F.lit("Diarization on "), F.col("mode")))
    return catalog.refresh_warnings(D.meetings(spark, sf), new).select(
        "meeting_id", F.array_join("warnings", "|").alias("warnings"))


def backfill_missing(spark, sf):
    return catalog.backfill_missing(D.meetings(spark, sf), D.meeting_edits(spark, sf)).select("meeting_id")


def apply_renames(spark, sf):
    return catalog.rename_titles(D.meetings(spark, sf), D.meeting_edits(spark, sf)).select("meeting_id", "title")


def rename_speakers(spark, sf):
    rows = D.meetings(spark, sf).select("meeting_id", F.inline("speakers"))
    edits = D.meeting_edits(spark, sf).select(
        "meeting_id", F.when(F.col("doc_id") % 2 == 0, "s1").otherwise("s7").alias("speaker"),
        F.col("title").alias("name"), "version")
    return catalog.rename_speakers(rows, edits).select("meeting_id", "speaker", "name")


def safe_names(spark, sf):
    rows = D.meetings(spark, sf)
    return rows.select("meeting_id", X.folder_name(F.col("title"), F.col("meeting_id")).alias("folder"),
                       X.safe_file_name(F.col("text"), F.col("meeting_id")).alias("file"))


def locale_lookup(spark, sf):
    chosen = X.language_choice(F.col("language"))
    return D.meetings(spark, sf).select(
        "meeting_id", chosen.alias("chosen"),
        X.locale(F.coalesce(chosen, F.when(F.col("mode") == "online", "pt")), c.LOCALES, c.DEFAULT_LOCALE).alias("locale"))


def owner_rows(spark, sf):
    return sync.owned_by(D.meetings(spark, sf), F.lit("u7")).select("user_id", "meeting_id", "mode")


def upsert_meetings(spark, sf):
    stamp = lambda s: F.lit(s).cast("timestamp_ntz")
    old = D.meetings(spark, sf).filter("status <> 'error'").select(
        "user_id", "meeting_id", "title", "version", stamp("2024-06-01 00:00:00").alias("updated_at"))
    new = D.meeting_edits(spark, sf).select("user_id", "meeting_id", "title", "version")
    return catalog.upsert(old, new, ["user_id", "meeting_id"], "version", stamp("2024-07-01 00:00:00")).select(
        "user_id", "meeting_id", "title", "version", _stamp("updated_at"), "replaced")


def sync_push(spark, sf):
    rows = sync.payload(catalog.eligible(D.synced_meetings(spark, sf)))
    return sync.sized(rows, limit=40_000).select("user_id", "meeting_id", "bytes", "accepted")


def sync_delete(spark, sf):
    edits = D.meeting_edits(spark, sf)
    users = D.meetings(spark, sf).filter("doc_id % 50 = 13").select("user_id").distinct()
    kept = sync.delete_copies(D.meetings(spark, sf).filter("sync_enabled"), edits.filter("version > 1"), users)
    return kept.select("user_id", "meeting_id")


def delete_meetings(spark, sf):
    rows = D.meetings(spark, sf)
    busy = rows.filter("language IS NULL").select("meeting_id")
    return catalog.delete_meetings(rows, D.meeting_edits(spark, sf), busy).select("meeting_id", "status")


def sync_drain(spark, sf):
    rows = D.meetings(spark, sf)
    queue = sync.enqueue(D.meeting_edits(spark, sf), rows.filter("mode = 'inperson'"))
    late = rows.filter("language = 'auto'")
    failed = sync.to_push(queue, rows).filter("n_turns > 20")
    return sync.after_drain(sync.enqueue(queue, late), queue, failed)


def tidy_undo(spark, sf):
    base = D.meetings(spark, sf).select("doc_id", "meeting_id", "title")
    versions = base.select("meeting_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("doc_id") % 4 + 1)).alias("version"),
                           "title", "doc_id")
    rows = versions.select("meeting_id", "version", F.concat_ws("#", "title", F.col("version").cast("string")).alias("title"),
                           ((F.col("version") > 1) & (F.col("version") >= F.col("doc_id") % 3 + 1)).alias("tidied"))
    return catalog.undo_tidy(rows).select("meeting_id", "version", "title")


def merge_vocabulary(spark, sf):
    return vocabulary.merge_terms(*D.terms(spark, sf))


def attendee_names(spark, sf):
    who = F.col("attendees")
    return D.attendees(spark, sf).select(
        "order_id", F.size(vocabulary.other_attendees(who)).cast("bigint").alias("attendees"),
        F.array_join(vocabulary.attendee_names(who), "|").alias("names"))


def _talks(spark, sf):
    return D.modes(spark, sf).select(
        "meeting_id", F.concat(F.lit("Meeting "), "meeting_id").alias("title"),
        F.concat(F.lit("day "), "meeting_id").alias("created"),
        (F.col("meeting_id").cast("bigint") * 100_000).alias("duration_ms"), "mode")


def _named(spark, sf):
    return turns.named_turns(build_turns(spark, sf), D.speakers(spark, sf))


def export_text(spark, sf):
    return catalog.text_lines(_talks(spark, sf), _named(spark, sf))


def _summaries(spark, sf):
    talk = F.col("meeting_id")
    n = talk.cast("bigint")
    some = lambda k, word: F.when(n % k == 0, F.array(F.concat(F.lit(f"{word} one "), talk), F.lit(f"{word} two"))).otherwise(
        F.array().cast("array<string>"))
    actions = F.array(F.struct(F.lit("You").alias("owner"), F.concat(F.lit("task "), talk).alias("task"),
                               F.when(n % 2 == 0, "Monday").otherwise("").alias("due")))
    return D.modes(spark, sf).select(
        talk, F.when(n % 2 == 0, F.concat(F.lit("About "), talk)).otherwise("").alias("tldr"),
        some(2, "point").alias("key_points"), some(3, "decision").alias("decisions"), actions.alias("action_items"),
        some(4, "later").alias("follow_ups"), some(5, "question").alias("open_questions"),
        F.when(n % 3 == 0, F.concat(F.lit("About "), talk)).otherwise("").alias("email_subject"),
        F.when(n % 2 == 1, F.concat(F.lit("Hi,\n\nsee "), talk)).otherwise("").alias("email_body"))


def export_markdown(spark, sf):
    """Exports read a stored transcript: its turns are built once."""
    said, names = cut_lineage(build_turns(spark, sf)), D.speakers(spark, sf)
    keys = ["meeting_id", "speaker"]
    top = stats.filler_top(stats.filler_counts(said)).select(*keys, "top")
    table = stats.speaker_stats(said, names).join(names.select(*keys, "name"), keys).join(top, keys, "left")
    return catalog.markdown_rows(_talks(spark, sf), _summaries(spark, sf), table, turns.named_turns(said, names))


QUERIES = {f.__name__: f for f in (
    list_meetings, list_total, search_meetings, meeting_detail, page_lookahead, page_labels, sync_eligible,
    recover_interrupted, refresh_warnings, backfill_missing, apply_renames, rename_speakers, safe_names, locale_lookup,
    owner_rows, upsert_meetings, sync_push, sync_delete, delete_meetings, sync_drain, tidy_undo, merge_vocabulary,
    attendee_names, export_text, export_markdown)}

MEETINGS = f"""
meetings AS (
  SELECT doc_id, text, strftime(ts, '%Y%m%d-%H%M%S') AS meeting_id, 'u' || (doc_id % 50) AS user_id,
    string_split(text, chr(10))[1] AS title, ts AS created,
    CASE WHEN doc_id % 3 = 0 THEN 'inperson' ELSE 'online' END AS mode,
    CASE doc_id % 10 WHEN 0 THEN 'recording' WHEN 1 THEN 'processing' WHEN 2 THEN 'error' ELSE 'done' END AS status,
    n_chars::BIGINT * 60 AS duration_ms, doc_id % 4 < 3 AS sync_enabled,
    CASE WHEN doc_id % 3 = 0 THEN ['You', 'Guest ' || source, lang] ELSE ['You', 'Guest ' || source] END AS names,
    CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'auto' WHEN 2 THEN lang || '-gb' WHEN 3 THEN 'english_us!' ELSE lang END AS language,
    len(list_filter(string_split(text, chr(10)), lambda x: {S.strip('x')} <> '')) AS n_turns, lang
  FROM (SELECT *, TIMESTAMP '2024-01-01' + to_seconds(doc_id * 397) AS ts FROM documents))"""

EDITS = f"""{MEETINGS},
edits AS (
  SELECT doc_id, meeting_id, user_id, CASE WHEN quality = 1 THEN '  ' || text ELSE '   ' END AS title,
         (toxic * 3 + doc_id % 3)::BIGINT AS version FROM labels JOIN meetings USING (doc_id))"""

_LISTED = """SELECT meeting_id, title, strftime(created, '%Y-%m-%d %H:%M:%S') AS created, duration_ms, status, mode,
  sync_enabled, len(names) AS speakers FROM meetings"""
_FOUND = f"WHERE contains(lower(title || ' ' || array_to_string(names, ' ')), '{SEARCH.lower()}')"

_NAMED = f"""{S.MEASURED},{S.MODES},
named AS (SELECT t.*, coalesce(s.name, t.speaker) AS name FROM turns t LEFT JOIN speakers s USING (meeting_id, speaker))"""

_TALK = "'Meeting ' || meeting_id"


def _bullets(title, items):
    return (f"CASE WHEN len({items}) > 0 THEN list_concat(['**{title}**', ''], list_concat("
            f"list_transform({items}, lambda x: '- ' || x), [''])) ELSE [] END")


def _some(k, word):
    return (f"CASE WHEN meeting_id::BIGINT % {k} = 0 THEN ['{word} one ' || meeting_id, '{word} two'] "
            f"ELSE []::VARCHAR[] END")


def _concat(parts):
    out = parts[0]
    for part in parts[1:]:
        out = f"list_concat({out}, {part})"
    return out


_SUMMARY = _concat([
    "['', '## Summary', '']::VARCHAR[]",
    "CASE WHEN n % 2 = 0 THEN ['About ' || meeting_id, ''] ELSE [] END",
    _bullets("Key points", "kp"), _bullets("Decisions", "de"),
    "['**Action items**', '', '- **You:** task ' || meeting_id || CASE WHEN n % 2 = 0 THEN ' _(by Monday)_' ELSE '' END, '']",
    _bullets("Follow-ups", "fu"), _bullets("Open questions", "oq"),
    """CASE WHEN n % 2 = 1 THEN list_concat(list_concat(['**Draft follow-up email**', ''],
      CASE WHEN n % 3 = 0 THEN ['*Subject:* About ' || meeting_id, ''] ELSE [] END),
      ['> Hi,', '>', '> see ' || meeting_id, '']) ELSE [] END"""])

ORACLE = {
    "list_meetings": f"WITH {MEETINGS} {_LISTED} ORDER BY meeting_id DESC LIMIT 40",
    "list_total": f"WITH {MEETINGS} SELECT count(*) AS total FROM meetings {_FOUND}",
    "search_meetings": f"WITH {MEETINGS} {_LISTED} {_FOUND}",
    "meeting_detail": f"WITH {MEETINGS} {_LISTED} WHERE meeting_id = (SELECT max(meeting_id) FROM meetings)",
    "page_lookahead": f"""WITH {MEETINGS},
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created DESC, meeting_id DESC) AS rank,
      count(*) OVER (PARTITION BY user_id) AS n FROM meetings)
SELECT user_id, meeting_id, strftime(created, '%Y-%m-%d %H:%M:%S') AS created, rank, n > 10 AS has_more FROM r WHERE rank <= 10""",
    "page_labels": f"""WITH {MEETINGS} SELECT meeting_id, strftime(created, '%b %-d') || ' · ' || strftime(created, '%-I:%M %p') AS date
FROM meetings""",
    "sync_eligible": f"WITH {MEETINGS} SELECT meeting_id, status, n_turns FROM meetings WHERE status = 'done' AND n_turns > 0",
    "recover_interrupted": f"""WITH {MEETINGS} SELECT meeting_id,
CASE WHEN status IN ('recording', 'processing') THEN 'error' ELSE status END AS status,
CASE WHEN status IN ('recording', 'processing') THEN '{catalog.INTERRUPTED}' END AS error FROM meetings""",
    "refresh_warnings": f"""WITH {MEETINGS} SELECT meeting_id,
CASE WHEN doc_id % 5 = 0 THEN 'mic track stopped early: ' || lang || '|' ELSE '' END || 'Diarization on ' || mode AS warnings FROM meetings""",
    "backfill_missing": f"""WITH {EDITS} SELECT meeting_id FROM meetings
WHERE status = 'done' AND n_turns > 0 AND meeting_id NOT IN (SELECT meeting_id FROM edits)""",
    "apply_renames": f"""WITH {EDITS},
v AS (SELECT meeting_id, arg_max(substring({S.strip('title')}, 1, 120), version) AS t FROM edits
      WHERE substring({S.strip('title')}, 1, 120) <> '' GROUP BY 1)
SELECT meeting_id, coalesce(t, title) AS title FROM meetings LEFT JOIN v USING (meeting_id)""",
    "rename_speakers": f"""WITH {EDITS},
s AS (SELECT meeting_id, unnest(['you', 's1', 's2'][1:len(names)]) AS speaker, unnest(names) AS name FROM meetings),
v AS (SELECT meeting_id, CASE WHEN doc_id % 2 = 0 THEN 's1' ELSE 's7' END AS speaker,
      arg_max(substring({S.strip('title')}, 1, 60), version) AS t FROM edits
      WHERE substring({S.strip('title')}, 1, 60) <> '' GROUP BY 1, 2)
SELECT meeting_id, speaker, coalesce(t, name) AS name FROM s LEFT JOIN v USING (meeting_id, speaker)""",
    "safe_names": f"""WITH {MEETINGS},
f AS (SELECT meeting_id, text, trim(substring(trim(regexp_replace(regexp_replace(title, '[<>:"/\\\\|?*\\x00-\\x1f]', '', 'g'),
      '[\\s\\p{{Z}}]+', ' ', 'g'), ' .'), 1, 60), ' .') AS safe FROM meetings)
SELECT meeting_id, CASE WHEN safe <> '' THEN safe || ' — ' || meeting_id ELSE meeting_id END AS folder,
  coalesce(nullif(trim(regexp_replace(text, '[^{S.LETTER}\\- ]+', '', 'g')), ''), meeting_id) AS file FROM f""",
    "locale_lookup": f"""WITH {MEETINGS},
m(code, locale) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in c.LOCALES.items())}),
c AS (SELECT meeting_id, mode, CASE WHEN regexp_full_match(language, '[a-zA-Z-]{{2,10}}') AND language <> 'auto' THEN language END AS chosen FROM meetings),
l AS (SELECT *, lower(coalesce(chosen, CASE WHEN mode = 'online' THEN 'pt' END, '')) AS lang FROM c)
SELECT meeting_id, chosen, CASE WHEN lang = '' THEN 'en-US' WHEN contains(lang, '-')
  THEN split_part(lang, '-', 1) || '-' || upper(substring(lang, instr(lang, '-') + 1)) ELSE coalesce(m.locale, 'en-US') END AS locale
FROM l LEFT JOIN m ON m.code = l.lang""",
    "owner_rows": f"WITH {MEETINGS} SELECT user_id, meeting_id, mode FROM meetings WHERE user_id = 'u7'",
    "upsert_meetings": f"""WITH {EDITS},
rows AS (SELECT user_id, meeting_id, title, 1::BIGINT AS version, false AS fresh FROM meetings WHERE status <> 'error'
         UNION ALL SELECT user_id, meeting_id, title, version, true FROM edits),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, meeting_id ORDER BY version DESC, fresh DESC) AS rn,
      bool_or(NOT fresh) OVER (PARTITION BY user_id, meeting_id) AS old FROM rows)
SELECT user_id, meeting_id, title, version,
  CASE WHEN fresh THEN '2024-07-01 00:00:00' ELSE '2024-06-01 00:00:00' END AS updated_at, fresh AND old AS replaced
FROM r WHERE rn = 1""",
    "sync_push": f"""WITH {MEETINGS},
t AS (
  SELECT *, list_filter(string_split(text, chr(10)), lambda x: {S.strip('x')} <> '') AS lines FROM meetings
  WHERE status = 'done' AND n_turns > 0),
b AS (
  SELECT user_id, meeting_id, strlen(to_json({{
    'user_id': user_id, 'meeting_id': meeting_id, 'title': coalesce(title, ''), 'created': strftime(created, '%Y-%m-%dT%H:%M:%S'),
    'duration': duration_ms / 1000, 'mode': mode,
    'speakers': list_transform(names, lambda n, i: {{'speaker': (['you', 's1', 's2'])[i], 'name': n}}),
    'turns': list_transform(lines, lambda x, i: {{'speaker': CASE WHEN i % 2 = 1 THEN 'you' ELSE 's1' END,
      'start': (i - 1) * 5, 'end': (i - 1) * 5 + 4, 'text': {S.strip('x')}}}), 'summary': NULL, 'stats': NULL}})::VARCHAR) AS bytes FROM t)
SELECT user_id, meeting_id, bytes, bytes <= 40000 AS accepted FROM b""",
    "sync_delete": f"""WITH {EDITS} SELECT user_id, meeting_id FROM meetings WHERE sync_enabled
AND meeting_id NOT IN (SELECT meeting_id FROM edits WHERE version > 1) AND doc_id % 50 <> 13""",
    "delete_meetings": f"""WITH {EDITS} SELECT meeting_id, status FROM meetings
WHERE status IN ('recording', 'processing') OR language IS NULL OR meeting_id NOT IN (SELECT meeting_id FROM edits)""",
    "sync_drain": f"""WITH {EDITS},
queue AS (SELECT meeting_id FROM edits UNION SELECT meeting_id FROM meetings WHERE mode = 'inperson')
SELECT meeting_id FROM meetings WHERE language = 'auto' AND meeting_id NOT IN (SELECT meeting_id FROM queue)
UNION SELECT meeting_id FROM meetings WHERE sync_enabled AND n_turns > 20 AND meeting_id IN (SELECT meeting_id FROM queue)""",
    "tidy_undo": f"""WITH {MEETINGS},
v AS (SELECT meeting_id, title, doc_id, unnest(range(1, doc_id % 4 + 2)) AS version FROM meetings),
t AS (SELECT *, version > 1 AND version >= doc_id % 3 + 1 AS tidied FROM v),
k AS (SELECT t.*, row_number() OVER (PARTITION BY meeting_id ORDER BY version DESC) AS rn FROM t
      WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.meeting_id = t.meeting_id AND b.tidied AND b.version <= t.version))
SELECT meeting_id, version, title || '#' || version AS title FROM k WHERE rn = 1""",
    "merge_vocabulary": f"""WITH {S.PIECES},
w AS (SELECT conv_id::VARCHAR AS meeting_id, role, turn * 1000000 + pos * 1000 + generate_subscripts(tokens, 1) - 1 AS pos,
      generate_subscripts(tokens, 1) - 1 AS i, unnest(tokens) AS term FROM pieces),
d AS (SELECT unnest({S.quoted(c.DEFAULT_VOCABULARY)}) AS term, generate_subscripts({S.quoted(c.DEFAULT_VOCABULARY)}, 1) AS pos),
a AS (SELECT meeting_id, 0 AS rank, pos, term FROM w WHERE role = 'user'
      UNION ALL SELECT meeting_id, 1, pos, term FROM w WHERE role <> 'user' AND i = 0
      UNION ALL SELECT m.meeting_id, 2, pos, term FROM (SELECT DISTINCT conv_id::VARCHAR AS meeting_id FROM conversations) m, d),
o AS (SELECT meeting_id, lower(term) AS key, arg_min(term, {{'r': rank, 'p': pos}}) AS term, min({{'r': rank, 'p': pos}}) AS first_at
      FROM a GROUP BY 1, 2)
SELECT meeting_id, place, substring(term, 1, 80) AS term FROM (
  SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY first_at) AS place FROM o) WHERE place <= 100""",
    "attendee_names": """WITH a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN [] ELSE list_filter([
  {'n': ' ' || clerk, 's': false}, {'n': 'Customer ' || o_custkey, 's': o_orderkey % 3 = 0}, {'n': '  ', 's': false},
  {'n': o_custkey || '@example.com', 's': false}, CASE WHEN o_orderkey % 2 = 0 THEN {'n': clerk, 's': false} END,
  {'n': o_orderstatus, 's': false}], lambda p: p IS NOT NULL) END AS people FROM (SELECT *, 'Clerk ' || (o_custkey % 97) AS clerk FROM orders)),
b AS (SELECT k, people, list_filter(people, lambda p: NOT p.s) AS o FROM a),
c AS (SELECT k, CASE WHEN len(o) = len(people) AND len(o) > 0 THEN o[1:len(o) - 1] ELSE o END AS o FROM b),
n AS (SELECT k, len(o) AS attendees, list_filter(list_transform(o, lambda p: trim(p.n)), lambda x: x <> '' AND NOT contains(x, '@')) AS names FROM c)
SELECT k AS order_id, attendees, coalesce(array_to_string(list_filter(names, lambda x, i: list_position(names, x) = i), '|'), '') AS names FROM n""",
    "export_markdown": f"""WITH {_NAMED},
agg AS (
  SELECT s.meeting_id, s.speaker, s.name, s.ord, coalesce(sum(ms), 0)::BIGINT AS ms, coalesce(sum(words), 0)::BIGINT AS words,
         coalesce(sum(questions), 0)::BIGINT AS questions
  FROM speakers s LEFT JOIN measured m USING (meeting_id, speaker) GROUP BY 1, 2, 3, 4),
tot AS (SELECT *, sum(ms) OVER (PARTITION BY meeting_id)::BIGINT AS total, {S.tenths('ms')} AS t FROM agg),
figures AS (SELECT *, CASE WHEN total > 0 THEN {S.div_round('t * 100000', 'total')} ELSE 0 END AS share,
         CASE WHEN t > 30 THEN {S.div_round('words * 600', 't')} ELSE 0 END AS wpm FROM tot),
hit AS ({' UNION ALL '.join(f"SELECT meeting_id, speaker, turn_id, {i} AS o, '{p}' AS phrase, {S.phrase_hits('text', p)} AS n FROM turns" for i, p in enumerate(c.FILLER_PHRASES))}),
often AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, speaker ORDER BY hits DESC, ft, o) AS rn FROM (
  SELECT meeting_id, speaker, phrase, o, sum(n)::BIGINT AS hits, min(turn_id) AS ft FROM hit WHERE n > 0 GROUP BY 1, 2, 3, 4)),
top AS (SELECT meeting_id, speaker, string_agg(phrase || '×' || hits, ', ' ORDER BY rn) AS top FROM often WHERE rn <= 3 GROUP BY 1, 2),
summary AS (SELECT meeting_id, {_SUMMARY} AS lines FROM (
  SELECT meeting_id, meeting_id::BIGINT AS n, {_some(2, 'point')} AS kp, {_some(3, 'decision')} AS de,
         {_some(4, 'later')} AS fu, {_some(5, 'question')} AS oq FROM modes)),
fixed AS (SELECT ['', '## Speaking stats', '', '| Speaker | Talk time | Share | Words | WPM | Questions | Fillers |',
                  '|---|---|---|---|---|---|---|'] AS s, ['', '## Transcript', ''] AS t)
SELECT meeting_id, 0::BIGINT AS part, i::BIGINT AS pos, ['# ' || {_TALK}, '', '*Recorded:* day ' || meeting_id || '  |  *Duration:* '
  || {S.clock('meeting_id::BIGINT * 100000')} || '  |  *Mode:* ' || mode][i + 1] AS line FROM modes, range(3) r(i)
UNION ALL SELECT meeting_id, 1, i - 1, lines[i] FROM (SELECT *, unnest(range(1, len(lines))) AS i FROM summary)
UNION ALL SELECT meeting_id, 2, i - 2, s[i] FROM modes, fixed, range(1, 6) r(i)
UNION ALL SELECT f.meeting_id, 2, f.ord + 4, '| ' || name || ' | ' || {S.clock('t * 100')} || ' | ' || {S.div_round('share', '10')} || '% | '
  || words || ' | ' || wpm || ' | ' || questions || ' | ' || coalesce(top, '—') || ' |' FROM figures f LEFT JOIN top USING (meeting_id, speaker)
UNION ALL SELECT meeting_id, 3, i - 4, t[i] FROM modes, fixed, range(1, 4) r(i)
UNION ALL SELECT meeting_id, 3, turn_id * 2, '**' || name || '** `[' || {S.clock('start_ms')} || ']`  ' || text FROM named
UNION ALL SELECT meeting_id, 3, turn_id * 2 + 1, '' FROM named""",
    "export_text": f"""WITH {_NAMED}
SELECT meeting_id, i::BIGINT AS line_no, [{_TALK}, repeat('=', length({_TALK})), ''][i + 1] AS line FROM modes, range(3) r(i)
UNION ALL SELECT meeting_id, turn_id + 3, '[' || {S.clock('start_ms')} || '] ' || name || ': ' || text FROM named""",
}
