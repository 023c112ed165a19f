"""Canonical tables derived by Spark from the generic test tables.

Every derivation is a projection of the whole table; none gathers a group.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.constants import ALIASES, FILLER_PHRASES, MEETING_APPS
from parley.functions.text import split_words, strip, tokens
from parley.functions.vectors import normalize
from parley.operators.summaries import SECTIONS

WORD_MS = 400
TURN_MS = 90_000
PIECE_MS = 9_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sentence of a conversation turn, with its place in time."""
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", F.posexplode(F.split("text", r"\. ")).alias("pos", "piece"))
    rows = rows.select("conv_id", "turn", "role", F.col("pos").cast("bigint").alias("pos"),
                       strip(F.col("piece")).alias("raw")).filter(F.col("raw") != "")
    gap = (F.col("conv_id") * 31 + F.col("turn") * 17 + F.col("pos") * 13) % 11 * 500
    start = F.col("turn") * TURN_MS + F.col("pos") * PIECE_MS + gap
    return (rows.withColumn("tokens", split_words(F.col("raw")))
            .withColumn("start_ms", start)
            .withColumn("end_ms", start + F.size("tokens") * WORD_MS))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript segments with speaker labels; questions, fillers and misheard
    phrases are added to the text, the times do not move."""
    k = (F.col("conv_id") * 7 + F.col("turn") * 3 + F.col("pos")) % 20
    a = (F.col("conv_id") * 5 + F.col("turn") * 11 + F.col("pos") * 3) % 40
    fillers = F.array(*[F.lit(p) for p in FILLER_PHRASES])
    wrong = F.array(*[F.lit(p) for p in ALIASES])
    text = F.concat(
        F.col("raw"),
        F.when((F.col("conv_id") + F.col("turn") + F.col("pos")) % 4 == 0, "?").otherwise(""),
        F.when(k < len(FILLER_PHRASES), F.concat(F.lit(" "), F.get(fillers, k.cast("int")))).otherwise(""),
        F.when(a < len(ALIASES), F.concat(F.lit(" "), F.initcap(F.get(wrong, a.cast("int"))))).otherwise(""))
    return pieces(spark, sf_dir).select(
        F.col("conv_id").cast("string").alias("meeting_id"),
        F.when(F.col("role") == "user", "mic").otherwise("system").alias("track"),
        (F.col("turn") * 1_000_000 + F.col("pos")).alias("seg_id"),
        F.when(F.col("role") == "user", "you").when(F.col("role") == "assistant", "s1")
        .otherwise("s2").alias("speaker"),
        "start_ms", "end_ms", text.alias("text"), "tokens")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognizer words of 400 ms each; a word carries its leading blank."""
    rows = segments(spark, sf_dir).select(
        "meeting_id", "track", "seg_id", "start_ms", F.posexplode("tokens").alias("word_id", "w"))
    return rows.select(
        "meeting_id", "track", "seg_id", F.col("word_id").cast("bigint").alias("word_id"),
        F.concat(F.lit(" "), F.col("w")).alias("w"),
        (F.col("start_ms") + F.col("word_id") * WORD_MS).alias("s_ms"),
        (F.col("start_ms") + (F.col("word_id") + 1) * WORD_MS).alias("e_ms"))


def speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speaker names per meeting; s2 has no name of its own, s9 never speaks."""
    meetings = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    entry = F.explode(F.array(
        F.struct(F.lit("you").alias("speaker"), F.lit("You").alias("name"), F.lit(0).alias("ord")),
        F.struct(F.lit("s1").alias("speaker"),
                 F.concat(F.lit("Guest "), F.col("conv_id").cast("string")).alias("name"),
                 F.lit(1).alias("ord")),
        F.struct(F.lit("s9").alias("speaker"), F.lit("Silent").alias("name"), F.lit(2).alias("ord"))))
    return meetings.select(F.col("conv_id").cast("string").alias("meeting_id"), entry.alias("e")).select(
        "meeting_id", "e.*")


def voice_labels(windows: DataFrame) -> DataFrame:
    """Windows with a cluster number that changes every few seconds."""
    five = (F.col("start_ms") - F.col("start_ms") % 5000) / 5000
    return windows.withColumn("label", (five.cast("bigint") + F.col("meeting_id").cast("bigint")) % 3)


def modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return ids.select(F.col("conv_id").cast("string").alias("meeting_id"),
                      F.when(F.col("conv_id") % 3 == 0, "inperson").otherwise("online").alias("mode"))


def echo_mic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Microphone segments: what the user says, and for every system segment of four
    words or more a late copy (k=0), the copy with own words after it (1), a word by
    word mix (2) or only own words (3). Own words are spelled backwards."""
    rows = pieces(spark, sf_dir)
    own = F.transform("tokens", lambda w: F.reverse(w))
    mixed = F.flatten(F.zip_with("tokens", own, lambda a, b: F.array(a, b)))
    k = (F.col("conv_id") + F.col("turn") + F.col("pos")) % 4
    user = F.col("role") == "user"
    said = (F.when(user | (k == 0), F.col("tokens")).when(k == 1, F.concat("tokens", own))
            .when(k == 2, mixed).otherwise(own))
    rows = rows.filter(user | (F.size("tokens") >= 4)).select(
        F.col("conv_id").cast("string").alias("meeting_id"), F.lit("mic").alias("track"),
        (F.col("turn") * 1_000_000 + F.col("pos") + F.when(user, 0).otherwise(500_000)).alias("seg_id"),
        (F.col("start_ms") + F.when(user, 0).otherwise(800)).alias("start_ms"), said.alias("said"))
    timed = F.transform("said", lambda w, i: F.struct(
        F.concat(F.lit(" "), w).alias("w"), (F.col("start_ms") + i * WORD_MS).alias("s_ms"),
        (F.col("start_ms") + (i + 1) * WORD_MS).alias("e_ms")))
    return rows.select("meeting_id", "track", "seg_id", "start_ms",
                       (F.col("start_ms") + F.size("said") * WORD_MS).alias("end_ms"),
                       F.array_join("said", " ").alias("text"), timed.alias("words"))


def tidy_ops(turns: DataFrame) -> DataFrame:
    """Edit operations proposed for a transcript, some of them not valid."""
    conv, t = F.col("meeting_id").cast("bigint"), F.col("turn_id")
    words = tokens(F.col("text"))
    k = (conv * 3 + t) % 7
    d = ((t - t % 5) / 5).cast("bigint") % 4
    none, no_turn = F.lit(None).cast("string"), F.lit(None).cast("bigint")

    def op(when, kind, label=none, target=none, turn=no_turn, keep=none):
        return F.when(when, F.struct(F.lit(kind).alias("op"), label.alias("label"), target.alias("target"),
                                     turn.alias("turn_id"), keep.alias("keep")))
    fifth, lit = t % 5 == 0, F.lit
    ops = F.array(
        op(k == 0, "drop", turn=t),
        op(k == 1, "trim", turn=t, keep=F.array_join(F.filter(words, lambda w, i: i % 2 == 0), " ")),
        op(k == 2, "trim", turn=t, keep=F.array_join(F.reverse(words), " ")),
        op(fifth & (d == 0) & (conv % 2 == 0), "merge", lit("s9"), lit("s1")),
        op(fifth & (d == 1) & (conv % 2 == 1), "merge", lit("s1"), lit("s9")),
        op(fifth & (d == 2), "merge", lit("you"), lit("s1")),
        op(fifth & (d == 3), "merge", lit("s2"), lit("s1")),
        op(t % 11 == 0, "rename", lit("s1"), F.concat(lit(" Name "), t.cast("string"))),
        op(t % 13 == 0, "rename", lit("you"), lit("  ")))
    rows = turns.select("meeting_id", t.alias("_turn"), F.posexplode(F.array_compact(ops)).alias("p", "e"))
    return rows.select("meeting_id", ((F.col("_turn") - F.col("_turn") % 30) / 30).cast("bigint").alias("window_no"),
                       (F.col("_turn") * 10 + F.col("p")).alias("pos"), "e.*")


def voice_merges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Label folds over the embedding rows: 50 labels per meeting, long chains and
    cycles; the first is `you` and one label class proposes nothing."""
    rows = table(spark, sf_dir, "embeddings")
    node = F.col("vec_id") % 50
    to = (node * 7 + F.col("label") * 11 + 3) % 50
    label = lambda n: F.when(n == 0, "you").otherwise(F.concat(F.lit("v"), n.cast("string")))
    meeting = ((F.col("vec_id") - node) / 50).cast("bigint").cast("string").alias("meeting_id")
    return (rows.filter("label <> 9").select(meeting, label(node).alias("label"), label(to).alias("target")),
            rows.select(meeting, label(node).alias("speaker")))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that are not blank, numbered as they stand."""
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"),
                       strip(F.col("line")).alias("line")).filter("line <> ''")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines as summary items, ten documents to a meeting."""
    n = F.col("line_no")
    section = F.get(F.array(*[F.lit(s) for s in SECTIONS]), (n % 5).cast("int"))
    action = section == "action_items"
    return document_lines(spark, sf_dir).select(
        ((F.col("doc_id") - F.col("doc_id") % 10) / 10).cast("bigint").cast("string").alias("meeting_id"),
        section.alias("section"), (F.col("doc_id") * 100_000 + n).alias("pos"),
        F.when(action, F.concat(F.lit("Owner "), (n % 3).cast("string"))).alias("owner"),
        F.col("line").alias("item"), F.when(action, "").alias("due"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies made of whole documents: JSON bare, fenced, inside prose, cut
    off, or with sections of the wrong type."""
    k = F.col("doc_id") % 6
    lines = F.split("text", "\n")
    task = F.transform(lines, lambda x, i: F.struct(
        F.when(i % 3 == 0, "").otherwise(" You ").alias("owner"), x.alias("task"),
        F.when(i % 2 == 0, "TBD").otherwise("Friday").alias("due")))
    body = F.to_json(F.struct(
        F.concat(F.lit("  {"), F.element_at(lines, 1), F.lit("}")).alias("headline"), F.col("text").alias("tldr"),
        lines.alias("key_points"), F.when(k != 3, lines).alias("decisions"),
        F.when(k != 4, task).alias("action_items"),
        F.when(k == 4, F.col("lang")).alias("follow_ups"),
        F.struct(F.col("source").alias("subject"), F.col("text").alias("body")).alias("follow_up_email")))
    reply = (F.when(k == 0, body).when(k == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nDone.")))
             .when(k == 2, F.concat(F.lit("Sure. "), body, F.lit(" {not json}")))
             .when(k == 5, body.substr(F.lit(1), F.length(body) - 1)).otherwise(body))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("meeting_id"), reply.alias("reply"))


def meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as meetings: the first line is the title, lines count as turns."""
    n = F.col("doc_id")
    created = F.expr("timestampadd(SECOND, doc_id * 397, TIMESTAMP_NTZ '2024-01-01 00:00:00')")
    none = F.lit(None).cast("string")
    speakers = F.array_compact(F.array(
        F.struct(F.lit("you").alias("speaker"), F.lit("You").alias("name")),
        F.struct(F.lit("s1").alias("speaker"), F.concat(F.lit("Guest "), F.col("source")).alias("name")),
        F.when(n % 3 == 0, F.struct(F.lit("s2").alias("speaker"), F.col("lang").alias("name")))))
    warnings = F.array_compact(F.array(
        F.when(n % 2 == 0, "Diarization failed on mic track"), F.when(n % 3 == 0, "Removed 2 segments"),
        F.when(n % 5 == 0, F.concat(F.lit("mic track stopped early: "), F.col("lang")))))
    status = F.when(n % 10 == 0, "recording").when(n % 10 == 1, "processing").when(
        n % 10 == 2, "error").otherwise("done")
    return table(spark, sf_dir, "documents").select(
        F.date_format(created, "yyyyMMdd-HHmmss").alias("meeting_id"),
        F.concat(F.lit("u"), (n % 50).cast("string")).alias("user_id"),
        F.element_at(F.split("text", "\n"), 1).alias("title"), created.alias("created"),
        F.when(n % 3 == 0, "inperson").otherwise("online").alias("mode"), status.alias("status"),
        (F.col("n_chars") * 60).cast("bigint").alias("duration_ms"), speakers.alias("speakers"),
        warnings.alias("warnings"), (n % 4 < 3).alias("sync_enabled"),
        F.when(n % 7 == 0, none).when(n % 7 == 1, "auto").when(n % 7 == 2, F.concat("lang", F.lit("-gb")))
        .when(n % 7 == 3, "english_us!").otherwise(F.col("lang")).alias("language"),
        F.size(F.filter(F.split("text", "\n"), lambda x: strip(x) != "")).cast("bigint").alias("n_turns"),
        F.lit(1).cast("bigint").alias("version"), n.alias("doc_id"), "text")


def meeting_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edit per label row: a new title, sometimes blank, and a version."""
    ids = meetings(spark, sf_dir).select("doc_id", "meeting_id", "user_id", "text")
    title = F.when(F.col("quality") == 1, F.concat(F.lit("  "), F.col("text"))).otherwise("   ")
    return table(spark, sf_dir, "labels").join(ids, "doc_id").select(
        "doc_id", "meeting_id", "user_id", title.alias("title"),
        (F.col("toxic") * 3 + F.col("doc_id") % 3).cast("bigint").alias("version"))


def synced_meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meetings with their transcript nested: every line of the document is a turn."""
    lines = F.filter(F.split("text", "\n"), lambda x: strip(x) != "")
    turns = F.transform(lines, lambda x, i: F.struct(
        F.when(i % 2 == 0, "you").otherwise("s1").alias("speaker"),
        F.when(i % 2 == 0, "mic").otherwise("system").alias("track"), (i * 5).alias("start"),
        (i * 5 + 4).alias("end"), strip(x).alias("text")))
    return meetings(spark, sf_dir).withColumn("turns", turns).withColumn(
        "duration", F.col("duration_ms") / 1000).withColumn(
        "created", F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss")).withColumn(
        "summary", F.lit(None).cast("string")).withColumn("stats", F.lit(None).cast("string"))


def attendees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as calendar events with attendees; in every third the user is marked."""
    marked = F.col("o_orderkey") % 3 == 0
    person = lambda name, me=F.lit(False): F.struct(name.alias("name"), me.alias("is_self"))
    clerk = F.concat(F.lit("Clerk "), (F.col("o_custkey") % 97).cast("string"))
    people = F.array_compact(F.array(
        person(F.concat(F.lit(" "), clerk)), person(F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")), marked),
        person(F.lit("  ")), person(F.concat(F.col("o_custkey").cast("string"), F.lit("@example.com"))),
        F.when(F.col("o_orderkey") % 2 == 0, person(clerk)), person(F.col("o_orderstatus"))))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.when(F.col("o_orderkey") % 5 == 0, F.slice(people, 1, 0)).otherwise(people).alias("attendees"))


def terms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Meetings, user terms (words of the user's turns) and names (other words that
    begin a sentence)."""
    rows = pieces(spark, sf_dir).select(
        F.col("conv_id").cast("string").alias("meeting_id"), "role",
        (F.col("turn") * 1_000_000 + F.col("pos") * 1000).alias("base"), F.posexplode("tokens").alias("i", "term"))
    placed = rows.select("meeting_id", "role", "i", (F.col("base") + F.col("i")).alias("pos"), "term")
    user = placed.filter("role = 'user'")
    names = placed.filter("role <> 'user' AND i = 0")
    return modes(spark, sf_dir).select("meeting_id"), user, names


def timed(rows: DataFrame) -> DataFrame:
    """Events with milliseconds since 1970 and a zoned time, whatever the session's
    time zone; works on batch and streaming frames."""
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    return rows.withColumn("ts_ms", ms).withColumn("ts", F.timestamp_millis(F.col("ts_ms")))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timed(table(spark, sf_dir, "events"))


def mic_samples(rows: DataFrame) -> DataFrame:
    """Microphone samples per user: recording, free, or busy with some app."""
    kind = F.col("event_type")
    apps = F.array(*[F.lit(a) for a in list(MEETING_APPS) + ["firefox", "Music"]])
    return rows.select(
        F.col("user_id").cast("string").alias("user_id"), "event_id", "ts", "ts_ms",
        kind.isin("click", "view", "purchase").alias("busy"), (kind == "signup").alias("recording"),
        F.get(apps, (F.col("event_id") % 8).cast("int")).alias("app"))


def captions(rows: DataFrame) -> DataFrame:
    """Caption events: the user is the meeting."""
    t = F.when(F.col("event_id") % 3 == 0, "final").when(F.col("event_id") % 3 == 1, "partial").otherwise("done")
    track = F.when(F.col("event_id") % 2 == 0, "mic").otherwise("system")
    return rows.select(
        F.col("user_id").cast("string").alias("meeting_id"), track.alias("track"), t.alias("t"),
        F.col("value").alias("start"), (F.col("value") + 1).alias("end"), F.col("props").alias("text"),
        F.col("ts").alias("arrival"), F.col("ts_ms").alias("arrival_ms"), "event_id")


def jobs(rows: DataFrame) -> DataFrame:
    state = (F.when(F.col("event_type") == "view", "processing").when(F.col("event_type") == "purchase", "done")
             .when(F.col("event_type") == "error", "error"))
    return rows.select(
        F.col("user_id").cast("string").alias("meeting_id"),
        F.when(F.col("event_id") % 2 == 0, "transcript").otherwise("summary").alias("kind"),
        state.alias("state"), "ts", "ts_ms", "event_id").filter(state.isNotNull())


def _seconds(rows: DataFrame):
    return F.floor(F.col("ts_ms") / 1000).cast("bigint")


def calendar(rows: DataFrame) -> DataFrame:
    """Sign-ups as calendar entries of fifteen teams."""
    start = _seconds(rows)
    return rows.filter("event_type = 'signup'").select(
        (F.col("user_id") % 15).cast("string").alias("team"), F.col("event_id").alias("event_pos"),
        F.concat(F.lit("Event "), F.col("props")).alias("title"), start.alias("start_s"),
        (start + (1 + F.col("event_id") % 8) * 3600).alias("end_s"), (F.col("event_id") % 6 == 0).alias("all_day"),
        (F.col("event_id") % 11).alias("attendees"))


def moments(rows: DataFrame) -> DataFrame:
    """Clicks as the moments somebody starts a recording."""
    n = F.col("event_id")
    given = F.when(n % 4 == 0, (n % 13).cast("string")).when(n % 4 == 1, "many").when(n % 4 == 2, "")
    return rows.filter("event_type = 'click'").select(
        (F.col("user_id") % 15).cast("string").alias("team"), n.alias("probe_id"), _seconds(rows).alias("now_s"),
        given.alias("given"), (n % 3 == 0).alias("in_person"),
        F.when(n % 5 == 0, F.concat(F.lit(" "), "props")).otherwise(" ").alias("title"))


# frames count seconds since this day
ORIGIN_S = 1_704_067_200
FRAMES = 8


def audio_chunks(rows: DataFrame) -> DataFrame:
    """Every event as a chunk of eight frames at one frame a second, two channels for
    one track and one for the other; small values are silence."""
    loud = F.floor(F.col("value") * 20).cast("bigint")
    channels = (F.col("event_id") % 2 + 1).cast("int")
    sample = lambda j: (loud * (j + 1) % 32768 * (1 - 2 * (j % 2))).cast("smallint")
    return rows.select(
        F.col("user_id").cast("string").alias("meeting_id"),
        F.when(F.col("event_id") % 2 == 0, "mic").otherwise("system").alias("track"),
        F.col("event_id").alias("chunk_id"), F.lit(1).alias("rate"), channels.alias("channels"),
        (_seconds(rows) - ORIGIN_S).alias("start_frame"),
        F.transform(F.sequence(F.lit(0), channels * FRAMES - 1), sample).alias("samples"))


def audio_tracks(rows: DataFrame) -> DataFrame:
    """Both tracks of each user on a timeline of 40 days; the system starts late."""
    chunks = audio_chunks(rows).select("meeting_id", "track").distinct()
    return chunks.select("meeting_id", "track",
                         F.when(F.col("track") == "mic", 0).otherwise(3600).cast("bigint").alias("offset_frames"),
                         F.lit(40 * 86_400).cast("bigint").alias("total_frames"))


def audio_segments(rows: DataFrame) -> DataFrame:
    """Views and clicks as recognized segments over the chunks' time."""
    start = _seconds(rows) - ORIGIN_S - F.col("event_id") % 5
    return rows.filter("event_type IN ('view', 'click')").select(
        F.col("user_id").cast("string").alias("meeting_id"),
        F.when(F.col("event_id") % 2 == 0, "mic").otherwise("system").alias("track"), F.col("event_id").alias("seg_id"),
        start.alias("start_frame"), (start + F.col("event_id") % 9).alias("end_frame"),
        (F.col("event_id") % 100 / 100).alias("no_speech_prob"))


def stopped_tracks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a recorder reports per track on stop, and the tracks known before."""
    keys = [F.col("user_id").cast("string").alias("meeting_id"),
            F.when(F.col("event_id") % 2 == 0, "mic").otherwise("system").alias("track")]
    stopped = rows.groupBy(*keys).agg(
        F.min("ts_ms").alias("started_ms"), F.max((F.col("value") * 40).cast("bigint")).alias("recorded_ms"),
        F.min("event_type").alias("language"),
        F.max(F.when(F.col("event_type") == "error", F.col("props"))).alias("device"))
    old = rows.groupBy(*keys).agg(F.min("props").alias("old_device"))
    return stopped, old


def voice_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding rows as windows of four voices per meeting: the first four rows of
    the table are the voices, each window is its voice with some of its own vector."""
    rows = table(spark, sf_dir, "embeddings").filter("embedding IS NOT NULL")
    meeting = (F.col("vec_id") - F.col("vec_id") % 50) / 50
    turn = (F.col("vec_id") - F.col("vec_id") % 5) / 5
    base = rows.filter("vec_id < 4").select(F.col("vec_id").alias("voice"), F.col("embedding").alias("_base"))
    mixed = rows.withColumn("voice", ((turn + meeting) % 4).cast("bigint")).join(F.broadcast(base), "voice")
    vector = F.zip_with("_base", "embedding", lambda a, b: a + b * F.lit(0.2).cast("float"))
    start = F.col("vec_id") % 50 * 1000
    return mixed.select(
        meeting.cast("bigint").cast("string").alias("meeting_id"), F.lit("system").alias("track"),
        (F.col("vec_id") % 50).alias("win_id"), start.alias("start_ms"), (start + 2000).alias("end_ms"),
        F.transform(normalize(vector), lambda x: x.cast("float")).alias("embedding"))


def labelled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding rows with the table's own label as cluster, fifty to a meeting."""
    meeting = ((F.col("vec_id") - F.col("vec_id") % 50) / 50).cast("bigint").cast("string")
    start = F.col("vec_id") % 50 * 1000
    return table(spark, sf_dir, "embeddings").select(
        meeting.alias("meeting_id"), F.lit("system").alias("track"), F.col("vec_id").alias("win_id"),
        start.alias("start_ms"), (start + 2000).alias("end_ms"), F.col("label").cast("bigint").alias("label"),
        "embedding")


def _speech(spark: SparkSession, sf_dir: str, marked: DataFrame) -> DataFrame:
    """Embeddings for speech windows whose `label` says the voice, with some of a vector
    drawn from the whole table."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    size = vectors.agg(F.count(F.lit(1)).alias("_n"))  # one row
    marked = marked.join(F.broadcast(size)).withColumn(
        "vec_id", F.pmod(F.xxhash64("meeting_id", "win_id"), F.col("_n"))).drop("_n")
    base = vectors.filter("vec_id < 3").select(F.col("vec_id").alias("label"), F.col("embedding").alias("_base"))
    mixed = marked.join(vectors, "vec_id", "left").join(F.broadcast(base), "label")
    vector = F.zip_with("_base", F.coalesce("embedding", "_base"), lambda a, b: a + b * F.lit(0.2).cast("float"))
    return mixed.select("meeting_id", "track", "win_id", "start_ms", "end_ms",
                        F.transform(normalize(vector), lambda x: x.cast("float")).alias("embedding"))


def speech_voices(spark: SparkSession, sf_dir: str, windows: DataFrame) -> DataFrame:
    """One of three voices that change every few seconds."""
    return _speech(spark, sf_dir, voice_labels(windows))


def _two_voices(turn):
    """Every second turn of a side is another voice."""
    return ((turn - turn % 2) / 2).cast("bigint") % 2


def turn_voices(spark: SparkSession, sf_dir: str, windows: DataFrame) -> DataFrame:
    """Two voices that change from turn to turn; one on the system track in person."""
    turn = ((F.col("seg_id") - F.col("seg_id") % 1_000_000) / 1_000_000).cast("bigint")
    inperson = (F.col("meeting_id").cast("bigint") % 3 == 0) & (F.col("track") == "system")
    return _speech(spark, sf_dir, windows.withColumn("label", F.when(inperson, 0).otherwise(_two_voices(turn))))


LATE_MS = 700


def recordings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(recognizer output, meetings, stopped tracks, known tracks) of the conversations. The system
    track starts late. What the microphone hears is no word of the other side. One microphone in
    seven recorded too little to be used."""
    n = F.col("meeting_id").cast("bigint")
    mic = F.col("track") == "mic"
    said = segments(spark, sf_dir).withColumn("turn", ((F.col("seg_id") - F.col("seg_id") % 1_000_000) / 1_000_000).cast("bigint"))
    own = F.transform("tokens", lambda w: F.when(mic, F.concat(F.lit("zq"), w)).otherwise(w))
    seconds = lambda ms: (ms - F.when(mic, 0).otherwise(LATE_MS)) / 1000
    words = F.transform("own", lambda w, i: F.struct(
        F.concat(F.lit(" "), w).alias("w"), seconds(F.col("start_ms") + i * WORD_MS).alias("s"),
        seconds(F.col("start_ms") + (i + 1) * WORD_MS).alias("e")))
    piece = F.struct("seg_id", seconds(F.col("start_ms")).alias("start"), seconds(F.col("end_ms")).alias("end"),
                     F.when(mic, F.array_join("own", " ")).otherwise(F.col("text")).alias("text"), words.alias("words"))
    # a row holds what was one row of the conversations
    parts = said.withColumn("own", own).groupBy("meeting_id", "track", F.col("turn").alias("part")).agg(
        F.transform(F.array_sort(F.collect_list(piece)), lambda p: p.dropFields("seg_id")).alias("segments"))
    output = parts.select("meeting_id", "track", "part", F.to_json(F.struct(F.lit("en").alias("language"), "segments")).alias("output"))
    mode = modes(spark, sf_dir)
    asked = said.join(mode, "meeting_id").filter("(mode = 'online') = (track = 'system')").groupBy("meeting_id").agg(
        F.count_distinct(_two_voices(F.col("turn"))).alias("expected_speakers"))
    meetings = mode.join(asked, "meeting_id", "left").select(
        "meeting_id", "mode", "expected_speakers", F.concat(F.lit("Talk "), "meeting_id").alias("title"),
        F.lit("processing").alias("status"), F.array_compact(F.array(
            F.when(n % 2 == 0, "Diarization failed on mic track"), F.when(n % 4 == 1, "mic track stopped early"))).alias("warnings"))
    tracks = said.select("meeting_id", "track").distinct()
    stopped = tracks.select(
        "meeting_id", "track", F.when(mic, 10_000).otherwise(10_000 + LATE_MS).cast("bigint").alias("started_ms"),
        F.when(mic & (n % 7 == 3), 250).otherwise(600_000 + n % 100 * 10).cast("bigint").alias("recorded_ms"),
        F.lit("en").alias("language"), F.when(mic, "built-in").alias("device"))
    known = tracks.filter(n % 2 == 0).withColumn("old_device", F.lit("headset"))
    return output, meetings, stopped, known
