"""Meeting list, search, edits of meeting rows, exports."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.text import clock, date_label, strip
from parley.operators.summaries import markdown_lines

MAX_PAGE = 500
PAGE = 25
TITLE_CHARS = 120
NAME_CHARS = 60
INTERRUPTED = "Interrupted — press Reprocess to transcribe the saved audio."
# Warnings rebuilt on every run.
REBUILT = ("Diarization", "Removed ")


def list_items(meetings: DataFrame) -> DataFrame:
    """The fields a list shows, and how many speakers there are."""
    return meetings.select(
        "meeting_id", "title", "created", "duration_ms", "status", "mode", "sync_enabled",
        F.coalesce(F.size("speakers"), F.lit(0)).cast("bigint").alias("speakers"))


def search(meetings: DataFrame, query: str = "") -> DataFrame:
    """Literal, case-blind search in the title and the speakers' names."""
    wanted = (query or "").strip().lower()
    names = F.transform("speakers", lambda s: s["name"])
    hay = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.array_join(names, " ")))
    return meetings.filter(F.contains(hay, F.lit(wanted))) if wanted else meetings


def page(meetings: DataFrame, limit: int = 40, offset: int = 0) -> DataFrame:
    """Newest ids first; the total comes from counting the same frame."""
    return meetings.orderBy(F.desc("meeting_id")).offset(max(0, offset)).limit(max(1, min(MAX_PAGE, limit)))


def page_lookahead(meetings: DataFrame, keys: list[str], size: int = PAGE) -> DataFrame:
    """First page per owner with a flag for more. One row beyond the page is read;
    the rank limit is applied before the shuffle."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("created"), F.desc("meeting_id"))
    rows = meetings.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= size + 1)
    more = F.max("rank").over(Window.partitionBy(*keys)) > size
    return rows.withColumn("has_more", more).filter(F.col("rank") <= size)


def by_id(meetings: DataFrame, meeting_id: str) -> DataFrame:
    return meetings.filter(F.col("meeting_id") == meeting_id).limit(1)


def eligible(meetings: DataFrame) -> DataFrame:
    """Finished meetings with a transcript."""
    return meetings.filter((F.col("status") == "done") & (F.col("n_turns") > 0))


def recover_interrupted(meetings: DataFrame) -> DataFrame:
    stuck = F.col("status").isin("recording", "processing")
    return meetings.withColumn("error", F.when(stuck, INTERRUPTED)).withColumn(
        "status", F.when(stuck, "error").otherwise(F.col("status")))


def refresh_warnings(meetings: DataFrame, new: Column | None = None,
                     rebuilt: tuple[str, ...] = REBUILT) -> DataFrame:
    """Warnings of the recorder stay, those of earlier runs are replaced."""
    def kept(w):
        keep = F.lit(True)
        for prefix in rebuilt:
            keep = keep & ~w.startswith(prefix)
        return keep
    left = F.filter(F.coalesce("warnings", F.array().cast("array<string>")), kept)
    return meetings.withColumn("warnings", left if new is None else F.concat(left, new))


def rename_titles(meetings: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (meeting_id, title, version): the newest valid one wins."""
    text = F.substring(strip(F.col("title")), 1, TITLE_CHARS)
    last = edits.withColumn("title", text).filter("title <> ''").groupBy("meeting_id").agg(
        F.max_by("title", "version").alias("_title"))
    return meetings.join(last, "meeting_id", "left").withColumn(
        "title", F.coalesce("_title", "title")).drop("_title")


def rename_speakers(speakers: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (meeting_id, speaker, name, version) of speakers that exist."""
    text = F.substring(strip(F.col("name")), 1, NAME_CHARS)
    last = edits.withColumn("name", text).filter("name <> '' AND speaker <> ''").groupBy(
        "meeting_id", "speaker").agg(F.max_by("name", "version").alias("_name"))
    return speakers.join(last, ["meeting_id", "speaker"], "left").withColumn(
        "name", F.coalesce("_name", "name")).drop("_name")


def backfill_missing(meetings: DataFrame, exports: DataFrame) -> DataFrame:
    """Finished meetings without a written transcript."""
    return eligible(meetings).join(exports.select("meeting_id"), "meeting_id", "left_anti")


def delete_meetings(meetings: DataFrame, deletions: DataFrame, busy: DataFrame) -> DataFrame:
    """Without the deleted meetings. A meeting that is recording, being processed or
    being summarized (`busy`) is not deleted."""
    allowed = deletions.select("meeting_id").join(busy.select("meeting_id"), "meeting_id", "left_anti")
    gone = meetings.filter(~F.col("status").isin("recording", "processing")).select("meeting_id").join(
        allowed, "meeting_id", "left_semi")
    return meetings.join(gone, "meeting_id", "left_anti")


def undo_tidy(versions: DataFrame) -> DataFrame:
    """The state before the clean-up: of the versions older than the first tidied one,
    the newest. Meetings without a clean-up keep their newest version."""
    first = versions.groupBy("meeting_id").agg(F.min(F.when(F.col("tidied"), F.col("version"))).alias("_tidy"))
    rows = versions.join(first, "meeting_id").filter(F.col("_tidy").isNull() | (F.col("version") < F.col("_tidy")))
    return newest(rows.drop("_tidy"), ["meeting_id"], "version")


def newest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row per key, the newest version; combined before the shuffle, so a key
    with very many versions is no hot spot."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), version).alias("_row")).select("_row.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str, batch_time: Column) -> DataFrame:
    """Newest version per key; updated_at is set where an old row is replaced."""
    names = [n for n in old.columns if n != "updated_at"]
    rows = old.select(*names, F.lit(False).alias("_new"), "updated_at").unionByName(
        new.select(*names, F.lit(True).alias("_new"), F.lit(None).cast("timestamp_ntz").alias("updated_at")))
    full = F.struct(*names, "_new", "updated_at")
    merged = rows.groupBy(*keys).agg(
        F.max_by(full, F.struct(version, "_new")).alias("_row"),
        F.max(F.when(~F.col("_new"), F.col("updated_at"))).alias("_was"),
        F.bool_or(~F.col("_new")).alias("_old"))
    touched = F.when(F.col("_row._new"), batch_time).otherwise(F.col("_was"))
    return merged.select(*[F.col(f"_row.{n}").alias(n) for n in names], touched.alias("updated_at"),
                         (F.col("_row._new") & F.col("_old")).alias("replaced"))


def text_lines(meetings: DataFrame, named: DataFrame) -> DataFrame:
    """Plain-text export as rows (meeting_id, line_no, line): no meeting is gathered.
    `named` has meeting_id, turn_id, name, start_ms, text."""
    head = meetings.select("meeting_id", F.posexplode(F.array(
        F.col("title"), F.repeat(F.lit("="), F.length("title")), F.lit(""))).alias("line_no", "line"))
    body = named.select("meeting_id", (F.col("turn_id") + 3).alias("line_no"), F.concat(
        F.lit("["), clock(F.col("start_ms")), F.lit("] "), F.col("name"), F.lit(": "), F.col("text")).alias("line"))
    return head.withColumn("line_no", F.col("line_no").cast("bigint")).unionByName(body)


def markdown_rows(meetings: DataFrame, summaries: DataFrame, stats: DataFrame, named: DataFrame) -> DataFrame:
    """Markdown export as rows (meeting_id, part, pos, line), to be ordered by part
    and pos. Parts: 0 heading, 1 summary, 2 statistics, 3 transcript."""
    bar = "  |  "
    facts = F.concat(
        F.lit("*Recorded:* "), F.coalesce(F.col("created").cast("string"), F.lit("")), F.lit(f"{bar}*Duration:* "),
        clock(F.coalesce("duration_ms", F.lit(0))), F.lit(f"{bar}*Mode:* "), F.col("mode"))
    head = meetings.select("meeting_id", F.posexplode(F.array(
        F.concat(F.lit("# "), F.col("title")), F.lit(""), facts)).alias("pos", "line"))
    lines = markdown_lines({n: F.col(n) for n in summaries.columns})
    # the blank line before, and none at the end
    section = summaries.select("meeting_id", F.posexplode(F.concat(
        F.array(F.lit("")), F.slice(lines, 1, F.size(lines) - 1))).alias("pos", "line"))
    row = F.concat(
        F.lit("| "), F.col("name"), F.lit(" | "), clock((F.col("seconds") * 1000).cast("bigint")), F.lit(" | "),
        F.bround(F.col("share").cast("decimal(6,3)") * 100, 0).cast("int").cast("string"), F.lit("% | "),
        F.concat_ws(" | ", F.col("words").cast("string"), F.col("wpm").cast("string"),
                    F.col("questions").cast("string"), F.coalesce("top", F.lit("—"))), F.lit(" |"))
    table = stats.select("meeting_id", (F.col("ord") + 4).alias("pos"), row.alias("line"))
    title = stats.select("meeting_id").distinct().select("meeting_id", F.posexplode(F.array(
        F.lit(""), F.lit("## Speaking stats"), F.lit(""),
        F.lit("| Speaker | Talk time | Share | Words | WPM | Questions | Fillers |"),
        F.lit("|---|---|---|---|---|---|---|"))).alias("pos", "line")).withColumn("pos", F.col("pos") - 1)
    start = meetings.select("meeting_id", F.posexplode(F.array(
        F.lit(""), F.lit("## Transcript"), F.lit(""))).alias("pos", "line")).withColumn("pos", F.col("pos") - 3)
    said = F.concat(F.lit("**"), F.col("name"), F.lit("** `["), clock(F.col("start_ms")), F.lit("]`  "), F.col("text"))
    body = named.select("meeting_id", "turn_id", F.posexplode(F.array(said, F.lit(""))).alias("i", "line")).select(
        "meeting_id", (F.col("turn_id") * 2 + F.col("i")).alias("pos"), "line")
    parts = [(0, head), (1, section), (2, title), (2, table), (3, start), (3, body)]
    rows = [df.select("meeting_id", F.lit(n).cast("bigint").alias("part"), F.col("pos").cast("bigint").alias("pos"),
                      "line") for n, df in parts]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def page_rows(meetings: DataFrame, this_year: int) -> DataFrame:
    return meetings.select("meeting_id", "title", date_label(F.col("created"), F.lit(this_year)).alias("date"))


