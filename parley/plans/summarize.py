"""Map-reduce over transcript chunks with a model given by the caller."""

from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from parley.functions import constants as c
from parley.functions.text import excerpt
from parley.operators.windows import budget_groups, chunk_lines, join_groups
from parley.session import cut_lineage, spread

MAX_SPLITS = 2
SLACK_CHARS = 200
#: Calls a task has out at once, and how often a call is made again that got no answer.
IN_FLIGHT = 3
RETRIES = 2


class Overflow(Exception):
    """The portion is too long for the model."""


class Refused(Exception):
    """The model declined the portion."""


class Busy(Exception):
    """No answer this time; asked again at once, and if need be by the task's next attempt."""


def no_model(text: str, title: str) -> str:
    """Stands in for a model: every portion is kept as an excerpt."""
    raise Refused


def _answer(note: Callable, retries: int, call: tuple) -> tuple:
    """(answer, None), or (None, why there is none)."""
    for left in range(retries, -1, -1):
        try:
            return note(*call), None
        except Overflow:
            return None, "long"
        except Refused:
            return None, "refused"
        except Busy:
            if not left:
                raise


def answers(note: Callable, calls: Iterable[tuple], in_flight: int = IN_FLIGHT, retries: int = RETRIES) -> Iterator[tuple]:
    """Answers to the calls in their order, at most `in_flight` of them out at once."""
    with ThreadPoolExecutor(in_flight) as pool:
        yield from pool.map(partial(_answer, note, retries), calls)


def _asked(rows: DataFrame, text: str, note) -> DataFrame:
    """Adds `note`, the model's answer, and `why` where there is none: long or refused. The rows
    are spread over tasks, for a call takes longer than to move its text."""
    def ask(batches):
        for pdf in batches:
            found = list(answers(note, zip(pdf[text], pdf["title"])))
            yield pdf.assign(note=[a for a, _ in found], why=[why for _, why in found])
    kind = StructType(list(rows.schema.fields)).add("note", StringType()).add("why", StringType())
    return cut_lineage(spread(rows, "meeting_id", text).mapInPandas(ask, kind))


def map_chunks(chunks: DataFrame, note=no_model) -> DataFrame:
    """Notes (meeting_id, chunk, block, excerpts) per chunk. `note(text, title)` may raise
    Overflow or Refused. Chunks go to the model in rounds: one that is too long comes
    back as two rows, the halves of its lines, at most MAX_SPLITS times, so halves are
    worked on by different tasks. What the model never took is kept as an excerpt, and
    `excerpts` counts these."""
    todo = chunks.select("meeting_id", "title", "chunk", F.lit("").alias("part"), F.col("line").alias("body"))
    found = []
    for left in range(MAX_SPLITS, -1, -1):
        asked = _asked(todo, "body", note)
        lines = F.split("body", "\n")
        half = F.floor(F.size(lines) / 2).cast("int")
        again = (F.col("why") == "long") & (half > 0) if left else F.lit(False)
        found.append(asked.filter(F.col("why").isNull() | ~again).select(
            "meeting_id", "chunk", "part", F.coalesce("note", excerpt(F.col("body"))).alias("block"),
            F.col("why").isNotNull().cast("bigint").alias("excerpts")))
        halves = F.array(F.struct(F.lit("0").alias("p"), F.slice(lines, 1, half).alias("t")),
                         F.struct(F.lit("1").alias("p"), F.slice(lines, half + 1, F.size(lines)).alias("t")))
        todo = asked.filter(again).withColumn("h", F.explode(halves)).select(
            "meeting_id", "title", "chunk", F.concat("part", "h.p").alias("part"),
            F.array_join("h.t", "\n").alias("body")).filter(F.trim("body") != "")
    parts = F.array_sort(F.collect_list(F.struct("part", "block")))
    return reduce(DataFrame.unionByName, found).groupBy("meeting_id", "chunk").agg(
        F.array_join(F.transform(parts, lambda p: p["block"]), "\n").alias("block"),
        F.sum("excerpts").alias("excerpts")).filter(F.trim("block") != "")


def condense(blocks: DataFrame, titles: DataFrame, note=no_model, limit: int = c.CHUNK_CHARS) -> DataFrame:
    """Notes of each meeting in one text (meeting_id, notes, cut). Meetings whose notes do
    not fit are grouped and condensed again, each round on those only; where no two notes
    fit together, or the model does not take a group, they are cut to the limit, and
    `cut` counts the characters that went."""
    done, lost, state = [], [], blocks.select("meeting_id", "chunk", "block")
    while True:
        state = cut_lineage(state)
        size = state.groupBy("meeting_id").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.length("block")).alias("chars"))
        fits = size.filter((F.col("n") <= 1) | (F.col("chars") + SLACK_CHARS <= limit)).select("meeting_id")
        done.append(_joined(state.join(fits, "meeting_id", "left_semi")))
        grouped = budget_groups(
            state.join(fits, "meeting_id", "left_anti").withColumnRenamed("chunk", "at"), "at", "block", limit, extra=2)
        shape = grouped.groupBy("meeting_id").agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct("chunk").alias("groups"))
        stuck = shape.filter("n = groups").select("meeting_id")
        whole = _joined(grouped.join(stuck, "meeting_id", "left_semi").drop("chunk").withColumnRenamed("at", "chunk"))
        done.append(whole.withColumn("notes", F.substring("notes", 1, limit)))
        lost.append(whole.select("meeting_id", F.greatest(F.length("notes") - limit, F.lit(0)).alias("cut")))
        rest = join_groups(grouped.join(stuck, "meeting_id", "left_anti"), "at", "block", "\n\n")
        rest = cut_lineage(rest.join(titles.select("meeting_id", "title"), "meeting_id"))
        if rest.isEmpty():
            break
        alone = rest.filter("lines = 1").select("meeting_id", "chunk", "block")
        asked = _asked(rest.filter("lines > 1"), "block", note)
        flat = F.replace("block", F.lit("\n\n"), F.lit("\n"))
        state = alone.unionByName(asked.select(
            "meeting_id", "chunk", F.coalesce("note", F.substring(flat, 1, limit // 2)).alias("block")))
        lost.append(asked.filter("why IS NOT NULL").select(
            "meeting_id", F.greatest(F.length(flat) - limit // 2, F.lit(0)).alias("cut")))
    cut = reduce(DataFrame.unionByName, lost).groupBy("meeting_id").agg(F.sum("cut").cast("bigint").alias("cut"))
    return reduce(DataFrame.unionByName, done).join(cut, "meeting_id", "left").fillna(0, ["cut"])


def _joined(blocks: DataFrame) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("chunk", "block")))
    return blocks.groupBy("meeting_id").agg(
        F.array_join(F.transform(parts, lambda p: p["block"]), "\n").alias("notes"))


def sources(lines: DataFrame, titles: DataFrame, note=no_model, limit: int = c.CHUNK_CHARS) -> DataFrame:
    """The text a final model call gets per meeting: the transcript where it is one
    chunk, the condensed notes of all chunks else; `cut` counts characters of notes that
    did not fit. `titles` has meeting_id, title and participants."""
    chunks = cut_lineage(chunk_lines(lines, limit).join(titles, "meeting_id"))
    many = chunks.groupBy("meeting_id").agg(F.count(F.lit(1)).alias("n"))
    whole = chunks.join(many.filter("n = 1").select("meeting_id"), "meeting_id", "left_semi").select(
        "meeting_id", F.lit(1).cast("bigint").alias("chunks"), F.col("line").alias("notes"), F.lit(0).cast("bigint").alias("cut"))
    parts = chunks.join(many.filter("n > 1"), "meeting_id")
    blocks = map_chunks(parts, note)
    mapped = condense(blocks, titles.select("meeting_id", "title"), note, limit).join(
        many.select("meeting_id", F.col("n").alias("chunks")), "meeting_id")
    rows = whole.unionByName(mapped.select(*whole.columns)).join(titles, "meeting_id")
    head = F.when(F.col("chunks") == 1, F.concat(F.lit('Transcript of the meeting "'), "title", F.lit('". '))).otherwise(
        F.concat(F.lit('Notes covering the whole meeting "'), "title", F.lit('", in order. ')))
    people = F.when(F.col("participants") != "", F.concat(
        F.lit("Participants: "), "participants", F.lit("."))).otherwise("")
    return rows.select("meeting_id", "chunks", F.concat(head, people, F.lit("\n\n"), "notes").alias("source"), "cut")


def summarize_meetings(lines: DataFrame, titles: DataFrame, model, note=no_model, limit: int = c.CHUNK_CHARS) -> DataFrame:
    """The summary of each meeting with lines, as its fields (see `coerce_summary`) without repeated thoughts, the
    number of `chunks`, the characters of notes `cut`, and `state`: done, long or refused (the last call was not
    taken), unread (the reply holds no whole object). Only done ones have contents.

    `model(source, title)` returns the reply to the last call, `note(text, title)` the notes of a portion. Both may
    raise Overflow, Refused or Busy, and are called from several threads of a task.
    """
    # Not at the top: a model that names this module takes it along to the workers, and a used UDF cannot travel.
    from parley.operators import summaries

    given = sources(lines, titles, note, limit).join(titles.select("meeting_id", "title"), "meeting_id")
    asked = _asked(given, "source", model)
    read = summaries.extract_json(asked.select("meeting_id", "chunks", "cut", "why", F.col("note").alias("reply")))
    state = F.coalesce("why", F.when(F.col("json").isNull(), "unread").otherwise("done"))
    full = cut_lineage(summaries.coerce_summary(read.withColumn("state", state).drop("reply", "why")))
    return summaries.with_items(full, summaries.dedup_items(summaries.summary_items(full)))
