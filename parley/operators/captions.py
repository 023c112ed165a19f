"""Caption events in batch: the same rules as the live session."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.constants import CAPTION_RING
from parley.operators.scans import DAY_MS, numbered, time_block

ORDER = ["arrival_ms", "event_id"]


def who(track: Column) -> Column:
    return F.when(track == "mic", "You").when(track == "system", "Them").otherwise(track)


def finals(events: DataFrame, block_ms: int = DAY_MS) -> DataFrame:
    """Final lines with numbers from 1 per meeting, across both tracks."""
    rows = numbered(events.filter("t = 'final'"), ["meeting_id"], ORDER,
                    time_block("arrival_ms", block_ms), "_n")
    return rows.select("meeting_id", (F.col("_n") + 1).alias("seq"), "track", who(F.col("track")).alias("who"),
                       F.col("start"), F.col("end"), F.coalesce("text", F.lit("")).alias("text"))


def partials(events: DataFrame) -> DataFrame:
    """The partial of each track that no later final or end has cleared."""
    last = events.groupBy("meeting_id", "track").agg(
        F.max_by(F.struct("t", "start", "end", "text"), F.struct(*ORDER)).alias("e"))
    return last.filter("e.t = 'partial'").select(
        "meeting_id", "track", who(F.col("track")).alias("who"), "e.start", "e.end", "e.text")


def since(lines: DataFrame, seen: Column) -> DataFrame:
    return lines.filter(F.col("seq") > seen)


def ring(lines: DataFrame, size: int = CAPTION_RING) -> DataFrame:
    """The newest lines of each meeting; the rank limit is applied before the shuffle."""
    newest = Window.partitionBy("meeting_id").orderBy(F.desc("seq"))
    return lines.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= size).drop("_n")
