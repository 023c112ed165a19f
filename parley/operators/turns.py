"""Turns: consecutive segments of one speaker, merged."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.constants import TURN_GAP_MS
from parley.functions.numbers import centis
from parley.functions.text import strip
from parley.operators.scans import MEETING_BLOCK_MS, islands, join_text, numbered, time_block


def _merge(df: DataFrame, same: list[str], order: list[str], gap_ms: int | None,
           block_ms: int) -> DataFrame:
    """One row per island with its first row's columns and its furthest end."""
    marked = islands(df, ["meeting_id"], same, order, "end_ms", gap_ms, block_ms)
    return join_text(
        marked, ["meeting_id", "island"], order, "text",
        [F.min_by(F.struct("speaker", "track"), F.struct(*order)).alias("_who"),
         F.min(F.struct(*order)).alias("_at"), F.max("end_ms").alias("_end"),
         F.count(F.lit(1)).alias("_n")],
        [F.min_by("_who", "_at").alias("_who"), F.max("_end").alias("end_ms"),
         F.sum("_n").alias("pieces")])


def build_turns(segments: DataFrame, gap_ms: int = TURN_GAP_MS,
                block_ms: int = MEETING_BLOCK_MS, number: bool = True) -> DataFrame:
    """Segments (meeting_id, speaker, track, seg_id, start_ms, end_ms, text) to
    turns. Sorted by start, microphone rows before system rows at equal times.
    Without `number`, turn_id is the first segment's id: unique in its track, and
    cheaper where only the turns count and not their positions."""
    rows = segments.select(
        "meeting_id", "speaker", "track", "seg_id", "start_ms",
        F.greatest("start_ms", "end_ms").alias("end_ms"), "text",
        (F.col("track") != "mic").cast("int").alias("_rank"))
    merged = _merge(rows, ["speaker", "track"], ["start_ms", "_rank", "seg_id"], gap_ms, block_ms)
    turns = merged.select(
        "meeting_id", F.col("_who.speaker").alias("speaker"), F.col("_who.track").alias("track"),
        F.col("island.start_ms").alias("_t0"), F.col("island._rank").alias("_t1"),
        F.col("island.seg_id").alias("_t2"), centis(F.col("end_ms")).alias("end_ms"),
        F.when(F.col("pieces") > 1, strip(F.col("text"))).otherwise(F.col("text")).alias("text"))
    if number:
        turns = number_turns(turns, ["_t0", "_t1", "_t2"], block_ms)
    else:
        turns = turns.withColumn("turn_id", F.col("_t2"))
    return turns.select("meeting_id", "turn_id", "speaker", "track",
                        centis(F.col("_t0")).alias("start_ms"), "end_ms", "text")


def number_turns(turns: DataFrame, order: list[str], block_ms: int = MEETING_BLOCK_MS) -> DataFrame:
    return numbered(turns, ["meeting_id"], order, time_block(order[0], block_ms), "turn_id")


def merge_turns(turns: DataFrame, gap_ms: int = TURN_GAP_MS,
                block_ms: int = MEETING_BLOCK_MS) -> DataFrame:
    """Merge again after edits: by speaker only, in turn order, ends not rounded."""
    merged = _merge(turns, ["speaker"], ["start_ms", "turn_id"], gap_ms, block_ms)
    return number_turns(merged.select(
        "meeting_id", F.col("_who.speaker").alias("speaker"), F.col("_who.track").alias("track"),
        F.col("island.start_ms").alias("start_ms"), F.col("island.turn_id").alias("_first"), "end_ms",
        F.when(F.col("pieces") > 1, strip(F.col("text"))).otherwise(F.col("text")).alias("text")),
        ["start_ms", "_first"], block_ms).drop("_first")


def display_groups(turns: DataFrame, block_ms: int = MEETING_BLOCK_MS) -> DataFrame:
    """Consecutive turns of one speaker for display, however far apart."""
    merged = _merge(turns, ["speaker"], ["start_ms", "turn_id"], None, block_ms)
    return merged.select("meeting_id", F.col("island.turn_id").alias("first_turn"),
                         F.col("_who.speaker").alias("speaker"),
                         F.col("island.start_ms").alias("start_ms"), "pieces", "text")


def named_turns(turns: DataFrame, speakers: DataFrame) -> DataFrame:
    """Display name of each turn's speaker, the label where there is none."""
    names = speakers.select("meeting_id", "speaker", "name")
    return turns.join(names, ["meeting_id", "speaker"], "left").withColumn(
        "name", F.coalesce("name", "speaker"))


def time_order(block_ms: int = MEETING_BLOCK_MS) -> Column:
    return time_block("start_ms", block_ms)
