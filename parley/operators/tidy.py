"""Validated transcript edits: window operations merged, resolved and applied."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.constants import TURN_GAP_MS
from parley.functions.numbers import div_round
from parley.functions.text import ordered_subset, strip, tokens
from parley.operators.turns import merge_turns
from parley.session import cut_lineage

LABELS = ["meeting_id", "label"]


def merge_window_ops(ops: DataFrame) -> DataFrame:
    """One operation per key, the first window's; incomplete ones are left out.
    Keys are the folded or renamed label, or the turn. Duplicates are combined
    before the shuffle, so a key proposed by every window stays small."""
    label, turn = F.col("op").isin("merge", "rename"), F.col("op").isin("drop", "trim")
    text = F.when(F.col("op") == "merge", F.col("target")).when(
        F.col("op") == "rename", strip(F.col("target"))).when(F.col("op") == "trim", F.col("keep"))
    full = (F.col("op") == "drop") | (strip(F.coalesce(text, F.lit(""))) != "")
    rows = ops.withColumn("_text", text).filter(full).filter(
        (label & (F.coalesce("label", F.lit("")) != "")) | (turn & F.col("turn_id").isNotNull()))
    key = ["meeting_id", "op", F.when(label, F.col("label")).alias("label"),
           F.when(turn, F.col("turn_id")).alias("turn_id")]
    return rows.groupBy(*key).agg(
        F.min_by("_text", F.struct("window_no", "pos")).alias("value"))


def resolve_merges(merges: DataFrame, speakers: DataFrame) -> DataFrame:
    """Transitive label map (meeting_id, label, target) from single folds.

    `you` is on neither side, both labels must exist, and chains that end in a
    cycle are dropped. Pointers double their reach each round: a round in which no
    label arrives means that all left over run in circles.
    """
    known = speakers.select("meeting_id", "speaker")
    edges = (merges.filter("label <> 'you' AND target <> 'you' AND label <> target")
             .join(known.withColumnRenamed("speaker", "label"), LABELS, "left_semi")
             .join(known.withColumnRenamed("speaker", "target"), ["meeting_id", "target"], "left_semi")
             .select(*LABELS, "target"))
    sources = edges.select("meeting_id", F.col("label").alias("target"), F.lit(True).alias("_more"))
    state = edges.join(sources, ["meeting_id", "target"], "left").select(
        *LABELS, "target", F.col("_more").isNull().alias("arrived"), F.lit(False).alias("fresh"))
    state = cut_lineage(state)
    while True:
        step = state.select("meeting_id", F.col("label").alias("target"),
                            F.col("target").alias("_next"), F.col("arrived").alias("_done"))
        moved = state.filter("NOT arrived").join(step, ["meeting_id", "target"]).select(
            *LABELS, F.col("_next").alias("target"), F.col("_done").alias("arrived"),
            F.col("_done").alias("fresh"))
        state = cut_lineage(state.filter("arrived").withColumn("fresh", F.lit(False)).unionByName(moved))
        if state.filter("fresh").isEmpty():
            return state.filter("arrived").select(*LABELS, "target")


def _of(ops: DataFrame, op: str) -> DataFrame:
    return ops.filter(F.col("op") == op)


def edited_turns(turns: DataFrame, ops: DataFrame, merges: DataFrame) -> DataFrame:
    """Turns after drops, trims and folds, not merged yet; `trimmed` marks trims.
    A trim only counts when its words occur in the turn in that order."""
    keys = ["meeting_id", "turn_id"]
    trims = _of(ops, "trim").select(*keys, strip(F.col("value")).alias("keep"))
    rows = turns.join(_of(ops, "drop").select(*keys), keys, "left_anti").join(trims, keys, "left")
    rows = rows.withColumn("_new", tokens(F.col("keep"))).withColumn("_old", tokens(F.col("text")))
    new, old = F.size("_new"), F.size("_old")
    ok = F.coalesce((new > 0) & ordered_subset(F.col("_new"), F.col("_old")), F.lit(False))
    length = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))
    cut = div_round(F.col("start_ms") * old + length * new, old * 10) * 10
    rows = rows.withColumn("trimmed", ok).withColumn(
        "end_ms", F.when(ok & (new < old), cut).otherwise(F.col("end_ms"))).withColumn(
        "text", F.when(ok, F.col("keep")).otherwise(F.col("text")))
    folds = merges.select("meeting_id", F.col("label").alias("speaker"), F.col("target").alias("_into"))
    return rows.join(folds, ["meeting_id", "speaker"], "left").select(
        *keys, F.coalesce("_into", "speaker").alias("speaker"), "track", "start_ms", "end_ms", "text",
        "trimmed")


def apply_turns(turns: DataFrame, ops: DataFrame, merges: DataFrame,
                gap_ms: int = TURN_GAP_MS) -> DataFrame:
    """The tidied transcript with a flag per row. A meeting that the edits would
    empty keeps its turns and has `refused` set."""
    edited = edited_turns(turns, ops, merges)
    left = edited.select("meeting_id").distinct()
    kept = turns.join(left, "meeting_id", "left_anti").select(
        "meeting_id", "turn_id", "speaker", "track", "start_ms", "end_ms", "text")
    tidy = merge_turns(edited.drop("trimmed"), gap_ms).select(*kept.columns)
    return tidy.withColumn("refused", F.lit(False)).unionByName(kept.withColumn("refused", F.lit(True)))


def apply_speakers(tidied: DataFrame, speakers: DataFrame, ops: DataFrame) -> DataFrame:
    """Speakers still in use, renamed where a name was given (60 characters)."""
    used = speakers.join(tidied.select("meeting_id", "speaker").distinct(),
                         ["meeting_id", "speaker"], "left_semi")
    names = _of(ops, "rename").select("meeting_id", F.col("label").alias("speaker"),
                                      F.substring(strip(F.col("value")), 1, 60).alias("_new"))
    return used.join(names, ["meeting_id", "speaker"], "left").select(
        "meeting_id", "speaker", F.coalesce("_new", "name").alias("name"), "ord",
        F.col("_new").isNotNull().alias("renamed"))


def tidy_report(turns: DataFrame, ops: DataFrame, merges: DataFrame, speakers_after: DataFrame) -> DataFrame:
    """Counts per meeting of what was really applied."""
    keys = ["meeting_id", "turn_id"]
    dropped = turns.select(*keys).join(_of(ops, "drop").select(*keys), keys, "left_semi")
    trimmed = edited_turns(turns, ops, merges).filter("trimmed")
    counted = [(dropped, "dropped_turns"), (trimmed, "trimmed_turns"), (merges, "merged_speakers"),
               (speakers_after.filter("renamed"), "renamed_speakers")]
    names = [n for _, n in counted]
    marks = [df.select("meeting_id", *[F.lit(int(n == name)).cast("bigint").alias(n) for n in names])
             for df, name in counted]
    rows = turns.select("meeting_id").distinct().select(
        "meeting_id", *[F.lit(0).cast("bigint").alias(n) for n in names])
    for mark in marks:
        rows = rows.unionByName(mark)
    return rows.groupBy("meeting_id").agg(*[F.sum(n).alias(n) for n in names])
