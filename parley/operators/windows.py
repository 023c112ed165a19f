"""Greedy windows and chunks over ordered rows."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import constants as c
from parley.functions.text import minutes_seconds
from parley.operators.scans import numbered, running
from parley.session import cut_lineage, spread

BLOCK_TURNS = 1024
END = -1


def _reach(turns: DataFrame, max_turns: int, max_chars: int, cost: int, overlap: int) -> DataFrame:
    """For every turn the window that would begin there: its size and the jump to
    the next window's first turn. Each block sees the first turns of the next."""
    block = F.floor(F.col("turn_id") / BLOCK_TURNS).cast("bigint")
    at = F.col("turn_id") % BLOCK_TURNS
    sizes = turns.select("meeting_id", "turn_id", (F.length("text") + cost).alias("cost"),
                         block.alias("_own"), F.explode(F.when(
                             (at < max_turns) & (block > 0), F.array(block, block - 1))
                             .otherwise(F.array(block))).alias("_blk"))
    ahead = Window.partitionBy("meeting_id", "_blk").orderBy("turn_id").rowsBetween(0, max_turns)
    rows = sizes.withColumn("_costs", F.collect_list("cost").over(ahead)).filter("_own = _blk")
    fits = lambda s, x: (s["n"] == 0) | ((s["n"] < max_turns) & (s["sum"] + x <= max_chars))
    fold = F.aggregate(
        "_costs", F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("sum")),
        lambda s, x: F.struct(
            F.when(fits(s, x), s["n"] + 1).otherwise(s["n"]).alias("n"),
            # once a turn does not fit, nothing after it does
            F.when(fits(s, x), s["sum"] + x).otherwise(F.lit(2**62)).alias("sum")))
    # one turn more than a window may hold is in sight: none left means the last window
    return rows.select("meeting_id", "_blk", "turn_id", fold["n"].cast("bigint").alias("turns"),
                       F.size("_costs").alias("_seen")).select(
        "meeting_id", "_blk", "turn_id", "turns", F.greatest(F.col("turns") - overlap, F.lit(1)).alias("jump"),
        (F.col("turns") >= F.col("_seen")).alias("last"))


def _exits(max_jump: int):
    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        """Where a walk that enters a block at its 1st, 2nd, … turn leaves it, as an
        offset into the next block; -1 where the last window is reached."""
        pdf = pdf.sort_values("turn_id")
        jump, last = pdf["jump"].to_numpy(), pdf["last"].to_numpy()
        out = [0] * len(jump)
        for i in range(len(jump) - 1, -1, -1):
            to = i + jump[i]
            out[i] = END if last[i] else (int(to - BLOCK_TURNS) if to >= BLOCK_TURNS else out[to])
        return pd.DataFrame({"meeting_id": [pdf["meeting_id"].iloc[0]], "_blk": [pdf["_blk"].iloc[0]],
                             "exits": [out[:max_jump]]})
    return exits


def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("turn_id")
    jump, last, at = pdf["jump"].to_numpy(), pdf["last"].to_numpy(), int(pdf["enter"].iloc[0])
    seen = []
    while at < len(jump):
        seen.append(at)
        if last[at]:
            break
        at += int(jump[at])
    return pdf.iloc[seen][["meeting_id", "turn_id", "turns"]]


def edit_windows(turns: DataFrame, max_turns: int = c.TIDY_TURNS, max_chars: int = c.TIDY_CHARS,
                 overlap: int = c.TIDY_OVERLAP, cost: int = c.TIDY_TURN_COST) -> DataFrame:
    """Overlapping windows of turns (meeting_id, first_turn, turns), each within both
    budgets. Where a window begins depends on the one before, so every block of
    1024 turns first says where a walk leaves it for each way of entering; one small
    row per block then gives the real entry, and the blocks walk independently."""
    # a few numbers per turn, read by both passes
    rows = cut_lineage(_reach(turns, max_turns, max_chars, cost, overlap))
    max_jump = max(1, max_turns - overlap)
    rows = spread(rows, "meeting_id", "_blk")
    ways = rows.groupBy("meeting_id", "_blk").applyInPandas(
        _exits(max_jump), "meeting_id string, _blk bigint, exits array<int>")
    steps = F.array_sort(F.collect_list(F.struct("_blk", "exits")))
    enters = F.aggregate(
        steps, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("seen")),
        lambda s, x: F.struct(
            F.when(s["at"] < 0, END).otherwise(F.coalesce(F.get(x["exits"], s["at"]), F.lit(END))).alias("at"),
            F.concat(s["seen"], F.array(s["at"])).alias("seen")))
    entry = ways.groupBy("meeting_id").agg(enters["seen"].alias("seen")).select(
        "meeting_id", F.posexplode("seen").alias("_at", "enter")).select(
        "meeting_id", F.col("_at").cast("bigint").alias("_blk"), "enter").filter("enter >= 0")
    starts = rows.join(entry, ["meeting_id", "_blk"]).groupBy("meeting_id", "_blk").applyInPandas(
        _walk, "meeting_id string, turn_id bigint, turns bigint")
    return starts.withColumnRenamed("turn_id", "first_turn")


def numbered_windows(windows: DataFrame) -> DataFrame:
    block = F.floor(F.col("first_turn") / BLOCK_TURNS).cast("bigint")
    return numbered(windows, ["meeting_id"], ["first_turn"], block, "window_no")


def transcript_lines(named: DataFrame, max_chars: int | None = None) -> DataFrame:
    """'[m:ss] name: text' per turn. With `max_chars` the column `cut` marks the lines
    after the one that crosses the limit; none is dropped."""
    line = F.concat(F.lit("["), minutes_seconds(F.col("start_ms")), F.lit("] "), F.col("name"),
                    F.lit(": "), F.col("text"))
    rows = named.select("meeting_id", "turn_id", line.alias("line"))
    if max_chars is None:
        return rows
    block = F.floor(F.col("turn_id") / BLOCK_TURNS).cast("bigint")
    return running(rows, ["meeting_id"], ["turn_id"], block,
                   {"_used": ("sum", F.length("line").cast("bigint"))}).withColumn(
        "cut", F.col("_used") > max_chars).drop("_used")


def _ways(limit: int, span: int):
    """For each text of a block at which a walk may enter: the least sum that lies before it in
    the block (`under`), and the sum the last chunk it begins there may reach (`out`)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        before, end = _sums(pdf)
        jump = _next(before, end, limit)
        out = np.empty(len(end), np.int64)
        for i in range(len(end) - 1, -1, -1):
            out[i] = before[i] + limit if jump[i] == len(end) else out[jump[i]]
        ways = 1 + int(np.searchsorted(end, pdf["_blk"].iloc[0] * span + limit, side="right"))
        return pd.DataFrame({"meeting_id": [pdf["meeting_id"].iloc[0]], "_blk": [pdf["_blk"].iloc[0]],
                             "under": [end[:ways].tolist()], "out": [out[:ways].tolist()]})
    return run


def _sums(pdf):
    pdf.sort_values(["_before", "_at"], inplace=True)
    before = pdf["_before"].to_numpy()
    return before, before + pdf["_n"].to_numpy()


def _next(before, end, limit):
    """Where a chunk that begins at each text ends: the first one that does not fit any more."""
    return np.maximum(np.searchsorted(end, before + limit, side="right"), np.arange(len(end)) + 1)


def _chunks(limit: int):
    """How many chunks have begun in the block up to each text, given what the one before may reach."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        before, end = _sums(pdf)
        jump, begins = _next(before, end, limit), np.zeros(len(end), np.int64)
        at = int(np.searchsorted(end, pdf["_reach"].iloc[0], side="right"))
        while at < len(end):
            begins[at] = 1
            at = int(jump[at])
        return pdf[["meeting_id", "_blk", "_at"]].assign(_no=np.cumsum(begins))
    return run


def budget_groups(rows: DataFrame, order: str, text: str, limit: int = c.CHUNK_CHARS,
                  extra: int = 1, blocks: int = 64) -> DataFrame:
    """Adds `chunk`: a new one begins when the next text would pass the limit; each
    text costs its length plus `extra`. `order` is a whole number, unique in a meeting.

    Where a chunk begins depends on the one before. With running sums a text begins the next
    chunk if the sum up to its end passes what the chunk may reach: the sum before its first
    text plus the limit. A meeting is cut into blocks of `blocks` limits. Only texts in the first
    limit of a block can be the first to begin a chunk there, so a block says for each of these
    what its last chunk may reach. One such row per block, a small part of the meeting, is folded to
    what really comes in, and the blocks then walk independently. Texts stay where they are.
    """
    span = limit * blocks
    cost = F.coalesce(F.length(text), F.lit(0)).cast("bigint")
    thin = rows.select("meeting_id", F.col(order).cast("bigint").alias("_at"), cost.alias("_n"))
    sums = running(thin, ["meeting_id"], ["_at"], F.floor(F.col("_at") / BLOCK_TURNS).cast("bigint"),
                   {"_before": ("sum", F.col("_n") + extra)})
    sums = cut_lineage(sums.withColumn("_blk", F.floor(F.col("_before") / span).cast("bigint")))
    ways = spread(sums, "meeting_id", "_blk").groupBy("meeting_id", "_blk").applyInPandas(
        _ways(limit, span), "meeting_id string, _blk bigint, under array<bigint>, out array<bigint>")
    steps = F.array_sort(F.collect_list(F.struct("_blk", "under", "out")))

    def enter(state, block):
        way = F.size(F.filter(block["under"], lambda u: u <= state["reach"]))
        return F.struct(F.coalesce(F.get(block["out"], way), state["reach"]).alias("reach"),
                        F.concat(state["seen"], F.array(F.struct(block["_blk"].alias("_blk"), state["reach"].alias("_reach")))).alias("seen"))
    start = F.struct(F.lit(-1).cast("bigint").alias("reach"),
                     F.array().cast("array<struct<_blk:bigint,_reach:bigint>>").alias("seen"))
    reach = ways.groupBy("meeting_id").agg(F.aggregate(steps, start, enter)["seen"].alias("seen")).select(
        "meeting_id", F.inline("seen")).select("meeting_id", "_blk", F.col("_reach"))
    placed = cut_lineage(spread(sums.join(reach, ["meeting_id", "_blk"]), "meeting_id", "_blk")
                         .groupBy("meeting_id", "_blk").applyInPandas(
        _chunks(limit), "meeting_id string, _blk bigint, _at bigint, _no bigint"))
    earlier = Window.partitionBy("meeting_id").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    begun = placed.groupBy("meeting_id", "_blk").agg(F.max("_no").alias("_all")).select(
        "meeting_id", "_blk", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_base"))
    numbers = placed.join(begun, ["meeting_id", "_blk"]).select(
        F.col("meeting_id").alias("_meeting"), "_at", (F.col("_base") + F.col("_no") - 1).cast("bigint").alias("chunk"))
    return rows.join(numbers, (F.col("meeting_id") == F.col("_meeting")) & (F.col(order) == F.col("_at"))).drop(
        "_meeting", "_at")


def join_groups(rows: DataFrame, order: str, text: str, separator: str = "\n") -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(text).alias("t"))))
    return rows.groupBy("meeting_id", "chunk").agg(
        F.array_join(F.transform(parts, lambda p: p["t"]), separator).alias(text),
        F.count(F.lit(1)).alias("lines"))


def chunk_lines(lines: DataFrame, limit: int = c.CHUNK_CHARS) -> DataFrame:
    """Chunks of transcript lines, one model call each."""
    return join_groups(budget_groups(lines, "turn_id", "line", limit), "turn_id", "line")


