"""Live captions: one state per meeting, shared by its tracks; meetings are handled in groups."""

from itertools import groupby
from operator import itemgetter
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructType

from parley.functions.constants import CAPTION_RING
from parley.operators.captions import who
from parley.schemas import CAPTION

WATERMARK = "1 minute"
LINE = (StructType().add("meeting_id", StringType()).add("kind", StringType()).add("seq", LongType())
        .add("track", StringType()).add("start", DoubleType()).add("end", DoubleType()).add("text", StringType())
        .add("arrival_ms", LongType()).add("event_id", LongType()))

PARTIAL = "track: string, start: double, end: double, text: string"
KEPT = f"seq bigint, ring array<struct<seq: bigint, {PARTIAL}>>, open array<struct<{PARTIAL}>>"
EVENT = ["meeting_id", "t", "track", "start", "end", "text", "arrival_ms", "event_id"]
#: Groups of meetings. A group costs several milliseconds a batch in Python and a meeting in it much less, so there are
#: far fewer groups than meetings, and more than tasks. A checkpoint is bound to the number.
GROUPS = 2048


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """NDJSON caption lines; what is no event is skipped."""
    return lines.withColumn("_e", F.from_json(F.col(column), CAPTION)).filter("_e.t IS NOT NULL").select(
        *[c for c in lines.columns if c != column], "_e.*")


class CaptionState(StatefulProcessor):
    """Numbers final lines across tracks and keeps the open partial of each track.

    Emits every final, and after each batch the partial of each track the batch
    touched; a cleared one has no text. Rows carry the arrival and number of their
    event, so partials of several batches can be ordered. The newest `ring` finals stay in
    the state, trimmed with each batch.
    """

    def __init__(self, keep_ms: int | None = None, ring: int = CAPTION_RING):
        self.keep_ms, self.ring = keep_ms, ring

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._kept = handle.getMapState("meetings", "meeting_id string", KEPT, self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # one group's share of one batch; the source's rate bounds it
        batch = pd.concat(list(rows)).sort_values(["meeting_id", "arrival_ms", "event_id"])
        lines = []
        for meeting, events in groupby(zip(*(batch[c] for c in EVENT)), key=itemgetter(0)):
            lines += self._meeting(meeting, events)
        yield pd.DataFrame(lines, columns=LINE.names)

    def _meeting(self, meeting, events):
        """Lines of a meeting's events, which come in order; reads and writes its state once."""
        seq, ring, held = self._kept.getValue((meeting,)) or (0, [], [])
        finals, touched = [], {}
        for _, t, track, start, end, text, *event in events:
            if t == "final":
                seq += 1
                finals.append((meeting, "final", seq, track, start, end, text, *event))
            touched[track] = ((start, end, text) if t == "partial" else None, event)
        newest = [f[2:7] for f in finals[-self.ring:]]
        older = [tuple(r) for r in ring[max(0, len(ring) + len(newest) - self.ring):]]
        still = [tuple(p) for p in held if p[0] not in touched]
        still += [(track, *value) for track, (value, _) in touched.items() if value is not None]
        self._kept.updateValue((meeting,), (seq, older + newest, still))
        return finals + [(meeting, "partial", seq, track, *(v or (None, None, None)), *event)
                         for track, (v, event) in touched.items()]

    def close(self) -> None:
        pass


def caption_lines(events: DataFrame, keep_ms: int | None = None, ring: int = CAPTION_RING) -> DataFrame:
    """Stream of lines and partials from events (meeting_id, track, t, start, end, text,
    arrival, arrival_ms, event_id). A live stream names `keep_ms`, after which a silent
    meeting's state goes; Spark then looks for state to clear for ever, so a run over
    what is there now (available-now trigger) leaves it out."""
    rows = events.withWatermark("arrival", WATERMARK).select(
        F.pmod(F.xxhash64("meeting_id"), F.lit(GROUPS)).alias("group"), *EVENT, "arrival")
    out = rows.groupBy("group").transformWithStateInPandas(
        statefulProcessor=CaptionState(keep_ms, ring), outputStructType=LINE, outputMode="Append",
        timeMode="None" if keep_ms is None else "ProcessingTime")
    return out.withColumn("who", who(F.col("track")))


def ring_of(spark, checkpoint: str) -> DataFrame:
    """The newest lines of every meeting as the state of a stream has them now."""
    rows = (spark.read.format("statestore").option("stateVarName", "meetings").option("flattenCollectionTypes", "true")
            .load(checkpoint))
    kept = "user_map_value"
    if "value" in rows.schema[kept].dataType.names:  # beside its time to live, where the stream names `keep_ms`
        kept += ".value"
    lines = rows.select(F.col("user_map_key.meeting_id").alias("meeting_id"), F.inline(f"{kept}.ring"))
    return lines.withColumn("who", who(F.col("track")))
