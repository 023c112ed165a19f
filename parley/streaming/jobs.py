"""Job completions as a stream."""

from typing import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructType

WATERMARK = "1 hour"
DONE = (StructType().add("meeting_id", StringType()).add("kind", StringType()).add("event_id", LongType())
        .add("ts_ms", LongType()).add("state", StringType()).add("ok", BooleanType()))


class LeftProcessing(StatefulProcessor):
    """Remembers the last state of a job; the first one only sets the baseline."""

    def __init__(self, keep_ms: int | None = None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "state string", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        def place(row):  # what has no time or number comes last
            return [x for name in ("ts_ms", "event_id") for x in (row[name] is None, row[name] or 0)]
        kept = self._last.get()
        last = kept[0] if kept is not None else None
        for row in sorted(rows, key=place):
            state = row["state"]
            if last == "processing" and state != "processing":
                yield Row(meeting_id=key[0], kind=key[1], event_id=row["event_id"], ts_ms=row["ts_ms"], state=state, ok=state == "done")
            last = state
        self._last.update((last,))

    def close(self) -> None:
        pass


def finished_jobs(jobs: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """A live stream names `keep_ms`, after which a silent job's state goes; a run over what
    is there now leaves it out."""
    return jobs.withWatermark("ts", WATERMARK).groupBy("meeting_id", "kind").transformWithState(
        statefulProcessor=LeftProcessing(keep_ms), outputStructType=DONE, outputMode="Append",
        timeMode="None" if keep_ms is None else "ProcessingTime")
