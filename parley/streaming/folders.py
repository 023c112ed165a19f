"""Scans of meeting folders as a stream: which folders are new, changed or gone.

A scan is a listing with a number; its rows are followed by a tick, a row without a folder,
that says the listing is whole. The number is the stream's clock, so a folder that a whole
scan did not hold is found gone by a timer, without a join against the scan before.
"""

from typing import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructType

from parley.streaming.run import file_stream

# One scan is a second of the clock: its rows come first, the tick later, and the watermark
# stays half a scan behind, so that rows of one scan may come in several batches.
SCAN_MS, TICK_MS, LATE, END_MS = 1000, 900, "500 milliseconds", 250

CHANGE = (StructType().add("folder", StringType()).add("scan", LongType()).add("state", StringType())
          .add("modified", LongType()))


def record_scan(listing: DataFrame, path: str, scan: int) -> None:
    """Appends a listing (folder, modified) and its tick. Scan numbers are consecutive; a scan that
    failed half way may be recorded again under its number."""
    rows = listing.select(F.lit(scan).cast("long").alias("scan"), F.col("folder").cast("string").alias("folder"),
                          F.unix_micros("modified").alias("modified")).filter("folder IS NOT NULL")
    rows.write.mode("append").parquet(path)
    tick = rows.sparkSession.range(1).select(F.lit(scan).cast("long").alias("scan"), F.lit(None).cast("string").alias("folder"),
                                             F.lit(None).cast("long").alias("modified"))
    tick.coalesce(1).write.mode("append").parquet(path)


def scans(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return file_stream(spark, path, "*.parquet", files_per_trigger)


class FolderState(StatefulProcessor):
    """The last scan that held a folder, and the folder's time then. A folder that is gone leaves no state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", "scan bigint, modified bigint")

    def _keep(self, last: tuple | None, scan: int, modified: int) -> None:
        """A folder has one timer, for the scan behind its last one; only a new scan moves it."""
        self._last.update((scan, modified))
        if last is None or last[0] != scan:
            if last is not None:
                self._handle.deleteTimer((last[0] + 1) * SCAN_MS + END_MS)
            self._handle.registerTimer((scan + 1) * SCAN_MS + END_MS)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        """Called for each row of a key."""
        if key[0] is not None:
            last, found = self._last.get(), (initialState["scan"], initialState["modified"])
            if last is None or tuple(last) < found:
                self._keep(last, *found)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[0] is None:  # ticks
            return
        kept = last = self._last.get()
        for scan, modified in sorted((r["scan"], r["modified"]) for r in rows):
            if last is not None and scan > last[0] + 1:
                yield Row(folder=key[0], scan=last[0] + 1, state="gone", modified=last[1])
                last = None
            if last is None or modified != last[1]:
                yield Row(folder=key[0], scan=scan, state="new" if last is None else "changed", modified=modified)
            last = (scan, modified)
        self._keep(kept, *last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        scan, modified = self._last.get()
        self._last.clear()
        yield Row(folder=key[0], scan=scan + 1, state="gone", modified=modified)

    def close(self) -> None:
        pass


def folder_changes(listings: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Stream of (folder, scan, state, modified) from a stream of listings: new, changed or gone since the scan
    before. `known` (folder, scan, modified) holds the folders of the last scan before the stream begins; a
    restart reads the state and not `known`. A folder named twice by a scan counts with its later time."""
    clock = F.timestamp_millis(F.col("scan") * SCAN_MS + F.when(F.col("folder").isNull(), TICK_MS).otherwise(0))
    whole = F.col("folder").isNull() | F.col("modified").isNotNull()
    rows = listings.filter(whole).withColumn("clock", clock).withWatermark("clock", LATE)
    first = None if known is None else known.select(
        "folder", F.col("scan").cast("long").alias("scan"), F.unix_micros("modified").alias("modified")).groupBy("folder")
    found = rows.groupBy("folder").transformWithState(
        statefulProcessor=FolderState(), outputStructType=CHANGE, outputMode="Append", timeMode="EventTime",
        initialState=first)
    return found.withColumn("modified", F.timestamp_micros("modified"))
