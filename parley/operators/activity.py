"""Activity over time: fixed, sliding and session windows, batch or streaming."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.scans import DAY_MS, islands


def _bounds(df: DataFrame) -> DataFrame:
    second = lambda side: F.unix_seconds(F.col(f"window.{side}").cast("timestamp")).alias(f"{side}_s")
    return df.select(second("start"), second("end"), *[x for x in df.columns if x != "window"])


def windowed(events: DataFrame, keys: list[str], size: str, slide: str | None = None) -> DataFrame:
    """Counts and sums of `value` per window and key; partial sums before the shuffle."""
    return _bounds(events.groupBy(F.window("ts", size, slide or size), *keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents")))


def session_stream(events: DataFrame, keys: list[str], gap: str) -> DataFrame:
    """Sessions per key of a stream, closed after `gap` of silence."""
    return _bounds(events.groupBy(F.session_window("ts", gap).alias("window"), *keys).agg(
        F.count(F.lit(1)).alias("n")))


def session_totals(events: DataFrame, keys: list[str], gap: str, size: str) -> DataFrame:
    """Sessions and their events per window they end in, from a stream: two stateful steps behind one
    watermark, the second of which only gets closed sessions. Both count before the shuffle."""
    closed = events.groupBy(F.session_window("ts", gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    return _bounds(closed.groupBy(F.window(F.window_time("session_window"), size)).agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("n")))


def sessions(events: DataFrame, keys: list[str], gap_ms: int, block_ms: int = DAY_MS) -> DataFrame:
    """The same for a table (ts_ms, event_id). A session window would sort all events of
    a key in one task; islands over blocks spread a busy key."""
    marked = islands(events.withColumn("_one", F.lit(1)), keys, ["_one"], ["ts_ms", "event_id"], "ts_ms",
                     gap_ms, block_ms)
    found = marked.groupBy(*keys, "island").agg(F.max("ts_ms").alias("_last"), F.count(F.lit(1)).alias("n"))
    second = lambda ms: F.floor(ms / 1000).cast("bigint")
    return found.select(second(F.col("island.ts_ms")).alias("start_s"), second(F.col("_last") + gap_ms).alias("end_s"),
                        *keys, "n")
