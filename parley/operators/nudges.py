"""Meeting nudges in batch: busy microphones, calendar keys, remembered answers."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import constants as c
from parley.functions.text import nudge_key
from parley.operators.calendar import current_event
from parley.operators.scans import DAY_MS, islands, running, time_block


def busy_sessions(samples: DataFrame, persist_ms: int = c.CALL_PERSIST_S * 1000,
                  block_ms: int = DAY_MS) -> DataFrame:
    """Unbroken runs of busy samples that last at least `persist_ms`. `samples` has
    user_id, ts_ms, event_id, busy; a free or recording sample ends a run."""
    marked = islands(samples, ["user_id"], ["busy"], ["ts_ms", "event_id"], "ts_ms", None, block_ms)
    runs = marked.filter("busy").groupBy("user_id", "island").agg(
        F.max("ts_ms").alias("last_ms"), F.count(F.lit(1)).alias("samples"))
    return runs.select("user_id", F.col("island.ts_ms").alias("first_ms"), "last_ms", "samples").filter(
        F.col("last_ms") - F.col("first_ms") >= persist_ms)


def calendar_nudges(probes: DataFrame, events: DataFrame, keys: list[str], lead_min: int = 1) -> DataFrame:
    """Each event once: the first moment it could be offered."""
    found = current_event(probes, events, keys, lead_min=lead_min)
    offered = found.join(probes.select(*keys, "probe_id", "now_s"), [*keys, "probe_id"]).withColumn(
        "nudge_id", nudge_key(F.col("title"), F.col("start_s")))
    return offered.groupBy(*keys, "nudge_id").agg(
        F.min_by("title", F.struct("now_s", "probe_id")).alias("meeting_title"), F.min("now_s").alias("offered_s"))


def announce_once(nudges: DataFrame) -> DataFrame:
    """The first showing of each nudge id."""
    return nudges.groupBy("nudge_id").agg(F.min("ts_ms").alias("first_ms"), F.count(F.lit(1)).alias("shown"))


def remembered(answers: DataFrame, keep: int = c.DONE_RING) -> DataFrame:
    """The newest answered nudges per user; ranked down before the shuffle."""
    last = answers.groupBy("user_id", "nudge_id").agg(F.max("done_ms").alias("done_ms"))
    newest = Window.partitionBy("user_id").orderBy(F.desc("done_ms"), "nudge_id")
    return last.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= keep).drop("_n")


def app_label(process: Column, apps: dict[str, str] = c.MEETING_APPS) -> Column:
    """Label of the first listed app among the running processes (an array)."""
    out = F.lit(None).cast("string")
    for name, label in reversed(list(apps.items())):
        out = F.when(F.array_contains(process, name), label).otherwise(out)
    return out


def transitions(jobs: DataFrame, block_ms: int = DAY_MS) -> DataFrame:
    """Jobs that left `processing`, per kind and meeting; the first state seen only
    sets the baseline."""
    keys = ["meeting_id", "kind"]
    rows = running(jobs, keys, ["ts_ms", "event_id"], time_block("ts_ms", block_ms),
                   {"before": ("last", F.col("state"))})
    return rows.filter("before = 'processing' AND state <> 'processing'").select(
        *keys, "event_id", "ts_ms", "state", (F.col("state") == "done").alias("ok"))


