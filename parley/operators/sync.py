"""Copies of meetings for other devices: payloads, pushes, queue, deletions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.constants import MAX_PAYLOAD_BYTES

ROW_KEY = ["user_id", "meeting_id"]


def payload(meetings: DataFrame) -> DataFrame:
    """The synced row; turns go without their track."""
    turns = F.transform("turns", lambda t: F.struct(t["speaker"], t["start"], t["end"], t["text"]))
    return meetings.select(
        "user_id", "meeting_id", F.coalesce("title", F.lit("")).alias("title"), "created", "duration", "mode",
        "speakers", turns.alias("turns"), "summary", "stats")


def sized(rows: DataFrame, limit: int = MAX_PAYLOAD_BYTES) -> DataFrame:
    """Adds the payload's UTF-8 JSON, its bytes and whether it may be pushed."""
    body = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    return rows.withColumn("body", body).withColumn(
        "bytes", F.octet_length("body").cast("bigint")).withColumn("accepted", F.col("bytes") <= limit)


def owned_by(rows: DataFrame, user: Column) -> DataFrame:
    """Row-level access: owners read and write their own rows only."""
    return rows.filter(F.col("user_id") == user)


def delete_copies(synced: DataFrame, meetings: DataFrame, users: DataFrame) -> DataFrame:
    """Synced rows without those of deleted meetings and deleted users."""
    return synced.join(meetings.select("meeting_id"), "meeting_id", "left_anti").join(
        users.select("user_id"), "user_id", "left_anti")


def enqueue(queue: DataFrame, ids: DataFrame) -> DataFrame:
    return queue.select("meeting_id").union(ids.select("meeting_id")).distinct()


def to_push(queue: DataFrame, meetings: DataFrame) -> DataFrame:
    """Queued meetings that still exist and are still synced; others just vanish."""
    return meetings.filter("sync_enabled").join(queue.select("meeting_id").distinct(), "meeting_id", "left_semi")


def after_drain(current: DataFrame, taken: DataFrame, failed: DataFrame) -> DataFrame:
    """The queue after a drain: what came in meanwhile, and what failed."""
    return current.select("meeting_id").join(taken.select("meeting_id"), "meeting_id", "left_anti").union(
        failed.select("meeting_id")).distinct()
