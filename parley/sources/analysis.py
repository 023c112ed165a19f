"""Saved analysis: segments, words and voice windows for clustering again."""

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from parley.sources import store

TABLES = ("segments", "words", "voice_windows")


def save_analysis(path: str, tables: dict[str, DataFrame], ids: DataFrame | None = None) -> None:
    """Writes the tables; they are seen together or not at all. The analysis of the given
    meetings (those of `ids`, else those with a row in any table) is replaced, that of all
    others stays."""
    run, names = uuid.uuid4().hex, [name for name in TABLES if name in tables]
    spark = tables[names[0]].sparkSession
    for name in names:
        store.stage(tables[name], path, name, run)
    if ids is None:
        ids = reduce(DataFrame.union, [store.read_staged(spark, path, run, n).select("meeting_id") for n in names])
    store.publish(spark, path, run, names, ids)


def load_analysis(spark: SparkSession, path: str, meeting_id: str | None = None) -> dict[str, DataFrame]:
    """The saved tables; for one meeting only its bucket is read."""
    found = {name: store.read(spark, path, name, meeting_id=meeting_id) for name in TABLES}
    return {name: rows for name, rows in found.items() if rows is not None}
