"""Continuous push of changed meetings, with a queue that the stream itself drains."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from parley.operators import sync
from parley.session import cut_lineage, discard

QUEUE = StructType([StructField("meeting_id", StringType())])


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches whose queue has been written whole."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place):
        return []
    names = [s.getPath().getName() for s in system.listStatus(place) if s.isDirectory()]
    whole = [n for n in names if n.startswith("batch=") and system.exists(
        spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    return sorted(int(n.removeprefix("batch=")) for n in whole)


def read_queue(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """Ids that wait for a push after the last batch, or the last one before number `before`."""
    numbers = [n for n in _numbers(spark, folder) if before is None or n < before]
    if not numbers:
        return spark.createDataFrame([], QUEUE)
    return spark.read.schema(QUEUE).parquet(f"{folder}/batch={numbers[-1]}")


def drain_batch(changes: DataFrame, batch_id: int, push: Callable[[DataFrame, int], DataFrame], queue_path: str,
                current: Callable[[], DataFrame]) -> None:
    """One batch: the changed meetings and those that wait are pushed; what fails waits for the next.

    The queue of a batch is worked out from the queue of the batch before alone and written under
    the batch's number, so a batch that is repeated after a failure takes the same ids, pushes them
    under the same number and writes the same queue again.
    """
    spark = changes.sparkSession
    queue = read_queue(spark, queue_path, batch_id)
    new = changes.filter("meeting_id IS NOT NULL")
    # of a meeting that waits and has changed the change is what counts; rows of others come from the catalogue
    waiting = sync.to_push(queue.join(new.select("meeting_id"), "meeting_id", "left_anti"), current())
    rows = sync.payload(new.filter("sync_enabled")).unionByName(sync.payload(waiting))
    sized = cut_lineage(sync.sized(rows).drop("body"))
    failed = push(sized.filter("accepted").drop("accepted"), batch_id).select("meeting_id")
    large = sized.filter("NOT accepted").select("meeting_id")
    sync.after_drain(queue, queue, sync.enqueue(failed, large)).write.mode("overwrite").parquet(f"{queue_path}/batch={batch_id}")
    discard(sized)


def push_changes(changes: DataFrame, push: Callable[[DataFrame, int], DataFrame], queue_path: str, checkpoint: str,
                 current: Callable[[], DataFrame], trigger: dict | None = None):
    """Starts a query over a change feed of synced meetings (rows as `payload` wants them).

    `push(rows, batch_id)` gets the accepted rows of a batch and returns the meeting ids that
    failed; it names what it writes by the batch's number, so that a repeated batch replaces
    it. `current()` is the catalogue of synced meetings, from which waiting ones are read. A row
    without a meeting id is a tick: it makes a batch that only drains the queue, so a feed that is
    silent for long is joined with one (`spark.readStream.format("rate")`).
    """
    def batch(rows: DataFrame, batch_id: int) -> None:
        drain_batch(rows, batch_id, push, queue_path, current)
    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()
