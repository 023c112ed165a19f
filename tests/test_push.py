"""The stream drains its own queue, and a repeated batch changes nothing."""

from pyspark.sql import functions as F

from parley.operators import sync
from parley.registry import streams
from parley.streaming import sync as pushing

FIELDS = "user_id string, meeting_id string, title string, created string, duration double, mode string, speakers string, " \
         "turns array<struct<speaker:string,start:int,end:int,text:string>>, summary string, stats string, sync_enabled boolean"


def meetings(spark, ids, title="t", enabled=True):
    return spark.createDataFrame([("u", i, title, "c", 1.0, "online", "s", [], None, None, enabled) for i in ids], FIELDS)


class Target:
    """A push that fails for some ids, and writes what it gets under the batch's number."""

    def __init__(self, spark, path, fails):
        self.spark, self.path, self.fails = spark, path, fails

    def __call__(self, rows, batch_id):
        bad = F.col("meeting_id").isin(self.fails.get(batch_id, []))
        rows.filter(~bad).select("meeting_id", "title").write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        return rows.filter(bad)

    def got(self):
        return sorted((r["batch"], r["meeting_id"], r["title"]) for r in self.spark.read.parquet(self.path).collect())


def waiting(spark, path, before=None):
    return sorted(r["meeting_id"] for r in pushing.read_queue(spark, path, before).collect())


def test_failed_ids_are_pushed_by_a_later_batch(spark, tmp_path):
    queue, out = str(tmp_path / "queue"), str(tmp_path / "out")
    push = Target(spark, out, {0: ["a", "b", "c", "d"], 1: ["a"], 2: []})
    catalogue = meetings(spark, ["a", "b", "x"], "now").union(meetings(spark, ["c"], "now", False))  # d is deleted
    steps = [meetings(spark, ["a", "b", "c", "d", "e"]), meetings(spark, ["f", "b"], "changed"), meetings(spark, ["g"]).limit(0)]
    for n, changes in enumerate(steps):
        pushing.drain_batch(changes, n, push, queue, lambda: catalogue)
    assert push.got() == [(0, "e", "t"), (1, "b", "changed"), (1, "f", "changed"), (2, "a", "now")]
    assert [waiting(spark, queue, n) for n in range(4)] == [[], ["a", "b", "c", "d"], ["a"], []]


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    queue, out = str(tmp_path / "queue"), str(tmp_path / "out")
    push = Target(spark, out, {0: ["a"], 1: ["b"]})
    catalogue = meetings(spark, ["a", "b"], "now")
    for n in (0, 1, 1, 1):
        pushing.drain_batch(meetings(spark, [["a"], ["b"]][n]), n, push, queue, lambda: catalogue)
    assert push.got() == [(1, "a", "now")] and waiting(spark, queue) == ["b"]


def test_too_large_ones_wait(spark, tmp_path, monkeypatch):
    queue, push = str(tmp_path / "queue"), Target(spark, str(tmp_path / "out"), {})
    real = sync.sized
    monkeypatch.setattr(sync, "sized", lambda rows: real(rows, 200))
    big = meetings(spark, ["big"], "x" * 300)
    pushing.drain_batch(big.union(meetings(spark, ["ok"])), 0, push, queue, lambda: big)
    assert [r[1] for r in push.got()] == ["ok"] and waiting(spark, queue) == ["big"]


def test_stream_with_ticks(spark, tmp_path):
    feed, push = str(tmp_path / "feed"), Target(spark, str(tmp_path / "out"), {0: ["a", "b"], 1: ["b"]})
    rows = meetings(spark, ["a", "b", "c"])
    rows.coalesce(1).write.parquet(feed)
    tick = spark.range(2).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])
    for _ in range(2):
        tick.coalesce(1).write.mode("append").parquet(feed)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(feed)
    pushing.push_changes(stream, push, str(tmp_path / "queue"), str(tmp_path / "cp"), lambda: rows).awaitTermination()
    assert [r[:2] for r in push.got()] == [(0, "c"), (1, "a"), (2, "b")] and waiting(spark, str(tmp_path / "queue")) == []


def test_the_retry_query_feeds_a_batch_by_many_tasks(spark, sf_dir, tmp_path, monkeypatch):
    spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(streams, "run_dir", lambda _, name: str(tmp_path / name))
    got = streams.sync_retry(spark, str(tmp_path))
    assert len(list((tmp_path / "sync/feed").glob("*.parquet"))) >= 3 * 4 + 2  # 5 if a batch is one file
    assert sorted(r["batch"] for r in got.select("batch").distinct().collect() if r["batch"] is not None) == [1, 2, 3]
