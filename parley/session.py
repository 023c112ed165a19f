"""Session helpers shared by operators that have to write something."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a local one only where none is named."""
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="parley-")
        spark.conf.set(CHECKPOINT_DIR, named)
    return named.rstrip("/")


def run_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; never reused between runs."""
    return f"{shared_dir(spark)}/parley/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder. Lost executors cannot take it away,
    and loops start each round from a bare scan: a checkpointed plan would carry the
    constraints of all rounds before, which makes planning ever slower."""
    spark = df.sparkSession
    path = run_dir(spark, "rows")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the table that `cut_lineage` wrote, once nothing will read it again."""
    spark = df.sparkSession
    folder = next((p.rsplit("/", 1)[0] for p in df.inputFiles() if "/parley/rows-" in p), None)
    if folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Partitioning for Python-heavy steps on `keys`. It takes the place of the shuffle
    the step needs anyway, with a number of partitions that adaptive execution keeps:
    rows that are few may still be hours of work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
