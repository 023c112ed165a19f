"""Starting streams: sources, state store, and a run over what is there now."""

from pyspark.sql import DataFrame, SparkSession

from parley.session import run_dir

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 1000) -> DataFrame:
    """Parquet files of a table as a stream; its schema is the table's own. The number
    of files per trigger bounds what a batch holds, and with it what one key can bring
    to a stateful step at once."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option(
        "maxFilesPerTrigger", files_per_trigger).parquet(folder)


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def to_table(stream: DataFrame, name: str) -> DataFrame:
    """Runs the stream over all data present and returns the table it appended."""
    spark = stream.sparkSession
    use_state_store(spark)
    path = run_dir(spark, name)
    query = (stream.writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/table")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table")
