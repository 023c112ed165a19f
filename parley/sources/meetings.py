"""Meeting documents in folders: scans, incremental scans, writes."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from parley.schemas import CALENDAR_EVENT, MEETING
from parley.sources import folders, store

# Meeting id, and a folder that ends in one.
ID = r"^\d{8}-\d{6}$"
FOLDER_ID = r"^(?:.* — )?(\d{8}-\d{6})$"
DOCUMENT = "meeting.json"


def folder_id(folder):
    """Meeting id of a folder name, NULL for other folders."""
    return F.nullif(F.regexp_extract(folder, FOLDER_ID, 1), F.lit(""))


def _read(spark: SparkSession, root: str, safe: bool, document: str) -> DataFrame:
    """Rows of all documents, with folder and modified. Spark's reader is for places that Python tasks cannot
    read, and says so where there is no document."""
    place = folders.place_of(spark, root, document)
    if place is not None and folders.has_documents(place, document):
        return _parse(folders.read_text(spark, place, document), safe).withColumn("folder", _key(F.col("folder")))
    reader = spark.read.schema(MEETING).option("multiLine", True).option(
        "mode", "DROPMALFORMED" if safe else "FAILFAST")
    rows = reader.json(f"{root}/*/{document}")
    return rows.select("*", _folder(F.col("_metadata.file_path")).alias("folder"),
                       F.col("_metadata.file_modification_time").alias("modified"))


def _parse(files: DataFrame, safe: bool) -> DataFrame:
    """Texts as Spark's reader of whole files has them: an object is a row, an array one for each of its objects;
    of a text that is malformed anywhere no row stays, or it ends the read."""
    mode = {"mode": "PERMISSIVE" if safe else "FAILFAST", "columnNameOfCorruptRecord": "_bad"}
    schema = StructType([*MEETING.fields]).add("_bad", StringType()) if safe else MEETING
    objects = F.when(F.ltrim("text").startswith("["), F.from_json("text", "array<string>", mode)).otherwise(F.array("text"))
    parsed = F.transform(objects, lambda x: F.from_json(x, schema, mode))
    # behind the generator the parsed rows are a column, which filters do not parse again
    rows = files.select("folder", "modified", F.explode(F.array(parsed)).alias("_rows"))
    good = F.forall("_rows", lambda x: x.isNotNull() & x["_bad"].isNull() if safe else x.isNotNull())
    return rows.filter(good).select(F.explode("_rows").alias("_row"), "folder", "modified").select(
        *[F.col(f"_row.{f.name}").alias(f.name) for f in MEETING.fields], "folder", "modified")


def _key(folder):
    """Folders that Spark wrote begin with their column's name."""
    return F.regexp_replace(folder, "^folder=", "")


def _folder(path):
    """The path comes escaped."""
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return _key(F.element_at(F.split(plain, "/"), -2))


def _folders(spark: SparkSession, root: str, document: str) -> DataFrame:
    """Meeting folders that hold a document, by their names alone: one that cannot be read is not gone."""
    place = folders.place_of(spark, root, document)
    if place is not None:
        names = folders.holders(spark, place, document).select(_key(F.col("folder")).alias("folder")).distinct()
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", document)
        names = files.load(root).select(_folder(F.col("path")).alias("folder")).distinct()
    return names.filter(folder_id(F.col("folder")).isNotNull())


def scan_meetings(spark: SparkSession, root: str, safe: bool = True, document: str = DOCUMENT) -> DataFrame:
    """Meeting documents below `root`, one folder each. Malformed ones are left out
    when `safe`, else they end the read."""
    return _read(spark, root, safe, document).withColumn("meeting_id", folder_id(F.col("folder"))).filter(
        "meeting_id IS NOT NULL")


def scan_changed(spark: SparkSession, root: str, known: DataFrame,
                 document: str = DOCUMENT) -> tuple[DataFrame, DataFrame]:
    """(changed or new documents, known rows of folders that are gone). `known` has
    folder and modified from the scan before; only file facts are compared."""
    now = scan_meetings(spark, root, document=document)
    same = known.select("folder", "modified")
    return (now.join(same, ["folder", "modified"], "left_anti"),
            known.join(_folders(spark, root, document), "folder", "left_anti"))


def write_meetings(meetings: DataFrame, path: str) -> int:
    """Replaces the given meetings in the store's meeting table, all of them or none; all others
    stay. Returns the version."""
    return store.replace(meetings, path, "meetings")


def read_meetings(spark: SparkSession, path: str) -> DataFrame:
    return store.read(spark, path, "meetings")


def write_exports(lines: DataFrame, path: str, order: list[str]) -> None:
    """Text exports, one folder per meeting; folders of other meetings stay. Range
    partitioning keeps lines in order and splits a very long meeting over several files
    whose names sort."""
    lines.repartitionByRange("meeting_id", *order).sortWithinPartitions("meeting_id", *order).select(
        "meeting_id", F.col("line").alias("value")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("meeting_id").text(path)


def calendar_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CALENDAR_EVENT).option("multiLine", True).json(path)
