"""Text files in folders, one folder for each set of keys, written and read by Python tasks.

Spark's own writer sets the rights of every file and moves it twice, one after the other at the
end of the job; with a folder per meeting that takes longer than all else. Its readers hold an
entry for every file at the driver and give few short files to a task. Here a task lists the
folders' names, and the tasks that get them list what is in them and read it.
"""

import json
import os
import re
from fnmatch import fnmatchcase
from itertools import groupby
from typing import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.session import spread
from parley.sources.store import _place

#: Bytes of texts that a task gives on at once.
BATCH_BYTES = 8 << 20


def write_text(rows: DataFrame, root: str, folder: str, value: str = "value") -> None:
    """Writes `value` as lines below root/<folder>: a file for each folder and task,
    named by the task's number, so that a task that is repeated writes the same file again. Null is an empty line."""
    def write(part):
        system, place = _place(root)
        name = f"part-{TaskContext.get().partitionId():05d}.txt"

        for at, lines in groupby(part, key=lambda row: row[0]):
            system.create_dir(f"{place}/{at}", recursive=True)
            with system.open_output_stream(f"{place}/{at}/{name}") as f:
                for _, line in lines:
                    f.write((line or "").encode() + b"\n")
    rows.select(folder, value).sortWithinPartitions(folder).foreachPartition(write)


def place_of(spark: SparkSession, root: str, document: str) -> str | None:
    """`root` as Python tasks name it. None where only Spark's readers can go, where nothing is, and
    for patterns of more than * and ? below a plain folder."""
    from pyarrow import fs
    if re.search(r"[][{}\\/]", document) or re.search(r"[][{}\\*?]", root):
        return None
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString()
    try:
        system, place = _place(uri)
        return uri if system.get_file_info(place).type == fs.FileType.Directory else None
    except (pa.ArrowException, OSError):
        return None


def _entries(system, place: str) -> Iterator[tuple[str, bool]]:
    """Name and whether it is a folder of all that lies in one; a local folder is never held as a whole."""
    from pyarrow import fs
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(place) as found:
            for entry in found:
                yield entry.name, entry.is_dir()
    else:
        for entry in system.get_file_info(fs.FileSelector(place)):
            yield entry.base_name, entry.type == fs.FileType.Directory


def _hidden(name: str) -> bool:
    """As Spark's readers have it."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _inside(system, place: str, document: str) -> Iterator[str]:
    """Names of the documents in a folder; none in one that has gone since it was listed."""
    try:
        for name, folder in _entries(system, place):
            if not folder and fnmatchcase(name, document) and not _hidden(name):
                yield name
    except FileNotFoundError:
        return


def has_documents(uri: str, document: str) -> bool:
    system, place = _place(uri)
    return any(next(_inside(system, f"{place}/{name}", document), None)
               for name, folder in _entries(system, place) if folder)


def _names(spark: SparkSession, uri: str) -> DataFrame:
    """Names of the folders in `uri`, listed by one task and dealt out by name."""
    def run(batches):
        for batch in batches:
            for _ in range(batch.num_rows):
                system, place = _place(uri)
                held = []
                for name, folder in _entries(system, place):
                    if folder:
                        held.append(name)
                    if len(held) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["at"])
                        held = []
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["at"])
    return spread(spark.range(0, 1, 1, 1).mapInArrow(run, "at string"), "at")


def _decoded(raw: bytes) -> str:
    """Bytes as a JSON parser takes them, by their mark or the places of zeros; what is no text is no JSON either."""
    try:
        return raw.decode(json.detect_encoding(raw))
    except UnicodeDecodeError:
        return "{"


def read_text(spark: SparkSession, uri: str, document: str) -> DataFrame:
    """folder, modified and text of the files <uri>/<folder>/<document>."""
    def run(batches):
        system, place = _place(uri)
        held, size = [], 0

        def rows():
            return pa.RecordBatch.from_arrays(
                [pa.array(x, kind) for x, kind in zip(zip(*held) if held else ((), (), ()), (pa.string(), pa.int64(), pa.string()))],
                names=["folder", "ms", "text"])
        for at in (x for batch in batches for x in batch.column(0).to_pylist()):
            for name in _inside(system, f"{place}/{at}", document):
                path = f"{place}/{at}/{name}"
                time = system.get_file_info(path).mtime_ns
                with system.open_input_stream(path) as f:
                    raw = f.read()
                held.append((at, None if time is None else time // 1_000_000, _decoded(raw)))
                size += len(raw) + len(at) + 64
                if size >= BATCH_BYTES:
                    yield rows()
                    held, size = [], 0
        yield rows()
    found = _names(spark, uri).mapInArrow(run, "folder string, ms long, text string")
    return found.select("folder", F.timestamp_millis(F.col("ms")).alias("modified"), "text")


def holders(spark: SparkSession, uri: str, document: str) -> DataFrame:
    """Names of the folders below `uri`, at any depth, and of `uri` itself that hold a document with content."""
    def holds(system, place):
        return any(system.get_file_info(f"{place}/{name}").size for name in _inside(system, place, document))

    def below(system, place):
        if holds(system, place):
            yield place.rsplit("/", 1)[-1]
        try:
            for name, folder in _entries(system, place):
                if folder and not _hidden(name):
                    yield from below(system, f"{place}/{name}")
        except FileNotFoundError:
            return

    def run(batches):
        system, place = _place(uri)
        for batch in batches:
            found = [x for at in batch.column(0).to_pylist() if not _hidden(at) for x in below(system, f"{place}/{at}")]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["folder"])
    names = _names(spark, uri).mapInArrow(run, "folder string")
    system, place = _place(uri)
    if not holds(system, place):
        return names
    return names.unionByName(spark.createDataFrame([(place.rstrip("/").rsplit("/", 1)[-1],)], "folder string"))
