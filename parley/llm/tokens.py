"""Token counts by a separator scan over flat token files.

A flat file is nothing but 16-bit big-endian token ids; a document ends at the separator
id, and no index says where. `write_flat` tokenizes documents into such files, each task
into files of a few MB of its own, in a single pass. `scan` cuts files into blocks, finds the separators of a block
with one vectorised comparison, and emits the documents that lie inside the block with
their number of tokens, and the two open pieces at its ends. A prefix sum of the blocks'
separator counts, per file, gives every piece the number of its document; pieces of the
same document are added. So a document may run over any number of blocks.

Defined results: null and empty texts have 0 tokens; ids after the last separator are a
document of their own; an empty file holds no document; equal rows have a row each; a
file with an odd number of bytes is refused. Separator texts in a document are ordinary
text. Runs of white space of any length are encoded as the pattern would cut them, though its
matcher would overflow on a very long one. Spark hands a file over as one row and holds it several times, so
files of `write_flat` end with the document that makes them `FILES` portions of `PORTION` bytes, however large an
input partition is. A file of others must stay below 2 GB (a larger one is refused by Spark).
"""

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import map_arrow
from parley.session import run_dir

#: Tokens per block, and documents that a task holds as Python objects at once.
BLOCK = 1 << 20
ROWS = 256
#: Bytes of tokens, or of ids, after which a portion ends with its document, and portions of a file.
PORTION = 1 << 20
FILES = 4
#: The separator's id and the pattern that cuts a text before the merges.
SEPARATOR = 50_256
PATTERN = (r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White space of the pattern, in runs that its matcher is not given whole.
LONG_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CONCURRENT = "spark.sql.maxConcurrentOutputFileWriters"

_tokenizers = {}


def tokenizer(ranks: bytes):
    """Byte-level BPE from the lines of a rank file; built once per worker."""
    key = hash(ranks)
    if key not in _tokenizers:
        import tiktoken
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _tokenizers[key] = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _tokenizers[key]


def encode(encoding, text: str) -> list[int]:
    """Token ids of a text. A run of white space is one piece, but for its last character where
    something follows; no piece goes over the run's beginning. So long runs are merged directly."""
    ids, at = [], 0
    for run in LONG_BLANKS.finditer(text):
        end = run.end() - (run.end() < len(text))
        ids += encoding.encode_ordinary(text[at:run.start()])
        ids += encoding._encode_single_piece(text[run.start():end])  # merges without the pattern
        at = end
    return ids + encoding.encode_ordinary(text[at:])


def write_flat(docs: DataFrame, path: str, ranks: str = RANKS) -> None:
    """Writes `docs` (doc_id, text) below `path`: part=tokens holds the flat files and part=ids,
    file by file, the ids of their documents (20 digits each, null as the least number).

    Both files of a portion come from one pass, so their order agrees whatever is run again. A
    row is a portion of either; Spark's writer begins a new file after `FILES` rows.
    """
    spark = docs.sparkSession
    with open(ranks, "rb") as file:
        shared = spark.sparkContext.broadcast(file.read())
    end = np.array([SEPARATOR], ">u2").tobytes()
    least = -(1 << 63)

    def run(batches):
        encoding = tokenizer(shared.value)
        tokens, keys = bytearray(), bytearray()

        def portion():
            # The last byte of every value is written as the text writer's line end.
            row = pa.RecordBatch.from_arrays([pa.array(["tokens", "ids"], pa.string()),
                                              pa.array([bytes(tokens[:-1]), bytes(keys[:-1])], pa.binary())],
                                             names=["part", "value"])
            tokens.clear(), keys.clear()
            return row
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    tokens += np.array(encode(encoding, text), ">u2").tobytes()
                tokens += end
                keys += b"%020d" % ((least if key is None else key) - least) + end[1:]
                if max(len(tokens), len(keys)) >= PORTION:
                    yield portion()
        if keys:
            yield portion()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    flat = rows.mapInArrow(run, "part string, value binary").select("part", F.col("value").cast("string"))
    before = spark.conf.get(CONCURRENT, None)
    spark.conf.set(CONCURRENT, "4")  # two files side by side, so rows are not sorted by part
    try:
        (flat.write.partitionBy("part").option("lineSep", end[1:].decode("ascii"))
         .option("maxRecordsPerFile", FILES).text(path))
    finally:
        spark.conf.unset(CONCURRENT) if before is None else spark.conf.set(CONCURRENT, before)


def flat_files(spark, path: str) -> DataFrame:
    """stream, content: every flat file below `path`. A stream is named by its task and file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_replace(F.regexp_extract("path", r"part-([^/]*)$", 1), r"-[^/]*(\.c\d+)\..*$", "$1")
    return files.select(name.alias("stream"), "content")


def blocks(files: DataFrame, separator: int = SEPARATOR, size: int = BLOCK) -> DataFrame:
    """One row per block: stream, block, n_sep, head (tokens before the first separator, all if
    there is none), inner (tokens of the documents that begin and end in it), tail."""
    def run(batch):
        out = [[] for _ in range(6)]
        for stream, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            content = content.as_buffer()
            if content is None:
                continue
            if content.size % 2:
                raise ValueError(f"stream {stream}: {content.size} bytes are no whole number of tokens")
            ids = np.frombuffer(content, ">u2")
            for at in range(0, len(ids), size):
                part = ids[at:at + size]
                ends = np.flatnonzero(part == separator)
                n = len(ends)
                row = (stream, at // size, n, int(ends[0]) if n else len(part),
                       (np.diff(ends) - 1).tolist(), int(len(part) - 1 - ends[-1]) if n else 0)
                for column, value in zip(out, row):
                    column.append(value)
        return out
    return map_arrow(files, run, "stream string, block long, n_sep long, head long, inner array<long>, tail long")


def scan(files: DataFrame, separator: int = SEPARATOR, size: int = BLOCK) -> DataFrame:
    """stream, at (the document's number in it) and n_tokens of every document of flat files."""
    order = Window.partitionBy("stream").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    found = blocks(files, separator, size).withColumn("before", F.coalesce(F.sum("n_sep").over(order), F.lit(0)))
    inner = found.select("stream", F.posexplode("inner").alias("i", "n_tokens"), "before").select(
        "stream", (F.col("before") + 1 + F.col("i")).alias("at"), "n_tokens")
    # A tail without tokens is a document only if a later block ends it; that block's head says so.
    ends = found.select("stream", F.explode(F.array(
        F.struct(F.col("before").alias("at"), F.col("head").alias("n"), (F.col("n_sep") > 0).alias("ended")),
        F.struct((F.col("before") + F.col("n_sep")).alias("at"), F.col("tail").alias("n"), F.lit(False).alias("ended"))
    )).alias("p"))
    open_ends = (ends.groupBy("stream", F.col("p.at").alias("at"))
                 .agg(F.sum("p.n").alias("n_tokens"), F.max("p.ended").alias("ended"))
                 .filter("n_tokens > 0 OR ended").drop("ended"))
    return inner.unionByName(open_ends)


def document_ids(spark, path: str) -> DataFrame:
    """stream, at, doc_id from the id files that `write_flat` has put beside the flat files."""
    def run(batches):
        for stream, content in ((s, c) for b in batches for s, c in zip(b.column(0).to_pylist(), b.column(1))):
            digits = np.frombuffer(content.as_buffer(), np.uint8).reshape(-1, 21)[:, :20] - ord("0")
            value = np.zeros(len(digits), np.uint64)
            for i in range(20):
                value = value * np.uint64(10) + digits[:, i]
            ids = pa.array((value ^ np.uint64(1 << 63)).view(np.int64), pa.int64(), mask=value == 0)
            yield pa.RecordBatch.from_arrays([pa.array([stream] * len(ids), pa.string()),
                                              pa.array(np.arange(len(ids))), ids], names=["stream", "at", "doc_id"])
    return flat_files(spark, path).mapInArrow(run, "stream string, at long, doc_id long")


def count_tokens(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id and n_tokens of every row of `docs` (doc_id, text), by way of flat files in the shared folder."""
    spark = docs.sparkSession
    path = run_dir(spark, "flat")
    write_flat(docs, path, ranks)
    names = {n for n in ("tokens", "ids") if _exists(spark, f"{path}/part={n}")}
    if not names:
        return spark.createDataFrame([], "doc_id long, n_tokens long")
    counts = scan(flat_files(spark, f"{path}/part=tokens"))
    return document_ids(spark, f"{path}/part=ids").join(counts, ["stream", "at"]).select("doc_id", "n_tokens")


def _exists(spark, path):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
