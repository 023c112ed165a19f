"""N-gram Jaccard join by MinHash banding.

A text is the set of its five-word shingles; two texts are linked if the Jaccard similarity
of their sets is at least `threshold`. Texts with one and the same set stand for each other
from the start (a representative). Signatures are cut into bands; `bands_for` chooses their
number so that a pair right at the threshold shares a band with the wanted probability
(0.9999). Representatives shuffle on their band hashes; buckets of one, and buckets whose
members all met in an earlier band, are dropped, so most pairs are looked at once. Members
of a bucket bring their full sets along, and all pairs that have not met in an earlier band
are verified on them.

A bucket with more than `BLOCK` members is cut into blocks, and each pair of blocks is a
task's group of its own, so no group grows with a hot bucket. Pairs never become rows: a
group returns a row per member with the number of its links and one link to a spanning
forest, on which the classes are found.

Defined results: a text of fewer than five words is one shingle; texts without words are
copies of each other only if equal; null texts are a class each and have no links; the
class id is the least id in the class (null only if all are null); equal texts are copies,
which share a class and count as one text in `n_links`; an empty table gives an empty one.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import Codes, encode, map_arrow, mix, ngram_codes, text_bytes, words
from parley.llm.components import components
from parley.session import cut_lineage

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9999
ROWS = 5
#: Members of one block of a bucket.
BLOCK = 512

SIGNED = "doc_id long, text_code binary, set_code binary, n int, band array<long>"


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of `rows` values for which a pair at the threshold shares one with probability `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))


def multipliers(n):
    """Odd 64-bit factors, the same everywhere."""
    return np.random.default_rng(20_231).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text, codes, size=SHINGLE):
    """Sorted distinct shingle codes of UTF-8 bytes."""
    return np.unique(ngram_codes(encode(codes, words(text)), size))


def signature(own, factors, rows):
    """Band hashes of a non-empty shingle set."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 4_096):
        least = np.minimum(least, (own[at:at + 4_096, None] * factors[None, :]).min(axis=0))
    return ngram_codes_rows(least.reshape(-1, rows))


def ngram_codes_rows(values):
    """One code per row; the row's number is part of it, so bands never mix."""
    out = np.arange(len(values), dtype=np.uint64)
    for i in range(values.shape[1]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + values[:, i])
    return out.view(np.int64)


def sign(docs: DataFrame, threshold: float = THRESHOLD, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """doc_id, codes of the text and of its set (128 bits), set size and band hashes per row."""
    factors, codes = multipliers(bands_for(threshold, RECALL, rows) * rows), Codes()

    def run(batch):
        out = [[] for _ in range(3)]
        for text, plain in zip(text_bytes(batch.column(2)), batch.column(1).to_pylist()):
            own = shingles(text, codes, size)
            whole = hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else plain
            for column, value in zip(out, (whole, len(own), signature(own, factors, rows) if len(own) else [])):
                column.append(value)
        return [batch.column(0), batch.column(1), *out]
    return map_arrow(keyed(docs), run, SIGNED)


def text_code():
    return F.unhex(F.md5(F.col("text").cast("string").cast("binary")))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_code, text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_code().alias("text_code"),
                       F.col("text").cast("string").alias("text"))


def sets(signed: DataFrame) -> DataFrame:
    """One row per distinct set: set_code, n, band, weight (distinct texts), rep (doc_id, text_code)."""
    texts = signed.filter("set_code IS NOT NULL").groupBy("set_code", "text_code").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("band").alias("band"))
    return texts.groupBy("set_code").agg(
        F.count(F.lit(1)).alias("weight"), F.first("n").alias("n"), F.first("band").alias("band"),
        F.min(F.struct("text_code", "doc_id")).alias("rep"))


def candidates(own: DataFrame, n_bands: int, block: int) -> DataFrame:
    """One row per member and pair of blocks of the buckets that are looked at: band_no, bucket,
    left, right (block numbers), mine (the member's block), set_code."""
    flat = own.filter("n > 0").select("set_code", F.posexplode("band").alias("band_no", "bucket"))
    many = flat.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    members = flat.join(many, "bucket").join(own.select("set_code", "band"), "set_code")
    known = cut_lineage(members)
    same = [F.when(F.min(F.col("band")[i]) == F.max(F.col("band")[i]), F.lit(i)) for i in range(n_bands)]
    first = F.array_min(F.array_compact(F.array(*same)))  # the first band in which all members meet
    fresh = known.groupBy("bucket").agg(first.alias("met"), F.first("band_no").alias("at")).filter("met = at or met IS NULL")
    n_blocks = F.ceil(F.col("members") / F.lit(block)).cast("int")
    placed = (known.join(fresh.select("bucket"), "bucket")
              .withColumn("blocks", n_blocks)
              .withColumn("mine", F.pmod(F.xxhash64("set_code"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    return placed.select("band_no", "bucket", F.least("mine", "other").alias("left"),
                         F.greatest("mine", "other").alias("right"), "mine", "set_code")


def with_sets(docs: DataFrame, own: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """set_code, n, weight, band and the shingles (sorted codes as bytes) of the wanted sets."""
    reps = own.join(wanted.select("set_code").distinct(), "set_code").select(
        "set_code", "n", "weight", "band", F.col("rep.doc_id").alias("__id"), F.col("rep.text_code").alias("__code"))
    codes = Codes()
    found = keyed(docs).join(reps, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_code") == F.col("__code")))

    def run(batch):
        return [*batch.columns[:4], [shingles(t, codes, size).tobytes() for t in text_bytes(batch.column(4))]]
    return map_arrow(found.select("set_code", "n", "weight", "band", "text"), run,
                     "set_code binary, n int, weight long, band array<long>, shingle binary")


class _Forest:
    """Roots of members that were linked."""

    def __init__(self, n):
        self.up = list(range(n))

    def root(self, i):
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i


def verify(group, band_no, across, threshold):
    """Links of one group: (set_code, links, to) of every linked member.

    `group`: a list of (mine, set_code, weight, band, shingles), each member once; pairs are
    taken across its two blocks, or within its only one.
    """
    n = len(group)
    mine = np.array([g[0] for g in group])
    size = np.array([len(g[4]) for g in group], np.int64)
    pair = np.triu(np.ones((n, n), bool), 1)
    if across:
        pair &= mine[:, None] != mine[None, :]
    if band_no:
        early = np.array([g[3][:band_no] for g in group], np.int64)
        for k in range(band_no):
            pair &= early[:, None, k] != early[None, :, k]
    pair &= np.minimum(size[:, None], size[None, :]) >= threshold * np.maximum(size[:, None], size[None, :])
    pair |= pair.T
    busy = np.flatnonzero(pair.any(axis=1))
    if not len(busy):
        return []
    group, size, pair, n = [group[i] for i in busy], size[busy], np.triu(pair[np.ix_(busy, busy)]), len(busy)
    common = _common(group) if n > 8 else None
    links, forest, to = np.zeros(n, np.int64), _Forest(n), {}
    weight = [g[2] for g in group]
    for i, j in zip(*np.nonzero(pair)) if common is None else zip(*np.nonzero(
            pair & (common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9))):
        if common is None:
            both = len(np.intersect1d(group[i][4], group[j][4], assume_unique=True))
            if both < threshold * (size[i] + size[j] - both) - 1e-9:
                continue
        links[i] += weight[j]
        links[j] += weight[i]
        a, b = forest.root(int(i)), forest.root(int(j))
        if a != b:
            forest.up[b] = a
            to[b] = a
    return [(group[i][1], int(links[i]), group[to[i]][1] if i in to else None) for i in range(n) if links[i]]


def _common(group):
    """Sizes of the members' intersections, as sums of products over slices of the shingles."""
    n = len(group)
    member = np.repeat(np.arange(n), [len(g[4]) for g in group])
    codes = np.concatenate([g[4] for g in group])
    order = np.argsort(codes, kind="stable")
    codes, member = codes[order], member[order]
    column = np.cumsum(np.r_[False, codes[1:] != codes[:-1]])
    count = np.bincount(column)
    shared = count[column] > 1
    column = (np.cumsum(count > 1) - 1)[column[shared]]
    member, out = member[shared], np.zeros((n, n), np.float32)
    width = max(1, (1 << 22) // n)
    edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 1 + width, width))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        if a < b:
            part = np.zeros((n, width), np.float32)
            part[member[a:b], column[a:b] - k * width] = 1.0
            out += part @ part.T
    return np.rint(out).astype(np.int64)


def links(docs: DataFrame, own: DataFrame, threshold: float, rows: int, size: int, block: int) -> DataFrame:
    """set_code, links, to: a row per linked member and group."""
    spark = docs.sparkSession
    wanted = cut_lineage(candidates(own, bands_for(threshold, RECALL, rows), block))
    full = with_sets(docs, own, wanted, size)
    key = ["bucket", "left", "right"]
    placed = (wanted.join(full, "set_code")
              .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *key)
              .sortWithinPartitions(*key, "set_code")
              .select(*key, "band_no", "mine", "set_code", "weight", "band", "shingle"))
    kind = "set_code binary, links long, to binary"
    names = ["set_code", "links", "to"]
    types = [pa.binary(), pa.int64(), pa.binary()]

    def run(batches):
        now, group, band_no, last = None, [], 0, None

        def rows_of(found):
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*found), types)], names=names)
        held = []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(8)]
            for i, (bucket, left, right, no, mine, code, weight, band) in enumerate(zip(*columns)):
                if (bucket, left, right) != now:
                    if len(group) > 1:
                        held += verify(group, band_no, now[1] != now[2], threshold)
                    now, group, band_no, last = (bucket, left, right), [], no, None
                if code != last:  # equal rows of a representative come once
                    last = code
                    group.append((mine, code, weight, band,
                                  np.frombuffer(batch.column(8)[i].as_buffer(), np.uint64).copy()))
            if held:
                yield rows_of(held)
                held = []
        if len(group) > 1:
            held = verify(group, band_no, now[1] != now[2], threshold)
        if held:
            yield rows_of(held)
    return cut_lineage(placed.mapInArrow(run, kind))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, rows: int = ROWS, size: int = SHINGLE,
                    block: int = BLOCK) -> DataFrame:
    """doc_id, text_code, class_root (a set's code, equal in a class; null for null texts), class_id and n_links
    (other distinct texts linked to it) of every row of `docs` (doc_id, text)."""
    signed = cut_lineage(sign(docs, threshold, rows, size))
    own = cut_lineage(sets(signed))
    found = links(docs, own, threshold, rows, size, block)
    counts = found.groupBy("set_code").agg(F.sum("links").alias("links"))
    roots = components(found.filter("to IS NOT NULL").select(F.col("set_code").alias("u"), F.col("to").alias("v")))
    grouped = (own.select("set_code", "weight").join(roots.withColumnRenamed("node", "set_code"), "set_code", "left")
               .join(counts, "set_code", "left")
               .select("set_code", F.coalesce("root", "set_code").alias("root"),
                       (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    member = signed.select("doc_id", "text_code", "set_code").join(cut_lineage(grouped), "set_code", "left")
    member = cut_lineage(member)
    ids = member.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return member.join(ids, "root", "left").select(
        "doc_id", "text_code", F.col("root").alias("class_root"), F.coalesce("class_id", F.when(F.col("root").isNull(), F.col("doc_id"))).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"))


def report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class of `docs`, with all columns: the one with the least id, of these the one with the
    least hash of its text, of equal rows any. Rows without an id come last in their class; every null text
    stays, as it is a class of its own."""
    key = ["__id", "__code"]
    found = cut_lineage(near_duplicates(docs).filter("class_root IS NOT NULL")
                        .groupBy(F.col("doc_id").alias("__id"), F.col("text_code").alias("__code"), "class_root")
                        .agg(F.count(F.lit(1)).alias("__times")))
    least = F.min(F.struct(F.col("__id").isNull().alias("none"), *key)).alias("least")
    first = cut_lineage(found.groupBy("class_root").agg(least).select("least.__id", "least.__code"))

    def same(a, b):
        return a["__id"].eqNullSafe(b["__id"]) & (a["__code"] == b["__code"])
    twice = found.filter("__times > 1").join(first, same(found, first), "left_semi").select(*key)
    gone = found.join(first, same(found, first), "left_anti").select(*key).union(twice)
    named = docs.withColumn("__own", F.col("doc_id").cast("long")).withColumn("__text", text_code())
    mine = F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__code"))
    again = named.join(twice, mine, "left_semi").dropDuplicates(["__own", "__text"])
    return named.join(gone, mine, "left_anti").union(again).drop("__own", "__text")
