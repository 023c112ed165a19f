"""Benchmark decontamination over a distributed positional inverted index.

`build_index` stores the postings of the training text: one row per block of documents
with the ascending word positions of every term. A block holds whole documents, laid one
after the other with a gap, so positions of different documents never form a phrase.
`find_matches` orders the terms of every test window by their frequency in the whole
index and intersects the offset-adjusted lists, the rarest term first; blocks work apart
and nothing is shuffled but one row per document. Test items pass in chunks of a fixed
number of words, so what a task holds of them is bounded whatever the benchmark's size.

An index for known test items needs postings of their terms only. The terms are passed as
a bit set of fixed size (`FILTER_BITS`); a term let in by mistake only adds postings.

Defined results: null and empty texts have no words and no hits; an empty table gives an
empty result, a benchmark without words gives rows without hits; repeated rows give one
row each; items with equal id or text are told apart by their place, their ids are
returned once.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import Codes, map_arrow, text_bytes, words
from parley.session import cut_lineage

FILTER_BITS = 1 << 23
BLOCK_WORDS = 1 << 20
CHUNK_WORDS = 200_000
GAP = 1 << 16

ITEM = "item_id string, __place long, __terms array<binary>"
INDEX = ("block long, doc_id array<long>, text_code array<long>, start array<long>, n_words array<long>, term array<binary>, "
         "n_postings array<int>, postings binary")
MATCH = "block long, row int, doc_id long, text_code long, n_words long, item array<string>, near array<string>, " \
        "span array<struct<a:long,b:long>>"


def item_words(items: DataFrame) -> DataFrame:
    """item_id as string, its place in the table and its words."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"),
                        F.monotonically_increasing_id().alias("place"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, lambda b: [b.column(0), b.column(1), [words(t) for t in text_bytes(b.column(2))]], ITEM)


def term_filter(items: DataFrame):
    """Bits of the terms' hashes: a fixed number of 64-bit words, whatever the number of terms."""
    bit = F.pmod(F.crc32("term"), F.lit(FILTER_BITS))
    rows = (items.select(F.explode("__terms").alias("term")).select(bit.alias("bit")).distinct()
            .groupBy(F.floor(F.col("bit") / 8).alias("at"))
            .agg(F.sum(F.expr("shiftleft(1, int(bit % 8))")).cast("int").alias("bits")))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for at, bits in rows.collect():  # at most FILTER_BITS / 8 rows
        out[at] = bits
    return out.tobytes()


class _Terms(Codes):
    """Term to its number in the block, or -1 for a term outside the filter. Forgetting words
    when it is full costs a lookup only: a term keeps its number until the block ends."""

    def __init__(self, bits):
        self.bits, self.numbers = bits, {}

    def code(self, word):
        bit = zlib.crc32(word) % FILTER_BITS
        if self.bits is not None and not self.bits[bit >> 3] >> (bit & 7) & 1:
            return -1
        return self.numbers.setdefault(word, len(self.numbers))

    def end_block(self):
        self.clear()
        self.numbers = {}


def _block(ids, keys, texts, terms):
    """Postings of a block as the columns of one index row, without its number."""
    starts, sizes, found, where, at = [], [], [], [], 0
    for text in texts:
        tokens = words(text)
        n = len(tokens)
        codes = np.fromiter(map(terms.__getitem__, tokens), np.int64, n)
        keep = np.flatnonzero(codes >= 0)
        found.append(codes[keep])
        where.append(keep + at)
        starts.append(at)
        sizes.append(n)
        at += n + GAP
    codes, where = np.concatenate(found), np.concatenate(where)
    order = np.argsort(codes, kind="stable")
    codes, where = codes[order], where[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[first, len(codes)])
    step = np.diff(where, prepend=0)
    if len(first):
        step[first] = where[first]
    known = list(terms.numbers)
    names = [known[c] for c in codes[first]]
    return ids, keys, starts, sizes, names, counts.tolist(), step.astype("<i8").tobytes()


def build_index(docs: DataFrame, bits=None) -> DataFrame:
    """The positional index of `docs` (doc_id, text) as a table in the shared folder.

    `bits`: the filter of `term_filter`; None stores the postings of every term. A list is
    stored as steps from position to position; a block ends after BLOCK_WORDS words and
    holds at least one whole document.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    kind = StructType.fromDDL(INDEX)
    arrow = to_arrow_schema(kind)
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.xxhash64(F.col("text").cast("string")).alias("code"), F.spark_partition_id().alias("part"))

    def run(batches):
        terms, ids, keys, texts, size, number = _Terms(shared.value), [], [], [], 0, 0

        def row(part):
            columns = _block(ids, keys, texts, terms)
            return pa.RecordBatch.from_arrays(
                [pa.array([value], f.type) for value, f in zip(((part << 32) + number, *columns), arrow)],
                schema=arrow)
        part = 0
        for batch in batches:
            for key, text, code, part in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)),
                                             batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                ids.append(key)
                keys.append(code)
                texts.append(text)
                size += len(text or b"") // 6 + 1
                if size >= BLOCK_WORDS:
                    yield row(part)
                    terms.end_block()
                    ids, keys, texts, size, number = [], [], [], 0, number + 1
        if ids:
            yield row(part)
    return cut_lineage(rows.mapInArrow(run, kind))


def term_counts(index: DataFrame) -> DataFrame:
    """Postings per term of the whole index: term, n."""
    return (index.select(F.explode(F.arrays_zip("term", "n_postings")).alias("p"))
            .groupBy(F.col("p.term").alias("term")).agg(F.sum("p.n_postings").alias("n")))


def item_windows(items: DataFrame, counts: DataFrame, size: int) -> DataFrame:
    """Windows of the items with the total frequency of every word: item_id, __terms, n (per word)."""
    at = items.select("item_id", "__place", F.posexplode("__terms").alias("at", "term"))
    known = at.join(counts, "term", "left").groupBy("__place").agg(
        F.first("item_id").alias("item_id"),
        F.sort_array(F.collect_list(F.struct("at", "term", F.coalesce("n", F.lit(0)).alias("n")))).alias("w"))
    return known.select("item_id", F.col("w.term").alias("__terms"), F.col("w.n").alias("n"))


def _chunks(items, size):
    """Items in lists of at most CHUNK_WORDS words, or one item; windows as (offset, term) by rarity."""
    chunk, held = {}, 0
    for item, terms, counts in items.toLocalIterator():
        terms = [bytes(t) for t in terms]
        for at in range(max(1, len(terms) - size + 1)):
            own = terms[at:at + size]
            key = tuple(own)
            if key not in chunk:
                order = sorted(range(len(own)), key=lambda i: (counts[at + i], i))
                chunk[key] = ([(i, own[i]) for i in order], min(counts[at:at + size]), set())
                held += len(own)
            chunk[key][2].add(item)
        if held >= CHUNK_WORDS * size:
            yield _packed(chunk)
            chunk, held = {}, 0
    if chunk:
        yield _packed(chunk)


def _packed(chunk):
    """Windows that can occur; a term without postings rules one out for phrase and proximity alike."""
    return [(order, len(order), sorted(items, key=str)) for order, least, items in chunk.values() if least]


def _phrase(lists, order):
    """Starts of the exact occurrences: offset-adjusted lists, the rarest first."""
    offset, term = order[0]
    starts = lists[term] - offset
    for offset, term in order[1:]:
        if not len(starts):
            break
        own = lists[term]
        at = np.searchsorted(own, starts + offset)
        at[at == len(own)] = 0
        starts = starts[own[at] == starts + offset]
    return starts


def _proximity(lists, order, slop):
    """Positions of the rarest term that have every other term of the window within `slop` words."""
    centre = lists[order[0][1]]
    for term in dict.fromkeys(t for _, t in order[1:]):
        if not len(centre):
            break
        own = lists[term]
        at = np.searchsorted(own, centre - slop)
        centre = centre[(at < len(own)) & (own[np.minimum(at, len(own) - 1)] <= centre + slop)]
    return centre


def _matches(row, windows, slop):
    """Rows of MATCH for the documents of one index row."""
    starts = np.array(row["start"], np.int64)
    sizes = np.array(row["n_words"], np.int64)
    ends = np.cumsum(row["n_postings"]) if row["n_postings"] else np.zeros(0, np.int64)
    steps = np.frombuffer(row["postings"], "<i8")
    place = {t: i for i, t in enumerate(row["term"])}

    class Lists(dict):
        def __missing__(self, term):
            i = place[term]
            self[term] = out = np.cumsum(steps[ends[i] - row["n_postings"][i]:ends[i]])
            return out
    lists, spans, exact, near = Lists(), {}, {}, {}
    for order, size, items in windows:
        if any(t not in place for _, t in order):
            continue
        if slop is not None:
            for d in np.unique(np.searchsorted(starts, _proximity(lists, order, slop), "right") - 1).tolist():
                near.setdefault(d, set()).update(items)
        hits = _phrase(lists, order)
        for d, s in zip((np.searchsorted(starts, hits, "right") - 1).tolist(), hits.tolist()):
            spans.setdefault(d, []).append((s - int(starts[d]), s - int(starts[d]) + size))
            exact.setdefault(d, set()).update(items)
    text = lambda found, d: sorted(i for i in found.get(d, ()) if i is not None)
    return [(row["block"], d, row["doc_id"][d], row["text_code"][d], int(sizes[d]), text(exact, d), text(near, d), _merged(spans.get(d, ())))
            for d in range(len(starts))]


def _merged(spans):
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1]["b"]:
            out[-1]["b"] = max(out[-1]["b"], b)
        else:
            out.append({"a": a, "b": b})
    return out


def find_matches(index: DataFrame, items: DataFrame, size: int = 10, slop: int | None = 15) -> DataFrame:
    """One row per document of the index: doc_id, n_words, span (merged word ranges of exact
    occurrences), item (ids with an exact occurrence), near (ids of which a window's terms lie
    within `slop` words of its rarest one; None looks for no proximity matches).

    `items`: from `item_words`. A window is `size` consecutive words of an item; a shorter
    item that has words is one window.
    """
    spark = index.sparkSession
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    kind = StructType.fromDDL(MATCH)
    arrow = to_arrow_schema(kind)

    def matcher(shared):
        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    found = _matches(row, shared.value, slop)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(c), f.type) for c, f in zip(zip(*found), arrow)], schema=arrow)
        return run
    out = None
    for chunk in _chunks(item_windows(items, term_counts(index), size), size):
        part = index.mapInArrow(matcher(spark.sparkContext.broadcast(chunk)), kind)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = index.mapInArrow(matcher(spark.sparkContext.broadcast([])), kind)
    joined = out.groupBy("block", "row").agg(
        F.first("doc_id").alias("doc_id"), F.first("text_code").alias("text_code"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item")))).alias("item"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"),
        F.array_sort(F.flatten(F.collect_list("span"))).alias("span"))
    return joined.select("block", "row", "doc_id", "text_code", "n_words", "item", "near", "span")


def covered_words(span):
    """Number of words in the union of sorted ranges."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(span, zero, lambda acc, s: F.struct(
        (acc["n"] + F.greatest(s["b"] - F.greatest(s["a"], acc["end"]), F.lit(0).cast("long"))).alias("n"),
        F.greatest(acc["end"], s["b"]).alias("end")), lambda acc: acc["n"])


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, slop: int | None = 15) -> DataFrame:
    """Index of the items' terms over `docs`, then the matches of `items` (item_id, text) in it."""
    held = cut_lineage(item_words(items))
    return find_matches(build_index(docs, term_filter(held)), held, size, slop)


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; n_near: items with a proximity match."""
    found = decontaminate(docs, items).withColumn("n_hit", covered_words(F.col("span")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item").cast("long").alias("n_items"),
        F.sha2(F.array_join("item", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), F.size("near").cast("long").alias("n_near"))


def remove_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs` without an exact occurrence of a test window; all columns stay."""
    hit = decontaminate(docs, items, slop=None).filter(F.size("span") > 0)
    bad = hit.select(F.col("doc_id").alias("__id"), F.col("text_code").alias("__code")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__code"))
    return docs.join(bad, same, "left_anti")
