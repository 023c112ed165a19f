"""Quality rules and the frequency of lines across the documents of a host.

One pass over the texts gives the base values of a document and a hash of each of its
normalised lines (lower case, single spaces). The lines are counted over the distinct
contents of each host, so exact copies count once. A line in more than
max(`min_docs`, `share` of the host's distinct contents) of them is removed, and a
document that keeps too little is rejected.

Defined results: null and empty texts have no words and fail the base rule; a null host
is a host of its own; a copy has the outcome of its text; an empty table gives none.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import Codes, covered, encode, map_arrow, ngram_codes, text_bytes
from parley.session import cut_lineage

STATS = ("row long, doc_id long, host string, content long, n_words long, word_chars long, n_symbols long, "
         "n_dup_lines long, n_repeat_words long, line array<struct<code:long,words:int>>")
#: White space and the continuation bytes of UTF-8: what is left counts the code points in words.
_NOT_COUNTED = b" \t\n\x0b\x0c\r" + bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"


def _measure(text, codes, lines, window):
    """Values of one text from n_words to line."""
    text = text or b""
    tokens, found, seen, duplicates = [], [], set(), 0
    for raw in text.split(b"\n"):
        own = raw.split()
        if not own:
            continue
        duplicates += raw in seen
        seen.add(raw)
        tokens += own
        found.append((lines[b" ".join(own).lower()] - (1 << 63), len(own)))
    repeated = 0
    if len(tokens) >= window:
        grams = ngram_codes(encode(codes, tokens), window)
        _, back, count = np.unique(grams, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(count[back] > 1)
        repeated = int(covered(starts, window, len(tokens)).sum()) if len(starts) else 0
    return (len(tokens), len(text.translate(None, _NOT_COUNTED)), len(text) - len(text.translate(None, _SYMBOLS)),
            duplicates, repeated, [{"code": c, "words": n} for c, n in found])


def measure(docs: DataFrame, host: str = "source", window: int = 8) -> DataFrame:
    """Base values and line hashes of every row of `docs` (doc_id, text, host)."""
    text = F.col("text").cast("string")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.col(host).cast("string").alias("host"), F.xxhash64(text).alias("content"),
                       text.alias("text"))
    codes, lines = Codes(), Codes()

    def values(batch):
        found = [_measure(t, codes, lines, window) for t in text_bytes(batch.column(4))]
        return [*batch.columns[:4], *(list(zip(*found)) if found else [[]] * 6)]
    return map_arrow(rows, values, STATS)


def frequent_lines(stats: DataFrame, min_docs: int, share: float) -> DataFrame:
    """host, code of the lines above the limit of their host."""
    distinct = stats.select("host", "content", F.array_distinct("line.code").alias("code"))
    distinct = distinct.dropDuplicates(["host", "content"])
    sizes = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("n_host"))
    counted = (distinct.select("host", F.explode("code").alias("code")).groupBy("host", "code")
               .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min_docs))
    sizes = sizes.withColumnRenamed("host", "__host")
    return (counted.join(sizes, F.col("host").eqNullSafe(F.col("__host")))
            .filter(F.col("n") > share * F.col("n_host")).select("host", "code"))


def judge(docs: DataFrame, host: str = "source", min_docs: int = 10, share: float = 0.02,
          min_words: int = 20, min_kept: float = 0.3) -> DataFrame:
    """Base values, words removed with frequent lines, and the verdict of every row.

    A document is depleted if less than `min_kept` of its words remain.
    """
    stats = cut_lineage(measure(docs, host))
    bad = frequent_lines(stats, min_docs, share).select(F.col("host").alias("__host"), F.col("code").alias("__code"))
    lines = stats.select("row", "host", F.explode("line").alias("line"))
    removed = (lines.join(bad, F.col("host").eqNullSafe(F.col("__host")) & (F.col("line.code") == F.col("__code")))
               .groupBy("row").agg(F.sum("line.words").alias("n_removed")))
    left = F.col("n_words") - F.col("n_removed")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    depleted = left < min_kept * F.col("n_words")
    return (stats.drop("line").join(removed, "row", "left").fillna(0, ["n_removed"])
            .withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted))


def report(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                              "n_removed", "base_failed", "kept")
