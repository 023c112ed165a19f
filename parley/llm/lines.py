"""Line dedup by winnowing over line hashes. DataFrame functions only.

A line is hashed after every run of Unicode white space in it (tabs and \\r too) became one
space, trimming and lower-casing. It has one word more than spaces inside; of scripts
without spaces every letter is a word. Lines of white space only are no part of the
sequence. From every line on, and up to every line, the shortest run of lines with at least
`min_words` words is a window; its smallest line hash is the window's fingerprint. A run of
that many words holds a whole window wherever it stands, so two equal runs are guaranteed a
common fingerprint. Occurrences of a fingerprint are joined with the first one that has the
same lines on both sides of it up to the window's ends; overlapping windows carry the match
on in both directions. All lines of a window that occurred before, in an earlier document or
further up, are deleted.

Documents are ordered by id, then by hashes of their text. Occurrences meet as counts and
minima, which are formed before the shuffle, so a line that stands everywhere is no hot
spot, and each later occurrence is compared with one row, never with all others.

Defined results: null and empty texts stay as they are; a null id comes first; rows with
equal id and text are one document and are changed alike; runs below `min_words` words
stay; blank lines inside a deleted run go with it; an empty table gives an empty one.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_WORDS = 50
#: White space other than the end of a line, and letters of scripts that are written without spaces.
_SPACE = r"\t\x0B\f\r\x1C-\x1F\x85\p{Z}"
_LETTER = (r"[\p{L}&&[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]]")


def line_rows(docs: DataFrame) -> DataFrame:
    """One row per line with words: __id, __key, pos, h, n (words)."""
    keyed = docs.select(F.col("doc_id").alias("__id"), _key(), F.col("text").cast("string").alias("text"))
    even = F.regexp_replace("text", f"[{_SPACE}&&[^ ]][{_SPACE}]*| [{_SPACE}]+", " ")
    split = keyed.select("__id", "__key", F.posexplode(F.split(even, "\n")).alias("pos", "line"))
    own = split.withColumn("line", F.trim("line")).filter("line <> ''")
    spaces = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "))) + 1
    each = F.size(F.regexp_extract_all("line", F.lit(rf"{_LETTER}[\p{{M}}\p{{P}}]*|(?:(?!{_LETTER})[^ ])+"), F.lit(0)))
    plain = (F.octet_length("line") == F.length("line")) | ~F.col("line").rlike(_LETTER)
    n = F.when(plain, spaces).otherwise(each)
    return own.select("__id", "__key", "pos", F.xxhash64(F.lower("line")).alias("h"), n.alias("n"))


def _key() -> Column:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.struct(F.xxhash64(text).alias("a"), F.hash(text).alias("b")).alias("__key")


def windows(lines: DataFrame, min_words: int) -> DataFrame:
    """Windows of at least `min_words` words: __id, __key, s, e (line positions), f (fingerprint),
    l, r (lines before and after it) and q (hash of the lines in order)."""
    lines = lines.dropDuplicates(["__id", "__key", "pos"])
    doc = Window.partitionBy("__id", "__key")
    lines = (lines.withColumn("i", F.row_number().over(doc.orderBy("pos")))
             .withColumn("z", F.sum("n").over(doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("a", F.col("z") - F.col("n")))
    forward = doc.orderBy("a").rangeBetween(0, min_words - 1)
    backward = doc.orderBy("z").rangeBetween(1 - min_words, 0)
    each = F.struct("h", "i", "pos")
    for name, over in (("x", forward), ("y", backward)):
        lines = (lines.withColumn(name, F.collect_list(each).over(over))
                 .withColumn(name + "n", F.sum("n").over(over)))
    both = F.array(F.struct(F.col("x").alias("w"), F.col("xn").alias("n")),
                   F.struct(F.col("y").alias("w"), F.col("yn").alias("n")))
    runs = (lines.select("__id", "__key", F.explode(F.array_distinct(both)).alias("v")).filter(f"v.n >= {min_words}")
            .select("__id", "__key", F.col("v.w").alias("w"), F.array_min("v.w").alias("m")))
    return runs.select(
        "__id", "__key", F.expr("w[0].pos").alias("s"), F.expr("w[size(w) - 1].pos").alias("e"),
        F.col("m.h").alias("f"), F.expr("m.i - w[0].i").alias("l"), F.expr("w[size(w) - 1].i - m.i").alias("r"),
        F.xxhash64("w.h").alias("q"))


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """__id, __key and gone: the positions of the lines to delete, sorted."""
    found = windows(line_rows(docs), min_words)
    match = ["f", "l", "r", "q"]
    first = (found.groupBy(*match).agg(F.min(F.struct("__id", "__key", "s")).alias("first"), F.count("s").alias("n"))
             .filter("n > 1").drop("n"))
    later = (found.join(first, match)
             .filter(~F.struct("__id", "__key", "s").eqNullSafe(F.col("first"))))
    at = later.select("__id", "__key", F.explode(F.sequence("s", "e")).alias("pos"))
    return at.groupBy("__id", "__key").agg(F.array_sort(F.collect_set("pos")).alias("gone"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of `docs` (doc_id, text) with all their columns, the text without the deleted
    lines, and __gone: the positions of these lines, empty where there are none."""
    rows = docs.withColumn("__key", _key().getField("a")).withColumn("__key2", _key().getField("b"))
    gone = repeated_lines(docs, min_words).select(
        "__id", F.col("__key.a").alias("__a"), F.col("__key.b").alias("__b"), F.col("gone").alias("__found"))
    same = (F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__a"))
            & (F.col("__key2") == F.col("__b")))
    # The outer transform binds the split text once.
    kept = F.expr("""transform(array(split(text, '\n')), t -> array_join(
                     transform(array_except(sequence(0, size(t) - 1), __found), i -> t[i]), '\n'))[0]""")
    return (rows.join(gone, same, "left")
            .withColumn("text", F.when(F.col("__found").isNull(), F.col("text")).otherwise(kept))
            .withColumn("__gone", F.coalesce("__found", F.array().cast("array<int>")))
            .select(*docs.columns, "__gone"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_deleted, deleted (positions, comma-joined) and the text that is left."""
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split(F.col("text"), "\n")))
    rows = dedup_lines(docs.select("doc_id", "text", n.cast("long").alias("n_lines")))
    return rows.select("doc_id", "n_lines", F.size("__gone").cast("long").alias("n_deleted"),
                       F.array_join(F.col("__gone").cast("array<string>"), ",").alias("deleted"), "text")


#: The same rows by SQL: a window is repeated if the same lines stand in an earlier place. It knows
#: words between single spaces only, so it holds for texts like those of the given tables.
ORACLE = f"""
WITH l AS (
  SELECT doc_id, text, pos - 1 AS pos, trim(line) AS h
  FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS pos
        FROM (SELECT DISTINCT doc_id, text FROM documents))),
m AS (SELECT doc_id, text, pos, lower(h) AS h, length(h) - length(replace(h, ' ', '')) + 1 AS n FROM l WHERE h <> ''),
c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, text ORDER BY pos) AS z FROM m),
f AS (SELECT doc_id, text, pos, list(h) OVER a AS w, sum(n) OVER a AS n, pos AS s, max(pos) OVER a AS e FROM c
      WINDOW a AS (PARTITION BY doc_id, text ORDER BY z - n RANGE BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING)
      UNION ALL
      SELECT doc_id, text, pos, list(h) OVER a, sum(n) OVER a, min(pos) OVER a, pos FROM c
      WINDOW a AS (PARTITION BY doc_id, text ORDER BY z RANGE BETWEEN {MIN_WORDS - 1} PRECEDING AND CURRENT ROW)),
d AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS k
      FROM (SELECT DISTINCT doc_id, text, w, s, e FROM f WHERE n >= {MIN_WORDS})),
g AS (SELECT DISTINCT doc_id, text, unnest(generate_series(s, e)) AS pos FROM d WHERE k > 1),
t AS (SELECT doc_id, text, list(pos ORDER BY pos) AS gone FROM g GROUP BY doc_id, text)
SELECT o.doc_id, coalesce(len(string_split(o.text, chr(10))), 0) AS n_lines, coalesce(len(gone), 0) AS n_deleted,
       coalesce(list_aggregate(gone, 'string_agg', ','), '') AS deleted,
       CASE WHEN gone IS NULL THEN o.text ELSE coalesce(array_to_string(list_transform(list_filter(
         generate_series(0, len(string_split(o.text, chr(10))) - 1), lambda i: NOT list_contains(gone, i)),
         lambda i: string_split(o.text, chr(10))[i + 1]), chr(10)), '') END AS text
FROM documents o LEFT JOIN t ON o.doc_id = t.doc_id AND o.text = t.text
"""
