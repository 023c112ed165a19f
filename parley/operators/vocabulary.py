"""Vocabulary for recognizers, attendee names, locales."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.constants import DEFAULT_VOCABULARY, VOCABULARY_CAP
from parley.functions.text import BLANKS, strip

TERM_CHARS = 80


def merge_terms(meetings: DataFrame, user_terms: DataFrame, names: DataFrame,
                defaults: list[str] = DEFAULT_VOCABULARY, cap: int = VOCABULARY_CAP) -> DataFrame:
    """User terms, then names, then defaults; each term once in its first spelling,
    the first `cap` per meeting. Inputs have meeting_id, pos, term. The defaults are added to
    each meeting's list of at most `cap` terms, so they never become rows that are sorted."""
    rows = None
    for rank, df in enumerate([user_terms, names]):
        part = df.select("meeting_id", F.struct(F.lit(rank).alias("rank"), F.col("pos").cast("bigint").alias("pos"))
                         .alias("at"), strip(F.col("term")).alias("term")).filter("term <> ''")
        rows = part if rows is None else rows.unionByName(part)
    once = rows.groupBy("meeting_id", F.lower("term").alias("key")).agg(
        F.min_by("term", "at").alias("term"), F.min("at").alias("at"))
    place = F.row_number().over(Window.partitionBy("meeting_id").orderBy("at"))
    own = once.withColumn("place", place).filter(F.col("place") <= cap).select(
        "meeting_id", F.struct("place", "key", "term").alias("own"), F.lit(False).alias("listed"))
    lists = own.unionByName(meetings.select("meeting_id", F.lit(True).alias("listed")), allowMissingColumns=True).groupBy(
        "meeting_id").agg(F.array_sort(F.collect_list("own")).alias("own"), F.max("listed").alias("listed"))
    first = {}
    for term in (t.strip(BLANKS) for t in defaults):
        first.setdefault(term.lower(), term)
    usual = F.array(*[F.struct(F.lower(F.lit(t)).alias("key"), F.lit(t).alias("term")) for t in first.values() if t]).cast(
        "array<struct<key:string,term:string>>")
    keys, terms = F.transform("own", lambda t: t["key"]), F.transform("own", lambda t: t["term"])
    more = F.transform(F.filter(usual, lambda t: ~F.array_contains("keys", t["key"])), lambda t: t["term"])
    found = lists.select("meeting_id", "listed", keys.alias("keys"), terms.alias("terms")).select(
        "meeting_id", F.posexplode(F.slice(F.when(F.col("listed"), F.concat("terms", more)).otherwise(F.col("terms")), 1, cap)).alias("i", "term"))
    return found.select("meeting_id", (F.col("i") + 1).cast("bigint").alias("place"),
                        F.substring("term", 1, TERM_CHARS).alias("term"))


def other_attendees(attendees: Column) -> Column:
    """Attendees (name, is_self) without the user; the last one goes where nobody is
    marked as the user."""
    others = F.filter(attendees, lambda a: ~a["is_self"])
    unmarked = (F.size(others) == F.size(attendees)) & (F.size(attendees) > 0)
    return F.when(unmarked, F.slice(others, 1, F.greatest(F.size(others) - 1, F.lit(0)))).otherwise(others)


def attendee_names(attendees: Column) -> Column:
    """Names in order, once each; blanks and bare addresses are left out."""
    names = F.transform(other_attendees(attendees), lambda a: strip(F.coalesce(a["name"], F.lit(""))))
    return F.array_distinct(F.filter(names, lambda n: (n != "") & ~F.contains(n, F.lit("@"))))
