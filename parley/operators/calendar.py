"""Calendar entries around a moment, and what a recording takes from them."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN_BITS = 12  # a bin has 4096 seconds
LEAD_MIN = 15
MAX_SPEAKERS = 8


def events_of_days(events: DataFrame) -> DataFrame:
    """One row per event and day it touches; all-day entries are left out."""
    day = 86_400
    first, last = F.floor(F.col("start_s") / day), F.floor((F.col("end_s") - 1) / day)
    return events.filter(~F.col("all_day")).withColumn(
        "day", F.explode(F.sequence(first, F.greatest(first, last))))


def current_event(probes: DataFrame, events: DataFrame, keys: list[str], probe: str = "probe_id",
                  lead_min: int = LEAD_MIN) -> DataFrame:
    """The event running at `now_s`, or about to: the latest start among those with
    start - lead <= now < end, the first listed where starts are equal. All-day entries
    (`all_day`, where the table has it) are never current.

    An event is cut at the bounds of bins into a head, a tail and the bins between; one
    that lies inside a bin is cut by half bins, or halves of these, into head and tail. In
    a bin the best head is a running maximum over openings, the best tail one over ends
    from behind, and of the events that fill it only the best one counts. So no probe meets
    an event row by row, however many run at once, and a busy owner spreads over bins.
    """
    timed = events.filter(~F.coalesce("all_day", F.lit(False))) if "all_day" in events.columns else events
    event = F.struct("start_s", (-F.col("event_pos")).alias("_rank"), "event_pos", "title", "end_s")
    rows = timed.dropna(subset=keys).select(
        *keys, event.alias("_event"), (F.col("start_s") - lead_min * 60).cast("bigint").alias("_opens"),
        F.col("end_s").cast("bigint").alias("_end")).filter("_event.end_s > _event.start_s AND _end > _opens")
    rows = rows.withColumn("_size", _bin_size(F.col("_opens"), F.col("_end") - 1)).select(
        "*", _bin("_opens").alias("_first"), _bin(F.col("_end") - 1).alias("_last"))
    # one row: the sizes in use, each of which costs a row of every probe
    sizes = rows.agg(F.collect_set("_size").alias("_sizes"))

    at = [*keys, "_size", "_bin"]
    edge = lambda side, where, when: F.struct(F.lit(side).alias("side"), F.col(where).alias("bin"), F.col(when).alias("at"))
    edges = rows.withColumn("_e", F.explode(F.array(edge("head", "_first", "_opens"), edge("tail", "_last", "_end")))).filter(
        "_e.side = 'head' OR _last > _first").select(
        *keys, "_size", F.col("_e.bin").alias("_bin"), F.col("_e.at").alias("_at"), F.col("_e.side").alias("_side"), "_event")
    asked = probes.dropna(subset=[*keys, "now_s"]).select(
        *keys, F.col(probe).alias("_probe"), F.col("now_s").cast("bigint").alias("_at")).join(F.broadcast(sizes)).select(
        "*", F.explode("_sizes").alias("_size")).select("*", _bin("_at").alias("_bin"), F.lit("probe").alias("_side"))
    filled = rows.filter(F.col("_last") - F.col("_first") > 1).withColumn(
        "_bin", F.explode(F.sequence(F.col("_first") + 1, F.col("_last") - 1))).groupBy(*at).agg(
        F.max("_event").alias("_filled"))

    line = Window.partitionBy(*at)
    opened = line.orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    running = line.orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, -1)
    side = lambda name: F.when(F.col("_side") == name, F.col("_event"))
    met = edges.unionByName(asked.drop("_sizes"), allowMissingColumns=True).withColumn(
        "_head", F.max(side("head")).over(opened)).withColumn("_tail", F.max(side("tail")).over(running))
    best = met.filter("_side = 'probe'").join(filled, at, "left").groupBy(*keys, "_probe").agg(
        F.max(F.greatest("_head", "_tail", "_filled")).alias("_event")).filter("_event IS NOT NULL")
    return best.select(*keys, F.col("_probe").alias(probe), *[F.col(f"_event.{c}").alias(c) for c in (
        "event_pos", "title", "start_s", "end_s")])


def _bin(at) -> Column:
    """Number of the bin of `_size` seconds that a second lies in."""
    return F.floor((F.col(at) if isinstance(at, str) else at) / F.col("_size"))


def _bin_size(first: Column, last: Column) -> Column:
    """The largest bin, a full one or a half of one of the sizes above, that does not hold both seconds;
    one second where they are the same."""
    size = F.lit(1)
    for bits in range(BIN_BITS + 1):
        size = F.when(F.shiftright(first, bits) != F.shiftright(last, bits), 1 << bits).otherwise(size)
    return size.cast("bigint")


def expected_speakers(given: Column, attendees: Column, in_person: Column) -> Column:
    """1 to 8 speakers as asked for; else the attendees, plus the user in person."""
    asked = F.trim(given).try_cast("int")
    clamp = lambda n: F.greatest(F.least(n, F.lit(MAX_SPEAKERS)), F.lit(1)).cast("bigint")
    return F.coalesce(
        F.when(asked.isNotNull(), clamp(asked)),
        F.when(attendees > 0, clamp(attendees + F.when(in_person, 1).otherwise(0))))


def default_title(given: Column, event_title: Column, started: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(given), F.lit("")), F.nullif(event_title, F.lit("")),
                      F.concat(F.lit("Meeting "), F.date_format(started, "dd MMM yyyy, HH:mm")))
