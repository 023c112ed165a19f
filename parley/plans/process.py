"""From recognizer output to stored transcripts, voices, names and statistics, as one job.

A run processes a batch of meetings in stages. Each stage is staged in the meeting store under the
run's name, so a run that is started again after a failure goes on behind the last stage that was
written whole. Nothing is seen by readers until all tables of the run are published together.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import audio, catalog, echo, speakers, stats, turns
from parley.plans import transcript
from parley.sources import recognizer, store

TRACK = ["meeting_id", "track"]
#: Tables that readers see; the other stages are the run's own.
TABLES = ["tracks", "segments", "voice_windows", "speakers", "turns", "speaker_stats", "fillers", "meetings"]
#: Fixed value: how the warning about echo begins; it is made anew by every run.
ECHO_WARNING = "Mic audio contained speaker echo"


class Run:
    """Named stages of a batch; a stage that has been written is read, not made again."""

    def __init__(self, spark: SparkSession, path: str, name: str):
        self.spark, self.path, self.name = spark, path, name

    def stage(self, table: str, make: Callable[[], DataFrame]) -> DataFrame:
        if store.staged(self.path, self.name, table) is None:
            store.stage(make(), self.path, table, self.name)
        return store.read_staged(self.spark, self.path, self.name, table)

    def publish(self, ids: DataFrame) -> int:
        return store.publish(self.spark, self.path, self.name, TABLES, ids)


def process(spark: SparkSession, path: str, name: str, output: DataFrame, meetings: DataFrame, stopped: DataFrame,
            known: DataFrame, embed: Callable[[DataFrame], DataFrame], **options) -> int:
    """Runs or resumes the run `name` on the store `path`; returns the published version.

    `output`: what the recognizer gave (meeting_id, track, part, output JSON, times from the track's
    own start). `meetings`: meeting_id, mode, expected_speakers, warnings and whatever else a
    meeting row has. `stopped`, `known`: the recorder's report per track and the devices known
    before (see `align_tracks`). `embed` adds `embedding` to speech windows. `options` go to the
    clustering. All rows of these meetings in the store are replaced, names given to speakers are
    kept where the labels are the same.
    """
    run = Run(spark, path, name)
    ids = meetings.select("meeting_id")
    tracks = run.stage("tracks", lambda: audio.align_tracks(known, stopped))

    heard = run.stage("heard", lambda: audio.shift_segments(recognizer.ingest_segments(output), tracks).drop("no_speech_prob"))
    decided = run.stage("decided", lambda: transcript.clean_segments(heard, meetings))
    kept = run.stage("segments", lambda: decided.filter("action <> 'drop'").drop("action"))

    # the model sees each window once, however often the clustering reads it
    windows = run.stage("windows", lambda: embed(speakers.speech_windows(transcript.shared_tracks(kept, meetings))))
    voices = run.stage("voice_windows", lambda: transcript.voices(windows, meetings, **options))
    labelled = run.stage("labelled", lambda: speakers.label_tracks(transcript.label_segments(kept, voices), meetings))
    said = run.stage("turns", lambda: turns.build_turns(labelled))

    def named():
        found = speakers.speaker_list(labelled)
        old = store.read(spark, path, "speakers")
        return found if old is None else speakers.carry_names(found, old)
    people = run.stage("speakers", named)
    run.stage("speaker_stats", lambda: stats.speaker_stats(said, people))
    run.stage("fillers", lambda: stats.filler_counts(said))
    run.stage("meetings", lambda: finished(meetings, tracks, decided, said, people))
    return run.publish(ids)


def finished(meetings: DataFrame, tracks: DataFrame, decided: DataFrame, said: DataFrame, people: DataFrame) -> DataFrame:
    """The meeting rows after a run: done, with warnings made anew, languages, duration and totals."""
    report = echo.echo_report(decided.filter("track = 'mic'")).select("meeting_id", F.col("warning").alias("_echo"))
    recorded = tracks.groupBy("meeting_id").agg(
        F.max("duration_ms").alias("duration_ms"), F.max("languages").alias("languages"))
    usual = meetings.drop("duration_ms", "languages", "duration", "n_turns", "spoken_seconds", "words").join(
        recorded, "meeting_id", "left")
    totals = stats.meeting_totals(said, people, usual.select("meeting_id", "duration_ms")).filter("is_total = 1").select(
        "meeting_id", "duration", F.col("turns").alias("n_turns"), "spoken_seconds", "words")
    rows = usual.join(report, "meeting_id", "left").join(totals, "meeting_id")
    fresh = F.array_compact(F.array("_echo"))
    return catalog.refresh_warnings(rows, fresh, (*catalog.REBUILT, ECHO_WARNING)).withColumn(
        "status", F.lit("done")).drop("_echo")
