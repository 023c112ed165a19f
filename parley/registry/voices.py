"""Queries over voice windows and their clusters."""

from pyspark.sql import functions as F

from parley.functions.vectors import norm, normalize
from parley.operators import diarize as V
from parley.operators import speakers
from parley.plans import transcript
from parley.sources import derived as D


def normalize_vectors(spark, sf):
    rows = D.table(spark, sf, "embeddings").withColumn("long", F.transform("embedding", lambda x: x * 3))
    return rows.select("vec_id", F.round(norm(F.col("long")), 4).alias("length"),
                       F.posexplode(normalize(F.col("long"))).alias("dim", "x")).select(
        "vec_id", "length", F.col("dim").cast("bigint").alias("dim"), F.round("x", 4).alias("x"))


def voice_centroids(spark, sf):
    rows = V.centroids(D.labelled_vectors(spark, sf))
    return rows.select("meeting_id", "label", "windows", "speech_ms", F.posexplode("centroid").alias("dim", "x")).select(
        "meeting_id", "label", "windows", "speech_ms", F.col("dim").cast("bigint").alias("dim"), F.round("x", 4).alias("x"))


def centroid_pairs(spark, sf):
    return V.closest_pairs(V.centroids(D.labelled_vectors(spark, sf))).select(
        "meeting_id", "a", "b", F.round("similarity", 4).alias("similarity"))


def cluster_tiny(spark, sf):
    return V.fold_tiny(V.centroids(D.labelled_vectors(spark, sf)), min_windows=4).select("meeting_id", "label", "into")


def diarize(spark, sf):
    return V.diarize(D.voice_windows(spark, sf)).select("meeting_id", "win_id", "label")


def speakers_found(spark, sf):
    return V.diarize(D.voice_windows(spark, sf)).groupBy("meeting_id").agg(
        F.count_distinct("label").alias("speakers"))


def recluster(spark, sf):
    return transcript.recluster(D.voice_windows(spark, sf), [1, 2, 3, 4, 5, 6]).select("meeting_id", "k", "win_id", "label")


def _inputs(spark, sf):
    said = D.segments(spark, sf)
    timed = F.transform("tokens", lambda w, i: F.struct(
        F.concat(F.lit(" "), w).alias("w"), (F.col("start_ms") + i * D.WORD_MS).alias("s_ms"),
        (F.col("start_ms") + (i + 1) * D.WORD_MS).alias("e_ms")))
    system = said.filter("track = 'system'").withColumn("words", timed)
    names = ["meeting_id", "track", "seg_id", "start_ms", "end_ms", "text", "words"]
    segments = system.select(*names).unionByName(D.echo_mic(spark, sf).select(*names))
    windows = D.speech_voices(spark, sf, speakers.speech_windows(segments))
    n = F.col("meeting_id").cast("bigint")
    meetings = D.modes(spark, sf).withColumn("expected_speakers", F.when(n % 5 == 0, 2))
    return segments, windows, meetings


def assemble(spark, sf):
    return transcript.transcript(transcript.assemble(*_inputs(spark, sf)))


QUERIES = {f.__name__: f for f in (
    normalize_vectors, voice_centroids, centroid_pairs, cluster_tiny, diarize, speakers_found, recluster, assemble)}

_MEANS = """means AS (
  SELECT (vec_id // 50)::VARCHAR AS meeting_id, label::BIGINT AS label, i AS dim, avg(embedding[i]::DOUBLE) AS x,
         count(*) AS windows, count(*) * 2000 AS speech_ms
  FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2, 3)"""
_LISTS = f"""{_MEANS},
c AS (SELECT meeting_id, label, any_value(windows) AS n, list(x ORDER BY dim) AS v FROM means GROUP BY 1, 2)"""

_TRUE = """truth AS (
  SELECT (vec_id // 50)::VARCHAR AS meeting_id, vec_id % 50 AS win_id, (vec_id // 5 + vec_id // 50) % 4 AS voice FROM embeddings),
firsts AS (SELECT meeting_id, voice, row_number() OVER (PARTITION BY meeting_id ORDER BY min(win_id)) - 1 AS label
           FROM truth GROUP BY 1, 2)"""

ORACLE = {
    "normalize_vectors": """WITH l AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: 9 * x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)
SELECT vec_id, round(n, 4) AS length, i - 1 AS dim, round(3 * embedding[i]::DOUBLE / n, 4) AS x FROM l, range(1, 65) r(i)""",
    "voice_centroids": f"WITH {_MEANS} SELECT meeting_id, label, windows, speech_ms, dim - 1 AS dim, round(x, 4) AS x FROM means",
    "centroid_pairs": f"""WITH {_LISTS},
u AS (SELECT meeting_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM c)
SELECT a.meeting_id, arg_max(a.label, list_dot_product(a.v, b.v)) AS a, arg_max(b.label, list_dot_product(a.v, b.v)) AS b,
       round(max(list_dot_product(a.v, b.v)), 4) AS similarity
FROM u a JOIN u b ON a.meeting_id = b.meeting_id AND a.label < b.label GROUP BY 1""",
    "cluster_tiny": f"""WITH {_LISTS}
SELECT s.meeting_id, s.label, CASE WHEN any_value(s.n) >= 4 OR count(b.label) = 0 THEN s.label
  ELSE arg_max(b.label, list_dot_product(s.v, b.v)) END AS into
FROM c s LEFT JOIN c b ON b.meeting_id = s.meeting_id AND b.n >= 4 GROUP BY 1, 2""",
    "diarize": f"WITH {_TRUE} SELECT meeting_id, win_id, label FROM truth JOIN firsts USING (meeting_id, voice)",
    "speakers_found": f"WITH {_TRUE} SELECT meeting_id, count(*) AS speakers FROM firsts GROUP BY 1",
}
