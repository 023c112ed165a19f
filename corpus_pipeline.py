"""The corpus pipeline: toxicity, line dedup, near duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its
result is written as Parquet and read again as the next stage's documents. All but the
last return the columns of documents; the last adds the token count, the likeliest domain
and the rate at which a document is to be drawn.
"""

from pyspark.sql import functions as F

from parley.llm import decontaminate, lines, mixing, near, toxicity
from parley.session import cut_lineage


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without_toxic(spark, docs, sf_dir):
    """Documents that the classifier chain finds toxic go."""
    return toxicity.remove_toxic(docs, _table(spark, sf_dir, "labels"))


def without_repeated_lines(spark, docs, sf_dir):
    """Later repeated runs of lines go; so do documents of which nothing else is left."""
    found = lines.dedup_lines(docs).withColumn("__touched", F.size("__gone") > 0)
    left = found.filter("NOT __touched OR trim(text) <> ''")
    if "n_chars" in docs.columns:
        count = F.length("text").cast(dict(docs.dtypes)["n_chars"])
        left = left.withColumn("n_chars", F.when(F.col("__touched"), count).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


def one_of_each_group(spark, docs, sf_dir):
    """Of each class of near duplicates the document with the least id stays."""
    return near.keep_one(docs)


def without_benchmark(spark, docs, sf_dir):
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.remove_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def with_rates(spark, docs, sf_dir):
    """Every document gets its rate; one with rate 0 is never drawn and goes."""
    return mixing.mix(docs, _table(spark, sf_dir, "labels")).filter("rate > 0")


STAGES = [("toxicity", without_toxic), ("line dedup", without_repeated_lines),
          ("n-gram Jaccard join", one_of_each_group), ("benchmark decontamination", without_benchmark),
          ("mixing sources to target weights", with_rates)]

#: Classifiers and iterations are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
