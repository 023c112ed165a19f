"""Small tables for the corpus operators."""

import random

from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()),
                   StructField("lang", StringType()), StructField("source", StringType()),
                   StructField("n_chars", LongType())])
#: Columns whose names operators use inside or return.
CLASHES = ["pos", "n", "h", "rate", "row", "block", "found", "word", "f", "kept", "host", "set_code", "domain"]


def docs(spark, rows, more=()):
    """`rows`: (doc_id, text) or (doc_id, text, source); `more`: extra columns, filled with 'x'."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
    frame = spark.createDataFrame(full, DOCS)
    for name in more:
        frame = frame.selectExpr("*", f"'x' AS {name}")
    return frame


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def prose(seed, n, vocabulary=400):
    """n words of invented prose, the same for the same seed."""
    r = random.Random(seed)
    parts = "ba be bo da de do ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to".split()
    names = ["".join(random.Random(i).choice(parts) for _ in range(2 + i % 3)) for i in range(vocabulary)]
    return " ".join(r.choice(names) for _ in range(n))


def awkward():
    """Nulls, empty and blank texts, a very long one, ties and repeated rows."""
    long = "\n".join(prose(i, 200) for i in range(60))
    return [(None, prose(1, 80)), (1, None), (1, None), (2, ""), (3, " \n\t \n"), (4, long), (5, prose(2, 30)),
            (5, prose(2, 30)), (6, "one"), (7, "é" * 5000), (None, None), (8, prose(3, 70) + "\n" + prose(4, 70))]
