"""Token counts: exact round trip through flat files, and blocks of every size."""

import os

import numpy as np
import pytest
from fixtures import CLASHES, awkward, docs, prose

from parley.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.RANKS), reason="no tokenizer files")


def encode(text):
    with open(tokens.RANKS, "rb") as file:
        return tokens.tokenizer(file.read()).encode_ordinary(text) if text else []


def test_counts(spark):
    rows = awkward() + [(-3, "<|endoftext|> P P"), (1 << 62, "x"), (-(1 << 62), "\n\n\t  y")]
    got = tokens.count_tokens(docs(spark, rows, CLASHES).repartition(3)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(((k, len(encode(t))) for k, t in rows), key=repr)


def test_long_blanks_have_the_same_ids(monkeypatch):
    import re
    with open(tokens.RANKS, "rb") as file:
        encoding = tokens.tokenizer(file.read())
    short = re.compile(tokens.LONG_BLANKS.pattern.replace("10000", "3"))
    monkeypatch.setattr(tokens, "LONG_BLANKS", short)
    r = np.random.default_rng(3)
    for _ in range(300):
        text = "".join(r.choice([" ", "\n", "\t", "\u00a0", "\u3000", "a", "B7", ".", "'s", "é", "\x1c"], r.integers(0, 30)).repeat(r.integers(1, 5)))
        assert tokens.encode(encoding, text) == encoding.encode_ordinary(text), repr(text)


def test_two_million_of_one_character(spark):
    many = 2_000_000
    rows = [(1, " " * many), (2, "\n" * many + "x"), (3, "a" * many), (4, "b" + " \n" * many + "  c d")]
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(docs(spark, rows).repartition(4)).collect()}
    assert got == {1: many, 2: many // 2 + 2, 3: many // 4, 4: 1 + 2 * many + 1 + 2}


def test_round_trip(spark, tmp_path):
    rows = [(i, prose(i, i)) for i in range(30)] + [(99, None)]
    path = str(tmp_path / "flat")
    tokens.write_flat(docs(spark, rows).repartition(2), path)
    found = []
    for row in tokens.flat_files(spark, f"{path}/part=tokens").collect():
        ids = np.frombuffer(row["content"], ">u2")
        assert ids[-1] == tokens.SEPARATOR
        found += [tuple(x.tolist()) for x in np.split(ids, np.flatnonzero(ids == tokens.SEPARATOR) + 1)[:-1]]
    assert sorted(found) == sorted((*encode(t), tokens.SEPARATOR) for _, t in rows)


@pytest.mark.parametrize("size", [1, 2, 3, 5, 64])
def test_blocks(spark, size):
    r = np.random.default_rng(size)
    streams = {"a": r.choice([7, 8, 9], 50).tolist(), "b": [9] * 6, "c": [7] * 20, "d": [], "e": [9, 7, 7, 7, 9, 9, 7]}
    files = spark.createDataFrame([(k, bytearray(np.array(v, ">u2").tobytes())) for k, v in streams.items()],
                                  "stream string, content binary")
    want = []
    for k, ids in streams.items():
        lengths, n = [], 0
        for x in ids:
            if x == 9:
                lengths.append(n)
                n = 0
            else:
                n += 1
        want += [(k, i, n) for i, n in enumerate(lengths + [n] * (n > 0))]
    got = tokens.scan(files, separator=9, size=size).select("stream", "at", "n_tokens").collect()
    assert sorted(tuple(x) for x in got) == sorted(want)


def test_odd_file_is_refused(spark):
    files = spark.createDataFrame([("a", bytearray(b"abc"))], "stream string, content binary")
    with pytest.raises(Exception, match="no whole number of tokens"):
        tokens.scan(files).collect()


def test_empty(spark):
    assert tokens.count_tokens(docs(spark, [])).collect() == []


def test_a_task_writes_files_of_bounded_size(spark, tmp_path, monkeypatch):
    """However large a task is, no file holds more than a few portions: Spark reads a file as one row."""
    monkeypatch.setattr(tokens, "PORTION", 2_000)
    rows = [(i - 300, prose(i, 60) if i % 5 else None) for i in range(600)] + [(None, "x y"), (-(1 << 63) + 1, "z"), ((1 << 63) - 1, "")]
    path = str(tmp_path / "flat")
    tokens.write_flat(docs(spark, rows).coalesce(1), path)
    longest = max(2 * (len(encode(t)) + 1) for _, t in rows)
    sizes = [len(r["content"]) for r in tokens.flat_files(spark, path).collect()]
    assert len(sizes) > 8 and max(sizes) <= tokens.FILES * (2_000 + longest)
    got = tokens.count_tokens(docs(spark, rows).coalesce(1)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(((k, len(encode(t))) for k, t in rows), key=repr)
