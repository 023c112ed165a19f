"""Merkle manifest against plain recursion over whole lists."""

import hashlib
import zlib

import pytest

from fixtures import CLASHES, DOCS, awkward, docs, prose
from parley.llm import manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    def one(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"
    return h(*(one(x) for x in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """All levels, from the leaves up."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def way(levels, i):
    out = []
    for nodes in levels[:-1]:
        a = i // 3 * 3
        out.append((nodes[a:i], nodes[i + 1:a + 3]))
        i //= 3
    return out


def brute(rows):
    """`rows`: (doc_id, text, lang, source, n_chars)."""
    by_source = {}
    for doc_id, text, lang, source, n_chars in rows:
        own = leaf(doc_id, source, lang, n_chars, text)
        bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and text is not None
        other = leaf(doc_id, source, lang, n_chars, text.replace("\n", "")) if bad else own
        by_source.setdefault(source, []).append((doc_id is not None, doc_id or 0, own, other, doc_id))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by_source[s].sort(key=lambda r: r[:3])
    trees = [tree([r[2] for r in by_source[s]]) for s in sources]
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(sources):
        for i, (_, _, own, other, doc_id) in enumerate(by_source[s]):
            path = way(trees[k], i) + way(top, k)
            node = other
            for left, right in path:
                node = h(*left, node, *right)
            proof = h(*(x for left, right in path for x in left + right))
            out.append((doc_id, own, trees[k][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def found(frame, **options):
    result = manifest.manifest(frame, **options)
    assert result.columns == COLUMNS
    return sorted((tuple(r) for r in result.collect()), key=repr)


def rows_of(sizes, seed=0):
    """Documents of sources with these numbers of rows; ids are dealt over the sources."""
    out, i = [], 0
    for s, n in enumerate(sizes):
        for _ in range(n):
            text = prose(seed + i, 12) + "\n" + prose(i, 5) if i % 7 else prose(i, 8)
            out.append(((i * 7919) % 100_003, text, "en", f"s{s}", len(text)))
            i += 1
    return out


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_same_as_whole_lists(spark, levels):
    """Superblocks of 3 and 9 nodes make trees of several steps; 28 and 27 end in and after a full one."""
    rows = rows_of([1, 2, 3, 4, 9, 10, 27, 28, 100, 1, 1, 1, 1])
    frame = spark.createDataFrame(rows, DOCS).repartition(5)
    assert found(frame, levels=levels) == brute(rows)


def test_one_hot_source_over_many_partitions(spark):
    rows = [(i, "a\nb", "en", None if i % 10 else "z", i) for i in range(900)]
    assert found(spark.createDataFrame(rows, DOCS), levels=2) == brute(rows)


def test_awkward_rows(spark):
    plain = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in awkward()]
    assert found(docs(spark, awkward(), more=[*CLASHES, "tree", "place", "node", "other", "at", "bundle"])) == brute(plain)
    rows = [(None, None, None, None, None)] * 3 + [(-5, "x\n", "fr", "", 1), (2 ** 62, "é\nü", None, "é", None),
                                                   (2 ** 62 + 1, "\n\n", "de", "Z", 2), (4, "a", "de", "a", 1)] * 2
    assert found(spark.createDataFrame(rows, DOCS)) == brute(rows)
    assert found(spark.createDataFrame([], DOCS)) == []
    assert found(spark.createDataFrame(rows[3:4], DOCS)) == brute(rows[3:4])


def test_tampering_is_seen(spark):
    rows = rows_of([40])
    result = found(spark.createDataFrame(rows, DOCS))
    for doc_id, *_, verified in result:
        text = next(r[1] for r in rows if r[0] == doc_id)
        assert verified == ("\n" not in text or zlib.crc32(str(doc_id).encode()) % 2 == 1)
    assert any(not r[-1] for r in result)
