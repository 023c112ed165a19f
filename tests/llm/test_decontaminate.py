"""Phrase and proximity matches against plain loops."""

import hashlib
import re

from fixtures import CLASHES, awkward, docs, prose

from parley.llm import decontaminate


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain(rows, items, size=10, slop=15):
    """(doc_id, n_words, n_hit, n_items, digest, contaminated, n_near) per row."""
    count, out = {}, []
    for _, text in rows:
        for w in words(text):
            count[w] = count.get(w, 0) + 1
    for key, text in rows:
        own, hit, exact, near = words(text), set(), set(), set()
        for item, phrase in items:
            w = words(phrase)
            for a in range(max(1, len(w) - size + 1) if w else 0):
                win = w[a:a + size]
                for s in range(len(own) - len(win) + 1):
                    if own[s:s + len(win)] == win:
                        hit |= set(range(s, s + len(win)))
                        exact.add(str(item))
                rare = min(range(len(win)), key=lambda i: (count.get(win[i], 0), i))
                if any(own[s] == win[rare] and set(win) <= set(own[max(0, s - slop):s + slop + 1])
                       for s in range(len(own))):
                    near.add(str(item))
        out.append((key, len(own), len(hit), len(exact), hashlib.sha256(",".join(sorted(exact)).encode()).hexdigest(),
                    bool(hit), len(near)))
    return sorted(out, key=repr)


def check(spark, rows, items, more=()):
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.report(docs(spark, rows, more), table).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows, items)


ITEMS = [(1, prose(500, 25)), (2, prose(501, 10)), (3, "Three small words"), (10, prose(502, 12)), (11, None), (12, ""),
         (13, prose(500, 25)), (14, "no one knows")]


def test_matches(spark):
    a, b, c = ITEMS[0][1], ITEMS[1][1], ITEMS[3][1]
    w = a.split()
    rows = [(1, "start " + a.upper() + ", end"), (2, b + " " + b), (3, " ".join(w[:9]) + " x " + " ".join(w[9:18])),
            (4, "three, SMALL\nwords three small words"), (5, prose(7, 60)), (6, " ".join(c.split()[1:] + ["y"])),
            (7, " ".join(reversed(b.split()))), (8, "three small"), (8, "words")]
    check(spark, rows, ITEMS)


def test_awkward(spark):
    rows = awkward() + [(30, awkward()[5][1] + "\n" + ITEMS[0][1])]
    check(spark, rows, ITEMS, CLASHES)


def test_empty(spark):
    check(spark, [], ITEMS)
    check(spark, [(1, "a b c")], [])
    check(spark, [(1, "a b c")], [(1, None), (2, "...")])


def test_chunks_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "CHUNK_WORDS", 10)
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 50)
    check(spark, [(i, prose(i, 40) + " " + ITEMS[i % 4][1]) for i in range(12)], ITEMS)


def test_more_distinct_words_than_the_cache_holds(spark, monkeypatch):
    """One block and one long document; matches stand before, between and after the clearings."""
    noise = [" ".join(f"w{k}x{i}" for i in range(30)) for k in range(8)]
    rows = [(k, f"{noise[k]} {ITEMS[k % 4][1]} {noise[7 - k]} {ITEMS[0][1]}") for k in range(8)]
    rows.append((99, " ".join(text for _, text in rows)))
    monkeypatch.setattr(decontaminate._Terms, "LIMIT", 16)
    terms = decontaminate._Terms(None)
    names = decontaminate._block([1], [1], [rows[-1][1].encode()], terms)[4]
    assert len(names) == len(set(names)) > 16
    check(spark, rows, ITEMS)


def test_whole_index(spark):
    """An index of every term finds the same as one of the items' terms."""
    rows = docs(spark, [(1, ITEMS[0][1]), (2, prose(9, 50)), (3, ITEMS[1][1] + " x")])
    items = decontaminate.item_words(spark.createDataFrame(ITEMS, "item_id long, text string"))
    found = decontaminate.find_matches(decontaminate.build_index(rows), items)
    assert {r["doc_id"]: r["item"] for r in found.collect()} == {1: ["1", "13"], 2: [], 3: ["2"]}


def test_removal_keeps_the_columns(spark):
    rows = docs(spark, [(1, ITEMS[0][1]), (1, "clean"), (None, ITEMS[1][1]), (None, None), (2, "")], CLASHES)
    left = decontaminate.remove_contaminated(rows, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert left.columns == rows.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == [(1, "clean"), (2, ""), (None, None)]
