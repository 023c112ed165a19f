"""Pairs that resemble each other, found by blocks, and the first-wins choice."""

import random

import pytest

from parley.operators import repeats, summaries
from test_sequential import alike, plain


def texts(seed, n):
    rng = random.Random(seed)
    words = "send the budget report to ana after lunch review plan launch friday quality team owner é ümlaut 12 7".split()
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            t = list(rng.choice(out))
            for _ in range(rng.randrange(0, 6)):
                t.insert(rng.randrange(len(t) + 1), rng.choice("abc xyz"))
                if t and rng.random() < 0.5:
                    t.pop(rng.randrange(len(t)))
            t = "".join(t)
        else:
            t = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 14)))
        out.append(t if rng.random() < 0.9 else t * 3)
    return out


@pytest.mark.parametrize("q", [1, 2, 3])
def test_common_grams(q):
    many = texts(1, 60) + ["", "a", "aa", "aaa", "aaaa"]

    def count(a, b):
        left, right = [[t[i:i + q] for i in range(len(t) - q + 1)] for t in (a, b)]
        return sum(min(left.count(g), right.count(g)) for g in set(left))
    got = repeats.common_grams(many, q)
    for i, a in enumerate(many):
        for j, b in enumerate(many):
            if i != j:
                assert got[i, j] == count(a, b), (a, b)


def test_bound_lets_every_pair_through():
    many = texts(2, 150)
    mask, n = repeats.candidates(many), 0
    for i, a in enumerate(many):
        for j, b in enumerate(many):
            if i != j and alike(a, b):
                assert mask[i, j], (a, b)
                n += 1
    assert n > 100 and mask.sum() < 0.7 * len(many) ** 2


@pytest.mark.parametrize("block", [7, 1_000])
def test_rivals_by_blocks(spark, block):
    many = texts(3, 80) + texts(3, 12)
    rows = [("m", "p", i % 3, i, i, i % 5 == 0, t) for i, t in enumerate(many)]
    frame = spark.createDataFrame(rows, "meeting_id string, pool string, rank int, pos long, id long, old_only boolean, text string")
    found = sorted(((r["new"], r["old"]) for r in repeats.rivals(frame, block).collect()), key=repr)
    seen, copies, once = set(), [], []
    for r in sorted(rows, key=lambda r: r[2:5]):
        if not r[5] and r[6] in seen:
            copies.append((r[4], None))
        else:
            once.append(r)
            seen |= set() if r[5] else {r[6]}
    want = [(a[4], b[4]) for a in once for b in once if a[2:5] > b[2:5] and not a[5] and alike(a[6], b[6])]
    assert found == sorted(want + copies, key=repr) and want and copies


def test_chains_are_decided_in_order(spark):
    """1 goes for 0, so 2, which only resembles 1, stays, and 3 goes for it."""
    pairs = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (3, 1), (5, 4), (6, 4), (6, 5), (9, None)], "new long, old long")
    assert sorted(r["id"] for r in repeats.dropped(pairs).collect()) == [1, 3, 5, 6, 9]
    assert repeats.dropped(pairs.filter("false")).collect() == []


@pytest.mark.parametrize("strict", [False, True])
def test_same_as_the_fold(spark, strict):
    rng, rows = random.Random(4), []
    for meeting, n in (("a", 160), ("b", 1), ("c", 40)):
        for i, t in enumerate(texts(meeting, n) + ["…", "…", "--"]):
            section = rng.choice(summaries.SECTIONS)
            act = section == "action_items"
            rows.append((meeting, section, i, rng.choice(["You", "Ana", None]) if act else None, t, "x" if act else None))
    frame = spark.createDataFrame(rows, "meeting_id string, section string, pos long, owner string, item string, due string")
    want = []
    for meeting in "abc":
        pool, tasks = [], []
        for r in sorted((r for r in rows if r[0] == meeting), key=lambda r: (summaries.SECTIONS.index(r[1]), r[2])):
            action, key = r[1] == "action_items", plain(r[4])
            mine, others = (plain(" ".join(x for x in (r[3], r[4]) if x is not None)), tasks) if action else (key, pool)
            if (action or key) and not any(alike(mine, o) for o in others):
                want.append(r)
                if action:
                    tasks.append(mine)
                if key or strict:
                    pool.append(key)
    got = summaries.dedup_items(frame, strict=strict)
    assert got.columns == frame.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_long_texts_keep_every_pair_and_few_others():
    """Long texts of few letters have most pairs of letters in common, also those that are not alike."""
    rng, many = random.Random(5), []
    syllables = "the an ing tion er re th and of en".split()
    for i in range(60):
        n = rng.randrange(40, 160)
        t = " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) + (rng.choice("jqxzvk79é") if rng.random() < 0.1 else "") for _ in range(n))
        if many and i % 2 == 0:
            t = list(rng.choice(many))
            for _ in range(rng.randrange(0, 40)):
                t[rng.randrange(len(t))] = rng.choice("aeq7 ")
            t = "".join(t)[:rng.choice([None, -9])]
        many.append(t)
    many += [many[0][:300], many[0][50:350], "the " * 50, "the " * 60, "\U00010348" * 220]
    loose = repeats.candidates(many)
    mask, true = repeats.narrowed(many, loose), set()
    for i, a in enumerate(many):
        for j, b in enumerate(many):
            if i != j and alike(a, b):
                assert mask[i, j], (a, b)
                true.add((i, j))
    left = [(i, j) for i, j in zip(*mask.nonzero()) if i != j]
    assert len(true) > 7 and loose.sum() > 10 * len(left)


def test_forms_are_worked_out_once(spark):
    """What the pairs and the counts read are stored forms, and items in no meeting repeat nothing."""
    frame = spark.createDataFrame([("m", "decisions", 0, None, "Ship it, now!", None), ("m", "key_points", 1, None, "ship IT now", None),
                                   (None, "decisions", 2, None, "Ship it, now!", None), (None, "key_points", 3, None, "ship it now", None)],
                                  "meeting_id string, section string, pos long, owner string, item string, due string")
    got = summaries.dedup_items(frame)
    assert sorted(r["pos"] for r in got.collect()) == [0, 2, 3] and got.columns == frame.columns
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan
