"""Sequential rules restated as loops and compared with the Spark operators."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.functions import linkage
from parley.functions.matching import char_places, common_length
from parley.operators import diarize as V
from parley.operators import echo, summaries, tidy, windows
from parley.plans import summarize

TURNS = "meeting_id string, turn_id long, text string"


def loop_windows(texts, max_turns, max_chars, overlap):
    out, start = [], 0
    while start < len(texts):
        n, size = 0, 0
        for text in texts[start:]:
            if n and (n >= max_turns or size + len(text) + 40 > max_chars):
                break
            n, size = n + 1, size + len(text) + 40
        out.append((start, n))
        if start + n >= len(texts):
            break
        start += max(1, n - overlap)
    return out


@pytest.mark.parametrize("n", [1, 35, 36, 37, 100, 3000])
def test_edit_windows(spark, n):
    """Meetings longer than a block of turns included."""
    rng = random.Random(n)
    texts = ["x" * rng.choice([0, 10, 200, 900, 9000]) for _ in range(n)]
    frame = spark.createDataFrame([("m", i, t) for i, t in enumerate(texts)], TURNS)
    got = sorted((r["first_turn"], r["turns"]) for r in windows.edit_windows(frame).collect())
    assert got == loop_windows(texts, 36, 8000, 6)
    covered = {i for start, size in got for i in range(start, start + size)}
    assert covered == set(range(n))


@pytest.mark.parametrize("limit", [1, 50, 400])
def test_chunks(spark, limit):
    rng = random.Random(limit)
    lines = ["y" * rng.randrange(1, 80) for _ in range(120)]
    frame = spark.createDataFrame([("m", i, t) for i, t in enumerate(lines)], "meeting_id string, turn_id long, line string")
    chunks, size = [], 0
    for line in lines:
        if chunks and size + len(line) <= limit:
            chunks[-1].append(line)
            size += len(line) + 1
        else:
            chunks.append([line])
            size = len(line) + 1
    got = windows.chunk_lines(frame, limit).orderBy("chunk").collect()
    assert [r["line"] for r in got] == ["\n".join(c) for c in chunks]
    assert "\n".join(r["line"] for r in got) == "\n".join(lines)


def test_transcript_cap_keeps_the_crossing_line(spark):
    rows = [("m", i, i * 1000, "N", "z" * 10) for i in range(3000)]
    frame = spark.createDataFrame(rows, "meeting_id string, turn_id long, start_ms long, name string, text string")
    lines = ["[%d:%02d] N: %s" % (i // 60, i % 60, "z" * 10) for i in range(3000)]
    used, want = 0, 0
    for line in lines:
        want += 1
        used += len(line)
        if used > 30_000:
            break
    assert windows.transcript_lines(frame, 30_000).filter("NOT cut").count() == want
    assert windows.transcript_lines(frame, 30_000).count() == windows.transcript_lines(frame).count() == 3000


def plain(text):
    return "".join(ch for ch in text.lower() if ch in "abcdefghijklmnopqrstuvwxyz0123456789 ").strip()


def blocks(a, b):
    return [m for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]


def loop_echo(mic, system):
    tokens = sorted(((s, i, plain(w), e) for i, (w, s, e) in enumerate(system)), key=lambda t: (t[0], t[1]))
    out = {}
    for seg, words in mic.items():
        start, end = words[0][1], words[-1][2]
        low = start - 1500
        around = " ".join(t[2] for t in tokens if low - 30_000 <= t[0] <= end + 1500 and t[3] >= low).split()
        mine = plain(" ".join(w for w, _, _ in words)).split()
        ratio = sum(m.size for m in blocks(mine, around)) / len(mine) if mine and around else 0.0
        if ratio >= (0.7 if len(mine) >= 4 else 0.999):
            out[seg] = ("drop", None)
            continue
        out[seg] = ("keep", None)
        use = [i for i, w in enumerate(words) if plain(w[0])]
        if ratio >= 0.35 and len(use) >= 7 and around:
            hit = set()
            for m in blocks([plain(words[i][0]) for i in use], around):
                hit.update(range(m.a, m.a + m.size))
            lead = next((i for i in range(len(use)) if i not in hit), len(use))
            tail = next((i for i in range(len(use) - lead) if len(use) - 1 - i not in hit), len(use) - lead)
            if len(use) - lead - tail >= 3 and max(lead, tail) >= 4:
                out[seg] = ("trim", " ".join(words[i][0] for i in use[lead:len(use) - tail]))
    return out


def test_echo(spark):
    rng = random.Random(11)
    names = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
    system = [(rng.choice(names), i * 400, i * 400 + 400) for i in range(400)]
    mic, rows = {}, []
    for seg in range(120):
        at = rng.randrange(0, 380)
        copied = [w for w, _, _ in system[at:at + rng.randrange(1, 10)]]
        own = [f"own{rng.randrange(50)}" for _ in range(rng.randrange(0, 9))]
        said = rng.choice([copied, copied + own, own + copied, own, copied + own + copied]) or ["…"]
        start = at * 400 + rng.choice([0, 800, 31_000])
        mic[seg] = [(w, start + i * 400, start + i * 400 + 400) for i, w in enumerate(said)]
        rows.append(("m", seg, start, mic[seg][-1][2], " ".join(said), [tuple(w) for w in mic[seg]]))
    frame = spark.createDataFrame(rows, "meeting_id string, seg_id long, start_ms long, end_ms long, text string, "
                                        "words array<struct<w:string,s_ms:long,e_ms:long>>")
    words = spark.createDataFrame([("m", "system", 0, i, w, s, e) for i, (w, s, e) in enumerate(system)],
                                  "meeting_id string, track string, seg_id long, word_id long, w string, s_ms long, e_ms long")
    none = spark.createDataFrame([], "meeting_id string, track string, seg_id long, start_ms long, end_ms long, text string")
    got = echo.drop_echo(frame, echo.system_tokens(none, words)).collect()
    want = loop_echo(mic, system)
    assert len(got) == len(rows)
    assert {r["seg_id"]: (r["action"], r["text"] if r["action"] == "trim" else None) for r in got} == want
    assert {a for a, _ in want.values()} == {"drop", "trim", "keep"}


def alike(a, b):
    return a == b or (len(a) > 20 and (a in b or b in a)) or SequenceMatcher(None, a, b).ratio() >= 0.87


def test_dedup_items(spark):
    rng = random.Random(2)
    base = ["Send the quarterly budget to Ana", "budget", "Launch on Friday after the review", "…",
            "Who owns quality assurance for the launch", "review the plan with the whole team tomorrow"]
    rows = []
    for meeting in range(12):
        for section in summaries.SECTIONS:
            for pos in range(rng.randrange(0, 30)):
                text = rng.choice(base) + rng.choice(["", ".", " now", " x" * rng.randrange(4), f" {rng.randrange(99)}"])
                act = section == "action_items"
                rows.append((f"m{meeting}", section, pos, rng.choice(["You", "Ana"]) if act else None, text, "" if act else None))
    frame = spark.createDataFrame(rows, "meeting_id string, section string, pos long, owner string, item string, due string")
    want = set()
    for meeting in {r[0] for r in rows}:
        pool, tasks = [], []
        for section in summaries.SECTIONS:
            for r in sorted((r for r in rows if r[0] == meeting and r[1] == section), key=lambda r: r[2]):
                key, rivals = plain(r[4]), pool
                mine = key
                if section == "action_items":
                    mine, rivals = plain(f"{r[3]} {r[4]}"), tasks
                elif not key:
                    continue
                if any(alike(mine, other) for other in rivals):
                    continue
                if section == "action_items":
                    tasks.append(mine)
                if key:
                    pool.append(key)
                want.add(r[:3])
    assert {(r["meeting_id"], r["section"], r["pos"]) for r in summaries.dedup_items(frame).collect()} == want


def test_common_length_bounds_the_matcher():
    rng = random.Random(8)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(0, 40))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert common_length(a, char_places(b), len(b)) == table[-1][-1]
        assert SequenceMatcher(None, a, b).ratio() * (len(a) + len(b)) <= 2 * table[-1][-1] + 1e-9


def loop_linkage(unit, stop):
    """Average linkage the slow way; `stop(groups, distance)` ends it."""
    groups = [[i] for i in range(len(unit))]
    while len(groups) > 1:
        best = min((1 - np.mean(unit[a] @ unit[b].T), i, j)
                   for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if stop(groups, best[0]):
            break
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(g) for g in groups}


def as_groups(labels):
    return {frozenset(np.flatnonzero(labels == k).tolist()) for k in set(labels.tolist())}


@pytest.mark.parametrize("seed", range(6))
def test_linkage(seed):
    rng = np.random.default_rng(seed)
    unit = rng.normal(size=(40, 6))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    merges = linkage.dendrogram(unit, np.ones(40))
    assert as_groups(linkage.cut(40, merges, clusters=5)) == loop_linkage(unit, lambda g, d: len(g) == 5)
    assert as_groups(linkage.cut(40, merges, threshold=0.6)) == loop_linkage(unit, lambda g, d: d >= 0.6)


def test_folds():
    unit = np.eye(3)[[0, 0, 0, 1, 1, 1, 2]]
    unit[6] = [0.9, 0.1, 0.0]
    labels = np.array([0, 0, 0, 3, 3, 3, 6])
    assert linkage.fold_tiny(labels, unit, np.ones(7)).tolist() == [0, 0, 0, 3, 3, 3, 0]
    weak = linkage.fold_weak(np.array([0, 0, 0, 3, 3, 3, 3]), unit, np.array([9.0] * 3 + [1.0] * 4), 0.6, 10)
    assert len(set(weak.tolist())) == 1
    apart = linkage.fold_weak(np.array([0, 0, 0, 3, 3, 3, 3]), unit, np.array([9.0] * 7), 0.1, 10)
    assert len(set(apart.tolist())) == 2


def voices(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(5, 16))
    who = rng.integers(0, 5, size=n)
    vectors = base[who] + rng.normal(size=(n, 16)) * 0.35
    rows = [("hot", "mic", i, i * 1000, i * 1000 + 2000, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [("cold", "mic", i, i * 1000, i * 1000 + 2000, [float(x) for x in v]) for i, v in enumerate(vectors[:20])]
    return spark.createDataFrame(rows, "meeting_id string, track string, win_id long, start_ms long, end_ms long, "
                                       "embedding array<double>")


@pytest.mark.parametrize("k", [None, 3])
def test_long_tracks_give_the_same_voices(spark, k):
    """A track reduced over many tasks ends like one clustered in a single task."""
    frame = voices(spark, 300).cache()
    counts = spark.createDataFrame([("hot", "mic", k), ("cold", "mic", k)], "meeting_id string, track string, k int")
    labels = lambda df: {(r["meeting_id"], r["win_id"]): r["label"] for r in df.collect()}
    whole = labels(V.diarize(frame, counts))
    assert labels(V.diarize(frame, counts, group_windows=60, shard_rows=64)) == whole
    assert len(set(whole.values())) == (k or 5)


def test_merge_cycles(spark):
    people = ["you", "a", "b", "c", "d", "e", "f", "g", "h"]
    folds = [("a", "b"), ("b", "c"), ("c", "d"), ("e", "f"), ("f", "e"), ("g", "e"), ("h", "you"), ("you", "a"), ("d", "zz")]
    merges = spark.createDataFrame([("m", s, t) for s, t in folds], "meeting_id string, label string, target string")
    known = spark.createDataFrame([("m", p) for p in people], "meeting_id string, speaker string")
    got = {(r["label"], r["target"]) for r in tidy.resolve_merges(merges, known).collect()}
    assert got == {("a", "d"), ("b", "d"), ("c", "d")}


def test_emptied_meeting_is_refused(spark):
    turns = spark.createDataFrame([("m", 0, "you", "mic", 0, 1000, "hello"), ("n", 0, "you", "mic", 0, 1000, "hi")],
                                  "meeting_id string, turn_id long, speaker string, track string, start_ms long, end_ms long, text string")
    ops = spark.createDataFrame([("m", "drop", None, 0, None), ("n", "drop", None, 7, None)],
                                "meeting_id string, op string, label string, turn_id long, value string")
    none = spark.createDataFrame([], "meeting_id string, label string, target string")
    got = {r["meeting_id"]: (r["text"], r["refused"]) for r in tidy.apply_turns(turns, ops, none).collect()}
    assert got == {"m": ("hello", True), "n": ("hi", False)}


def test_model_overflow_and_refusal(spark):
    def note(text, title):
        if "secret" in text and "\n" not in text:
            raise summarize.Refused
        if "\n" in text:
            raise summarize.Overflow
        return f"- {title}: {text}"
    chunks = spark.createDataFrame([("m", "T", 0, "one\ntwo\nsecret  part\nfour"), ("m", "T", 1, "five")],
                                   "meeting_id string, title string, chunk long, line string")
    got = {r["chunk"]: r["block"] for r in summarize.map_chunks(chunks, note).collect()}
    assert got[1] == "- T: five"
    assert got[0].split("\n") == [
        "- T: one", "- T: two", "- (portion kept verbatim — could not be auto-summarized): secret part…", "- T: four"]


def test_condense(spark):
    """Blocks join when they fit, are grouped and condensed when they do not, and are
    cut where no two fit together."""
    rows = [("small", i, "a" * 10) for i in range(3)] + [("big", i, "b" * 400) for i in range(9)] + [
        ("stuck", i, "c" * 990) for i in range(2)]
    blocks_ = spark.createDataFrame(rows, "meeting_id string, chunk long, block string")
    titles = spark.createDataFrame([(m, m) for m in ("small", "big", "stuck")], "meeting_id string, title string")
    found = summarize.condense(blocks_, titles, lambda text, title: f"{title}:{len(text)}", limit=1000).collect()
    got = {r["meeting_id"]: r["notes"] for r in found}
    assert got["small"] == "\n".join(["a" * 10] * 3)
    assert got["big"].split("\n") == ["big:802"] * 4 + ["b" * 400]
    assert got["stuck"] == ("c" * 990 + "\n" + "c" * 990)[:1000]
    lost = {r["meeting_id"]: r["cut"] for r in found}
    assert lost == {"small": 0, "big": 0, "stuck": 981}
