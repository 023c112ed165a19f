"""The last call of a summary: threads, retries, replies that fail, repeated thoughts."""

import json
import random
import threading
import time

import pytest

from parley.operators.summaries import ITEM_CHARS, SECTIONS, TASK_CHARS
from parley.plans import summarize as S
from test_sequential import alike, plain


def test_answers_keep_their_order_and_three_are_out_at_once():
    out, most, lock, asked = [0], [0], threading.Lock(), {}

    def note(text, title):
        with lock:
            out[0] += 1
            most[0] = max(most[0], out[0])
            asked[text] = asked.get(text, 0) + 1
        time.sleep(0.002 * (7 - int(text) % 7))  # later ones are done earlier
        with lock:
            out[0] -= 1
        if int(text) % 5 == 0 and asked[text] <= 2:
            raise S.Busy
        if int(text) % 11 == 3:
            raise S.Overflow
        if int(text) % 11 == 4:
            raise S.Refused
        return title + text
    got = list(S.answers(note, [(str(i), "t") for i in range(40)]))
    assert got == [(None, "long") if i % 11 == 3 else (None, "refused") if i % 11 == 4 else (f"t{i}", None) for i in range(40)]
    assert most[0] == 3 and all(n == (3 if int(t) % 5 == 0 else 1) for t, n in asked.items())


def test_a_call_that_never_gets_an_answer_fails():
    def note(text, title):
        raise S.Busy
    with pytest.raises(S.Busy):
        list(S.answers(note, [("a", "t")]))
    assert list(S.answers(note, [])) == []


def make_model():
    """A function of its own, so that it travels to the workers by value."""
    def model(source, title):
        """A list of items by the source's lines; some titles overflow, are refused or answered without an object."""
        if title.startswith(("long", "refused")):
            raise S.Overflow if title.startswith("long") else S.Refused
        if title.startswith("talk"):
            return "Nothing to report."
        lines = source.split("\n\n", 1)[1].split("\n")
        return "Here: " + json.dumps({
            "headline": title, "key_points": lines, "decisions": [x + "." for x in lines[::2]], "open_questions": lines[1::2],
            "action_items": [{"owner": "Ana", "task": x, "due": "Friday"} for x in lines[::3]], "follow_ups": []}) + " Bye."
    return model


def wanted(reply):
    """The reply's items by a plain loop: first 25 of each section, one after the other."""
    kept, pool, tasks = {s: [] for s in SECTIONS}, [], []
    for section in SECTIONS:
        for x in reply.get(section, [])[:25]:
            x = {**x, "task": x["task"][:TASK_CHARS]} if section == "action_items" else x[:ITEM_CHARS]
            text = x["task"] if section == "action_items" else x
            key, rivals = plain(text), tasks if section == "action_items" else pool
            mine = plain(f"{x['owner']} {text}") if section == "action_items" else key
            if (section != "action_items" and not key) or any(alike(mine, o) for o in rivals):
                continue
            rivals.append(mine)
            if section == "action_items" and key:
                pool.append(key)
            kept[section].append(x)
    return kept


def test_summaries(spark):
    model, rng = make_model(), random.Random(6)
    said = ["we ship the new release on friday", "ana sends the budget to the whole team", "who owns the review of the plan",
            "…", "the customer wants a second call", "we ship the new release on friday then"]
    names = ["done", "alone", "long one", "refused one", "talk", "short"]
    lines = [(m, i, rng.choice(said) + rng.choice(["", " now", f" {rng.randrange(9)}"]))
             for m in names for i in range({"done": 60, "alone": 1, "short": 3}.get(m, 8))]
    frame = spark.createDataFrame(lines, "meeting_id string, turn_id long, line string")
    titles = spark.createDataFrame([(m, m, "Ana, Bo") for m in [*names, "silent"]], "meeting_id string, title string, participants string")
    given = {r["meeting_id"]: r for r in S.sources(frame, titles, limit=700).collect()}
    got = {r["meeting_id"]: r for r in S.summarize_meetings(frame, titles, model, limit=700).collect()}
    assert set(got) == set(names) == set(given) and given["done"]["chunks"] > 1
    assert {m: got[m]["state"] for m in names} == {
        "done": "done", "alone": "done", "short": "done", "long one": "long", "refused one": "refused", "talk": "unread"}
    for m in names:
        assert (got[m]["chunks"], got[m]["cut"]) == (given[m]["chunks"], given[m]["cut"])
        done = got[m]["state"] == "done"
        reply = json.loads(model(given[m]["source"], m)[6:-5]) if done else {}
        want = wanted(reply)
        assert got[m]["headline"] == (m if done else "")
        assert {s: [a.asDict() if s == "action_items" else a for a in got[m][s]] for s in SECTIONS} == want
    assert len(got["done"]["key_points"]) < 25


def test_no_lines(spark):
    frame = spark.createDataFrame([], "meeting_id string, turn_id long, line string")
    titles = spark.createDataFrame([("m", "T", "")], "meeting_id string, title string, participants string")
    assert S.summarize_meetings(frame, titles, make_model()).collect() == []
