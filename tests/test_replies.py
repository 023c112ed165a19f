"""Model replies: finding the object, coercing its fields."""

import json

from parley.operators import summaries


def test_extract(spark):
    cases = {
        "bare": ('{"a": 1}', '{"a": 1}'), "fenced": ('Hi\n```json\n{"a": {"b": "}"}}\n```\nBye', '{"a": {"b": "}"}}'),
        "prose": ('Sure: {"a": "x\\"}"} and {"b": 2}', '{"a": "x\\"}"}'), "cut": ('{"a": [1, 2', None),
        "none": ("nothing here", None), "bad": ("{not json}", None), "null": (None, None)}
    frame = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "meeting_id string, reply string")
    got = {r["meeting_id"]: r["json"] for r in summaries.extract_json(frame).collect()}
    assert got == {k: v[1] for k, v in cases.items()}


def test_coerce(spark):
    full = {
        "headline": "  " + "h" * 100, "tldr": "short", "key_points": [" a ", "", "b" * 700] + ["c"] * 40,
        "decisions": "not a list", "action_items": [
            {"owner": " ", "task": " do it ", "due": "TBD"}, {"owner": "Ana", "task": "", "due": "Friday"},
            {"owner": "Bo", "task": "x", "due": "Friday"}, "call them", {"task": "y", "due": "d" * 41}, "  "],
        "follow_ups": ["later"], "follow_up_email": {"subject": "S", "body": "B\nC"}}
    rows = [("full", json.dumps(full)), ("empty", "{}"), ("null", None),
            ("odd", json.dumps({"headline": None, "key_points": None, "action_items": 7, "follow_up_email": "no"}))]
    got = {r["meeting_id"]: r for r in summaries.coerce_summary(
        spark.createDataFrame(rows, "meeting_id string, json string")).collect()}
    one = got["full"]
    assert one["headline"] == "h" * 90 and one["tldr"] == "short"
    assert one["key_points"] == (["a", "b" * 600] + ["c"] * 40)[:25] and one["decisions"] == []
    assert [tuple(a) for a in one["action_items"]] == [
        ("—", "do it", ""), ("Bo", "x", "Friday"), ("—", "call them", ""), ("—", "y", "")]
    assert (one["follow_ups"], one["email_subject"], one["email_body"]) == (["later"], "S", "B\nC")
    for name in ("empty", "null", "odd"):
        row = got[name]
        assert (row["headline"], row["tldr"], row["key_points"], row["action_items"], row["email_body"]) == ("", "", [], [], "")


def test_items(spark):
    frame = spark.createDataFrame([("m", json.dumps({"action_items": ["t"], "key_points": ["p", "q"]}))], "meeting_id string, json string")
    got = summaries.summary_items(summaries.coerce_summary(frame)).collect()
    assert sorted((r["section"], r["pos"], r["item"]) for r in got) == [
        ("action_items", 0, "t"), ("key_points", 0, "p"), ("key_points", 1, "q")]
