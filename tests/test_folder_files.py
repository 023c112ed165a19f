"""Many small text files: how they are written, and how many tasks read them."""

import json
import os

import pytest
from pyspark.errors import AnalysisException

from parley.registry import files
from parley.sources import folders, meetings
from parley.sources.captions import CaptionReader
from parley.sources.folders import write_text


def test_a_file_for_each_folder_and_task(spark, tmp_path):
    rows = spark.createDataFrame([(f"f — {i % 5}", f"ä{i}") for i in range(50)], "place string, value string").coalesce(1)
    for _ in range(2):  # a task that is repeated leaves the same files
        write_text(rows, str(tmp_path / "out"), "place")
    found = {d: os.listdir(tmp_path / "out" / d) for d in os.listdir(tmp_path / "out")}
    assert found == {f"f — {i}": ["part-00000.txt"] for i in range(5)}
    text = (tmp_path / "out" / "f — 3" / "part-00000.txt").read_text(encoding="utf-8")
    assert sorted(text.splitlines()) == sorted(f"ä{i}" for i in range(3, 50, 5)) and text.endswith("\n")


def test_documents_are_not_written_by_way_of_a_job_commit(spark, sf_dir, tmp_path, monkeypatch):
    """No folder holds marks or sums of Spark's committer, each of which costs a process or a move."""
    monkeypatch.setattr(files, "run_dir", lambda spark, name: str(tmp_path / name))
    files.scan_meetings(spark, sf_dir)
    names = {n for _, _, held in os.walk(tmp_path) for n in held}
    assert names and all(n.startswith("part-") and n.endswith(".txt") for n in names)


def test_short_files_share_a_task(tmp_path):
    reader = CaptionReader({"path": str(tmp_path), "range": str(1 << 20)})
    end = {f"meeting_id=m{i:03}/track=mic/a": 100 for i in range(100)} | {"meeting_id=z/track=mic/a": 5 << 19}
    parts = [p.ranges for p in reader.partitions({}, end)]
    assert len(parts) <= 12
    assert sorted((r.name, r.start, r.end) for p in parts for r in p) == sorted(
        [(n, 0, 100) for n, size in end.items() if size == 100]
        + [("meeting_id=z/track=mic/a", i << 20, min((i + 1) << 20, 5 << 19)) for i in range(3)])


def odd_documents(root):
    """Documents of every kind a reader may meet, a folder each."""
    whole = {"id": "a", "title": "T", "duration": 1.5, "speakers": {"you": "You"}, "turns": [{"speaker": "you", "start": 1}]}
    kinds = [json.dumps(whole), json.dumps(whole, indent=1) + "\n\n", "", "  ", "null", "5", '"x"', "[]", json.dumps([whole, whole]),
             json.dumps([whole, 5]), "[null]", json.dumps(whole)[:-9], json.dumps([whole])[:-3], json.dumps(whole) + " }{ more",
             json.dumps({"id": "a", "duration": "long"}), json.dumps({"title": 5, "other": [1], "sync": {"enabled": True}}),
             json.dumps([{"id": "a"}, {"id": "b", "warnings": 3}]), "﻿" + json.dumps(whole), json.dumps(whole).encode("utf-16"),
             json.dumps(whole).encode("utf-16-le"), b'{"id": "\xff"}', "{'id': 'a'}", '{"id": "ä — ☃", "title": "x\\u0000y"}']
    for i, body in enumerate(kinds):
        place = root / f"K {i}+é — 20240102-0304{i:02}"
        place.mkdir(parents=True)
        (place / "meeting.json").write_bytes(body if isinstance(body, bytes) else body.encode())
    for name in ("_hidden.txt", ".x.txt", "seen.txt", "two.txt"):
        (root / "20240102-030405").mkdir(exist_ok=True)
        (root / "20240102-030405" / name).write_text('{"id": "%s"}' % name)
    for at in ("_off — 20240102-030406", "20240102-030407/20240102-030408", "none — 20240102-030409"):
        (root / at).mkdir(parents=True)
        if not at.startswith("none"):
            (root / at / "meeting.json").write_text('{"id": "far"}')
    (root / "meeting.json").write_text('{"id": "root"}')
    (root / "folder=20240102-030410").mkdir()
    (root / "folder=20240102-030410" / "meeting.json").write_text('{"id": "key"}')


@pytest.mark.parametrize("document", ["meeting.json", "*.txt", "meeting.{json,txt}"])
def test_scans_are_those_of_sparks_reader(spark, tmp_path, monkeypatch, document):
    root = tmp_path / "20240102-030411"
    odd_documents(root)
    everything = lambda: (sorted(map(repr, meetings.scan_meetings(spark, str(root), document=document).collect())),
                          sorted(map(repr, meetings._folders(spark, str(root), document).collect())))
    mine = everything()
    monkeypatch.setattr(folders, "place_of", lambda *a: None)
    assert mine == everything() and mine[0] and mine[1]


def test_a_malformed_document_ends_a_strict_scan_as_before(spark, tmp_path, monkeypatch):
    for i, body in enumerate(['{"id": "a"}', "[]", "", '[{"id": "b"}, {"id": "c"}]']):
        (tmp_path / f"20240102-03040{i}").mkdir()
        (tmp_path / f"20240102-03040{i}" / "meeting.json").write_text(body)
    assert [r["id"] for r in meetings.scan_meetings(spark, str(tmp_path), safe=False).orderBy("id").collect()] == ["a", "b", "c"]
    for body in ("{", "[5]", '{"id": "a", "duration": "x"}', b'{"id": "\xff"}'):
        (tmp_path / "20240102-030400" / "meeting.json").write_bytes(body if isinstance(body, bytes) else body.encode())
        with pytest.raises(Exception):
            meetings.scan_meetings(spark, str(tmp_path), safe=False).collect()


def test_a_scan_has_no_entry_for_each_file_at_the_driver(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"20240102-030{i:03}").mkdir()
        (tmp_path / f"20240102-030{i:03}" / "meeting.json").write_text('{"id": "a"}')
    found = meetings.scan_meetings(spark, str(tmp_path))
    gone = meetings.scan_changed(spark, str(tmp_path), found.select("folder", "modified"))[1]
    assert found.count() == 300 and gone.count() == 0
    assert found.inputFiles() == [] and gone.inputFiles() == []
    assert found.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_scan_of_nothing_fails_as_before(spark, tmp_path):
    (tmp_path / "20240102-030405").mkdir()
    for root in (tmp_path / "away", tmp_path):
        with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
            meetings.scan_meetings(spark, str(root))


def test_a_folder_with_a_percent_sign_is_not_gone(spark, tmp_path):
    (tmp_path / "100%20 % — 20240102-030405").mkdir()
    (tmp_path / "100%20 % — 20240102-030405" / "meeting.json").write_text('{"id": "a"}')
    known = meetings.scan_meetings(spark, str(tmp_path)).select("folder", "modified")
    changed, gone = meetings.scan_changed(spark, str(tmp_path), known)
    assert [r[0] for r in known.select("folder").collect()] == ["100%20 % — 20240102-030405"]
    assert changed.count() == 0 and gone.count() == 0
