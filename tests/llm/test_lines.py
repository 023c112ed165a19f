"""Line dedup against a plain loop, its SQL, and the awkward rows."""

import duckdb
import pytest
from fixtures import CLASHES, awkward, docs, prose

from parley.llm import lines


def deleted(rows, least=lines.MIN_WORDS):
    """Positions to delete per (id, text), by comparing every window with every earlier place."""
    order = sorted({r for r in rows if r[1]}, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = set(), {}
    for key in order:
        own = [(i, t.strip(" ").lower()) for i, t in enumerate(key[1].split("\n")) if t.strip(" ")]
        size = [t.count(" ") + 1 for _, t in own]
        found = []
        for a in range(len(own)):
            for b in range(a, len(own)):
                if sum(size[a:b + 1]) >= least:
                    found.append((a, b))
                    break
        for b in range(len(own)):
            for a in range(b, -1, -1):
                if sum(size[a:b + 1]) >= least:
                    found.append((a, b))
                    break
        for a, b in sorted(set(found)):
            run = tuple(t for _, t in own[a:b + 1])
            if run in seen:
                out.setdefault(key, set()).update(range(own[a][0], own[b][0] + 1))
            seen.add(run)
    return out


def check(spark, rows, more=()):
    found = lines.dedup_lines(docs(spark, rows, more)).collect()
    want = deleted(rows)
    assert len(found) == len(rows)
    got = sorted((repr(r["doc_id"]), repr(r["text"]), r["__gone"]) for r in found)
    plan = []
    for key, text in rows:
        gone = sorted(want.get((key, text), ()))
        left = text if not gone else "\n".join(t for i, t in enumerate(text.split("\n")) if i not in gone)
        plan.append((repr(key), repr(left), gone))
    assert got == sorted(plan)
    return want


def test_runs(spark):
    run = [prose(50 + i, 20) for i in range(4)]
    single = prose(90, 64)
    rows = [(1, "\n".join(["head of one", *run, "tail of one"])), (2, "\n".join(["other", *run[1:], "end"])),
            (3, "\n".join([*run[:2], "cut short", *run[2:]])), (4, single), (5, "x\n\n" + single.upper() + "  \ny"),
            (6, "\n".join(["Les."] * 10)), (7, "\n".join([run[0], "", run[1], run[2], single, run[3]])),
            (8, "\n".join([single, single, single]))]
    want = check(spark, rows)
    assert want[rows[1]] == {1, 2, 3} and rows[2] not in want and want[rows[4]] == {2} and rows[5] not in want
    assert want[rows[6]] == {0, 1, 2, 3, 4}


def test_awkward(spark):
    rows = awkward()
    check(spark, rows + [(20, rows[5][1]), (21, rows[5][1].split("\n")[7] + "\nmine")], CLASHES)


def test_empty(spark):
    assert lines.dedup_lines(docs(spark, [])).collect() == []


def test_sql(spark, sf_dir):
    from compare import connect, difference
    assert difference(spark, connect(sf_dir),
                      lambda s, d: lines.report(s.read.parquet(f"{d}/documents.parquet")), lines.ORACLE, sf_dir) is None


@pytest.mark.parametrize("n", [49, 50])
def test_threshold(spark, n):
    text = prose(7, n)
    want = check(spark, [(1, "a\n" + text), (2, text + "\nb")])
    assert bool(want) == (n >= 50)


def test_duckdb_runs_the_sql_on_an_empty_table():
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    assert con.execute(lines.ORACLE).fetchall() == []


def test_other_white_space_and_scripts(spark):
    """Words between tabs, no-break and wide spaces, and letters of scripts without spaces count; a passage is
    the same with other white space."""
    rows, want = [], {}

    def twice(first, second, gone):
        rows.extend([(len(rows), f"head {len(rows)}\n{first}\ntail {len(rows)}"), (len(rows) + 1, f"{second}\nend")])
        want[len(rows) - 2], want[len(rows) - 1] = [], gone
    for k, space in enumerate(["\t", "\u00a0", "\u3000", "  ", " \t "]):
        table = ["\t".join(prose(700 + 10 * k + i, 10).split()).replace("\t", space) for i in range(6)]
        twice("\n".join(table), "\n".join(table), list(range(6)))
        twice("\n".join(prose(900 + 10 * k + i, 30) for i in range(3)),
              "\r\n".join(prose(900 + 10 * k + i, 30).replace(" ", space) for i in range(3)) + "\r", [0, 1, 2])
    for k, letters in enumerate([range(0x4E00, 0x4E00 + 900), range(0x3042, 0x3082), range(0x0E01, 0x0E2E)]):
        line = "".join(chr(letters[(7 * i + i * i // 5) % len(letters)]) for i in range(60))
        twice(line + "\u3002", line + "\u3002", [0])
        twice(line[:40], line[:40], [])  # below 50
    few = prose(990, 30)
    twice(few.replace(" ", "   "), few.replace(" ", "   "), [])
    twice("h\u00e9 " + prose(991, 48), "h\u00e9 " + prose(991, 48), [])
    twice("h\u00e9 " + prose(992, 49), "h\u00e9 " + prose(992, 49), [0])
    found = {r["doc_id"]: r for r in lines.dedup_lines(docs(spark, rows)).collect()}
    assert {k: r["__gone"] for k, r in found.items()} == want
    assert all(found[k]["text"] == (text if not want[k] else "end") for k, text in rows)
