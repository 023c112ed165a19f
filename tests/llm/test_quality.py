"""Quality rules against a plain loop."""

import re

from fixtures import CLASHES, awkward, docs, prose

from parley.llm import quality


def plain(rows, min_docs=10, share=0.02):
    """The columns of the query per (doc_id, text, host)."""
    words = lambda t: re.findall("[^\x20\x09-\x0D]+", t or "")
    hosts, seen = {}, {}
    for _, t, h in rows:
        hosts.setdefault(h, set()).add(t)
    for h, texts in hosts.items():
        for t in texts:
            for line in {" ".join(words(x)).lower() for x in (t or "").split("\n") if words(x)}:
                seen[h, line] = seen.get((h, line), 0) + 1
    out = []
    for key, t, h in rows:
        w, lines, dup, removed = words(t), set(), 0, 0
        for x in (t or "").split("\n"):
            if words(x):
                dup += x in lines
                lines.add(x)
                n = seen[h, " ".join(words(x)).lower()]
                removed += len(words(x)) if n > max(min_docs, share * len(hosts[h])) else 0
        runs = {}
        for i in range(len(w) - 7):
            runs.setdefault(tuple(w[i:i + 8]), []).append(i)
        hit = {j for at in runs.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
        failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        out.append((key, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit), removed,
                    failed, not failed and len(w) - removed >= 0.3 * len(w)))
    return sorted(out, key=repr)


def check(spark, rows, more=()):
    rows = [(*r, "s") if len(r) == 2 else r for r in rows]
    assert sorted((tuple(r) for r in quality.report(docs(spark, rows, more)).collect()), key=repr) == plain(rows)


def test_rules(spark):
    line = "This line is everywhere and it is not short at all, so it is said"
    rows = [(i, prose(i, 30) + "\n" + line.upper() + "\n" + prose(i, 3), "big") for i in range(14)]
    rows += [(100 + i, f"{line}\nown {i}\n{line}\n  {line} ", "big") for i in range(3)]
    rows += [(200 + i, f"{prose(900 + i, 25)}\n{line}", "small") for i in range(5)]
    rows += [(300, "a b c d e f g h " * 4 + prose(3, 20)), (301, "a# *b $c <d> |e| &f " * 2 + prose(4, 60)),
             (302, "x\n" * 30), (303, prose(1, 19)), (304, prose(1, 20)), (305, "é\x0bü\x0cñ\xa0o " * 9)]
    check(spark, rows)
    found = {r["doc_id"]: r["kept"] for r in quality.report(docs(spark, rows)).collect()}
    assert not any(found[100 + i] for i in range(3)) and all(found[i] for i in range(14))


def test_copies_count_once(spark):
    """Forty copies of one text do not make its lines frequent."""
    rows = [(i, prose(1, 40) + "\n" + prose(2, 40)) for i in range(40)] + [(99, prose(3, 50))]
    assert all(r["kept"] for r in quality.report(docs(spark, rows)).collect())


def test_awkward(spark):
    check(spark, [(k, t, h) for (k, t), h in zip(awkward(), [None, "a", None, "b"] * 9)], [
        c for c in CLASHES if c != "source"])


def test_empty(spark):
    check(spark, [])
