"""Licence scan: held-out accuracy on notices in running text, and the awkward rows."""

import random

from fixtures import CLASHES, awkward, docs, prose

from parley.llm import licences

HELD_OUT = {
    "gpl": ["This program is licensed under the GNU General Public License, version 3 or later.",
            "this work is LICENSED under the gnu general public license version 2"],
    "apache": ["The code is licensed under the Apache License, Version 2.0."],
    "mit": ["This software is released under the MIT License."],
    "cc-by-nc": ["Text licensed under CC BY-NC 4.0."], "cc-by": ["Photos licensed under CC BY 4.0."],
    "bsd": ["Licensed under the BSD 3-Clause License (see file)."], "reserved": ["(c) 2024. All rights reserved."],
}


def test_families(spark):
    rows, want = [], {}
    for family, notices in HELD_OUT.items():
        for notice in notices:
            for text in (notice, prose(1, 40) + "\n" + notice, prose(2, 90) + " " + notice + " " + prose(3, 90)):
                rows.append((len(rows), text))
                want[rows[-1][0]] = family
    clean = ["the general public was in the park", "released under the bridge", "MIT is a university", prose(5, 300),
             "he was licensed to drive", "the version of the work"]
    rows += [(1000 + i, t) for i, t in enumerate(clean)]
    got = {r["doc_id"]: r["families"] for r in licences.report(docs(spark, rows)).collect()}
    assert {k: got[k] for k in want} == want
    assert all(got[1000 + i] == "" for i in range(len(clean)))


WRAPPED = {
    "mit": ["MIT License", "", "Copyright (c) 2020 A. Author", "",
            "Permission is hereby granted, free of charge, to any person obtaining a copy",
            'of this software and associated documentation files (the "Software"), to deal',
            "in the Software without restriction, including without limitation the rights"],
    "gpl": ["This program is free software: you can redistribute it and/or modify",
            "it under the terms of the GNU General Public License as published by",
            "the Free Software Foundation, either version 3 of the License, or"],
    "bsd": ["Redistribution and use in source and binary forms, with or without",
            "modification, are permitted provided that the following conditions are met:"],
    "apache": ['Licensed under the Apache License, Version 2.0 (the "License");',
               "you may not use this file except in compliance with the License.",
               "You may obtain a copy of the License at"],
    "cc-by-sa": ["This work is licensed under a Creative Commons", "Attribution-ShareAlike 4.0", "International License."],
}


def test_wrapped_notices(spark):
    """Lines as files have them: plain, with \\r, behind comment signs, with empty lines between, in other text."""
    rows, want = [], {}
    for family, lines in WRAPPED.items():
        for text in ("\n".join(lines), "\r\n".join(lines), "/*\n" + "\n".join(" * " + x for x in lines) + "\n */",
                     "\n\n".join("# " + x for x in lines), prose(6, 40) + "\n" + "\n".join(lines) + "\n" + prose(7, 40)):
            rows.append((len(rows), text))
            want[rows[-1][0]] = family
    got = licences.report(docs(spark, rows)).collect()
    assert {r["doc_id"]: (r["families"], r["n_notices"]) for r in got} == {k: (f, 1) for k, f in want.items()}


def test_lines_of_a_notice(spark):
    text = "\n".join(["first", "", *WRAPPED["gpl"], "last"])
    found = [x for x in licences.scan(docs(spark, [(1, text)])).collect()[0]["found"] if x["confirmed"]]
    assert [(x["line"], x["last_line"], x["family"]) for x in found] == [(2, 4, "gpl")]


def test_several_in_one_document(spark):
    text = "\n".join([HELD_OUT["mit"][0], prose(4, 30), HELD_OUT["gpl"][0], HELD_OUT["mit"][0]])
    row = licences.report(docs(spark, [(1, text)])).collect()[0]
    assert (row["n_notices"], row["families"]) == (3, "gpl,mit")


def test_several_in_one_line(spark):
    """Dual licences, notices far apart in one line, and one licence named twice."""
    mit, apache, gpl = "Released under the MIT License.", HELD_OUT["apache"][0], HELD_OUT["gpl"][0]
    rows = [(1, mit + " " + apache), (2, apache + " " + mit), (3, mit + " " + prose(8, 4_000) + " " + gpl),
            (4, " ".join([gpl, apache, mit, HELD_OUT["reserved"][0]])), (5, mit + " " + mit), (6, gpl + " of the " * 5_000 + mit)]
    got = {r["doc_id"]: (r["families"], r["n_notices"]) for r in licences.report(docs(spark, rows)).collect()}
    assert got == {1: ("apache,mit", 2), 2: ("apache,mit", 2), 3: ("gpl,mit", 2), 4: ("apache,gpl,mit,reserved", 4),
                   5: ("mit", 2), 6: ("gpl,mit", 2)}


def test_near_families_in_one_place(spark):
    """Templates that have most word pairs in common: one place has one family."""
    rows = [(f, t) for f, ts in licences.TEMPLATES.items() for t in ts]
    got = licences.report(docs(spark, [(i, t) for i, (_, t) in enumerate(rows)])).collect()
    assert {r["doc_id"]: r["families"] for r in got} == {i: f for i, (f, _) in enumerate(rows)}


def test_planted_notices(spark, sf_dir):
    """Every document of the table with one of these sentences gets its family, and no other does."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    marks = {"gpl": "GNU General Public License, version 3.", "mit": "Released under the MIT License.",
             "apache": "Licensed under the Apache License, Version 2.0.", "cc-by-nc": "Licensed under CC BY-NC 4.0.",
             "reserved": "All rights reserved."}
    got = {r["doc_id"]: r["families"] for r in licences.report(table).collect()}
    for row in table.collect():
        assert got[row["doc_id"]] == ",".join(sorted(f for f, m in marks.items() if m in row["text"]))


def test_awkward(spark):
    rows = awkward() + [(50, "x " * 20_000 + HELD_OUT["mit"][0]), (51, "the " * 30_000)]
    got = licences.report(docs(spark, rows, CLASHES)).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"] for r in got if r["n_notices"]} == {50}
    assert licences.report(docs(spark, [])).collect() == []


def test_windows_against_every_stretch():
    """For each last pair the stretch of at most twice a template's words that begins as late as it can without
    losing a pair; of those with enough pairs the best that do not overlap, per family."""
    rng = random.Random(11)
    spoken = [licences.words(t) for ts in licences.TEMPLATES.values() for t in ts]
    for _ in range(60):
        tokens = []
        for _ in range(rng.randrange(1, 7)):
            own = rng.choice(spoken)
            tokens += [w for w in own[rng.randrange(3):] if rng.random() < 0.95] + rng.choice([[], ["x"] * 9, own[-4:]])
        found = licences.cues(tokens)
        want = []
        for family in licences.FAMILIES:
            options = []
            for template in licences.TEMPLATES[family]:
                own = licences.words(template)
                pairs = {f"{a} {b}" for a, b in zip(own, own[1:])}
                others = {f"{a} {b}" for f, ts in licences.TEMPLATES.items() if f != family for t in ts
                          for a, b in zip(licences.words(t), licences.words(t)[1:])}
                places = [(i, q) for i, q in found if q in pairs]
                for i, _ in places:
                    near = [(j, q) for j, q in places if j <= i and i + 2 - j <= 2 * len(own)]
                    held = {q for _, q in near}
                    begin = max(j for j, _ in near if {q for k, q in near if k >= j} == held)
                    if len(held) >= licences.CONFIRM * len(pairs) and held & ((pairs - others) or pairs):
                        options.append((-len(held) / len(pairs), i + 2 - begin, begin))
            taken = []
            for share, size, begin in sorted(options):
                if all(begin + size <= b or e <= begin for b, e in taken):
                    taken.append((begin, begin + size))
                    want.append((begin, begin + size, family, -share))
        assert sorted(w[:4] for w in licences.windows(found)) == sorted(want)


def test_classifier_decides_and_templates_confirm(spark):
    """Families that share most of a notice, other spellings, licences of no known family, everyday words."""
    lgpl = ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
            "General Public License as published by the Free Software Foundation; either version 2.1 of the License.")
    cases = [("lgpl", lgpl), ("gpl", lgpl.replace("Lesser ", "").replace("library", "program")),
             ("agpl", lgpl.replace("Lesser", "Affero").replace("library", "program")),
             ("agpl", "Licensed under the GNU Affero General Public License v3."),
             ("mit", "Distributed under the terms of the MIT licence."),
             ("apache", "This software is released under the Apache License 2.0"),
             ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby "
                     "granted, provided that"), ("boost", "Distributed under the Boost Software License, Version 1.0. (See file)"),
             ("unlicense", "This is free and unencumbered software released into the public domain.")]
    rows = [(i, prose(20 + i, 30) + "\n" + t) for i, (_, t) in enumerate(cases)]
    other = ["Licensed under the Foo Public License 7.", "This font is licensed under the Bar License, version 2."]
    plain = ["the top of the hill was cold", "the law of the land in the free world under the sun", "released under the bridge"]
    rows += [(100 + i, t) for i, t in enumerate(other)] + [(200 + i, t) for i, t in enumerate(plain)]
    rows += [(300 + i, prose(60 + i, 400)) for i in range(20)]
    got = {r["doc_id"]: (r["families"], r["n_notices"], r["n_unknown"]) for r in licences.report(docs(spark, rows)).collect()}
    assert [got[i] for i in range(len(cases))] == [(f, 1, 0) for f, _ in cases]
    assert [got[100 + i] for i in range(len(other))] == [("", 0, 1)] * len(other)
    assert all(got[i] == ("", 0, 0) for i in got if i >= 200)
