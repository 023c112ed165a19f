"""Licence scan: a trained paragraph classifier, confirmed by templates.

Per licence family one logistic regression over the words and word pairs of a passage, and one
for any licence at all, are fitted on passages made from the families' templates (whole, cut at
either end, with words left out, inside running text, two families in a row), on licences of
no known family, and on a bounded sample of the corpus's own lines that name no licence. All
are calibrated on held-out passages (scale and shift of the log odds).

The classifier comes first: a text is read in passages of `SPAN` words and of a quarter of that,
every half of it, over the ends of lines and paragraphs; those with a word pair of a template
are scored. The templates confirm: a predicted family counts where a stretch of words that
touches one of its passages holds enough of the word pairs of one of its templates. Each such
place goes to the likeliest of its families. Where no family is confirmed in a paragraph, a
passage that is a licence by the calibrated model of any licence makes it unknown.

Defined results: null and empty texts have no paragraph; notices that stand one after the
other all count, also in one line; one place with two families gets the likelier, on a tie the
first by name; a title alone ("MIT License") is no notice, but unknown where the model of any
licence takes it for one; "licence" is read as "license"; repeated rows give one row each; an
empty table gives an empty one (and the models then know the templates only).
"""

import re
import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import map_arrow
from parley.llm.linear import Sparse, fit_logistic, sigmoid

#: Pieces of corpus lines, of SPAN words each, taken as examples without a licence, and their longest.
SAMPLE_LINES = 4_000
PIECE_CHARS = 4_000
THRESHOLD = 0.5
#: Least share of a template's word pairs that confirms a prediction.
CONFIRM = 0.6
#: Words of a long passage; a short one has a quarter.
SPAN = 64

# Sentences by which licences are named or granted.
TEMPLATES = {
    "agpl": ["This work is licensed under the GNU Affero General Public License, version 3.",
             "Licensed under the GNU Affero General Public License.",
             "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
             "published by the Free Software Foundation.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "apache": ["Licensed under the Apache License, Version 2.0.",
               "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
               "compliance with the License.",
               "This project is released under the Apache 2.0 license.",
               "This software is released under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "boost": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met:", "Licensed under the BSD 3-Clause License.",
            "Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.",
              "Licensed under CC BY 4.0."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
                 "Licensed under CC BY-NC 4.0."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
                 "Licensed under CC BY-SA 4.0."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.",
            "Released under CC0 1.0 Universal."],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public "
            "License v2.0.", "SPDX-License-Identifier: EPL-2.0"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation.",
            "Licensed under the GNU GPL version 2.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted.", "Released under the ISC License.", "SPDX-License-Identifier: ISC"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 3.",
             "This library is free software: you can redistribute it and/or modify it under the terms of the GNU "
             "Lesser General Public License as published by the Free Software Foundation.",
             "SPDX-License-Identifier: LGPL-2.1-only"],
    "mit": ["Released under the MIT License.", "Licensed under the MIT license.",
            "Distributed under the terms of the MIT license.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction.",
            "SPDX-License-Identifier: MIT"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
            "SPDX-License-Identifier: MPL-2.0"],
    "reserved": ["All rights reserved.", "Copyright 2020 The Authors. All rights reserved."],
    "unlicense": ["This is free and unencumbered software released into the public domain.",
                  "SPDX-License-Identifier: Unlicense"],
}
# Licences of no family above, for the model of any licence.
OTHERS = ["Licensed under the Open Data Commons Attribution License.", "Released under the Artistic License 2.0.",
          "This font is licensed under the SIL Open Font License, Version 1.1.", "Licensed under the zlib license.",
          "This work is licensed under the Academic Free License version 3.0.", "SPDX-License-Identifier: Zlib",
          "Distributed under the terms of the European Union Public Licence.", "You may not copy or redistribute this "
          "software without a license from the owner.", "Released under the Universal Permissive License."]
# Words whose pairs say nothing about a licence.
EVERYDAY = frozenset("a all and any as at by can file for free from in is it of on or person project released the this "
                     "to under use with without work you".split())
FAMILIES = sorted(TEMPLATES)
_WORD = re.compile(r"[a-z0-9]+")


def words(paragraph):
    low = paragraph.lower()
    return _WORD.findall(low.replace("licence", "license") if "licence" in low else low)


def grams(tokens):
    """Words and word pairs."""
    return set(tokens) | {a + " " + b for a, b in zip(tokens, tokens[1:])}


#: Templates as (family, number of words, word pairs), and the templates that hold a pair.
_TEMPLATES = [(f, len(w), frozenset(a + " " + b for a, b in zip(w, w[1:])))
              for f in FAMILIES for w in map(words, TEMPLATES[f])]
#: Of each template the word pairs that no other family's template has; a place must hold one of them.
_OWN = [pairs.difference(*(q for g, _, q in _TEMPLATES if g != f)) or pairs for f, _, pairs in _TEMPLATES]
_CUES = {}
for _i, (_, _, _own) in enumerate(_TEMPLATES):
    for _p in _own:
        _CUES.setdefault(_p, []).append(_i)
_FIRST = frozenset(p.split()[0] for p in _CUES)


def cues(tokens):
    """(place, word pair) where two tokens are a word pair of a template."""
    return [(i, pair) for i in range(len(tokens) - 1)
            if tokens[i] in _FIRST and (pair := tokens[i] + " " + tokens[i + 1]) in _CUES]


def windows(found):
    """(begin, end, family, share, places of the pairs): shortest stretches of tokens, at most twice as long
    as a template, that hold at least CONFIRM of its word pairs, one that sets its family apart among them. Those of one family do not overlap: the
    larger share comes first, then the shorter, then the earlier. `found`: the cues."""
    places = {}
    for i, pair in found:
        for t in _CUES[pair]:
            places.setdefault(t, []).append((i, pair))
    every = {}
    for t, own in places.items():
        family, size, pairs = _TEMPLATES[t]
        left, held = 0, {}
        for i, pair in own:
            held[pair] = held.get(pair, 0) + 1
            while i + 2 - own[left][0] > 2 * size or held[own[left][1]] > 1:
                gone = own[left][1]
                held[gone] -= 1
                if not held[gone]:
                    del held[gone]
                left += 1
            if len(held) >= CONFIRM * len(pairs) and not _OWN[t].isdisjoint(held):
                every.setdefault(family, []).append((-len(held) / len(pairs), i + 2 - own[left][0], own[left][0], t))
    out = []
    for family, options in every.items():
        taken = []  # begin and end in order
        for share, size, begin, t in sorted(options):
            end = begin + size
            at = bisect_left(taken, (end, 0))
            if not at or taken[at - 1][1] <= begin:
                insort(taken, (begin, end))
                own = places[t][bisect_left(places[t], (begin, "")):bisect_left(places[t], (end - 1, ""))]
                out.append((begin, end, family, -share, frozenset(i for i, _ in own)))
    return sorted(out, key=lambda w: w[:3])


def passages(n, found):
    """(begin, end) of the passages of n tokens that hold a word pair of a template which is not everyday."""
    at = sorted({i for i, pair in found if not EVERYDAY.issuperset(pair.split())})
    out = []
    for size in (SPAN // 4, SPAN):
        step, last = size // 2, None
        for i in at:
            for k in range(max(0, (i + 2 - size + step - 1) // step), i // step + 1):
                if last is None or k > last:
                    out.append((k * step, min(n, k * step + size)))
                    last = k
    return out


def predictions(tokens, found, model):
    """({family: passages it is predicted for}, [(begin, end, family or 'unknown', probability)] of the passages that
    are a licence)."""
    families, licences = {}, []
    for begin, end in passages(len(tokens), found):
        p = probabilities(tokens[begin:end], model)
        best = int(np.argmax(p[:-1]))
        for k in np.flatnonzero(p[:-1] >= THRESHOLD):
            families.setdefault(FAMILIES[k], []).append((begin, end))
        if p[-1] >= THRESHOLD:
            licences.append((begin, end, FAMILIES[best] if p[best] >= THRESHOLD else "unknown", float(p[-1])))
    return {f: sorted(own) for f, own in families.items()}, licences


def touched(own, begin, end):
    """Whether one of the passages, which are sorted, has a token of begin to end."""
    at = bisect_left(own, (end, 0))
    return any(own[k][1] > begin for k in range(max(0, at - 2 * SPAN), at))


def notices(tokens, found, predicted, model):
    """(begin, end, family, probability, share) of the notices among the tokens: confirmed windows of predicted
    families. Those that have more than half of the pairs of either in common are one place, which goes to the
    likeliest of their families."""
    places, near = [], []
    for window in windows(found):
        if window[2] not in predicted or not touched(predicted[window[2]], window[0], window[1]):
            continue
        near = [place for place in near if max(w[1] for w in place) > window[0]]
        for place in near:
            if any(2 * len(w[4] & window[4]) > min(len(w[4]), len(window[4])) for w in place):
                place.append(window)
                break
        else:
            places.append([window])
            near.append(places[-1])
    out = []
    for place in places:
        begin, end = min(w[0] for w in place), max(w[1] for w in place)
        p = probabilities(tokens[begin:end], model)
        odds, family, share = min((-p[FAMILIES.index(w[2])], w[2], -w[3]) for w in place)
        if -odds >= THRESHOLD:
            out.append((begin, end, family, float(-odds), -share))
    return out


def examples(filler):
    """(tokens, families) made from the templates, other licences and the corpus lines `filler`."""
    fill = [words(p) for p in filler] or [[]]
    rng = np.random.default_rng(7)
    out = []
    for w in fill:  # every word is an example, in pieces as long as passages
        out.extend((w[k:k + SPAN], ()) for k in range(0, len(w), SPAN))
    every = [(f, words(t)) for f in FAMILIES for t in TEMPLATES[f]]
    for text in OTHERS:
        for k in range(10):
            around = fill[int(rng.integers(len(fill)))]
            out.append((around[:4 * k] + words(text) + around[4 * k:8 * k], ("unknown",)))
    for k, (family, own) in enumerate(every):
        for _ in range(6):
            other, more = every[int(rng.integers(len(every)))]
            out.append((own + more, (family, other)))
    for family in FAMILIES:
        for template in TEMPLATES[family]:
            whole = words(template)
            for k in range(40):
                own = list(whole)
                if k % 4 == 1 and len(own) > 6:
                    own = own[:max(5, int(len(own) * (0.6 + 0.4 * rng.random())))]
                if k % 4 == 2 and len(own) > 6:
                    own = [w for w in own if rng.random() > 0.1]
                if k % 2:
                    around = fill[int(rng.integers(len(fill)))]
                    cut = int(rng.integers(0, 30))
                    own = around[:cut] + own + around[cut:2 * cut]
                out.append((own, (family,)))
            for w in set(whole):  # a single word of a notice is no notice
                out.append(([w] + fill[int(rng.integers(len(fill)))][:20], ()))
    return out


def train(filler):
    """{gram: number}, weights (families and any licence x grams), biases, and (scale, shift) of the calibration."""
    data = examples(filler)
    held = np.array([zlib.crc32((" ".join(t) + str(i)).encode()) % 5 == 0 for i, (t, _) in enumerate(data)])
    known = {}
    for tokens, families in data:
        if families:
            for g in sorted(grams(tokens)):
                known.setdefault(g, len(known))
    rows = [sorted(known[g] for g in grams(t) if g in known) for t, _ in data]
    x = Sparse.of_rows(rows, len(known))
    learn, check = np.flatnonzero(~held), np.flatnonzero(held)
    weights, biases, odds, truth = [], [], [], []
    for family in [*FAMILIES, None]:
        y = np.array([bool(f) if family is None else family in f for _, f in data], float)
        w, b = fit_logistic(x.take(learn), y[learn], 0.1)
        odds.append(x.take(check).dot(w) + b)
        truth.append(y[check])
        weights.append(w)
        biases.append(b)
    z = np.concatenate(odds)
    line = Sparse(np.arange(len(z)), np.zeros(len(z), np.int64), z, (len(z), 1))
    scale, shift = fit_logistic(line, np.concatenate(truth), 0.01)
    return known, np.array(weights), np.array(biases), (float(scale[0]), shift)


def probabilities(tokens, model):
    """Calibrated probability of every family and, last, of any licence."""
    known, weights, biases, (scale, shift) = model
    at = [known[g] for g in grams(tokens) if g in known]
    return sigmoid(scale * (weights[:, at].sum(axis=1) + biases) + shift)


def paragraphs(text):
    """(first line, last line, first token, end) of the runs of lines that have words, and the line of each
    of their tokens."""
    out, lines, open_ = [], [], False
    for i, line in enumerate(text.split("\n")):
        n = len(words(line))
        if n and open_:
            out[-1][1], out[-1][3] = i, len(lines) + n
        elif n:
            out.append([i, i, len(lines), len(lines) + n])
        open_ = bool(n)
        lines.extend([i] * n)
    return out, lines


def scan_text(text, model):
    """The structs of `scan` for one text."""
    tokens = words(text or "")
    found = cues(tokens)
    predicted, licences = predictions(tokens, found, model) if found else ({}, [])
    if not licences and not predicted:
        return []
    blocks, lines = paragraphs(text)
    starts = [b[2] for b in blocks]
    block = lambda i: bisect_right(starts, i) - 1
    out, explained, unknown = [], set(), {}
    for begin, end, family, p, share in notices(tokens, found, predicted, model):
        out.append({"line": lines[begin], "last_line": lines[end - 1], "family": family, "p": p, "share": share,
                    "confirmed": True})
        explained.update(range(block(begin), block(end - 1) + 1))
    for begin, end, family, p in licences:
        own = set(range(block(begin), block(end - 1) + 1))
        if not own & explained:  # a passage over several paragraphs is put down to the one in its middle
            k = block((begin + end) // 2)
            unknown[k] = max(unknown.get(k, (0.0, "")), (p, family))
    out.extend({"line": blocks[k][0], "last_line": blocks[k][1], "family": family, "p": p, "share": 0.0, "confirmed": False}
               for k, (p, family) in sorted(unknown.items()))
    return out


def scan(docs: DataFrame, sample: int = SAMPLE_LINES) -> DataFrame:
    """doc_id and found: struct(line, last_line, family, p, share, confirmed) of every notice and of every
    paragraph without one that the classifier takes for a licence, for every row of `docs` (doc_id, text)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    some = rows.select("doc_id").filter("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id")
    plain = rows.join(F.broadcast(some.limit(sample // 4)), "doc_id").select(F.explode(F.split("text", "\n")).alias("t"))
    plain = plain.filter(~F.col("t").rlike("(?i)licen[sc]e|rights reserved|copyright|creative commons|spdx|cc by"))
    cut = F.expr(f"transform(sequence(0, size(w) - 1, {SPAN}), i -> array_join(slice(w, i + 1, {SPAN}), ' '))")
    pieces = plain.select(F.split(F.trim("t"), "\\s+").alias("w")).select(F.explode(cut).alias("t"))
    pieces = pieces.filter((F.col("t") != "") & (F.length("t") <= PIECE_CHARS)).distinct()
    lines = [r[0] for r in pieces.orderBy(F.xxhash64("t"), "t").limit(sample).collect()]
    # A line of a wrapped notice need not name a licence; it is no example without one.
    lines = [t for t in lines if not (own := cues(words(t))) or 2 * len(own) < len(words(t)) - 1]
    shared = spark.sparkContext.broadcast(train(lines))

    def run(batch):
        return batch.column(0), [scan_text(text, shared.value) for text in batch.column(1).to_pylist()]
    return map_arrow(rows, run, "doc_id long, found array<struct<line:int,last_line:int,family:string,p:double,"
                                "share:double,confirmed:boolean>>")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_notices (confirmed), families (confirmed, sorted, comma-joined), n_unknown (paragraphs
    that are a licence by the classifier, of none that a template confirms) of every row."""
    found = scan(docs)
    sure = F.filter("found", lambda x: x["confirmed"])
    return found.select(
        "doc_id", F.size(sure).cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"),
        F.size(F.filter("found", lambda x: ~x["confirmed"])).cast("long").alias("n_unknown"))
