import random

import numpy as np

from siftlake.llm import licences


def test_families_and_unknown(spark):
    plain = ["the quick brown fox and the lazy dog", "a general remark about public life", "no source of light in the room", "under the bridge all is well"]
    rows = [(k, "\n".join([plain[k % 4], plain[(k + 1) % 4]])) for k in range(40)]
    noted = {
        100: ("Intro text\nReleased under the MIT License.\nmore", "mit"),
        101: ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
        102: ("some words before this work is licensed under the GNU General Public License, version 3", "gpl"),
        103: ("Licensed under CC BY-NC 4.0.\nAll rights reserved.", "cc-by-nc,reserved"),
        104: ("I renewed my driving license", ""),
        105: ("x\n" * 30_000 + "Released under the MIT License.", "mit"),
    }
    rows += [(i, t) for i, (t, _) in noted.items()] + [(200, None), (201, ""), (None, "Released under the MIT License.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS families")
    got = {r.doc_id: r for r in licences.op6_licences(docs).collect()}
    assert len(got) == len(rows)
    assert {i: got[i].families for i in noted} == {i: f for i, (_, f) in noted.items()}
    assert all(got[k].families == "" and got[k].n_notices == 0 for k in [*range(40), 200, 201])
    assert got[None].families == "mit"
    assert licences.op6_licences(docs.limit(0)).count() == 0


def test_common_template_words_hide_no_notice(spark):
    plain = ["all is well with the mit team", "rights and wrongs of the town", "seats reserved for guests", "the film was released last year under a new title", "my driving license has gone", "permission to speak, free of any charge", "a gnu and a public house", "the general version of this work", "apache and creative commons in one line", "for each person the terms differ"]
    rows = [(k, "\n".join([plain[k % 10], plain[(k + 3) % 10]])) for k in range(60)]
    noted = {100: ("All rights reserved.", "reserved"), 101: ("Released under the MIT License.", "mit"), 102: ("x\nThis work is licensed under the GNU General Public License, version 3.", "gpl")}
    docs = spark.createDataFrame(rows + [(i, t) for i, (t, _) in noted.items()], "doc_id long, text string")
    got = {r.doc_id: r.families for r in licences.op6_licences(docs).collect()}
    assert got == {k: "" for k, _ in rows} | {i: f for i, (_, f) in noted.items()}


def brute_passages(model, words, paragraph):
    """Passages by looking at every run of words of every template."""
    out = set()
    for k, (_, t) in enumerate(model.templates):
        pairs = {(a, b) for a, b in zip(t.tolist(), t[1:].tolist())}
        held = [j for j in range(len(words) - 1) if (words[j], words[j + 1]) in pairs and paragraph[j] == paragraph[j + 1]]
        span = len(pairs) + max(8, len(pairs) // 2)
        for i in held:
            inside = [j for j in held if i <= j < i + span and paragraph[j] == paragraph[i]]
            distinct = {(words[j], words[j + 1]) for j in inside}
            if len(distinct) >= licences.LEAST_SEEDS * len(pairs):
                end = next(j for j in inside if len({(words[x], words[x + 1]) for x in inside if x <= j}) == len(distinct))
                out.add((i, end + 2, k, len(distinct)))
    return out


def test_passages_by_brute_force(spark):
    model = licences.train(spark.createDataFrame([("a b c",)], "text string"))
    rng = random.Random(4)
    words = sorted({w for ts in licences.TEMPLATES.values() for t in ts for w in licences._split(t)})
    every = [t for ts in licences.TEMPLATES.values() for t in ts]
    lines = ["", "all"] + [" ".join(rng.sample(words, 5)) for _ in range(50)] + [" ".join(w for w in rng.choice(every).split() if rng.random() > 0.2) + rng.choice([" end", "\n", ""]) for _ in range(200)]
    data = "\n".join(lines).encode()
    raw = np.frombuffer(data, np.uint8)
    hashes, _, paragraph = licences.paragraphs(raw, np.array([0, len(data)]))
    got = set(map(tuple, model.passages(hashes, paragraph)))
    assert got == brute_passages(model, hashes.tolist(), paragraph.tolist()) and len(got) > 300


#: Notices as they are commonly worded, none of them a template.
HEADERS = [
    ("# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.", "gpl"),
    ("/*\n * Permission is hereby granted, free of charge, to any person obtaining\n * a copy of this software and associated documentation files (the \"Software\"),\n * to deal in the Software without restriction\n */", "mit"),
    ("available under the MIT licence", "mit"),
    ("This code is released under the MIT License.", "mit"),
    ("// Licensed under the Apache License,\n// Version 2.0 (the \"License\"); you may not use\n// this file except in compliance with the License.", "apache-2.0"),
    ("Licensed under the Apache License 2.0", "apache-2.0"),
    ("This library is free software; you can redistribute it and/or modify it\nunder the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation", "lgpl"),
    ("Copyright 2019 The authors. All rights reserved.", "reserved"),
    ("This work is licensed under a Creative Commons\nAttribution-ShareAlike License", "cc-by-sa"),
    ("Use of this source code is governed by a BSD-style\nlicence that can be found in the LICENSE file.", "bsd"),
    ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:", "bsd"),
    ("-- This Source Code Form is subject to the terms of the Mozilla Public\n-- License, v. 2.0. If a copy of the MPL was not distributed", "mpl-2.0"),
    ("SPDX-License-Identifier: MIT", "mit"),
    ("<!-- SPDX-License-Identifier: Apache-2.0 -->", "apache-2.0"),
]
TALK = "permission license free software rights reserved under public general terms version source code work copyright authors charge person attribution commons universal distributed without following conditions may use this the of and in for with".split()


def test_held_out_notices(spark):
    """Noised, wrapped, respelt and differently worded notices, among prose made of the words of licences."""
    rng = random.Random(12)
    talk = lambda: " ".join(rng.choice(TALK) if rng.random() < 0.5 else rng.choice(["river", "stone", "early", "walk", "green", "paper"]) for _ in range(rng.randint(6, 30)))
    rows, want = [], {}

    def add(text, families):
        want[len(rows)] = families
        rows.append((len(rows), text))

    for family, texts in licences.TEMPLATES.items():
        for t in texts:
            for mark in ("", "# ", " * ", "// "):
                words = t.split()
                if len(words) > 5:
                    words.pop(rng.randrange(len(words)))
                lines = [" ".join(words[k : k + 5]) for k in range(0, len(words), 5)]
                text = "\n".join(mark + x for x in lines).replace("License", rng.choice(["License", "Licence", "LICENSE"]))
                add(f"{talk()}\n\n{text}\n\n{talk()}", {family})
    noised = len(rows)
    for text, family in HEADERS:
        add(f"{talk()}\n{text}\n{talk()}", {family})
        add(text, {family})
    for _ in range(300):
        add("\n".join(talk() for _ in range(4)), set())
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: set(r.families.split(",")) - {""} for r in licences.op6_licences(docs).collect()}
    for part in (range(noised), range(noised, noised + 2 * len(HEADERS)), range(len(rows))):
        true = sum(len(got[k] & want[k]) for k in part)
        recall, precision = true / sum(len(want[k]) for k in part), true / max(sum(len(got[k]) for k in part), 1)
        print(recall, precision, [(rows[k][1], want[k], got[k]) for k in part if got[k] != want[k]][:12])
        assert recall >= 0.9 and precision >= 0.9
