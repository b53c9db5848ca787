"""Chat perspectives and license scans against plain Python, and without Python on the executors."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cloakwork.llm import chat, licenses

ROLES = ["anna", "bob", "system", None, "user"]


def conversations(seed):
    rnd = random.Random(seed)
    rows = [(c, rnd.choice([t, t, 0, None]), rnd.choice(ROLES), rnd.choice([None, "", "hi <|end|>", "x" * rnd.randint(1, 60), "é\n🙂"])) for c in [None, 1, 2, 3] for t in range(rnd.randint(1, 40))]
    return [*rows, *rows[:3], (9, 0, "system", "alone")]


def rendered(rows):
    """(conv_id, perspective) -> (text, masks)."""
    key = lambda r: tuple((x is not None, x) for x in r)
    shown = defaultdict(list)
    for c, t, role, text in rows:
        shown[c].append((t, role or "unknown", (text or "").replace("<|", "< |")))
    out = {}
    for c, messages in shown.items():
        messages.sort(key=lambda r: (key(r[:1]), r[1].encode(), r[2].encode()))
        for speaker in {m[1] for m in messages} - {"system"}:
            text, masks = "", []
            for _, role, body in messages:
                head = "<|assistant|>\n" if role == speaker else "<|system|>\n" if role == "system" else f"<|user name={role}|>\n"
                if role == speaker:
                    masks.append((len(text) + len(head), len(text) + len(head) + len(body) + len("<|end|>")))
                text += f"{head}{body}<|end|>\n"
            out[c, speaker] = text, masks
    return out


@pytest.mark.parametrize(("seed", "part"), [(1, 65_536), (2, 100)])
def test_perspectives(spark, seed, part):
    rows = conversations(seed)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, perspective string, start int").repartition(4)
    got = defaultdict(list)
    for r in chat.perspectives(df, part_chars=part).collect():
        got[r.conv_id, r.perspective].append(r)
    want = rendered(rows)
    assert got.keys() == want.keys()
    for k, (text, masks) in want.items():
        parts = sorted(got[k], key=lambda r: r.part)
        assert "".join(r.text for r in parts) == text
        assert ",".join(r.mask for r in parts if r.mask) == ",".join(f"{a}-{b}" for a, b in masks)
        at = 0
        for r in parts:
            assert r.start == at and r.part == at // part
            at += len(r.text)
        assert sum(r.n_targets for r in parts) == len(masks)
    assert chat.perspectives(df.limit(0)).count() == 0


WORD = re.compile(licenses.WORD)


def plain(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    places = {x: [i for i in range(len(words)) if tuple(words[i : i + len(p)]) == p] for x, p in licenses.PHRASES.items()}
    every = [i for p in places.values() for i in p]
    base = {x for x, p in places.items() if p}
    best = {}
    near = licenses.rivals(licenses.TEMPLATES)
    for block in re.split(licenses.BLOCK_END, re.sub(licenses.VERSION, r"v \1", low)):
        own, held = set(WORD.findall(block)), {}
        for label, t in licenses.TEMPLATES.items():
            t = set(t.split())
            if len(own & t) >= licenses._needed(list(t), licenses.THRESHOLD):
                held[label] = len(own & t) / len(t), len(t)
        for label, of in held.items():
            if not any(held[x] > of for x in near[label] if x in held):
                best[label] = max(best.get(label, 0), of[0])
    score = 1.0 if every else max(best.values(), default=0.0)
    return len(words), len(every), min(every, default=None), max(every, default=None), ",".join(sorted(base)), ",".join(sorted(base | best.keys())), pytest.approx(score)


def test_licenses(spark):
    rnd = random.Random(3)
    texts = [None, "", "...", "CC-BY", "cc by cc BY", "İ General  PUBLIC\nlicense é", "all rights", "All rights reserved. All Rights Reserved", "ccc by", "This wor\u212a is licensed under the gnu general public license version 3", "L\u0130CENSED under cc by nc 4 0", "x " * 4000, "é" * 9000]
    for t in licenses.TEMPLATES.values():
        for drop in range(4):
            words = t.split()
            for _ in range(drop):
                words.pop(rnd.randrange(len(words)))
            rnd.shuffle(words)
            texts.append(" ".join(rnd.choice(["foo", "the", "license"]) for _ in range(5)) + rnd.choice([". ", "\n", " "]) + " ".join(words).title())
    texts += texts[3:9]
    df = spark.createDataFrame([(i if i % 7 else None, t, "x", 0.5) for i, t in enumerate(texts)], "doc_id long, text string, labels string, score double").repartition(4)
    got = licenses.scan(df).collect()
    want = sorted(map(repr, ((i if i % 7 else None, *plain(t)[:6]) for i, t in enumerate(texts))))
    assert sorted(repr((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels)) for r in got) == want
    assert all(r.score == plain(texts[r.doc_id])[6] for r in got if r.doc_id is not None)
    assert licenses.scan(df.limit(0)).count() == 0


def test_wrapped_license(spark):
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files"
    rows = [(1, f"/*\n * {grant}, to deal\n */"), (2, grant.replace("\n", "\n\n")), (3, "Redistribution and use in source and binary forms, with or without\r\nmodification, are permitted provided")]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "mit-grant", 2: "", 3: "bsd"}


GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or (at your option) any later version."
#: Unaltered public notices, with what is found in them.
NOTICES = [
    (GNU.format(""), "gpl,gpl-notice"),
    (GNU.format("Lesser "), "gpl,lgpl-notice"),
    (GNU.format("Affero "), "agpl-3.0,agpl-notice,gpl"),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.", "mpl-2.0"),
    ("Distributed under the MIT License.", "mit-distributed"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.", "mit-grant,mit-notice"),
    ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.", "bsd,bsd-3-clause,bsd-binary,bsd-clause"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.", "apache-2.0,apache-2.0-notice"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "isc"),
    ("Distributed under the Boost Software License, Version 1.0.", "bsl-1.0"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("Copyright (c) 2020 Some One. All rights reserved.", "reserved"),
]


def test_unaltered_notices(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(NOTICES)], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.scan(df).collect()} == {i: labels for i, (_, labels) in enumerate(NOTICES)}


def test_license_texts_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    rows = [(1, "Licensed under the MIT License."), (2, "all rights reserved"), (3, "nothing"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, given string").select("doc_id", F.udf(seen)("given").alias("text"))
    got = sorted((r.doc_id, r.labels) for r in licenses.scan(docs).collect())
    assert got == [(1, "mit-licensed"), (2, "reserved"), (3, ""), (3, "")]
    assert read.value == len(rows)


def test_no_python_on_the_executors(spark):
    docs = spark.createDataFrame([(1, "all rights reserved")], "doc_id long, text string")
    talk = spark.createDataFrame([(1, 0, "a", "x")], "conv_id long, turn long, role string, text string")
    for df in (licenses.scan(docs), chat.perspectives(talk)):
        assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().toString())
