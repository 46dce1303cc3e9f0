"""License scan against plain Python, and the rule table itself."""

from __future__ import annotations

import re

from strophe.llm import license_rules, licenses

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))


def words_of(t):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(AZ))


def brute_base(w):
    found = []
    for phrase, label in PHRASES:
        p = phrase.split()
        found += [(label, i, i + len(p), license_rules.PHRASE) for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    return sorted(found)


def brute_found(w):
    """All matches of all rules without the prefilter, then suppression by its definition, pair by pair."""
    text = " " + "  ".join(w) + " "
    every = []
    for at, r in enumerate(license_rules.RULES):
        for m in re.finditer(license_rules.compiled(r.pattern), text):
            start = text[:m.start()].count(" ") // 2
            every.append((start, start + m.group().count(" ") // 2, r.tier, at, r.label))
    inside = lambda a, b: b[0] <= a[0] and a[1] <= b[1] and (b[2], -(b[1] - b[0]), b[3]) < (a[2], -(a[1] - a[0]), a[3])
    return sorted((x[4], x[0], x[1], x[2]) for x in every if not any(inside(x, y) for y in every if y != x))


TEXTS = [
    "Licensed under the Apache License, Version 2.0. CC BY-NC 4.0! All rights reserved. MIT license mit License", None, "", "xmit license, mit licenses",
    "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: MIT",
    "GNU Lesser General Public License v2.1 or (at your option) any later version", "released under the terms of the\nBSD 3-Clause: Redistribution and use in source and binary forms, with or without modification, are permitted",
    "cc by cc by cc by CC-BY-SA-4.0 cc", "gnu general public license gnu general public license version 2 or any later version apache license version 2",
    "Copyright (c) 1999 2004, The Mozilla Public Licence 2.0 and the Eclipse Public License v2.0", "mit license " * 900 + "end", "ÉMIT License É mit license漢 mit license 漢",
    "GPLv3, LGPL 3.0 only; AGPL-3.0; this is free and unencumbered software released into the public domain",
]


def test_scan_equals_brute_force(spark, odd, empty):
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate([*TEXTS, TEXTS[0]])], "doc_id long, text string, base int, found string").repartition(3)
    rows = {r["doc_id"]: r for r in licenses.licensed(docs).collect()}
    assert len(rows) == len(TEXTS) + 1
    shown = lambda a: sorted((m["label"], m["start"], m["end"], m["tier"]) for m in a)
    for i, t in enumerate([*TEXTS, TEXTS[0]]):
        w, r = words_of(t), rows[i]
        assert r["n_words"] == len(w) and shown(r["base"]) == brute_base(w)
        want = brute_found(w) if len(w) < 1000 else None
        assert want is None or shown(r["found"]) == want
        assert r["labels"] == sorted({x[0] for x in [*brute_base(w), *shown(r["found"])]})
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["found"])
    assert len(rows[12]["base"]) == 900
    out = licenses.licensed(odd)
    assert out.count() == odd.count() and out.where("n_words = 0").count() == sum(not words_of(r["text"]) for r in odd.collect())
    assert licenses.licensed(empty).count() == 0


def test_every_rule_holds_its_keyword():
    for r in license_rules.RULES:
        p = r.pattern
        for _ in range(3):
            p = re.sub(r"\(\?:[^()]*\)\?", "", p)
        assert r.keyword in re.split("[^a-z0-9]+", p), r
    assert len(license_rules.RULES) >= 300


def test_no_python_in_the_plan(odd):
    plan = licenses.licensed(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_running_totals_in_blocks(spark):
    from pyspark.sql import functions as F

    df = spark.range(1).select(F.sequence(F.lit(1), F.lit(50)).alias("a"), F.array().cast("array<int>").alias("none"))
    got = df.select(licenses.running(F.col("a"), F.lit(0), lambda x, y: x + y).alias("s"), licenses.running(F.col("none"), F.lit(0), lambda x, y: x + y).alias("e")).first()
    assert got["s"] == [i * (i + 1) // 2 for i in range(1, 51)] and got["e"] == []
