"""Licence rules: planted statements, and whole results against a plain scan and suppression."""

import random
import re

import pytest

from tomolake.llm import license_rules, licenses


def plain(rows):
    """As the docstrings say, with Python's regular expressions and every pair of detections compared."""
    out = []
    for doc_id, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", low) if w]
        body = "  ".join(words)
        body = f" {body} " if words else ""
        found = []
        for r in license_rules.rules():
            for m in re.finditer(r.regex, body):
                start = body[: m.start()].count(" ") // 2
                found.append((start, start + m[0].count(" ") // 2, r.priority, r.rule, r.label, r.base))
        kept = [d for d in found if d[5] or not any(e[0] <= d[0] and e[1] >= d[1] and (e[2], e[1] - e[0], -e[3]) > (d[2], d[1] - d[0], -d[3]) for e in found)]
        base = [d for d in kept if d[5]]
        starts = [d[0] for d in base]
        score = max((license_rules.SURE[d[2]] for d in kept), default=0.0)
        out.append((doc_id, len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({d[4] for d in base})), ",".join(sorted({d[4] for d in kept})), score))
    return out


STATEMENTS = [
    "Licensed under CC BY-NC 4.0.",
    "Licensed under the Apache License, Version 2.0",
    "Released under the MIT License.",
    "GNU General Public License, version 3",
    "SPDX-License-Identifier: GPL-3.0-or-later",
    "All rights reserved. All rights reserved",
    "(c) 2011 Foo; copyright (c) 2012",
    "GNU Lesser General Public License v2.1 or (at your option) any later version",
    "https://creativecommons.org/licenses/by-sa/3.0/",
    "Creative Commons Attribution-ShareAlike 4.0 International License",
    "either version 3 of the License, or (at your option) any later version",
    "Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files",
    "Ünder cc BY é cc by",
    "cc by cc by cc",
    "LGPLv3 gplv2 gpl",
    "This is Proprietary and Confidential",
]


def corpus():
    rng = random.Random(11)
    vocabulary = sorted({re.sub(r"[^a-zé]", "", w) for r in license_rules.rules() for w in r.regex.split(" ")} - {""})
    rows = [(i, " ".join(rng.choice(STATEMENTS + ["the", "2", "0", "version", "…"]) for _ in range(rng.randrange(6)))) for i in range(150)]
    rows += [(i, rng.choice([" ", "-", "\n"]).join(rng.choice(vocabulary + ["2", "0", "3"] * 9) for _ in range(rng.randrange(300)))) for i in range(150, 220)]
    return rows + [(220, None), (221, ""), (222, " .,; "), (None, "cc by"), (7, "gpl"), (7, "gpl"), (223, "日本 All Rights\tReserved 語"), (224, "cc by " * 700)]


def test_scan_matches_plain_scan(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", 1, "r") for r in rows], "doc_id long, text string, words string, found int, rules string").repartition(4)
    got = [tuple(r) for r in licenses.summary(licenses.scan(docs)).collect()]
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr)
    assert sum(r[2] > 0 for r in got) > 50


@pytest.mark.parametrize(
    "text,labels",
    [
        ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0,licensed"),
        ("under the Apache License, Version 2.0", "apache-2.0"),
        ("Released under the MIT License.", "mit,released"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0,licensed"),
        ("SPDX-License-Identifier: MIT", "mit"),
        ("GNU Lesser General Public License v2.1", "gpl,lgpl-2.1"),
        ("© ACME. All rights reserved.", "reserved"),
        ("an apache helicopter with a mit in it", ""),
    ],
)
def test_statements(spark, text, labels):
    assert licenses.summary(licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()["labels"] == labels


def test_every_rule_needs_what_it_matches():
    """A rule's phrases are in whatever it matches, so the keyword gate loses nothing."""
    rng, seen = random.Random(2), 0
    for r in license_rules.rules():
        body = "".join(_one(part, rng) for part in re.findall(r"\(\?: .*? \)(?:\?|\{0,\d+\}\?)| \S+ ", r.regex))
        if m := re.search(r.regex, body):
            seen += 1
            assert all(n in m[0] or n in body for n in r.needs), (r, body)
    assert seen > 500


def _one(part, rng):
    """A word that a part of a rule matches, or nothing for a part that may be missing."""
    if part.startswith("(?: "):
        return ""
    word = part.strip()
    word = re.sub(r"\(\?:([^()|]*(?:\([^()]*\)[^()|]*)*)(?:\|[^()]*(?:\([^()]*\)[^()]*)*)*\)\??", lambda m: _one(f" {m[1]} ", rng).strip(), word)
    word = re.sub(r"\[([^\]])[^\]]*\]\??", r"\1", word)
    return " " + word.replace(r"\d", "1").replace("v?", "").replace("s?", "s").replace("?", "") + " "


def test_the_plan_is_one_pass_of_built_in_functions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = licenses.summary(licenses.scan(docs))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Pandas|Arrow", plan)
    assert plan.count("translate(") == 1 and plan.count("regexp_replace(") == 1


def test_no_rows(spark):
    assert licenses.summary(licenses.scan(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
