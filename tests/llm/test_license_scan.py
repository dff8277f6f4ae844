import re

from tarnspark.llm import license_rules, license_scan

from . import cases

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}


def brute(text, table):
    """Words, base places and labels by plain loops over word positions."""
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    base = [(i, k) for k, p in PHRASES.items() for i in range(len(words)) if words[i : i + len(p)] == p]
    norm = " " + "  ".join(words) + " "
    spans = []
    for n, r in enumerate(table):
        for m in re.finditer(license_scan.pattern(r), norm):
            first = norm[: m.start()].count(" ") // 2
            spans.append((first, first + m[0].count(" ") // 2 - 1, r, n))
    kept = [s for s in spans if s[2].base or not any(t[0] <= s[0] and t[1] >= s[1] and t is not s and (t[2].priority > s[2].priority or t[2].priority == s[2].priority and ((t[0], -t[1], t[3]) < (s[0], -s[1], s[3]))) for t in spans)]
    starts = [i for i, _ in base]
    return (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({k for _, k in base})), ",".join(sorted({s[2].label for s in kept})))


def check(docs, table=None):
    found = license_rules.rules() if table is None else table
    texts = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in docs.select("doc_id", "text").collect())
    got = sorted((tuple(r)[:7] if r.doc_id is not None else (-1, *tuple(r)[1:7]) for r in license_scan.scan(docs, table).collect()), key=str)
    want = sorted(((d, *brute(t, found)) for d, t in texts), key=str)
    assert got == want


def test_rules_are_many_and_compile():
    table = license_rules.rules()
    assert len(table) > 200
    for r in table:
        re.compile(license_scan.pattern(r))


def test_scan_of_the_table(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_odd_rows(spark):
    check(cases.frame(spark))
    assert license_scan.scan(cases.empty(spark)).count() == 0


def test_overlaps(spark):
    texts = ["Licensed under the Apache License, Version 2.0 and the GPL v2.", "gnu general public license version 3 cc by cc-by sa", "MIT License, all rights reserved all rights reserved", "SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: MIT. égpl gplé", "M\u0130T License \u212a ISC L\u0130CENSE ALL RIGHTS RESERVED", "ÉTÉ MIT LICENSE ÀÖ"]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    labels = {r.doc_id: r.labels for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert labels[0] == "apache-2.0,gpl-2.0" and labels[3] == "gpl-2.0-or-later" and labels[4] == "mit"


def test_keywords_are_forced_by_their_patterns():
    for r in license_rules.rules():
        sure = re.sub(r"\([^()]*\)\??", "|", r.pattern)
        every = all(r.keyword in way for way in re.findall(r"\(([^()]*)\)(?!\?)", r.pattern)[:1] for way in way.split("|")) and "(" in r.pattern
        assert r.keyword in sure or every, r
