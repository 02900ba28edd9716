import random
import re

from govflow.llm import license_rules, license_scan, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = [(i, label) for phrase, label in license_rules.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in hits]
    return len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


def test_base_columns_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    parts = ["GNU General Public License", "version 3", "or later", "Apache-License,", "2.0", "CC BY", "-SA 4.0", "MIT", "license", "é", "Übung", "x1", "...", "\n", "mit"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(0, 40)))) for i in range(300)]
    rows += [(None, "mit license"), (900, None), (901, ""), (902, "Apache License " * 20_000)]
    spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_words int").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op1_license_scan(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    assert sorted(map(repr, (((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got))) == sorted(map(repr, ((i, *brute(t)) for i, t in rows)))
    for r in got:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_suppression_matches_the_definition():
    rng = random.Random(8)
    for _ in range(300):
        spans = [(s := rng.randrange(20), s + rng.randrange(1, 8), rng.choice([10, 20, 30]), o, "x", False) for o in range(rng.randrange(1, 12))]

        def beats(a, b):
            inside = a[0] <= b[0] and b[1] <= a[1]
            rank = lambda x: (-x[2], -(x[1] - x[0]), x[3])
            return inside and rank(a) < rank(b)

        want = {i for i, b in enumerate(spans) if not any(beats(a, b) for a in spans)}
        assert license_scan.resolve(spans) == want


def test_rules_are_well_formed_and_specific():
    rules = license_rules.parsed()
    assert len(rules) > 200
    scan = license_scan.scanner().scan
    assert {d["label"] for d in scan("SPDX-License-Identifier: GPL-2.0-or-later")[1]} == {"gpl-2.0-or-later"}
    n, found = scan("Licensed under the Apache License, Version 2.0.")
    assert n == 8 and [(d["label"], d["start_word"], d["end_word"], d["base"], d["resolved"]) for d in found] == [("apache-2.0", 0, 8, False, True), ("apache", 3, 5, True, False)]
    assert scan("die Frau mit der Lizenz und das Wort gnu")[1] == []


def test_empty_table(spark):
    assert license_scan.license_scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
