import hashlib
import random
import unicodedata

import pytest

from govflow.llm import fingerprint


def canon(text):
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split())


def brute(rows):
    rows = sorted(((i if i is not None else -(2**63), t or "", i) for i, t in rows), key=lambda r: r[0])
    out = []
    for k, (_, text, i) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), float(canon(edited) == canon(text)), float(canon(text) == canon(after))))
    return sorted(out, key=repr)


def sample(n=400):
    rng = random.Random(1)
    words = ["Straße", "STRASSE", "éa", "éa", "ﬁne", "fine", "  ", "\n", " ", "①", "1", "word", "Word"]
    rows = [(i * 3, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12)))) for i in range(n)]
    return rows + [(None, "null id"), (5000, None), (5001, ""), (5002, "abc"), (5003, "y" * 90_000), (5004, "y" * 90_000)]


def test_edit_study_against_brute_force(spark):
    rows = sample()
    docs = spark.createDataFrame([(i, t, "c", "d") for i, t in rows], "doc_id long, text string, digest string, k string").repartition(5)
    got = fingerprint.edit_study(docs).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got), key=repr) == brute(rows)
    by_id = {i: canon(t or "") for i, t in rows}
    seen = {}
    for r in got:
        assert seen.setdefault(by_id[r.doc_id], r.fingerprint) == r.fingerprint
    assert len(set(seen.values())) == len(seen)


def test_repeated_ids_single_row_and_empty_table(spark):
    repeated = spark.createDataFrame([(1, "aaaa"), (1, "aaaa"), (1, "bbbb"), (2, "cccc")], "doc_id long, text string")
    assert fingerprint.edit_study(repeated).count() == 4
    one = fingerprint.edit_study(spark.createDataFrame([(7, "abcdefgh")], "doc_id long, text string")).collect()[0]
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one.near_next == 1.0
    assert fingerprint.edit_study(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_shuffled_way_and_clashes(spark, monkeypatch):
    rows = sample(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    usual = sorted(map(tuple, fingerprint.edit_study(docs).collect()), key=repr)
    monkeypatch.setattr(fingerprint, "BROADCAST_DIGESTS", -1)
    assert sorted(map(tuple, fingerprint.edit_study(docs).collect()), key=repr) == usual
    monkeypatch.setattr(fingerprint, "wide_digest", lambda form: fingerprint.F.lit("same"))
    got = fingerprint.edit_study(docs).collect()
    forms = {canon(t or "") for _, t in rows}
    assert len({r.fingerprint for r in got}) == len(forms)
    assert sorted((r.doc_id, r.n_chars, r.near_edited, r.near_next) for r in got if r.doc_id is not None) == sorted((r[0], r[1], r[5], r[6]) for r in usual if r[0] is not None)


@pytest.mark.parametrize("ids", [lambda i: None, lambda i: 5 if i % 3 else i, lambda i: None if i % 2 else 10**12])
def test_ids_that_fill_several_ranges_are_split_by_digest(spark, ids):
    rows = [(ids(i), f"text number {i} of them") for i in range(300)]
    got = fingerprint.edit_study(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    digests = {r.t: r.fingerprint for r in fingerprint.fingerprints(spark.createDataFrame([(i, t, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string, t string")).join(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, t string"), "doc_id").collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, digests[r[1]]))
    want = []
    for (i, t), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        q = len(t) // 4
        want.append((i, digests[t], hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.fingerprint, r.edited_sha256) for r in got), key=repr) == sorted(want, key=repr)


def test_range_numbers_keep_the_order(spark):
    rng = random.Random(3)
    bounds = sorted({rng.randrange(-500, 500) for _ in range(130)})
    rows = [(k, "") for k in range(-510, 510)]
    got = spark.createDataFrame(rows, "k long, sub_key string").select("k", fingerprint._range_number(bounds, {}).alias("r")).collect()
    assert all(r.r >> 32 == sum(b < r.k for b in bounds) for r in got)
