import hashlib
import random
import zlib

import pytest

from govflow.llm import merkle

FIELDS = "doc_id long, text string, lang string, source string, n_chars long, grp string, rank int, leaf string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, more=0):
    n = None if r[4] is None else r[4] + more
    return H(*map(field, (r[0], r[3], r[2], n, r[1])))


def up(nodes, fanout):
    """Levels from the leaves to what remains."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([H(*x[i : i + fanout]) for i in range(0, len(x), fanout)])
    return levels


def brute(rows, fanout=2):
    langs = sorted({r[2] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in langs:
        mine = sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = (mine, up([leaf(r) for r in mine], fanout))
    top = up([trees[g][1][-1][0] for g in langs], fanout)
    out = []
    for at, g in enumerate(langs):
        mine, levels = trees[g]
        for i, r in enumerate(mine):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            h, proof = leaf(r, int(changed)), ""
            for where, tree in ((i, levels), (at, top)):
                for level in tree[:-1]:
                    run = level[where - where % fanout :][:fanout]
                    k = where % fanout
                    proof += "".join(run[:k] + run[k + 1 :])
                    h = H(*run[:k], h, *run[k + 1 :])
                    where //= fanout
            out.append((r[0], leaf(r), levels[-1][0], top[-1][0], H(proof), h, h == top[-1][0]))
    return sorted(out, key=repr)


def got(spark, rows, fanout=2):
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], FIELDS).repartition(5)
    return sorted((tuple(r) for r in merkle.checked_proofs(docs, fanout=fanout).collect()), key=repr)


def some(n, seed):
    rng = random.Random(seed)
    ids = [rng.randint(-(2**63), 2**63 - 1) for _ in range(n // 2)] + list(range(n - n // 2))
    return [(i, rng.choice(["a", "é" * 5, "", None, "x" * 300]), rng.choice(["en", "de", None, "", "ü", "z"] if i % 3 else ["en"]), rng.choice(["s", None]), rng.choice([None, 0, 5, 2**63 - 1])) for i in ids]


@pytest.mark.parametrize("fanout", [2, 3])
def test_against_brute_force(spark, monkeypatch, fanout):
    monkeypatch.setattr(merkle, "TIER", 16)
    rows = some(300, fanout)
    rows += [(None, "a", "en", None, 1), (None, "a", "en", None, 1), (None, None, None, None, None), (3, "other", "en", None, 1), (3, "other", "en", None, 1)]
    assert got(spark, rows, fanout) == brute(rows, fanout)


def test_an_id_with_many_rows(spark, monkeypatch):
    monkeypatch.setattr(merkle, "MANY", 10)
    monkeypatch.setattr(merkle, "RUN", 8)
    rows = some(60, 5) + [(7, "same", "en", None, 1)] * 50 + [(7, f"t{i}", "en", None, i) for i in range(40)] + [(None, "same", "en", None, 2)] * 30
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, "a", None, None, None)], [(i, "a", "en", "s", 1) for i in range(3)]])
def test_few_rows(spark, rows):
    assert got(spark, rows) == (brute(rows) if rows else [])


def test_many_groups(spark, monkeypatch):
    monkeypatch.setattr(merkle, "TIER", 4)
    rows = [(i, "t", f"g{i % 50}", None, i) for i in range(120)]
    assert got(spark, rows) == brute(rows)
