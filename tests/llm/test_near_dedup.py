import random
import re

import pytest

from govflow.llm import near_dedup
from govflow.llm.components import connected_components


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text, k):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted(((i, len(s), find(i) if i is not None else None) for i, s in sets), key=repr)


def sample():
    rng = random.Random(11)
    vocabulary = ["w%d" % i for i in range(400)] + ["É", "ß", "x.y,"]
    rows = []
    for group in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([30, 80, 200]))]
        for copy in range(rng.choice([1, 2, 5, 25])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((len(rows) * 3 + 1, rng.choice([" ", "\n", "  "]).join(text).upper() if copy % 3 == 0 else " ".join(text)))
    # A chain: each text is like the next, the ends are not alike.
    chain = ["c%d" % i for i in range(300)]
    for step in range(12):
        rows.append((5000 - step, " ".join(chain[step * 9 : step * 9 + 150])))
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, "a b"), (9004, "A  b"), (9005, "a"), (None, "a b"), (9006, "long " * 60_000), (9007, "long " * 50_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("k", "percent", "nearest"), [(3, 85, 4), (5, 80, 4), (3, 85, 1)])
def test_against_all_pairs(spark, monkeypatch, k, percent, nearest):
    monkeypatch.setattr(near_dedup, "NEAREST", nearest)
    rows = sample()
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, digest string, id int").repartition(3)
    got = near_dedup.near_duplicates(docs, k, percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows, k, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_keep_one_and_empty_table(spark):
    docs = spark.createDataFrame([(3, "a b c d e f", "x", 1), (2, "a b c d e f", "y", 2), (None, "a b c d e f", "z", 3), (1, None, "n", 4)], "doc_id long, text string, lang string, _keep int")
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and {(r.doc_id, r.lang) for r in kept.collect()} == {(2, "y"), (None, "z"), (1, "n")}
    assert near_dedup.near_duplicates(docs.limit(0)).collect() == []


def test_large_group_of_edited_copies_and_clashing_ids(spark):
    rng = random.Random(31)
    base = ["b%d" % i for i in range(100)]
    rows = []
    for i in range(220):
        text = list(base) if i else base[:1] + base[1:]
        for _ in range(rng.choice([1, 2, 3, 4, 5, 6])):
            text[rng.randrange(100)] = rng.choice(["z%d" % rng.randrange(40), ""])
        rows.append((1000 + i, " ".join(text)))
    # Two texts of one id, each near to another text.
    rows += [(7, " ".join(base[:60])), (7, " ".join(f"q{i}" for i in range(50))), (8, " ".join(f"q{i}" for i in range(51))), (9, " ".join(base[:61]))]
    for k, percent in ((3, 85), (5, 80)):
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), k, percent).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows, k, percent)


def test_components_on_random_graphs(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7), (None, 3)]
    root = {x: x for e in edges for x in e if x is not None}
    for _ in range(80):
        for u, v in edges:
            if u is not None:
                root[u] = root[v] = min(root[u], root[v])
    real = {x for u, v in edges if u is not None and u != v for x in (u, v)}
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root[x] for x in real}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []
