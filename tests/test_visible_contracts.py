"""Contracts that projects see, without the pairs of a container meeting in one task or shuffle."""

import random

import pytest

from govflow.operators import hierarchy, metrics


def brute(parents, links, depth=hierarchy.MAX_DEPTH):
    """Pairs (project, contract), walking up over every parent."""
    found = set()
    for start in {i for i, _ in parents}:
        at = {start}
        for _ in range(depth + 1):
            found |= {(start, c) for p, c in links if p in at}
            at = {p for i, p in parents if i in at and p is not None}
    return found


def forest(seed, several=False):
    """Trees with a cycle, contracts held at several levels of a path and by many, links that stand twice."""
    deal = random.Random(seed)
    parents = [(i, deal.choice([None, *range(1, i)]) if i > 4 else {1: 2, 2: 3, 3: 1, 4: 4}[i]) for i in range(1, 40)] + [(40 + i, 39 + i) for i in range(12)]
    parents += [(i, deal.randint(1, 30)) for i in (10, 20)] * several
    links = [(deal.randint(1, 51), deal.randint(1, 25)) for _ in range(90)] + [(i, 99) for i in range(1, 52)]
    return sorted(set(parents), key=str), links + links[:5]


@pytest.fixture(params=[(1, False), (2, False), (3, True)])
def made(spark, request):
    parents, links = forest(*request.param)
    return parents, links, spark.createDataFrame(parents, "id long, parent_id long"), spark.createDataFrame(links, "project_id long, contract_id long")


@pytest.mark.parametrize("most", [1, 8, 64])
def test_pairs(made, monkeypatch, most):
    """Whatever the tiles and the holders that rows carry."""
    parents, links, projects, linked = made
    for name, value in {"MOST_HOLDERS": most, "TILE_IDS": 3, "TILE_CONTRACTS": 2}.items():
        monkeypatch.setattr(hierarchy, name, value)
    got = [tuple(r) for r in hierarchy.visible_contracts(projects, linked).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(parents, links)
    some = hierarchy.visible_contracts(projects, linked, of=projects.where("id % 3 = 0")).collect()
    assert {tuple(r) for r in some} == {x for x in brute(parents, links) if x[0] % 3 == 0}


def test_counts_and_funds(spark, made):
    parents, links, projects, linked = made
    projects, seen = projects.select("id", "parent_id").dropDuplicates(["id", "parent_id"]), brute(parents, links)
    got = {r.id: r.contracts for r in metrics.contract_counts(projects, linked).collect()}
    assert got == {i: sum(p == i for p, _ in seen) for i, _ in parents}
    deal = random.Random(5)
    contracts = [(c, 100 + c, c % 3) for c in [*range(1, 20), 99]]
    paid = [(deal.choice([None, *range(1, 52)]), deal.choice([None, *range(1, 26)]), deal.randint(1, 9)) for _ in range(300)]
    of = lambda rows, kind: spark.createDataFrame(rows, kind)
    frame = metrics.fund_summary(projects, of(contracts, "id long, contract_amount int, change_amount int"), linked, of(paid, "project_id long, contract_id long, paid_amount int"))
    known = {c for c, _, _ in contracts}
    for r in frame.collect():
        total = sum(a + b for c, a, b in contracts if (r.id, c) in seen)
        money = sum(x for p, c, x in paid if p == r.id or (c in known and (r.id, c) in seen))
        assert (r.contract_total, r.paid_total, r.outstanding) == (total, money, max(total - money, 0)), r
