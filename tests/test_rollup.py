import random
from decimal import Decimal

import pytest

from govflow.operators import hierarchy, metrics


def plain(rows):
    parent = {i: p for i, p, _ in rows}
    own = {i: a for i, _, a in rows}
    children: dict = {}
    for i, p, _ in rows:
        if p in parent:
            children.setdefault(p, []).append(i)

    def cyclic(i):
        seen, at = set(), parent.get(i)
        while at in parent and at not in seen:
            if at == i:
                return True
            seen.add(at)
            at = parent[at]
        return at == i

    def total(i):
        return sum(map(total, children[i]), Decimal(0)) if i in children else own[i] or Decimal(0)

    return sorted((i, None if cyclic(i) else total(i)) for i in parent)


@pytest.mark.parametrize("seed", range(4))
def test_forests_with_cycles(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, rng.randrange(0, i), rng.randrange(0, 70)]) if i else None, rng.choice([None, Decimal(rng.randrange(-500, 500)) / 4])) for i in range(60)]
    if seed == 0:  # without any cycle
        rows = [(i, p if p is not None and p < i else None, a) for i, p, a in rows]
    got = hierarchy.rolled_up(spark.createDataFrame(rows, "id long, parent_id long, amount decimal(18,2)").repartition(3))
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_a_long_chain_and_nothing(spark):
    rows = [(i, i - 1 if i else None, Decimal(i)) for i in range(300)]
    got = hierarchy.rolled_up(spark.createDataFrame(rows, "id long, parent_id long, amount decimal(18,2)"))
    assert {r.amount for r in got.collect()} == {Decimal(299)}
    assert hierarchy.rolled_up(spark.createDataFrame([], "id long, parent_id long, amount decimal(18,2)")).collect() == []


def test_three_levels_with_and_without_changes(spark):
    projects = spark.createDataFrame([(1, None, None, 100.0, 5.0), (2, 1, None, 7.0, None), (3, 2, 10, 1.0, 1.0), (4, 2, None, 2.0, 3.0)], "id long, parent_id long, contract_id long, contract_amount double, change_amount double")
    contracts = spark.createDataFrame([(10, 50.0, 25.0)], "id long, contract_amount double, change_amount double")
    amounts = lambda **more: {r.id: float(r.contract_amount) for r in metrics.contract_amounts(projects, contracts, **more).collect()}
    assert amounts() == {1: 80.0, 2: 80.0, 3: 75.0, 4: 5.0}
    assert amounts(with_changes=False) == {1: 52.0, 2: 52.0, 3: 50.0, 4: 2.0}


def test_nothing_is_broadcast(spark, monkeypatch):
    """A broadcast passes through the driver, in every round; joins of the rollup and of cycles are merges."""
    plans, real = [], hierarchy.durable
    monkeypatch.setattr(hierarchy, "durable", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or real(df, name))
    rows = spark.createDataFrame([(1, None, 1), (2, 1, 2), (3, 2, 4), (4, 5, 8), (5, 4, 16), (6, 4, 32)], "id long, parent_id long, amount int")
    assert {r.id: r.amount and int(r.amount) for r in hierarchy.rolled_up(rows).collect()} == {1: 4, 2: 4, 3: 4, 4: None, 5: None, 6: 32}
    assert len(plans) > 6 and not any("Broadcast" in plan for plan in plans)
