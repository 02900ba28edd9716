"""Pairs of projects and contracts come of arrays of contracts, whatever the bound on the contracts that an id skips."""

import pytest

from govflow.operators import hierarchy
from tests.test_visible_contracts import brute, forest


@pytest.mark.parametrize("most", [0, 1])
def test_pairs(spark, monkeypatch, most):
    parents, links = forest(3, True)
    for name, value in {"MOST_GONE": most, "TILE_IDS": 5, "TILE_CONTRACTS": 4}.items():
        monkeypatch.setattr(hierarchy, name, value)
    found = hierarchy.visible_contracts(spark.createDataFrame(parents, "id long, parent_id long"), spark.createDataFrame(links, "project_id long, contract_id long"))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(parents, links)
    assert "explode(_contracts" in found._jdf.queryExecution().optimizedPlan().toString()
