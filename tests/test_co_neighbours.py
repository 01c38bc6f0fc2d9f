"""Pairs of sources with shared targets: the same as counting them one by one, without an exchange of the pairs."""

import itertools
import random

import pytest

from evigraph.operators import graph as G


@pytest.mark.parametrize("block", [1, 3, 512])
def test_pairs_equal_counting(spark, monkeypatch, block):
    monkeypatch.setattr(G, "BLOCK", block)
    rng = random.Random(block)
    # many sources with the same targets, some with their own, repeated edges, nulls
    edges = [(f"s{i}", t) for i in range(25) for t in ((1,), (1, 2), (9,), tuple(rng.sample(range(1, 7), 3)))[i % 4]]
    edges += [*edges[:9], (None, 1), ("s1", None), ("alone", None)]
    targets = {}
    for s, t in edges:
        if s is not None and t is not None:
            targets.setdefault(s, set()).add(t)
    want = {(a, b, len(targets[a] & targets[b])) for a, b in itertools.combinations(sorted(targets), 2) if targets[a] & targets[b]}
    got = [tuple(r) for r in G.co_neighbours(spark.createDataFrame(edges, "source_id string, target_id int")).select("a", "b", "n").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_pairs_are_made_after_the_last_exchange(spark):
    edges = spark.range(3000).selectExpr("id AS source_id", "id % 2 AS target_id")
    out = G.co_neighbours(edges)
    assert out.count() == 2 * 1500 * 1499 // 2
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and plan.rindex("Generate") < min(plan.index(x) for x in ("Join", "Aggregate", "Repartition"))


def test_no_edges_no_pairs(spark):
    assert G.co_neighbours(spark.createDataFrame([], "source_id long, target_id long")).collect() == []
