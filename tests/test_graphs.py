"""Components and registration against plain versions."""

import random

import pytest

from mediaqc.operators import graphs


def in_order(nodes, edges):
    out = set()
    before = {}
    for l, r in edges:
        before.setdefault(r, []).append(l)
    for x in sorted(nodes):
        if not any(l in out for l in before.get(x, [])):
            out.add(x)
    return out


def run(spark, nodes, edges, fold=None):
    found = graphs.registered(spark.createDataFrame([(x,) for x in nodes], "node long"), spark.createDataFrame(edges, "l long, r long"), fold)
    got = found.collect()
    assert len(got) == len(nodes)
    return {r.node for r in got if r.registered}, found._rounds


def test_components(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1005), (1002, 1005), (1002, 1002), (7, 250), (1000, 1005)]
    got = {r.node: r.root for r in graphs.components(spark.createDataFrame(edges, "l long, r long")).collect()}
    assert got == {**{k: 0 for k in range(301)}, 1000: 1000, 1002: 1000, 1005: 1000}
    assert graphs.components(spark.createDataFrame([], "l long, r long")).collect() == []


def test_a_chain_takes_one_round(spark):
    """5,000 rows, each a duplicate of the one before it."""
    nodes, edges = list(range(5000)), [(k, k + 1) for k in range(4999)]
    assert run(spark, nodes, edges) == ({k for k in nodes if k % 2 == 0}, 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_many_small_components(spark, seed):
    """More pairs than a task decides, in components that one task can decide: one round."""
    rnd = random.Random(seed)
    edges = [(b * 50 + x, b * 50 + y) for b in range(40) for x, y in (sorted(rnd.sample(range(50), 2)) for _ in range(20))]
    got, rounds = run(spark, list(range(2100)), edges, 100)
    assert got == in_order(range(2100), edges) and rounds == 1


def test_a_giant_component_in_few_rounds(spark):
    """A long chain with shortcuts and a row of very many pairs, ten times as many pairs as a task decides."""
    rnd = random.Random(3)
    edges = [(k, k + 1) for k in range(600)] + [tuple(sorted(rnd.sample(range(600), 2))) for _ in range(60)] + [(k, 700) for k in range(0, 600, 2)] + [(700, 701), (701, 702)]
    got, rounds = run(spark, list(range(703)), edges, 200)
    assert got == in_order(range(703), edges) and rounds <= 8


def test_cases(spark):
    assert run(spark, [], []) == (set(), 0)
    assert run(spark, [4, 9], []) == ({4, 9}, 0)
    assert run(spark, [1, 2, 3], [(1, 2), (1, 2), (2, 3)]) == ({1, 3}, 1)
