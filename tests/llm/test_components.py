import random

import pytest

from nearkin.llm.components import connected_components


def brute(edges):
    low = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return {x: r for x, r in low.items()}


@pytest.mark.parametrize("kind", ["random", "chain", "star"])
def test_equals_brute_force(spark, kind):
    rng = random.Random(3)
    if kind == "random":
        edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    elif kind == "chain":
        order = rng.sample(range(-100, 100), 200)
        edges = list(zip(order, order[1:], strict=False))
    else:
        edges = [(500, i) for i in range(100)] + [(i, 500) for i in range(100)]
    df = spark.createDataFrame(edges + [(None, 1), (2, None)], "a long, b long").repartition(7)
    got = {r.node: r.root for r in connected_components(df).collect()}
    linked = [(a, b) for a, b in edges if a != b]
    assert got == brute(linked)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
