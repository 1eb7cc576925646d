import random

from shelfmark.plans.components import components


def test_random_graphs(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(110)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5001 + i) for i in range(50)] + [(9, 9)]
    low = {}
    for _ in range(300):
        for a, b in edges:
            m = min(low.get(a, a), low.get(b, b))
            low[a] = low[b] = m
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: low[x] for x in linked}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
