"""Components against a walk through the edges."""

import random

from snapledger.llm import components as module


def walked(edges):
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[top(a)] = top(b)
    groups = {}
    for x in parent:
        groups.setdefault(top(x), set()).add(x)
    return sorted(map(sorted, groups.values()))


def test_stars_paths_and_random_graphs(spark, monkeypatch):
    rng = random.Random(1)
    star = [(0, k) for k in range(1, 400)]
    path = [(1000 + k, 1001 + k) for k in range(150)]
    sparse = [(rng.randint(2000, 2400), rng.randint(2000, 2400)) for _ in range(260)]
    edges = [(a, b) for a, b in star + path + sparse + [(1, 0), (3, 3)] if a != b]
    tables, whole = [], module.stored
    monkeypatch.setattr(module, "stored", lambda df: tables.append(1) or whole(df))
    groups = {}
    for r in module.components(spark.createDataFrame(edges + [(3, 3)], "src long, dst long")).collect():
        groups.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(sorted, groups.values())) == walked(edges)
    assert len(tables) <= 1 + 3 * 8


def test_no_edges(spark):
    assert module.components(spark.createDataFrame([], "src long, dst long")).collect() == []
