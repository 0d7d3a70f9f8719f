import random

from massloom.operators.graph import connected_components


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7)]
    got = connected_components(spark.createDataFrame(edges, "src long, dst long"))
    assert {r.id: r.component for r in got.collect()} == brute(edges)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_hubs_and_long_paths_meet(spark, monkeypatch):
    from massloom.operators import graph

    monkeypatch.setattr(graph, "HUB", 5)
    edges = [(100, k) for k in range(200, 240)] + [(k, k + 1) for k in range(300, 330)] + [(7, 310), (239, 400), (400, 401)] + [(900, k) for k in range(901, 920)]
    got = {r.id: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert {got[k] for k in [100, *range(200, 240), 400, 401]} == {100}
    assert {got[k] for k in [7, *range(300, 331)]} == {7} and {got[k] for k in range(900, 920)} == {900}
