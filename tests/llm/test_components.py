"""Components of links against a plain union of sets."""

import random

import pytest

from kelvinlake.llm import graph


def unions(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    return {x: find(x) for x in root}


def shapes():
    rnd = random.Random(5)
    ids = [rnd.getrandbits(63) - 2**62 for _ in range(3000)]
    chain = list(zip(ids[:900], ids[1:901]))
    star = [(ids[1000], x) for x in ids[1001:2000]]
    pairs = [tuple(rnd.sample(ids, 2)) for _ in range(1500)]
    odd = [(1, 1), (2, 3), (3, 2), (2, 3), (None, 2), (5, None)]
    comb = [(i, i + 1) for i in range(0, 400, 2)] + [(0, i) for i in range(0, 400, 2)]
    return {"chain": chain, "star": star, "both": chain + star + [(ids[5], ids[1500])], "pairs": pairs, "odd": odd, "comb": comb, "none": []}


@pytest.mark.parametrize("name", list(shapes()))
@pytest.mark.parametrize("hot", [1024, 3])
def test_components(spark, monkeypatch, name, hot):
    monkeypatch.setattr(graph, "HOT", hot)
    edges = shapes()[name]
    random.Random(1).shuffle(edges)
    found = graph.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()
    want = unions(edges)
    assert len(found) == len(want)  # one row a node
    assert {r["node"]: r["component"] for r in found} == want
