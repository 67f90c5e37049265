import random

from loomwork.llm.near_dup import components


def test_components_equal_brute_force(spark):
    random.seed(5)
    edges = [(random.randint(0, 60), random.randint(0, 60)) for _ in range(35)]
    edges += [(100, 300), (300, 101), (101, 299), (299, 102)] + [(500 + i, 501 + i) for i in range(20)] + [(900, 700 + i) for i in range(30)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: root(x) for e in edges if e[0] != e[1] for x in e}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
