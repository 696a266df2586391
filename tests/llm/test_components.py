import random

import pytest

from docloom.llm import components as C


def brute(links):
    top = {}
    for a, b in links:
        top.setdefault(a, a)
        top.setdefault(b, b)

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        top[y] = x
    return {x: root(x) for x in top if any(x in e and e[0] != e[1] for e in links)}


@pytest.mark.parametrize("local", [5, 1000])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(C, "LOCAL", local)
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(20)] + [(100, k) for k in range(101, 125)] + [(rng.randrange(200, 240), rng.randrange(200, 240)) for _ in range(15)] + [(100, 101), (7, 7)]
    df = spark.createDataFrame(links, "a long, b long").repartition(4)
    got = {r.node: r.component for r in C.components(df).collect()}
    assert got == brute(links)
    assert C.components(df.limit(0)).count() == 0
