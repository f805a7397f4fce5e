import random

import pytest

from sitelens.llm.common import connected_components


@pytest.mark.parametrize("small", [0, 10**6])
def test_components(spark, small):
    r = random.Random(7)
    edges = [(r.randrange(-400, 400), r.randrange(-400, 400)) for _ in range(300)] + [(k, k + 1) for k in range(1000, 1080)] + [(2000, 2000 + k) for k in range(1, 60)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    df = spark.createDataFrame(edges + edges[:50], "a long, b long").repartition(7)
    got = [(x["node"], x["component"]) for x in connected_components(df, "a", "b", small).collect()]
    assert len(got) == len(set(got)) and dict(got) == want
    assert connected_components(df.limit(0), "a", "b", small).collect() == []
