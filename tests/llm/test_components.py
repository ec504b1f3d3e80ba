import random

import pytest

from quarrygrid.llm import components


@pytest.mark.parametrize("shape", ["random", "chain", "star", "none"])
def test_same_as_union_find(spark, shape):
    r = random.Random(6)
    n = 400
    edges = {"random": [(r.randrange(n), r.randrange(n)) for _ in range(330)], "chain": [(i, i + 1) for i in range(n - 1)], "star": [(7, i) for i in range(0, n, 2)], "none": []}[shape]
    tree = components.forest(edges)
    nodes = spark.createDataFrame([(i, 1000 - i) for i in range(n)], "k long, name long")
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    got = components.components(nodes, "k", "name", df).collect()
    root = {i: tree.get(i, i) for i in range(n)}
    least = {}
    for i in range(n):
        least[root[i]] = min(1000 - i, least.get(root[i], 1000))
    assert sorted((x.k, x.root, x.component_id) for x in got) == [(i, root[i], least[root[i]]) for i in range(n)]
