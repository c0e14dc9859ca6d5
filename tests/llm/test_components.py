import random

import pytest

from tessera.llm.components import connected_components


@pytest.mark.parametrize("small", [0, 1 << 18])
def test_both_ways_give_the_least_node(spark, small):
    rng = random.Random(6)
    edges = [(rng.randrange(200) - 50, rng.randrange(200) - 50) for _ in range(110)] + [(i, i + 1) for i in range(1000, 1040)] + [(None, 3), (7, 7), (2**40, -(2**41))]
    parent = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = parent.setdefault(a, a), parent.setdefault(b, b)
            parent = {k: min(x, y) if v in (x, y) else v for k, v in parent.items()}
    got = connected_components(spark.createDataFrame(edges, "src long, dst long"), small=small).collect()
    assert {r["node"]: r["component"] for r in got} == parent and len(got) == len(parent)
    assert connected_components(spark.createDataFrame([], "src long, dst long"), small=small).count() == 0
