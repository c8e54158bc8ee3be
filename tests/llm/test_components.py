import random

from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm.components import components


def plain(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(-30, 30), st.integers(-30, 30)), min_size=1, max_size=40))
def test_random_graphs(spark, edges):
    assert dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect())) == plain(edges)


def test_chain_and_hub(spark):
    rnd = random.Random(1)
    names = rnd.sample(range(10**6), 300)
    edges = list(zip(names, names[1:])) + [(-5, -i) for i in range(6, 200)]
    assert dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect())) == plain(edges)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
