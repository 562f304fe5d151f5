import random

import numpy as np
import pytest

from strandwork.llm.components import connected_components, priority, spanning_stars


def exact(nodes, edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            up[root(a)] = root(b)
    least = {}
    for x in nodes:
        least[root(x)] = min(x, least.get(root(x), x))
    return {x: least[root(x)] for x in nodes}


def groups(spark, nodes, edges, chunk, parts=6):
    n = spark.createDataFrame([(x, 1) for x in nodes], "node_id long, label long")
    e = spark.createDataFrame([(a, b, 0) for a, b in edges], "a long, b long, root long").repartition(parts)
    rows = [tuple(r) for r in connected_components(n, e, chunk=chunk).collect()]
    assert len(rows) == len({x for x, _ in rows})
    return dict(rows)


def shapes():
    draw = random.Random(1)
    yield "path", range(300), [(i, i + 1) for i in range(299)]
    yield "interleaved paths", range(400), [(i, i + 40) for i in range(360)]
    yield "star", range(-50, 250), [(7, i) for i in range(-50, 250)]
    yield "random", range(600), [(draw.randrange(600), draw.randrange(900)) for _ in range(450)]
    yield "dirt", range(9), [(1, 1), (None, 2), (3, None), (4, 5), (4, 5), (5, 4), (77, 8), (77, 2), (-(2**61), 2**61)]


@pytest.mark.parametrize("name, nodes, edges", list(shapes()))
def test_matches_brute_force_in_small_chunks(spark, name, nodes, edges):
    assert groups(spark, nodes, edges, chunk=50) == exact(nodes, edges)


def test_no_edges_and_no_nodes(spark):
    assert groups(spark, [3, 5], [], chunk=10) == {3: 3, 5: 5}
    assert groups(spark, [], [(1, 2)], chunk=10) == {}


def test_stars_span_and_priorities_differ():
    ids = np.arange(-500, 500)
    assert len(set(priority(ids, 3))) == len(ids) and (priority(ids, 1) != priority(ids, 2)).any()
    child, root = spanning_stars(np.array([1, 2, 9, 4]), np.array([2, 3, 9, 5]), 0)
    assert len(child) == 3 and exact(range(1, 6), zip(child, root)) == exact(range(1, 6), [(1, 2), (2, 3), (4, 5)])
