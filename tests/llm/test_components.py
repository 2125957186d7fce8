"""Connected components against a plain union of sets."""

import numpy as np
import pytest

from shelfmark.llm import components
from shelfmark.llm.components import connected_components


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


GRAPHS = {
    "path": [(i, i + 1) for i in range(100)],
    "star": [(0, i) for i in range(1, 500)],
    "hub of hubs": [(-5, 10 * i) for i in range(30)] + [(10 * i, 10 * i + k) for i in range(30) for k in range(1, 9)],
    "random": [tuple(x) for x in np.random.default_rng(0).integers(-300, 300, (280, 2)).tolist()],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_graphs(spark, name):
    edges = GRAPHS[name]
    found = connected_components(spark.createDataFrame([*edges, edges[0], (None, 3), (4, None)], "u long, v long")).collect()
    want = {x: r for x, r in plain([e for e in edges if e[0] != e[1]]).items()}
    assert {r.node: r.root for r in found} == want and len(found) == len(want)


def test_none(spark):
    assert connected_components(spark.createDataFrame([(1, 1)], "u long, v long")).count() == 0


def test_stars_take_no_round(spark, monkeypatch):
    written = []
    stage = components.stage
    monkeypatch.setattr(components, "stage", lambda df, label: written.append(label) or stage(df, label))
    edges = [(i, i % 7) for i in range(7, 60)]
    found = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.root for r in found} == plain(edges) and len(found) == 60
    assert written == ["edges"]
    written.clear()
    connected_components(spark.createDataFrame([(2, 1), (3, 2)], "u long, v long")).collect()
    assert written.count("small") == 1
