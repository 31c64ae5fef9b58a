"""Communities by rounds: about as good as moves in order, alike on reruns, with hubs and odd rows."""

import random

import pytest

from casegraph.operators import communities, inference


def planted(groups: int, size: int, inside: float, between: float, seed: int) -> dict:
    rng = random.Random(seed)
    names = [f"g{g}n{i:02}" for g in range(groups) for i in range(size)]
    return {(a, b): rng.choice([1.0, 2.5]) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < (inside if a.split("n")[0] == b.split("n")[0] else between)}


def frame(spark, weights):
    return spark.createDataFrame([(a, b, w) for (a, b), w in weights.items()], "src string, dst string, weight double")


def hub(n: int) -> dict:
    """A node that touches all, over rings of five."""
    ring = {(f"r{i - i % 5 + i % 5:03}", f"r{i - i % 5 + (i + 1) % 5:03}"): 3.0 for i in range(n)}
    return ring | {("hub", f"r{i:03}"): 0.1 for i in range(n)}


@pytest.mark.parametrize(("weights", "task_links"), [(planted(3, 6, 0.8, 0.05, 1), 0), (planted(6, 12, 0.6, 0.02, 1), 10**6), (hub(30), 60)])
def test_as_good_as_moves_in_order(spark, weights, task_links):
    edges = frame(spark, weights)
    found = {r.node: r.community for r in communities.large_communities(edges, task_links).collect()}
    assert set(found) == {x for e in weights for x in e}
    for x in set(found.values()):
        assert x == min(y for y, c in found.items() if c == x)
    reached = inference.modularity(weights, found)
    assert reached >= inference.modularity(weights, inference.louvain(weights)) - 0.01
    as_rows = spark.createDataFrame(list(found.items()), "node string, community string")
    assert communities.quality(edges, as_rows).first().modularity == pytest.approx(reached, abs=1e-9)
    if task_links == 60:  # its first level in rounds, the rest in one task
        again = communities.large_communities(edges.repartition(7), task_links).collect()
        assert {r.node: r.community for r in again} == found


def test_odd_rows(spark):
    schema = "src string, dst string, weight double"
    assert communities.large_communities(spark.createDataFrame([], schema)).count() == 0
    rows = [("a", "b", 1.0), ("b", "a", 1.0), ("a", "b", 1.0), ("c", "d", 1.0), ("c", "c", 9.0), (None, "a", 1.0), ("e", "f", 0.0), ("g", "h", -1.0), ("i", "j", None)]
    for task_links in (0, 100):
        found = communities.large_communities(spark.createDataFrame(rows, schema), task_links).collect()
        assert sorted((r.node, r.community) for r in found) == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "c")]
    numbered = spark.createDataFrame([(1, 2, 1.0), (3, 4, 1.0)], "src long, dst long, weight double")
    assert sorted(map(tuple, communities.large_communities(numbered).collect())) == [(1, 1), (2, 1), (3, 3), (4, 3)]


def test_heavy_hubs(spark):
    """Two hubs whose weights, in millionths, have a product beyond 64 bits."""
    rows = [(hub, f"{hub}{i}", 1000.0) for hub in "ab" for i in range(5)] + [("a", "b", 1.0)]
    found = communities.large_communities(spark.createDataFrame(rows, "src string, dst string, weight double"), 0).collect()
    assert {(r.node, r.community) for r in found} == {(x, x[0]) for row in rows for x in row[:2]}
