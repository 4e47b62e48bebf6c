"""Shortest paths from both ends, against a plain breadth-first search from one."""

import random

import pytest

from loomgraph.operators import lookup


def plain(edges, start, goal, directed, most):
    """Layers from the start, then back from the goal along the earliest relation."""
    ways = [(a, b, s) for a, b, s in edges] + ([] if directed else [(b, a, s) for a, b, s in edges])
    hop, layer = {start: 0}, [start]
    while layer and goal not in hop:
        new = sorted({b for a, b, _ in ways if a in layer and b not in hop})
        hop |= dict.fromkeys(new, hop[layer[0]] + 1)
        layer = new
    if hop.get(goal, most + 1) > most:
        return []
    path = [goal]
    while path[0] != start:
        path.insert(0, min((s, a) for a, b, s in ways if b == path[0] and hop.get(a) == hop[path[0]] - 1)[1])
    return path


def graph(seed):
    rng = random.Random(seed)
    n = 60
    edges = [(f"v{rng.randrange(n):02d}", f"v{rng.randrange(n):02d}", i) for i in range(rng.choice([70, 90]))]
    return edges + [("a", "b", 900), ("b", "c", 901), ("x", "y", 902), ("a", "a", 903)]


@pytest.mark.parametrize(("seed", "few"), [(1, 1000), (2, 0)])
def test_paths_are_those_of_a_search_from_one_end(spark, seed, few, monkeypatch):
    monkeypatch.setattr(lookup, "FEW", few)
    edges = graph(seed)
    rng = random.Random(seed)
    names = sorted({x for e in edges for x in e[:2]})
    found = 0
    with lookup.Paths(spark.createDataFrame(edges, "source string, target string, seq long"), 4) as paths:
        for directed in (True, False):
            pairs = [(rng.choice(names), rng.choice(names)) for _ in range(3)] + [("a", "c"), ("c", "a"), ("a", "a"), ("a", "nowhere")]
            for a, b in pairs:
                got = paths.shortest(a, b, 6, directed)
                assert got == plain(edges, a, b, directed, 6), (a, b, directed)
                found += len(got) > 2
    assert found > 1


def test_a_hop_moves_the_frontier_and_no_edges(spark):
    edges = spark.range(5000).selectExpr("cast(id % 700 as string) source", "cast(id % 900 as string) target", "id seq")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with lookup.Paths(edges, int(spark.conf.get("spark.sql.shuffle.partitions"))) as paths:
            front = spark.range(2000).selectExpr("cast(id as string) id")
            plan = paths._from(lookup.Layer(front, 2000, None), True, True)._jdf.queryExecution().executedPlan().toString()
            few = paths._from(paths._named(["0", "1"]), True, True)._jdf.queryExecution().executedPlan().toString()
            names = list(paths.names)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # the join's first input is the scan of the edges; the exchange is below the second
    assert plan.count("Exchange") == 1 and "Exchange" not in plan.split("FileScan")[0] and "PushedFilters: [In(a" in few
    assert not any(spark.catalog.tableExists(n) for n in names)
