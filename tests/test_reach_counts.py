import random

import pytest

from changeloom.operators import graph


def drawn(seed, nodes, n_edges, tests):
    rng = random.Random(seed)
    edges = {(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(n_edges)}
    return sorted((a, b) for a, b in edges if a != b), set(rng.sample(range(nodes), tests))


def walked(edges, start):
    seen, near, hops = {start: 0}, [start], 0
    while near:
        hops += 1
        near = sorted({b for a, b in edges if a in near and b not in seen})
        seen |= {b: hops for b in near}
    return seen


@pytest.mark.parametrize("seed", [3, 8])
def test_reach_of_tests_counts_without_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(graph, "HUB", 3)
    edges, tests = drawn(seed, 90, 120, 25)
    free = [(a, b) for a, b in edges if b not in tests]
    found = {t: walked(free, t) for t in tests}
    want = {}
    for v in set(range(90)) - tests:
        near = sorted((found[t][v], t) for t in tests if v in found[t])
        if near:
            want[v] = (len(near), near[0][0], [t for _, t in near[:2]])
    walks, before = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda d, name="step": (out := before(d, name), walks.append(out.count()) if name == "walked" else None)[0])
    df = spark.createDataFrame(edges, "src int, dst int")
    ids = lambda xs: spark.createDataFrame([(x,) for x in sorted(xs)], "id int")
    got = graph.reach_of_tests(df, ids(tests), ids({0}), ids(set(range(90)) - tests), first=2)
    assert {r.id: (r.n_tests, r.min_hops, r.tests) for r in got.collect()} == {k: v for k, v in want.items() if k != 0}
    assert max(walks) < sum(n for n, _, _ in want.values())


def test_components_are_walked_apart(spark, monkeypatch):
    monkeypatch.setattr(graph, "SMALL_GRAPH", 12)
    edges = [(i * 10 + a, i * 10 + b) for i in range(6) for a, b in [(1, 2), (2, 3), (3, 1), (4, 1), (5, 6), (6, 5)]] + [(100 + i, 100 + (i + 1) % 20) for i in range(20)]
    names, before = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda d, name="step": (names.append((name, out.count())) if (out := before(d, name)) and name == "cycles" else None, out)[1])
    got = {(r.id, r.group) for r in graph.cycle_groups(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == {(i * 10 + x, i * 10 + g) for i in range(6) for x, g in [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)]} | {(100 + i, 100) for i in range(20)}
    assert ("cycles", 20) in names  # only the ring is left for rounds
