import pytest

from changeloom.operators import graph

RINGS = [(i * 10 + a, i * 10 + b) for i in range(6) for a, b in [(1, 2), (2, 3), (3, 1), (4, 1), (5, 6), (6, 5)]] + [(100 + i, 100 + (i + 1) % 20) for i in range(20)]
TAIL = [(200 + i, 100) for i in range(30)] + [(100, 300 + i) for i in range(30)]


@pytest.fixture
def plans(monkeypatch):
    """Name and plan of all that a loop writes; frontiers count as many."""
    found, before = [], graph.cut

    def seen(d, name="step"):
        found.append((name, d._jdf.queryExecution().executedPlan().toString()))
        return before(d, name)

    monkeypatch.setattr(graph, "cut", seen)
    monkeypatch.setattr(graph, "FEW", 0)
    monkeypatch.setattr(graph, "SMALL_GRAPH", 12)
    return found


def test_new_cycles_reads_its_edges_once(spark, plans):
    read = spark.sparkContext.accumulator(0)

    def counted(parts):
        for part in parts:
            read.add(len(part))
            yield part

    frame = lambda rows: spark.createDataFrame(rows, "src int, dst int").mapInPandas(counted, "src int, dst int")
    base = [e for e in RINGS if e[0] % 10 != 3]
    got = sorted((r.src, r.dst, r.length) for r in graph.new_cycles(frame(base), frame(RINGS)).collect())
    assert got == [(i * 10 + 3, i * 10 + 1, 3) for i in range(6)] + [(103, 104, None), (113, 114, None)]
    assert read.value == len(base) + len(RINGS)
    assert not [n for n, p in plans if "BroadcastExchange" in p and n != "cycles"]


def test_import_cycles_broadcasts_no_tables_that_grow(spark, plans):
    got = {(r.id, r.group) for r in graph.cycle_groups(spark.createDataFrame(RINGS + TAIL, "src int, dst int")).collect()}
    assert got == {(i * 10 + x, i * 10 + g) for i in range(6) for x, g in [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)]} | {(100 + i, 100) for i in range(20)}
    # What is left of parts that are told apart holds a broadcast, of the few large parts only.
    assert {n for n, p in plans if "BroadcastExchange" in p} <= {"cycles"}
    assert "Join" in "".join(p for n, p in plans if n == "components")
    first = next(p for n, p in plans if n == "round")
    assert "LeftSemi" in first and [n for n, _ in plans].index("round") < [n for n, _ in plans].index("ends")  # cut down before parts are told apart


def test_reach_of_tests_broadcasts_no_tables_that_grow(spark, plans, monkeypatch):
    monkeypatch.setattr(graph, "HUB", 3)
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "id int")
    edges = spark.createDataFrame(RINGS + TAIL + [(1, 9), (9, 5)], "src int, dst int")
    found = graph.reach_of_tests(edges, ids([4, 200, 201]), ids([100]), ids([1, 5, 9, 101, 300]), first=2)
    assert {(r.id, r.n_tests, r.min_hops, tuple(r.tests)) for r in found.collect()} == {(1, 1, 1, (4,)), (5, 1, 3, (4,)), (9, 1, 2, (4,)), (101, 2, 2, (200, 201)), (300, 2, 2, (200, 201))}
    plans.append(("result", found._jdf.queryExecution().executedPlan().toString()))
    assert {n for n, p in plans if "BroadcastExchange" in p} <= {"cycles"}
