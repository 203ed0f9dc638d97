import numpy as np
import pytest

from changeloom.llm import multi_index as M

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, every, k):
    kept = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            v = [float(np.float32(x)) for x in v]
            kept[i] = min(kept.get(i, v), v)
    out = []
    for i, a in kept.items():
        if i % every == 0:
            scored = []
            for j, b in kept.items():
                s = 0.0
                for x, y in zip(a, b):
                    s += x * y
                scored.append((-s, j))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(x for x in scored if x[1] != i)[:k])]
    return sorted(out)


def found(spark, rows, every=5, k=4, **options):
    return sorted(tuple(r) for r in M.nearest_neighbours(spark.createDataFrame(rows, SCHEMA), every, k, **options).collect())


def drawn(n, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(n, dim)))]


def test_whole_visit_equals_brute_force(spark):
    rows = drawn(300)
    assert found(spark, rows, recall=1.0, n_probes=100) == brute(rows, 5, 4)


def test_recall_and_true_scores(spark):
    rows = drawn(2000, dim=16)
    got, want = found(spark, rows, every=20, k=20), brute(rows, 20, 20)
    scores = {(r[0], r[2]): r[3] for r in brute(rows, 20, 2000)}
    assert all(scores[r[0], r[2]] == r[3] for r in got)
    assert len({(r[0], r[2]) for r in got} & {(r[0], r[2]) for r in want}) >= 0.9 * len(want)


def test_copies_share_scores_and_go_by_id(spark):
    rows = drawn(30) + [(i, [1.0, 2.0, 3.0, 4.0, 0.1, 0.2, 0.3, 0.4]) for i in range(100, 200)]
    assert found(spark, rows, recall=1.0, n_probes=100) == brute(rows, 5, 4)


def test_edge_cases(spark):
    rows = drawn(12) + [(0, [9.0]), (50, None), (55, []), (60, [0.0] * 8), (65, [None] * 8), (70, [float("nan")] * 8), (75, [float("-inf")] * 8), (None, [1.0]), (80, [2.0, 1.0]), (3, drawn(12)[3][1])]
    assert found(spark, rows, k=40, recall=1.0) == brute(rows, 5, 40)
    assert found(spark, []) == [] and found(spark, [(5, [0.0])]) == [] and found(spark, [(5, [1.0])]) == []
    assert found(spark, [(1, [1.0]), (2, [1.0])]) == []  # no queries
    clashing = spark.createDataFrame([(*r, "x", 1) for r in drawn(12)], SCHEMA + ", room string, code int")
    assert sorted(tuple(r) for r in M.nearest_neighbours(clashing, 5, 4, recall=1.0).collect()) == brute(drawn(12), 5, 4)


@pytest.mark.parametrize("seed", range(5))
def test_the_heap_stops_where_sorted_sums_do(seed):
    rng = np.random.default_rng(seed)
    first, second = rng.integers(0, 6, 7).astype(float), rng.random(5)
    counts = rng.integers(0, 4, (7, 5))
    total = first[:, None] + second[None]
    order = np.argsort(total.ravel())
    for wanted in (0.5, 3, counts.sum() / 2, counts.sum()):
        upto = np.cumsum(counts.ravel()[order])
        assert M.walk(first, second, counts, wanted) == total.ravel()[order[np.searchsorted(upto, wanted)]]


def test_one_task_holds_more_queries_than_one_matrix(spark):
    rows = drawn(1300, dim=4)
    assert found(spark, rows, every=1, k=2, recall=1.0, n_probes=2000) == brute(rows, 1, 2)


def test_many_rooms_and_chunks_of_queries(spark, monkeypatch):
    from changeloom.llm import vectors as V

    monkeypatch.setattr(V, "ROOM_ROWS", 16)
    monkeypatch.setattr(V, "CHUNK_MOST", 9)
    monkeypatch.setattr(M, "QUERIES_AT_ONCE", 4)
    rows = drawn(300) + [(i, [1.0, 2.0, 3.0, 4.0, 0.1, 0.2, 0.3, 0.4]) for i in range(1000, 1090)]
    assert found(spark, rows, recall=1.0, n_probes=200) == brute(rows, 5, 4)
