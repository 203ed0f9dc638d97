import numpy as np
import pyarrow as pa
import pytest

from changeloom.llm import hard_negatives as H
from changeloom.llm import vectors as V

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, every=100, n_positives=5, n_negatives=10, moved=7):
    kept = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        row = ((label + 1) % 10 if i % moved == 0 else label, [int(np.floor(256 * float(np.float32(x)))) for x in v])
        kept[i] = min(kept.get(i, row), row)
    out = []
    score = lambda a, b: sum(x * y for x, y in zip(a[1], b[1]))
    for i, a in kept.items():
        if i % every:
            continue
        order = sorted((-score(a, b), j) for j, b in kept.items() if j != i)
        for s, j in [(s, j) for s, j in order if kept[j][0] == a[0]][:n_positives]:
            fit = [(t, m) for t, m in order if kept[m][0] != a[0] and -30 * s <= -100 * t <= -90 * s]
            out += [(i, j, r + 1, m, -s, -t) for r, (t, m) in enumerate(fit[:n_negatives])]
    return sorted(out)


def mined(spark, rows, **options):
    return sorted(tuple(r) for r in H.mine(spark.createDataFrame(rows, SCHEMA), **options).collect())


def drawn(n, dim=6, seed=3, copies=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[:copies] = v[0]
    return [(i, int(rng.integers(4)), [float(x) for x in v[i]]) for i in range(n)]


def test_against_brute_force_with_many_leaves(spark):
    rows = drawn(700)
    assert mined(spark, rows, every=10, arity=4, leaf_rows=20) == brute(rows, every=10)


def test_copies_and_ties(spark):
    rows = drawn(300, copies=120)
    assert mined(spark, rows, every=10, arity=3, leaf_rows=10) == brute(rows, every=10)


def test_edge_cases(spark):
    rows = drawn(60) + [(0, 3, [1.0, 0.0]), (10, None, [1.0]), (20, 1, None), (30, 1, [None, 1.0]), (40, 1, [float("nan")]), (50, 1, [float("inf")]), (None, 1, [1.0]), (100, 1, []), (-10, 1, [0.5] * 6), (3, 2, [0.1] * 6), (3, 2, [0.1] * 6)]
    assert mined(spark, rows, every=10, arity=3, leaf_rows=5) == brute(rows, every=10)
    assert mined(spark, []) == [] and mined(spark, [(1, None, None)]) == []
    assert mined(spark, [(0, 1, []), (1, 1, [])]) == []
    clashing = spark.createDataFrame([(*r, "x", 1) for r in drawn(40)], SCHEMA + ", room string, code int")
    assert sorted(tuple(r) for r in H.mine(clashing, every=10).collect()) == brute(drawn(40), every=10)


def test_large_components_stay_exact_and_too_large_ones_are_refused(spark):
    rows = [(i, i % 2, [float(2**17 + i), float(i * 977 % 13)]) for i in range(40)]
    assert mined(spark, rows, every=10) == brute(rows, every=10)
    with pytest.raises(ValueError):
        mined(spark, [(0, 1, [1e30]), (1, 1, [1.0])])


def test_the_tree_excludes_leaves_but_no_hit():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 3)) * 200
    x = np.floor(np.concatenate([c + rng.normal(size=(80, 3)) for c in centres]))
    tree = H.Tree(np.column_stack([x, np.zeros(len(x))]), 4, 40)
    space = H.Space(tree, float((x * x).sum(axis=1).max()), np.float64)
    space.tree = tree = H.Tree(space.lifted(x), 4, 40)
    for at, _, d, near in tree.walk(space.lifted(x)):
        for j in np.unique(near):
            tree.nodes[at].low[:, j] = np.minimum(tree.nodes[at].low[:, j], d[near == j].min(axis=0))
            tree.nodes[at].high[:, j] = np.maximum(tree.nodes[at].high[:, j], d[near == j].max(axis=0))
    scores = x @ x.T
    best = np.sort(scores, axis=1)[:, -20:]
    lo, hi = best[:, :1].astype(np.int64), best[:, -1:].astype(np.int64)
    alive, leaf = space.alive(x, lo, hi), tree.leaf_of(space.lifted(x))
    a, b = np.nonzero((scores >= lo) & (scores <= hi))
    assert alive[a, leaf[b]].all() and alive.mean() < 0.5


def test_keep_best_and_first_of_each():
    s = np.array([[3.0, 1.0, 3.0, 3.0, 2.0], [1.0, 2.0, 0.0, 5.0, 4.0]])
    which, least = V.keep_best(s, np.array([[1, 1, 0, 1, 1], [1, 0, 0, 0, 0]], bool), 2)
    assert which.tolist() == [[True, False, False, True, False], [True, False, False, False, False]] and least.tolist() == [3.0, -np.inf]
    g, v = np.array([1, 0, 1, 1, 0]), np.array([5, 2, 4, 3, 1])
    assert V.first_of_each(2, g, by=(v,)).tolist() == [4, 1, 3, 2]


def test_packing_covers_all_codes_and_splits_large_ones():
    packed = V.pack({0: 5, 1: 1000, 2: 5, 7: 300}, 16)
    rooms = [r for first, n in packed.values() for r in range(first, first + n)]
    assert packed[1][1] >= 12 and packed[0][1] == 1 and set(rooms) == set(range(max(rooms) + 1))


def test_an_empty_room_has_no_results():
    kinds = pa.table({"query_id": pa.array([], pa.int64())})
    assert H.best_in_room(kinds, kinds, None, 3, True).num_rows == 0


def test_many_rooms_and_chunks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(V, "ROOM_ROWS", 16)
    monkeypatch.setattr(V, "CHUNK_MOST", 9)
    monkeypatch.setattr(H, "QUERIES_AT_ONCE", 4)
    monkeypatch.setattr(H, "ROWS_AT_ONCE", 5)
    rows = drawn(400, copies=60)
    assert V.chunks_for(40, V.rooms_for(400), 4) == 5 and V.rooms_for(400) == 25
    assert mined(spark, rows, every=10, arity=4, leaf_rows=12) == brute(rows, every=10)
