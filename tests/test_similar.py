import random
from collections import Counter

import pytest

from changeloom.operators import relational


def jaccard(a, b):
    return len(a & b) / len(a | b)


def drawn(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        words = [f"w{int(rng.paretovariate(0.6)) % 40}" for _ in range(rng.randrange(1, 12))]
        rows.append((rng.choice("gh"), i, words, rng.random() < 0.5))
    for i in range(120, 160):  # near copies and copies
        g, _, words, _ = rng.choice(rows)
        rows.append((g, i, words + rng.choice([[], ["extra"], words[:1]]), rng.random() < 0.5))
    return rows + [("g", 900, [], True), ("g", 901, None, False), (None, 902, ["w1"], True), (None, 903, ["w1"], False), ("g", 904, ["w1", None], True)]


SCHEMA = "g string, id int, ts array<string>, old boolean"


@pytest.mark.parametrize(("threshold", "block"), [(0.5, 2048), (0.8, 3), (0.34, 5)])
def test_pairs_and_links_against_all_pairs(spark, monkeypatch, threshold, block):
    monkeypatch.setattr(relational, "TOKEN_BLOCK", block)
    rows = drawn(1)
    df = spark.createDataFrame(rows[:-1], SCHEMA)
    sets = [(g, i, set(ts), old) for g, i, ts, old in rows[:-1] if ts and g]
    want = {(g, i, j): jaccard(a, b) for g, i, a, _ in sets for h, j, b, _ in sets if g == h and i < j and jaccard(a, b) >= threshold - 1e-9}
    got = {(r.g, r.left_id, r.right_id): r.score for r in relational.similar_pairs(df, "g", "id", "ts", threshold).collect()}
    assert got == pytest.approx(want) and len(got) > 40
    n, best = Counter(), {}
    for (_, i, j), s in want.items():
        for x in (i, j):
            n[x] += 1
            best[x] = max(s, best.get(x, 0))
    links = {r.id: (r.n_links, r.best) for r in relational.similar_links(df, "g", "id", "ts", threshold).where("g IS NOT NULL").collect()}
    assert links == {i: (n[i], pytest.approx(best[i]) if i in best else None) for _, i, _, _ in sets}
    sides = {i: old for _, i, _, old in sets}
    crossed = {(r.g, r.left_id, r.right_id) for r in relational.similar_pairs(df, "g", "id", "ts", threshold, side="old").collect()}
    assert crossed == {k for k in want if sides[k[1]] != sides[k[2]]}
    assert relational.similar_pairs(df.limit(0), "g", "id", "ts", threshold).count() == 0


def test_plan_carries_no_sets_through_the_meeting(spark):
    df = spark.createDataFrame(drawn(2)[:-1], SCHEMA)
    heads = []
    before = relational.cut
    relational.cut = lambda d, name="step": (heads.append(d.columns) if name == "token-heads" else None, before(d, name))[1]
    try:
        relational.similar_pairs(df, "g", "id", "ts", 0.5)
    finally:
        relational.cut = before
    assert heads and "_set" not in heads[0]


def test_no_candidate_is_joined_or_shuffled(spark, monkeypatch):
    plans, before = [], relational.cut
    monkeypatch.setattr(relational, "cut", lambda d, name="step": (plans.append(d._jdf.queryExecution().optimizedPlan().toString()) if name == "similar-sets" else None, before(d, name))[1])
    monkeypatch.setattr(relational, "SET_TOKENS", 300)
    df = spark.createDataFrame(drawn(3)[:-1], SCHEMA)
    relational.similar_links(df, "g", "id", "ts", 0.5)
    assert len(plans) == 1 and plans[0].count("Join ") == 1  # the numbers of blocks


def test_tokens_that_hold_what_parts_tokens(spark):
    rows = [("g", 1, ["a\0b", "c"]), ("g", 2, ["a", "b", "c"]), ("g", 3, ["a\0b", "c", "c"]), ("g", 4, ["a\1\3b", "c"])]
    got = relational.similar_pairs(spark.createDataFrame(rows, "g string, id int, ts array<string>"), "g", "id", "ts", 0.5).collect()
    assert [(r.left_id, r.right_id, r.score) for r in got] == [(1, 3, 1.0)]
