import random

from pyspark.sql import functions as F

from changeloom.operators import relational


def test_sets_travel_to_blocks_of_near_sizes_only(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(k, "g", rng.sample([f"w{i}" for i in range(900)], min(600, 1600 // (k + 1)))) for k in range(400)]
    rows += [(400 + k, "g", rows[k][2][:-1]) for k in range(0, 400, 3)] + [(1000 + k, "h", ["a", "b", f"c{k % 3}"]) for k in range(9)]
    sets = {k: (g, set(w)) for k, g, w in rows}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a][0] == sets[b][0] and len(sets[a][1] & sets[b][1]) >= 0.5 * len(sets[a][1] | sets[b][1]) - 1e-9}
    tokens = sum(len(w) for g, w in sets.values() if g == "g")
    monkeypatch.setattr(relational, "SET_TOKENS", tokens // 10)
    travelled, cells, before = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0), relational.near_sets

    def counted(cell, threshold, sided):
        travelled.add(cell.num_rows)
        cells.add(1)
        return before(cell, threshold, sided)

    monkeypatch.setattr(relational, "near_sets", counted)
    found = relational.similar_pairs(spark.createDataFrame(rows, "id int, grp string, ws array<string>"), "grp", "id", "ws", 0.5)
    assert {(r.left_id, r.right_id) for r in found.collect()} == want and want
    # Blocks all met before: 67 cells.
    assert cells.value < 45 and travelled.value < 6 * len(rows)


def test_tokens_are_worked_out_once(spark, monkeypatch):
    plans, before = [], relational.cut
    monkeypatch.setattr(relational, "cut", lambda d, name="step": (plans.append(d._jdf.queryExecution().optimizedPlan().toString()) if name == "token-sets" else None, before(d, name))[1])
    df = spark.createDataFrame([(1, "g", "a b c"), (2, "g", "a b d"), (3, "g", ""), (4, "g", None)], "id int, grp string, t string").withColumn("ws", F.filter(F.split("t", " "), lambda w: w != ""))
    got = relational.similar_links(df, "grp", "id", "ws", 0.5).collect()
    assert sorted((r.id, r.n_links) for r in got) == [(1, 1), (2, 1)]
    assert len(plans) == 1 and plans[0].count("split(") == 1
