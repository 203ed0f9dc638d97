"""What a task holds does not grow with the input, and results stay."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from changeloom.operators import catalogs, contracts, groups, relational, scans
from changeloom.plans.registry import QUERIES


def n_tasks(frame):
    return frame.rdd.getNumPartitions()


def told(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_edges_are_grouped_once(spark, monkeypatch):
    edges = lambda *rows: spark.createDataFrame(rows, "src string, dst string")
    base, head = edges(("a", "b"), ("a", "b"), ("b", "c"), (None, "x"), ("c", "z")), edges(("a", "b"), ("a", "c"), ("a", "c"), (None, "x"))
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "id string")
    monkeypatch.setattr(relational, "TASK_ROWS", 2)
    got = relational.edge_changes(base, head, nodes)
    assert told(got) == [("a", "c", "added"), ("b", "c", "removed")]  # as EXCEPT has it, an edge of both sides is not new, whatever its ends
    assert n_tasks(got.where("change = 'added'")) >= 5


def test_hubs_are_dealt_by_the_number_of_edges(spark, monkeypatch):
    dealt, keys = relational.dealt, []
    monkeypatch.setattr(relational, "dealt", lambda rows, *k: (keys.append(k), dealt(rows, *k))[1])
    QUERIES["hub_degree"](spark, "/root/testdata/sf0.001")
    assert keys == [("src", "dst")]


def test_coverage_is_dealt_by_the_number_of_lines(spark, monkeypatch):
    monkeypatch.setattr(scans, "TASK_ROWS", 2)
    lines = spark.createDataFrame([("a", 1, 0), ("a", 1, 2), ("a", 2, 0), ("b", 1, None), ("b", 1, 0), ("c", 1, None), ("c", 3, 1)], "file string, line int, hits int")
    got = scans.merged_coverage(lines, ["file"])
    assert told(got) == [("a", 2, 1, 1), ("b", 1, 0, 1), ("c", 2, 1, 0)] and n_tasks(got) == 4


def test_diffs_are_read_in_their_rows(spark):
    text = "--- a/x\n+++ b/x\n@@ -1,3 +5 @@\n@@ -2,4 +0,0 @@\n--- a/y \n+++ /dev/null\t\n@@ -7 +7,2 @@\n+++ /dev/null\n@@ -9 +1,0 @@\n@@@ -1 +1 @@"
    got = scans.diff_lines(spark.createDataFrame([(1, text), (2, None), (3, "@@ -1 +1 @@"), (4, "+++ /dev/null\n@@ -1 +1 @@")], "diff_id int, text string"))
    assert told(got) == sorted([(1, "x", "old", n) for n in range(1, 6)] + [(1, "x", "new", 5), (1, "/dev/null\t", "old", 7), (1, "/dev/null\t", "new", 7), (1, "/dev/null\t", "new", 8), (1, "y", "old", 9)], key=repr)
    assert "Window" not in plan(got) and "Aggregate" not in plan(got)


def test_hot_words_do_not_travel(spark, monkeypatch):
    made = spark.createDataFrame([("return", "a.ts", "changed"), ("f1", "a.ts", "removed"), ("f1", "b.ts", "changed"), ("f2", "b.ts", "changed")], "name string, path string, change string")
    lines = spark.createDataFrame([(f"l{i % 7}.ts", i, f"return f{i % 5}(f1, x{i})") for i in range(60)] + [("a.ts", 1, "f1 f2"), (None, 1, "f1")], "path string, line int, content string")
    edited = lines.where("line % 9 = 0").select("path", "line")
    want = told(contracts.left_behind(made, lines, edited))
    monkeypatch.setattr(contracts, "BROADCAST_NAMES", 0)
    monkeypatch.setattr(contracts, "HOT_PART", 5)
    got = contracts.left_behind(made, lines, edited)
    assert told(got) == want and len(want) > 100
    assert "strategy=broadcast" in plan(got) and "strategy=merge" in plan(got)


def test_old_days_are_left_out_before_commits_are_sorted(spark, monkeypatch):
    rng = random.Random(5)
    start = datetime(2020, 1, 1)
    rows = [(f"s{rng.randrange(900)}", start + timedelta(hours=rng.randrange(5000)) if rng.random() < 0.98 else None, f"a/{rng.randrange(3)}/f{rng.randrange(9)}") for _ in range(2000)]
    rows += [("late", None, "b/x"), ("early", start, "b/x")]
    since, before = [], catalogs.cut
    monkeypatch.setattr(catalogs, "cut", lambda d, name="step": (since.append(out := before(d, name)), out)[1])
    for kind in ("timestamp", "timestamp_ntz", "string", "long"):
        as_ = {"string": lambda t: str(t), "long": lambda t: int(t.timestamp())}.get(kind, lambda t: t)
        told_ = [(s, None if t is None else as_(t), f) for s, t, f in rows]
        got = catalogs.path_history(spark.createDataFrame(told_, f"sha string, authored_at {kind}, file string"), spark.createDataFrame([("",), ("a/1",), ("b",)], "path string"), 20)
        for path in ("", "a/1", "b"):
            of = {(s, t) for s, t, f in told_ if path == "" or f.startswith(path + "/")}
            first = sorted((x for x in of if x[1] is not None), key=lambda x: x[0])
            first = sorted(first, key=lambda x: x[1], reverse=True) + sorted(x for x in of if x[1] is None)
            assert [(r.sha, r.authored_at) for r in got.where(F.col("path") == path).orderBy("nth").collect()] == first[:20]
        assert since.pop().count() == 2  # of b there are fewer than 20
        assert plan(got).count("strategy=broadcast") == 2  # a path that every file is under is in no single task


def test_files_are_not_broadcast(spark, monkeypatch):
    plans, before = {}, groups.cut
    monkeypatch.setattr(groups, "cut", lambda d, name="step": (plans.setdefault(name, plan(d)), before(d, name))[1])
    files = spark.createDataFrame([("m", f"m/user{i % 5}Page{i}.ts") for i in range(40)], "module string, path string")
    imports = files.selectExpr("path AS src").join(files.selectExpr("path AS dst").limit(3))
    groups.split_large(files, imports)
    assert plans["imports"].count("strategy=merge") == 2 and "strategy=merge" in plans["stems"] and "strategy=merge" in plans["moving"]
