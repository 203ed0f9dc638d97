import json
import random

import pytest
from pyspark.sql import functions as F

from changeloom.operators import exports, images, nested, stored, symbols


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def walked(value, prefix="", depth=0, limit=8):
    compact = lambda v: json.dumps(v, separators=(",", ":"), sort_keys=True)
    if value is None:
        return []
    if not isinstance(value, (dict, list)):
        return [(prefix or "value", " ".join((value if isinstance(value, str) else compact(value)).split()))]
    if depth >= limit or isinstance(value, list) and not any(isinstance(v, (dict, list)) for v in value):
        return [(prefix or "value", " ".join(compact(value).split()))]
    out = []
    if isinstance(value, list):
        for i, v in enumerate(value):
            if isinstance(v, dict) and isinstance(v.get("name"), str):
                rest = {k: x for k, x in v.items() if k != "name"}
                out += walked(rest, f"{prefix}[{v['name']}]", depth + 1, limit) if rest else [(f"{prefix}[{v['name']}]", v["name"])]
            else:
                out += walked(v, f"{prefix}[{i}]", depth + 1, limit)
        return out
    for k, v in value.items():
        out += walked(v, f"{prefix}.{k}" if prefix else k, depth + 1, limit)
    return out


def grown(rng, depth):
    kind = rng.randrange(7 if depth else 4)
    if kind < 4:
        return [rng.randrange(9), "t  x", True, None][kind]
    if kind == 4:
        return [rng.choice([1, None, "s"]) for _ in range(rng.randrange(4))]
    if kind == 5:
        return [grown(rng, depth - 1) for _ in range(3)] + [{"name": rng.choice("ab"), "v": grown(rng, depth - 1)}, {"name": "alone"}, {"name": 5, "w": 1}]
    return {k: grown(rng, depth - 1) for k in rng.sample(["name", "b", "c", "d"], 3)}


@pytest.mark.parametrize("limit", [2, 8])
def test_attributes_against_a_recursive_walk(spark, limit):
    rng = random.Random(1)
    values = [grown(rng, 4) for _ in range(60)]
    df = spark.createDataFrame([(i, json.dumps(v), "x") for i, v in enumerate(values)] + [(100, None, "x"), (101, "no json {", "x"), (102, "", "x")], "id int, j string, prefix string")
    want = sorted(((i, *x) for i, v in enumerate(values) for x in walked(v, limit=limit)), key=repr)
    assert rows(nested.attributes(df, "j", ["id"], depth=limit)) == want
    assert nested.attributes(df.limit(0), "j", ["id"]).count() == 0
    capped = nested.attributes(df, "j", ["id"], most=2).groupBy("id").count()
    assert capped.agg(F.max("count")).first()[0] == 2


def test_overlays_depend_on_order(spark):
    edits = [("a", "r", "x.y", "set", "1"), ("a", "r", "x.z", "set", "2"), ("a", "r", "l[k].v", "set", "3"), ("a", "r", "l[m].v", "set", "4"), ("b", "r", "x", "remove", None), ("b", "r", "x.w", "set", "5"), ("c", "r", "l", "replace", None), ("c", "r", "l[n].v", "set", "6"), ("b", "r", "l[m].v", "set", "7"), (None, "r", "q", "set", "8"), ("a", None, "q", "set", "8"), ("a", "r", "q", None, "8"), ("a", "r", "p", "set", None), ("a", "s", "xx", "set", "9"), ("a", "s", "xx", "set", "8"), ("b", "s", "xx.in", "set", "1"), ("c", "s", "xx", "set", "end")]
    df = spark.createDataFrame(edits, "layer string, record string, name string, action string, value string")

    def of(bases, env):
        chain = nested.chain_of(spark.createDataFrame(bases, "layer string, base string")).where(F.col("env") == env)
        return {(r.record, r.name): r.value for r in nested.overlaid(df, chain).collect()}

    assert of([("c", "b"), ("b", "a")], "c") == {("r", "x.w"): "5", ("r", "l[n].v"): "6", ("s", "xx"): "end"}
    assert of([("a", "b"), ("b", "c")], "a") == {("r", "x.y"): "1", ("r", "x.z"): "2", ("r", "x.w"): "5", ("r", "l[k].v"): "3", ("r", "l[m].v"): "4", ("r", "l[n].v"): "6", ("s", "xx"): "9"}
    assert of([("c", "b"), ("b", "a")], "b") == {("r", "x.w"): "5", ("r", "l[k].v"): "3", ("r", "l[m].v"): "7", ("s", "xx.in"): "1"}
    assert nested.overlaid(df.limit(0), nested.chain_of(spark.createDataFrame([("a", None), ("c", "c")], "layer string, base string"))).count() == 0


def test_image_stages_bind_late(spark):
    stages = spark.createDataFrame([("f", 0, "base", "img"), ("f", 1, "Base", "base"), ("f", 2, "tool", "base"), ("f", 3, None, "TOOL"), ("f", 3, None, "TOOL"), ("g", 0, "g", "g"), ("h", 0, None, None), (None, 0, "x", "y")], "file string, stage int, name string, base string")
    copies = spark.createDataFrame([("f", 3, "0"), ("f", 2, "nothing"), ("g", 0, None)], "file string, stage int, source string")
    assert rows(images.final_image(stages, copies)) == [("f", 0, 1, "from"), ("f", 1, 2, "from"), ("f", 2, 1, "from"), ("f", 3, 0, "from"), ("g", 0, 0, "from"), ("h", 0, 0, "from")]
    assert images.final_image(stages.limit(0), copies.limit(0)).count() == 0
    long = spark.createDataFrame([("f", i, f"s{i}", f"s{i - 1}") for i in range(150)], "file string, stage int, name string, base string")
    assert images.final_image(long, copies.limit(0)).count() == 150


def test_exports_and_conditions(spark):
    asked = spark.createDataFrame([("p", "a/b.js"), ("p", ""), ("p", None), ("p", "exact"), ("p", "none"), ("q", "x"), (None, "x"), ("p", "exact")], "package string, subpath string")
    known = spark.createDataFrame([("p", "./*", "./all/*"), ("p", "./a/*", "./a2/*"), ("p", "./a/*.js", "./a3/*.ts"), ("p", "./exact", "./missing.js"), ("p", ".", "index.js"), ("p", None, "x"), ("p", "./n*", None), ("p", "./*", "./all/*")], "package string, pattern string, target string")
    files = spark.createDataFrame([("p", "all/a/b.js"), ("p", "a2/b.js"), ("p", "a3/b.ts"), ("p", "all/exact"), ("p", "index.js")], "package string, path string")
    got = {(r.package, r.subpath): (r.pattern, r.file) for r in exports.resolved(asked, known, files).collect()}
    assert got == {("p", "a/b.js"): ("./a/*.js", "a3/b.ts"), ("p", ""): (".", "index.js"), ("p", None): (".", "index.js"), ("p", "exact"): (None, None), ("p", "none"): (None, None), ("q", "x"): (None, None), (None, "x"): (None, None)}
    fewer = exports.resolved(asked, known, files.where("path <> 'a3/b.ts'")).where("subpath = 'a/b.js'").first()
    assert (fewer.pattern, fewer.file) == ("./a/*", "a2/b.js")
    conditions = ['{"node":"n","import":{"types":"t","default":"d"}}', '[{"node":"n"},"a"]', '"s"', '{"other":"o"}', "5", None, '{"require":["r"]}']
    picked = spark.createDataFrame([(c,) for c in conditions], "j string").select(exports.picked("parse_json(j)").alias("t")).collect()
    assert [r.t for r in picked] == ["d", "n", "s", None, None, None, "r"]


def test_changed_symbols(spark):
    schema = "file string, name string, text string, callable boolean, exported boolean"
    base = [("f", "a", "x  y", True, True), ("f", "b", "calls a here", True, True), ("f", "c", "calls aa", True, True), ("f", "gone", "z", True, True), ("f", "$d", "1", False, True), ("f", "e", "uses $d", True, True), ("f", "h", "calls a", True, None), ("g", "b", "calls a", True, True), (None, "a", "q", True, True)]
    head = [("f", "a", "x y changed", True, True), *[r for r in base[1:3]], ("f", "$d", "2", False, True), *base[5:8], ("f", "new", None, True, True), ("f", "same", "s", True, True), ("f", "same", "s", True, True)]
    b, h = spark.createDataFrame(base + [("f", "same", " s ", True, True)], schema), spark.createDataFrame(head, schema)
    assert rows(symbols.changed_symbols(b, h)) == sorted([("f", "$d", "modified", None), ("f", "a", "modified", None), ("f", "b", "via", "a"), ("f", "e", "via", "$d"), ("f", "gone", "removed", None), ("f", "new", "added", None)], key=repr)
    wide = symbols.changed_symbols(b.withColumn("repo", F.lit("r")), h.withColumn("repo", F.lit("r")), scope="repo")
    assert ("g", "b", "via", "a") in rows(wide)
    assert symbols.changed_symbols(b.limit(0), h.limit(0)).count() == 0


def test_stored_analysis(spark, tmp_path):
    root, files = f"file://{tmp_path}", spark.range(6).withColumn("kind", F.lit("x"))
    with pytest.raises(LookupError):
        stored.load(spark, root, "a/b c", "files")
    stored.save(root, "a/b c", "s=1", {"files": files, "edges": files.limit(2)})
    stored.save(root, "other", "s", {"files": files.limit(1)})
    assert stored.load(spark, root, "a/b c", "files").count() == 6 and stored.load(spark, root, "other", "files").count() == 1
    broken = files.withColumn("kind", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        stored.save(root, "a/b c", "s2", {"edges": files, "files": broken}, run="r7")
    assert stored.current(spark, root, "a/b c")["sha"] == "s=1" and stored.load(spark, root, "a/b c", "edges").count() == 2
    stored.save(root, "a/b c", "s2", {"files": files.limit(3)}, run="r7")
    stored.save(root, "a/b c", "s2", {"files": files.limit(4)}, run="r7")
    found = stored.load(spark, root, "a/b c", "files")
    assert found.count() == 4 and found.columns == ["id", "kind"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(repo" in plan
    with pytest.raises(LookupError):
        stored.load(spark, root, "a/b c", "edges")
