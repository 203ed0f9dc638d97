"""Stored tables, imports and what belongs to a change: nulls, ties, repeats and empty sides."""

import pytest
from pyspark.sql import functions as F

from changeloom.operators import context, resolve, upkeep


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


@pytest.fixture(scope="module")
def df(spark):
    return lambda data, schema: spark.createDataFrame(data, schema)


def test_slots_sync_and_links(df):
    base, new = df([("r", 1, "a"), ("r", 2, "b"), ("s", 1, "c"), (None, 1, "n")], "repo string, id int, v string"), df([("r", 9, "z")], "repo string, id int, v string")
    slots = df([("r",), ("r",), ("t",)], "repo string")
    assert rows(upkeep.replace_slots(base, slots, new, ["repo"])) == sorted([("r", 9, "z"), ("s", 1, "c"), (None, 1, "n")], key=repr)
    assert upkeep.replace_slots(base, slots.limit(0), new.limit(0), ["repo"]).count() == 4
    old = df([(1, "kept", "x"), (2, None, "y")], "id int, note string, v string")
    got = upkeep.sync_by_id(old, df([(1, None, "X"), (2, "mine", "Y"), (3, None, "Z")], "id int, note string, v string"), ["id"], ["note"])
    assert rows(got) == [(1, "kept", "X"), (2, "mine", "Y"), (3, None, "Z")]
    links = df([("a", "f"), ("b", "g"), ("c", None)], "component string, file string")
    assert rows(upkeep.relinked(links, df([("f", "o")], "file string, owner string"), df([("b", "p")], "component string, parent string"))) == sorted([("o", "f"), ("p", "g"), ("c", None)], key=repr)
    assert rows(upkeep.without_children(df([(1,), (2,), (None,)], "k int"), df([(1,), (1,)], "k int"), "k")) == [(1,)]


def test_logs_histories_and_retention(df):
    log = df([("a", 1, "x"), ("a", 2, "y")], "job string, seq int, line string")
    more = df([("a", 1, "p", 2), ("a", 1, "q", 1), ("b", 1, "r", 1)], "job string, seq int, line string, at int")
    assert rows(upkeep.appended(log, more, ["job"], "at")) == [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "q"), ("a", 4, "p"), ("b", 1, "r")]
    assert rows(upkeep.next_sequence(log, ["job"], "seq")) == [("a", 3)]
    assert rows(upkeep.log_slice(log, ["job"], -1, -1), "line") == [("y",)] and upkeep.log_slice(log, ["job"], 5, 9).count() == 0
    history, picks = df([("g", "k", 3, 10), ("g", "old", 1, 1)], "g string, key string, uses long, last_used int"), df([("g", "k", 12), ("g", "k", 11), ("g", "new", 12)], "g string, key string, at int")
    assert rows(upkeep.picks_recorded(history, picks, ["g"], "key", most=2)) == [("g", "k", 5, 12), ("g", "new", 1, 12)]
    kv = df([('{"expiresAt":5}',), ('{"expiresAt":50}',), ("{}",), ("no",), (None,)], "value string")
    assert rows(upkeep.unexpired(kv, F.lit(10))) == sorted([('{"expiresAt":50}',), ("{}",), ("no",), (None,)], key=repr)
    jobs = df([("q", 1, 5), ("q", 2, 6), ("q", 3, 6), ("q", 4, None), ("q", 5, 1)], "queue string, id int, done int")
    assert rows(upkeep.retained(jobs, ["queue"], 2, "done", F.lit(3)), "id") == [(2,), (3,), (4,)]
    known, unknown = upkeep.to_parse(df([("a", "1"), ("b", "2"), ("b", "2"), (None, "3")], "blob string, text string"), df([("a", "parsed")], "blob string, facts string"))
    assert rows(known) == [("a", "parsed")] and rows(unknown, "blob") == [("b",), (None,)]


def test_imports(df):
    files = df([("lib/core/src/index.ts",), ("lib/core/src/x.ts",), ("lib/ui/b.tsx",), ("pkg/mod/__init__.py",), ("pkg/a.py",), ("src/deep/c.py",)], "path string")
    packages = df([("@w/core", "lib/core", None), ("ui", "lib/ui", "./b")], "name string, dir string, main string")
    exports = df([("@w/core", "./*", "./src/*.ts"), ("@w/core", "./bad", None)], "name string, key string, target string")
    specs = df([("@w/core",), ("@w/core/x",), ("ui",), ("ui/none",), ("react",), (None,), ("ui",)], "specifier string")
    assert rows(resolve.workspace_imports(specs, packages, exports, files)) == [("@w/core", "lib/core/src/index.ts"), ("@w/core/x", "lib/core/src/x.ts"), ("ui", "lib/ui/b.tsx")]
    python = df([("pkg/a.py", "pkg.mod"), ("pkg/a.py", ".mod"), ("pkg/a.py", "deep.c"), ("pkg/mod/z.py", "..a"), ("pkg/a.py", "os"), (None, "pkg.a"), ("pkg/a.py", "pkg.mod")], "file string, module string")
    assert rows(resolve.python_imports(python, files)) == sorted([("pkg/a.py", "pkg.mod", "pkg/mod/__init__.py"), ("pkg/a.py", ".mod", "pkg/mod/__init__.py"), ("pkg/a.py", "deep.c", "src/deep/c.py"), ("pkg/mod/z.py", "..a", "pkg/a.py"), (None, "pkg.a", "pkg/a.py")], key=repr)
    declared = df([("a.B", "x/y/B.java"), ("a.B", "x/z/B.java"), ("a.C", "q/C.java")], "fqn string, file string")
    assert rows(resolve.nearest_declared(df([("x/z/M.java", "a.B"), ("m/M.java", "a.B"), ("m/M.java", "a.D")], "file string, fqn string"), declared)) == [("m/M.java", "a.B", "x/y/B.java"), ("x/z/M.java", "a.B", "x/z/B.java")]
    rust = df([("crate::a::b::C",), ("crate::z",), ("std",), (None,)], "spec string")
    assert rows(resolve.rust_imports(rust, df([("crate", "lib.rs"), ("crate::a::b", "a/b.rs")], "module string, path string"))) == [("crate::a::b::C", "a/b.rs"), ("crate::z", "lib.rs")]
    assert resolve.module_imports(df([("x/y",)], "spec string"), df([("x", "d")], "module string, dir string").limit(0), files).count() == 0
    assert rows(resolve.module_imports(df([("m.io/r/lib/core/src",), ("other",)], "spec string"), df([("m.io/r", "")], "module string, dir string"), files)) == [("m.io/r/lib/core/src", "lib/core/src/index.ts"), ("m.io/r/lib/core/src", "lib/core/src/x.ts")]


def test_around_a_change(df):
    changed = df([("a",), ("a",)], "file string")
    edges = df([("a", "b"), ("c", "a"), ("d", "e"), ("a", "a")], "src string, dst string")
    mentions = df([("b", "x"), ("b", "y"), ("b", "x"), ("c", "x"), ("d", "x"), ("a", "x")], "file string, identifier string")
    names = df([("x",), ("y",), (None,)], "identifier string")
    assert rows(context.related_files(changed, edges, mentions, names)) == [("b", 2), ("c", 1)]
    assert context.related_files(changed.limit(0), edges, mentions, names).count() == 0
    calls = df([("m", "n"), ("m", "n"), ("o", "m"), ("m", "m")], "src string, dst string")
    assert rows(context.related_declarations(df([("m",)], "id string"), calls)) == [("n", "definition", 2), ("o", "caller", 1)]
    moved = context.moved_texts(df([("p", "q", "body"), ("r", "s", None)], "before_id string, after_id string, change string"), df([("p", 1, 2, "one\ntwo\nthree")], "id string, start_line int, end_line int, text string"), df([("q", 2, 2, "x\ny")], "id string, start_line int, end_line int, text string"))
    assert rows(moved, "before", "after") == [("one\ntwo", "y")]
    stamped = context.restamped(df([(1, "a", "old"), (2, None, "old")], "id int, k string, s string"), df([("a",), ("a",)], "k string"), ["k"], s=F.lit("new"))
    assert rows(stamped, "id", "s") == [(1, "new"), (2, "old")]
    prints = df([("c", "f", None, "x  y"), ("c", "f", "", "x y")], "c string, f string, r string, s string").select(context.finding_fingerprint(F.col("c"), F.col("f"), F.col("r"), F.col("s")).alias("p"))
    assert prints.distinct().count() == 1
