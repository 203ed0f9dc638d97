import pytest
from pyspark.sql import functions as F

from changeloom.operators import replay, snapshots

DECL = "id string, file string, kind string, qualified string, signature string, text_hash string, start_line int, end_line int"


@pytest.fixture(scope="module")
def df(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema)


def rows(frame, *cols):
    return sorted((tuple(r) for r in (frame.select(*cols) if cols else frame).collect()), key=repr)


@pytest.fixture(scope="module")
def sides(df):
    d = lambda f, n, sig="()", h="h", a=1, b=5, kind="function": (f"{f}#{n}", f, kind, n, sig, h, a, b)
    base = df([d("a", "f"), d("a", "g", a=10, b=20), d("a", "gone", a=30, b=31), d("a", "move", "(x)", a=40, b=41), d("a", "K", kind="class", a=100, b=400), d("c", "far")], DECL)
    head = df([d("a", "f", "(y)"), d("a", "g", a=10, b=20), d("b", "new"), d("b", "move", "(x)", "other"), d("a", "K", kind="class", a=100, b=400), d("c", "far")], DECL)
    changed = df([("a", "new", 15), ("a", "new", 300), ("b", "new", 1), ("a", "old", 30)], "file string, side string, line int")
    return base, head, changed


def test_declaration_changes(sides):
    got = rows(snapshots.declaration_changes(*sides), "id", "status")
    assert got == [("a#f", "signature"), ("a#g", "body"), ("a#gone", "removed"), ("b#move", "body"), ("b#new", "added")]
    assert rows(snapshots.declaration_moves(*sides)) == [("a#move", "b#move", "body")]


def test_call_graph(df, sides):
    base, head, changed = sides
    call = "src string, dst string, file string, line int"
    before = df([("c#far", "a#f", "c", 2), ("c#far", "a#move", "c", 3), ("a#g", "a#gone", "a", 12)], call)
    after = df([("c#far", "a#f", "c", 2), ("c#far", "b#move", "c", 3), ("a#g", "a#f", "a", 15), ("c#far", "c#far", "c", 9)], call)
    got = snapshots.call_graph(before, after, snapshots.declaration_changes(*sides), snapshots.declaration_moves(*sides), changed.where("side = 'new'").select("file", "line"))
    assert rows(got, "src", "dst", "status", "not_updated") == [("a#g", "a#f", "new", False), ("a#g", "a#gone", "removed", False), ("c#far", "a#f", "existing", True), ("c#far", "b#move", "existing", False)]


def test_schema_diff(df):
    s = "table string, column string, type string, nullable boolean, default string"
    base = df([("t", "a", "int", True, None), ("t", "b", "int", True, None), ("old", "x", "int", True, None), ("old", "Y", "int", True, None), ("was", "q", "int", True, None)], s)
    head = df([("t", "a", "bigint", True, "0"), ("t", "c", "int", True, None), ("fresh", "X", "int", True, None), ("fresh", "Y", "int", True, None), ("now", "q", "int", True, None)], s)
    got = snapshots.schema_diff(base.withColumn("column", F.lower("column")), head.withColumn("column", F.lower("column")), df([("was", "now")], "table_before string, table_after string"))
    assert rows(got, "table", "column", "status", "aspects", "renamed_from") == sorted([("t", "a", "changed", "type,default", None), ("t", "b", "removed", "", None), ("t", "c", "added", "", None), ("fresh", "x", "renamed", "", "old"), ("fresh", "y", "renamed", "", "old"), ("now", "q", "renamed", "", "was")], key=repr)


def test_resource_diff(df):
    r = "id string, tool string, stack string, kind string, address string"
    one = lambda *ids: df([(i, "tf", "s", "db", i) for i in ids], r)
    attrs = lambda rows: df([(i, f"n{k}", v) for i, vs in rows.items() for k, v in enumerate(vs)], "id string, name string, value string")
    base_attrs = attrs({"same": "abcde", "upd": "abcde", "ren": "vwxyz", "tie": "kkkkk", "mv": "mmmmm", "lost": "12345"})
    head_attrs = attrs({"same": "abcde", "upd": "abcdX", "ren2": "vwxyA", "tie1": "kkkkB", "tie2": "kkkkC", "mv2": "mmmmm"})
    got = snapshots.resource_diff(one("same", "upd", "ren", "tie", "mv", "lost"), one("same", "upd", "ren2", "tie1", "tie2", "mv2"), base_attrs, head_attrs, df([("mv", "mv2")], "before_id string, after_id string"))
    assert rows(got, "before_id", "after_id", "action") == sorted([("upd", "upd", "update"), ("ren", "ren2", "renamed"), ("mv", "mv2", "moved"), ("tie", None, "destroy"), ("lost", None, "destroy"), (None, "tie1", "create"), (None, "tie2", "create")], key=repr)


def test_endpoint_diff(df):
    s = "id string, kind string, method string, path string, handler string, auth array<string>"
    base = df([("a", "http", "GET", "/a", "h1", []), ("b", "http", "GET", "/b", "h2", ["login"]), ("c", "http", "GET", "/c", "h3", []), ("d", "action", "POST", "/d", "h4", [])], s)
    head = df([("a", "http", "GET", "/a", "h1", ["login"]), ("b", "http", "GET", "/b", "h2", []), ("c2", "http", "GET", "/c2", "h3", []), ("d2", "action", "POST", "/d2", "h4", []), ("e", "http", "GET", "/e", "h5", [])], s)
    got = rows(snapshots.endpoint_diff(base, head), "id", "status", "aspects", "breaking")
    assert got == [("a", "changed", "auth", True), ("b", "changed", "auth", False), ("c2", "moved", "path", True), ("d2", "moved", "path", False), ("e", "added", "", False)]
    assert rows(snapshots.endpoint_diff(head, base).where("status = 'removed'"), "id", "breaking") == [("e", True)]


def test_moved_and_paired_lines(df):
    text = ["alpha beta gamma delta", "epsilon zeta", "eta"]
    lines = [("x", i, "old", f"  {t}") for i, t in enumerate(text)] + [("y", 10 + i, "new", t) for i, t in enumerate(text)] + [("x", 5, "new", "alpha beta gamma delta"), ("y", 30, "old", "short"), ("x", 31, "new", "short")]
    got = snapshots.moved_lines(df(lines, "block string, pos int, side string, content string"))
    assert rows(got, "from_block", "to_block", "from_first", "from_last", "to_first") == [("x", "y", 0, 2, 10)]
    paired = snapshots.paired_lines(df([("b", 1, "old", "a"), ("b", 2, "old", "b"), ("b", 3, "new", "c")], "block string, pos int, side string, content string"))
    assert rows(paired, "nth", "old", "new") == [(1, "a", "c"), (2, "b", None)]


def test_exports_mounts_and_matches(df):
    e = "file string, name string, target_file string, target_name string"
    exports = df([("a", "x", None, None), ("a", "default", None, None), ("b", "*", "a", None), ("c", "y", "b", "x"), ("p", "q", "r", "q"), ("r", "q", "p", "q")], e)
    assert rows(snapshots.resolved_exports(exports)) == sorted([("a", "x", "a", "x"), ("a", "default", "a", "default"), ("b", "x", "a", "x"), ("c", "y", "a", "x")], key=repr)
    mounts = df([("app", "api", "/api"), ("api", "users", "/users")], "parent string, router string, prefix string")
    routes = df([("app", "GET", "/"), ("users", "GET", "/:id"), ("alone", "GET", "/z")], "router string, method string, path string")
    assert rows(snapshots.mounted_routes(mounts, routes), "router", "path") == [("alone", "/z"), ("app", "/"), ("users", "/api/users/:id")]
    services, loads = df([("s", {"a": "1", "b": "2"}), ("t", {})], "service string, selector map<string,string>"), df([("w", {"a": "1", "b": "2", "c": "3"}), ("v", {"a": "1"})], "workload string, labels map<string,string>")
    assert rows(snapshots.selected_workloads(services, loads)) == [("s", "w")]
    builds = df([("d1", "team/app"), ("d2", "x/tool"), ("d3", "y/tool"), ("d4", "two"), ("d5", "two")], "build string, image string")
    assert rows(snapshots.images_to_builds(df([("team/app",), ("other/app",), ("tool",), ("two",)], "image string"), builds)) == sorted([("team/app", "d1"), ("other/app", "d1"), ("tool", None), ("two", None)], key=repr)
    code, spec = df([("GET", "/a"), ("GET", "/b")], "method string, path_key string"), df([("GET", "/b"), ("GET", "/c")], "method string, path_key string")
    assert rows(snapshots.spec_drift(code, spec), "path_key", "where") == [("/a", "code-only"), ("/b", "both"), ("/c", "spec-only")]


def test_replay(df):
    ops = [("d", 1, 1, "create_table", "t", None, None, None, None), ("d", 1, 2, "add_column", "t", "a", None, "int", True), ("d", 1, 3, "add_column", "t", "b", None, "text", False), ("d", 3, 1, "rename_table", "t", None, "u", None, None), ("d", 2, 1, "rename_column", "t", "a", "z", None, None), ("d", 4, 1, "drop_column", "u", "b", None, None, None), ("d", 5, 1, "alter_type", "u", "z", None, "bigint", None), ("d", 6, 1, "drop_table", "nope", None, None, None, None), ("e", 1, 1, "create_table", "k", None, None, None, None), ("e", 1, 2, "add_column", "k", "id", None, "int", None)]
    got = replay.replay(df(ops, "database string, ord int, seq int, op string, table string, column string, to string, type string, nullable boolean"))
    assert rows(got) == [("d", "u", "z", "bigint", True, 1), ("e", "k", "id", "int", None, 0)]


def test_selected_workloads_meet_by_kind_and_block(df, monkeypatch):
    monkeypatch.setattr(snapshots, "PAIR_BLOCK", 3)
    told = [(f"s{i}", {"env": "prod", "app": f"a{i % 2}"}) for i in range(8)] + [("s0", {"env": "prod", "app": "a0"}), ("none", {"app": None}), ("empty", {})]
    labels = [(f"w{i}", {"env": "prod", "app": f"a{i % 4}", "x": "y"}) for i in range(20)] + [("w0", {"env": "prod", "app": "a0", "x": "y"}), ("w90", {"app": None})]
    met, before = [], snapshots.cut
    monkeypatch.setattr(snapshots, "cut", lambda d, name="step": (out := before(d, name), met.append(out.count()) if name == "selected-kinds" else None)[0])
    got = rows(snapshots.selected_workloads(df(told, "service string, selector map<string,string>"), df(labels, "workload string, labels map<string,string>")))
    assert got == sorted({(s, w) for s, a in told for w, b in labels if a and all(v is not None and b.get(k) == v for k, v in a.items())}, key=repr)
    assert met == [2]
