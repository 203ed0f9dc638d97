import pytest
from pyspark.sql import functions as F

from changeloom.api import Review
from changeloom.operators import review


@pytest.fixture(scope="module")
def df(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema)


def rows(frame, *cols):
    return sorted((tuple(r) for r in (frame.select(*cols) if cols else frame).collect()), key=repr)


def test_resolution(df):
    got = review.alias_match(df([("@/x/y",), ("@ui/button",), ("exact",), ("none/z",)], "specifier string"), df([("@/*", "src/*"), ("@ui/*", "lib/ui/*"), ("@*", "bad/*"), ("exact", "lib/exact.ts")], "pattern string, target string"))
    assert rows(got, "specifier", "resolved") == [("@/x/y", "src/x/y"), ("@ui/button", "lib/ui/button"), ("exact", "lib/exact.ts")]
    configs, settings = df([("c", "b"), ("b", "a"), ("a", None)], "id string, parent string"), df([("a", "k", "1"), ("a", "z", "0"), ("b", "k", "2"), ("c", "own", "3")], "id string, key string, value string")
    assert rows(review.inherited_settings(configs, settings).where("id = 'c'"), "key", "value") == [("k", "2"), ("own", "3"), ("z", "0")]


def test_usages_and_contracts(df):
    use = "id string, file string, line int, name string"
    got = review.usage_index(df([("d", "f", 3, "a"), ("d", "f", 3, "a")], use), df([("d", "f", 1, "b"), ("d", "g", 9, "a")], use))
    assert rows(got) == [("d", "f", [1, 3], ["a", "b"], 2), ("d", "g", [9], ["a"], 1)]
    links = df([("k", "t", "one", 5, 1), ("k", "t", "two", 6, 2), ("k", "t", "one", 2, 3)], "kind string, text string, target string, line int, ord int")
    assert rows(review.link_index(links)) == [("k", "t", "one", [2, 5])]
    changes, exported = df([("a", "signature"), ("b", "removed"), ("c", "removed"), ("d", "body")], "id string, status string"), df([(i, "f", i) for i in "abcd"], "id string, file string, name string")
    assert rows(review.contract_changes(changes, exported, df([("f", "a"), ("f", "b")], "file string, name string")), "id") == [("a",), ("c",)]
    imports = "file string, source string, name string"
    assert rows(review.new_dead_imports(df([("f", "s", "x")], imports), df([("f", "s", "x"), ("f", "s", "y")], imports)), "name") == [("y",)]
    edge = "src string, dst string, weight int"
    owners = df([("1", "A"), ("2", "B"), ("3", "C")], "id string, owner string")
    assert rows(review.component_edge_changes(df([("1", "2", 1)], edge), df([("1", "3", 1)], edge), owners)) == [("A", "B", "removed"), ("A", "C", "added")]
    part = "name string, part string, key string, value string"
    got = review.env_changes(df([("X", "read", "f:1", "r"), ("Y", "set", "p", "1"), ("S", "set", "p", "1")], part), df([("Z", "read", "f:1", "r"), ("Y", "set", "p", "2"), ("S", "set", "p", "1")], part))
    assert rows(got, "name", "status", "set") == [("X", "gone", 0), ("Y", "changed", 1), ("Z", "new", 0)]
    tables = review.endpoint_tables(df([("e", "f1"), ("e", "f2")], "origin string, id string"), df([("f1", "t", True), ("f2", "t", False)], "id string, table string, write boolean"))
    assert rows(tables.withColumn("a", review.access(F.col("reads"), F.col("writes"))), "table", "a", "via") == [("t", "both", ["f1", "f2"])]


def test_lines(df):
    pairs = df([(["a", "b", "c"], ["b", "x", "c"])], "o array<string>, n array<string>").select(review.lcs_pairs("o", "n").alias("p")).first().p
    assert [tuple(x) for x in pairs] == [(1, 0), (2, 2)]
    got = df([("let x = 1;", "let y = 1;"), ("aaa bbb", "zzz qqq rrr sss")], "o string, n string").select(review.word_diff("o", "n").alias("d")).collect()
    assert [tuple(x) for x in got[0].d] == [("same", "let "), ("old", "x"), ("new", "y"), ("same", " = 1;")] and got[1].d is None
    placed = review.placed_comments(df([(1, "f", 3), (2, "f", 9), (3, "g", 1), (4, "f", None)], "id int, file string, line int"), df([("f", 3)], "file string, line int"), df([("f",)], "file string"))
    assert rows(placed, "id", "placement") == [(1, "inline"), (2, "line-not-in-diff"), (3, "file-not-in-diff"), (4, "no-line")]
    assert rows(review.diff_identifiers(df([("foo(ab, bar_2)",), ("foo",)], "content string"))) == [("bar_2",), ("foo",)]
    got = review.code_search(df([("f", i, "x = y") for i in range(5)], "path string, line int, content string"), "= y", shown=2)
    assert rows(got, "line", "total") == [(0, 5), (1, 5)]


def test_groupings(df):
    files = df([("m", f"m/{d}/{i}.py") for d, n in (("a", 4), ("b", 3), ("c", 1)) for i in range(n)] + [("n", f"n/a/{i}.py") for i in range(5)], "cluster string, path string")
    got = review.folder_cut(files).groupBy("cluster", "part").count()
    assert rows(got) == sorted([("m", "a", 4), ("m", "b", 3), ("m", "", 1), ("n", None, 5)], key=repr)
    split = review.card_split(files.withColumn("k", F.split("path", "/")[1]), "cluster", "k", cards=2).groupBy("cluster", "part").count()
    assert rows(split) == [("m", "Other", 4), ("m", "a", 4), ("n", "a", 5)]
    placed = df([("a/b/1", "x"), ("a/b/2", "x"), ("a/c/1", "y"), ("a/c/2", "x"), ("d/1", "z")], "path string, key string")
    assert rows(review.compact_placements(placed)) == [("a/b", "x"), ("a/c/1", "y"), ("a/c/2", "x"), ("d", "z")]
    assert rows(review.prefix_groups(df([("pr-map",), ("pr-chat",), ("solo-x",)], "name string"), "name")) == sorted([("pr-map", "pr"), ("pr-chat", "pr"), ("solo-x", None)], key=repr)
    assert rows(review.feature_keys(df([("a/prMap.ts",), ("b/prChat.ts",)], "path string")), "key", "files", "folders") == [("chat", 1, 1), ("map", 1, 1), ("pr", 2, 2)]
    nodes, edges = review.capped_neighbourhood(df([("a", True, 1), ("b", False, 9), ("c", False, 2)], "id string, changed boolean, degree int"), df([("a", "b"), ("b", "c")], "src string, dst string"), 2)
    assert rows(nodes, "id") == [("a",), ("b",)] and rows(edges) == [("a", "b")]


def test_verdicts(df):
    checks = df([("1", "success"), ("1", "failure"), ("2", "success"), ("2", "pending"), ("3", "success")], "sha string, state string")
    assert rows(review.ci_state(checks)) == [("1", "failure"), ("2", "pending"), ("3", "success")]
    pairs = [(None, "x"), ("x", None), ("x", "x"), ("x", "y"), ("x", "failed"), ("failed", "x"), ("failed", "failed")]
    got = df(pairs, "b string, a string").select(review.outcome(F.col("b"), F.col("a")).alias("o")).collect()
    assert [r.o for r in got] == ["new", "removed", "same", "different", "breaks", "recovers", "failed"]
    criteria = df([("t", 1, "Shows a list"), ("t", 2, "shows a LIST!"), ("t", 3, "Sorts"), ("t", 4, "--")], "target string, ord int, text string")
    assert rows(review.numbered_criteria(criteria), "id", "text") == [("c1", "Shows a list"), ("c2", "Sorts")]
    found = review.posted_record(df([(1, "p"), (2, "q"), (3, "r")], "id int, fingerprint string"), df([(1, "zz", "d1"), (9, "q", "d2")], "finding_id int, fingerprint string, posted_at string"))
    assert rows(found) == [(1, "d1"), (2, "d2")]
    findings = df([("t", "a", 1), ("t", "b", 2), ("u", "b", 3)], "target string, component string, id int")
    assert rows(review.swept(findings, df([("t",)], "target string"), df([("t", "a")], "target string, component string")), "id") == [(1,), (3,)]


def test_facade(df):
    findings = df([("1", "t", "A", "f", "low", None, None), ("2", "t", "A", "f", "critical", None, ["x"]), ("3", "t", "B", "g", "high", "2024", None)], "id string, target string, component string, file string, severity string, resolved_at string, responses array<string>")
    files = df([("t", "f", 3, 1, "p"), ("t", "z", 1, 0, "p")], "target string, file string, additions int, deletions int, patch string")
    r = Review({"findings": findings, "changed_files": files, "component_files": df([("A", "f")], "component string, file string"), "endpoints": df([("http", "/users", "h")], "kind string, path string, handler string")})
    assert rows(r.list_reviews()) == [("t", 3, 2)]
    assert [x.id for x in r.get_review("t").collect()] == ["2", "1"] and r.get_review("t", resolved=True).count() == 3
    assert rows(r.changed_components("t")) == sorted([("A", 1, 3, 1), (None, 1, 1, 0)], key=repr)
    assert rows(r.component_diff("t", "A"), "file") == [("f",)] and r.file_diff("t", "z").count() == 1
    assert r.list_endpoints(query="USER").count() == 1 and r.list_endpoints(kind="rpc").count() == 0
    assert rows(r.respond_to_finding("2", "y"), "id", "responses") == sorted([("1", None), ("2", ["x", "y"]), ("3", None)], key=repr)
    with pytest.raises(KeyError):
        r.list_infra()


def test_contracts_and_history_of_a_review(df):
    import datetime as dt

    patch = "@@ -1,2 +1,2 @@\n-def load(a):\n+def load(a, b):\n     pass"
    at = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    r = Review({
        "changed_files": df([("t", "a.py", "modified", patch), ("u", "b.py", "modified", patch)], "target string, file string, status string, patch string"),
        "code_lines": df([("c.py", 1, "load(1)"), ("c.py", 2, "load(1, 2)")], "path string, line int, content string"), "edited_lines": df([("t", "c.py", 2)], "target string, path string, line int"),
        "commits": df([("r", "x", at[0]), ("r", "y", at[1]), ("r", "z", at[2]), ("s", "w", at[2])], "repo string, sha string, authored_at timestamp"), "touched": df([("x", at[0], "a/b.py"), ("y", at[1], "c.py")], "sha string, authored_at timestamp, file string"),
    })
    assert [(c.path, c.name, c.change) for c in r.get_contracts("t").collect()] == [("a.py", "load", "changed")]
    assert [(x.path, x.line) for x in r.left_behind("t").collect()] == [("c.py", 1)]
    assert [c.sha for c in r.list_commits("r", 2).collect()] == ["z", "y"] and [c.sha for c in r.list_commits("r", 2, before=(at[1], "y")).collect()] == ["x"]
    assert [c.sha for c in r.history("a").collect()] == ["x"]
