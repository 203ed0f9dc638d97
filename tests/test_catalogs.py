import datetime as dt

import pytest
from pyspark.sql import functions as F

from changeloom.functions import resources
from changeloom.functions.text import shell_words, unquoted_path
from changeloom.operators import catalogs, graph


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


@pytest.fixture(scope="module")
def df(spark):
    return lambda data, schema: spark.createDataFrame(data, schema)


def at(day):
    return dt.datetime(2024, 1, day)


def test_pages_follow_each_other(df):
    commits = df([("r", f"c{i}", at(1 + i // 2), "a") for i in range(7)] + [("q", "x", at(1), None), ("q", "y", None, None), (None, "z", at(1), None)], "repo string, sha string, authored_at timestamp, author string")
    first = catalogs.history_page(commits, 3).where("repo = 'r'")
    assert [r.sha for r in first.orderBy("nth").collect()] == ["c6", "c4", "c5"]
    second = catalogs.history_page(commits, 3, before=df([("r", at(3), "c5")], "repo string, authored_at timestamp, sha string"))
    assert [r.sha for r in second.where("repo = 'r'").orderBy("nth").collect()] == ["c2", "c3", "c0"] and second.where("repo = 'q'").count() == 2
    assert catalogs.history_page(commits.limit(0), 3).count() == 0
    touched = df([("c1", at(1), "a/b.ts"), ("c2", at(2), "a/c/d.ts"), ("c2", at(2), "a/c/d.ts"), ("c3", at(3), "ab.ts"), ("c4", at(4), None)], "sha string, authored_at timestamp, file string")
    got = catalogs.path_history(touched, df([("a",), ("a/c/d.ts",), ("",), ("none",), ("a",)], "path string"), 2)
    assert rows(got, "path", "nth", "sha") == [("", 1, "c3"), ("", 2, "c2"), ("a", 1, "c2"), ("a", 2, "c1"), ("a/c/d.ts", 1, "c2")]


def test_frameworks(df):
    files = df([("package.json", '{"devDependencies":{"vitest":"1","x":"2"},"scripts":{"e":"playwright test"}}'), ("api/package.json", "{bad"), ("api/jest.config.js", None), ("node_modules/a/jest.config.js", None), ("py/setup.cfg", "[tool:pytest]"), ("go.mod", "module x"), (None, "x")], "path string, text string")
    uses = catalogs.framework_uses(files)
    assert rows(uses, "framework", "root") == [("jest", "api"), ("playwright", ""), ("pytest", "py"), ("vitest", "")]
    assert ("go", "") in rows(catalogs.framework_uses(files.union(df([("a/x_test.go", None)], "path string, text string"))))
    tests = df([("a.test.ts",), ("api/b.test.ts",), ("api/e2e/c.spec.ts",), ("d_test.go",), ("e.py",), ("F.java",), ("g.cy.js",), ("h.rb",), ("i.test.js",), (None,)], "path string")
    imports = df([("i.test.js", 1, "mocha"), ("i.test.js", 0, "node:test"), ("h.rb", 0, "./x"), ("zz", 0, "mocha")], "path string, nth int, source string")
    got = dict(rows(catalogs.framework_of(tests, imports, uses)))
    assert got == {"a.test.ts": "vitest", "api/b.test.ts": "jest", "api/e2e/c.spec.ts": "playwright", "d_test.go": "go", "e.py": "pytest", "F.java": "junit", "g.cy.js": "cypress", "h.rb": "other", "i.test.js": "node"}
    assert dict(rows(catalogs.framework_of(tests.where("path IN ('a.test.ts', 'e.py')"), imports, uses.limit(0)))) == {"a.test.ts": "other", "e.py": "unittest"}


def test_changes_of_tests(df):
    f = lambda *names: df([(n,) for n in names], "file string")
    reach = df([("lib/a.ts", "t1", 2), ("lib/a.ts", "t1", 1), ("lib/a.ts", "t3", 1), ("lib/c.ts", "t2", 1)], "file string, test string, hops int")
    added = df([("lib/a.ts", 3), ("lib/a.ts", 4), ("lib/a.ts", 4), ("lib/b.ts", 1), ("lib/d.py", 1), ("t1", 9), (None, 1), ("lib/b.ts", None)], "file string, line int")
    coverage = df([("lib/a.ts", 3, 0), ("lib/a.ts", 3, 5), ("lib/a.ts", 4, 0), ("lib/b.ts", 1, 0)], "file string, line int, hits long")
    code, found = catalogs.test_changes(f("t1", "t9", "t8"), f("t1", "t3"), f("lib/a.ts", "lib/b.ts", "lib/c.ts", "lib/d.py"), reach, added, coverage, f("lib/a.ts"), df([("t9", "lib/a.ts"), ("t8", "gone.ts"), ("t1", "lib/a.ts")], "test string, file string"))
    assert rows(code) == [("lib/a.ts", "modified", 2, 2, 1, 1, 2, 1), ("lib/b.ts", "added", 1, 0, 0, None, 1, 1), ("lib/d.py", "added", 1, 0, 0, None, 0, 0)]
    assert rows(found) == [("deleted-test", "t9", None), ("uncovered-lines", "lib/b.ts", 1), ("untested", "lib/b.ts", 1)]
    empty = catalogs.test_changes(*[x.limit(0) for x in (f("a"), f("a"), f("a"), reach, added, coverage, f("a"), df([("a", "b")], "test string, file string"))])
    assert empty[0].count() == 0 and empty[1].count() == 0
    told, sources = catalogs.test_catalog(df([("e2e/t1", 3), ("t3", None), ("e2e/t1", 2)], "file string, cases int"), df([("t3", "cypress")], "path string, framework string"), reach.withColumn("test", F.when(F.col("test") == "t1", "e2e/t1").otherwise(F.col("test"))), f("lib/a.ts", "lib/b.ts"), coverage)
    assert rows(told) == [("e2e/t1", "other", "e2e", 3, 1), ("t3", "cypress", "e2e", None, 1)]
    assert rows(sources) == [("lib/a.ts", 2, 1, 2, 1), ("lib/b.ts", 0, None, 1, 0)]


def test_tags_of_settings(df):
    reads = df([("A", "app/x.ts", 1, None, None, None), ("A", "lib/x.ts", 2, None, False, None), ("B", "app/x.ts", 1, "d", False, True), ("C", "app/x.ts", 1, None, True, True), ("CI", "x", 1, None, False, True), (None, "x", 1, None, False, False), ("D", "x.ts", 1, None, False, False), ("VITE_X", "x.ts", 1, None, False, True)], "name string, file string, line int, fallback string, test boolean, client boolean")
    decls = df([("D", "", "zod", None), ("E", "", "example", None), ("F_TOKEN", "", "zod", True)], "name string, scope string, via string, client boolean")
    sets = df([("A", "app", "default", None, None, None), ("A", "lib", "prod", True, None, None), ("E", "", "default", False, True, False), ("G", "", "example", False, False, False), ("F_TOKEN", "", "default", False, False, False)], "name string, scope string, target string, ref boolean, secret boolean, client boolean")
    got = {r["name"]: (r.n_reads, r.n_decls, r.n_sets, r.tags) for r in catalogs.env_catalog(reads, decls, sets).collect()}
    assert got == {
        "A": (2, 0, 2, ["maybe-set"]), "B": (1, 0, 0, ["undefined-in-client"]), "C": (1, 0, 0, []), "CI": (1, 0, 0, ["platform"]), "D": (1, 1, 0, ["not-set"]), "E": (0, 1, 1, ["set-not-read", "secret"]),
        "F_TOKEN": (0, 1, 1, ["secret", "client"]), "VITE_X": (1, 0, 0, ["undeclared", "client"]),
    }
    assert catalogs.env_catalog(reads.limit(0), decls.limit(0), sets.limit(0)).count() == 0


def test_findings_by_contract(df):
    verdicts = df([("c", "f", 5, " b "), ("c", "f", 2, None), ("c", "f", 2, " "), ("c", "f", 5, "a"), ("c", "g", 1, "x"), (None, "g", 1, "x"), ("d", None, 1, "x")], "contract string, file string, line int, reason string")
    got = rows(catalogs.impact_findings(verdicts, df([("f", "two"), ("f", "one")], "file string, component string"), most=1))
    assert got == [("c", "f", "one", 2, 2, "this usage no longer fits.", "line 2: this usage no longer fits."), ("c", "g", None, 1, 1, "x", "line 1: x")]


def test_replacing_attributes(spark, df):
    changes = df([("aws_instance", "ami", 1), ("Deployment", "spec.selector.matchLabels.app", 2), ("Deployment", "spec.selector.matchLabelsX", 3), ("google_x_y", "zone", 4), ("google_x_y", "zone.a", 5), ("azurerm_", "name", 6), ("google", "name", 7), (None, "name", 8), ("aws_instance", None, 9), ("mine", "a[0].b", 10), ("aws_instance", "ami", 1)], "kind string, attribute string, n int")
    rules = resources.rules(spark).union(df([("mine", "a", False)], "kind string, attribute string, family boolean"))
    assert rows(resources.replaced(changes, rules).where("forces_new"), "n") == [(1,), (1,), (10,), (2,), (4,), (6,)]
    assert resources.replaced(changes, rules).count() == 11
    assert rows(df([("aws_kms_key",), ("aws_kms",), (None,)], "k string").select(resources.stateful(F.col("k")).alias("s"))) == [(False,), (None,), (True,)]


def split_words(text):
    out, now, quote, has, i = [], "", None, False, 0
    while i < len(text):
        c = text[i]
        if quote:
            if c == quote:
                quote = None
            elif c == "\\" and quote == '"' and i + 1 < len(text):
                i += 1
                now += text[i]
            else:
                now += c
        elif c in "\"'":
            quote, has = c, True
        elif c.isspace():
            if has or now:
                out.append(now)
            now, has = "", False
        else:
            now, has = now + c, True
        i += 1
    return out + [now] if has or now else out


def test_quoted_words_and_paths(df):
    import random

    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \"'\\é\t") for _ in range(rng.randrange(12))) for _ in range(2000)]
    got = df([(t,) for t in texts], "t string").select(shell_words(F.col("t")).alias("w")).collect()
    assert [r.w for r in got] == [split_words(t) for t in texts]
    paths = {'"a\\tb\\303\\251"': "a\tbé", "plain": "plain", '"q\\"x\\\\"': 'q"x\\', '"é\\n"': "é\n", '"': '"', '""': "", '"\\177"': "\x7f"}
    found = df([(p,) for p in [*paths, None]], "p string").select("p", unquoted_path(F.col("p")).alias("q")).collect()
    assert {r.p: r.q for r in found} == paths | {None: None}


def test_large_chains_are_refused(df, monkeypatch):
    monkeypatch.setattr(graph, "LARGEST_CHAIN", 2)
    with pytest.raises(ValueError, match="chain c"):
        graph.chain_order(df([("c", x) for x in "abc"], "chain string, id string"), df([("c", "a", "b")], "chain string, id string, dep string"))
