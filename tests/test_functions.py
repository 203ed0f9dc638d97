import pytest
from pyspark.sql import functions as F

from changeloom.functions import kinds, numbers, paths, text


@pytest.fixture(scope="module")
def value(spark):
    def of(make, *args):
        row = spark.createDataFrame([tuple(args)], [f"c{i}" for i in range(len(args))] or None) if args else spark.range(1)
        return row.select(make(*[F.col(f"c{i}") for i in range(len(args))]).alias("v")).first()["v"]

    return of


@pytest.mark.parametrize(("given", "want"), [("", 0), ("a", 1), ("a\n", 1), ("a\nb", 2), ("\n\n", 2)])
def test_line_count(value, given, want):
    assert value(text.line_count, given) == want


@pytest.mark.parametrize(
    ("given", "want"),
    [("src/PrMapCanvas.tsx", "pr map"), ("lib/useChecklist.ts", "checklist"), ("review-visuals.ts", "review"), ("test_users.py", "user"), ("a/classes.py", "classe"), ("bus.go", "bus"), ("123.txt", "")],
)
def test_name_stem(value, given, want):
    assert value(text.name_stem, given) == want


def test_words_and_names(value):
    assert value(text.words, "parseHTTPResponse_v2") == ["parse", "http", "response", "v2"]
    assert value(text.snake_case, "userAccountId") == "user_account_id"
    assert [value(text.ordinal, n) for n in (1, 2, 3, 4, 11, 12, 13, 21, 112)] == ["1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "21st", "112th"]
    assert value(text.criterion_key, "Given: Ünïcode—and 3 items!") == "given ünïcode and 3 items"
    assert value(text.normal_summary, "The call to `get_user` at line 12 is not checked...") == "call get_user line not checked"
    assert value(text.stable_uuid, "x").count("-") == 4
    assert value(text.entropy, "aabb") == 1.0 and value(text.entropy, "aaaa") == 0.0


def test_paths(value):
    assert value(paths.normal_path, "a/./b/../c//d") == "a/c/d" and value(paths.normal_path, "../x") == "x"
    assert value(paths.shared_depth, "a/b/c.ts", "a/b/d/e.ts") == 2 and value(paths.shared_depth, "a.ts", "b.ts") == 0
    assert value(paths.ancestors, "a/b/c") == ["a/b/c", "a/b", "a", ""]
    assert value(lambda a, b: paths.join_path(a, b), "/api/", "/users/") == "/api/users"
    assert value(paths.dir_name, "x.py") == "" and value(paths.extension, "a/b.TSX") == "tsx"
    assert value(paths.line_range, "40–12").asDict() == {"first": 12, "last": 40} and value(paths.line_range, "7").asDict() == {"first": 7, "last": 7}
    got = value(paths.image_parts, "reg.io:5000/team/app:1.2")
    assert (got.image, got.tag, got.digest) == ("reg.io:5000/team/app", "1.2", None)


@pytest.mark.parametrize(
    ("given", "want"),
    [(":id/x/", "/{id}/x"), ("/u/<int:pk>/", "/u/{pk}"), (r"^items/(?P<slug>[\w-]+)/$", "/items/{slug}"), (r"/a/{id:\d+}", "/a/{id}"), ("//a//b", "/a/b"), ("/", "/")],
)
def test_route_path(value, given, want):
    assert value(paths.route_path, given) == want


@pytest.mark.parametrize(("given", "want"), [("/api/v1/repos/{id}/branches", "repos › branches"), ("/users/{id}", "users"), ("/api", "/"), ("/{id}", "/")])
def test_route_group(value, given, want):
    assert value(paths.route_group, given) == want


def test_route_key_and_params(value):
    assert value(paths.route_key, "/Repos/:id/x") == "/repos/{}/x"
    assert value(paths.route_params, "/a/{x}/{y*}/{z?}") == ["x", "y", "z"]


@pytest.mark.parametrize(("path", "glob", "want"), [("a/b.ts", "a/**", True), ("ab.ts", "a/**", False), ("x.md", "*.md", True), ("src/x", "src*", True), ("a", "/a", True), ("a", "", False)])
def test_globs(value, path, glob, want):
    assert value(paths.matches_glob, path, glob) is want


def test_kinds(value):
    assert [value(kinds.file_role, p) for p in ("go.mod", "x/a_test.go", "docs/a.md", ".github/x.yml", "src/a.py")] == ["dependency", "test", "docs", "config", "code"]
    assert [value(kinds.layer, p) for p in ("db/x.sql", "src/tests/a_test.go", "Dockerfile", "src/server/a.ts", "A.tsx", "src/models/a.py", "lib/calc.py")] == ["data", "tests", "infrastructure", "logic", "ui", "data", "logic"]
    assert [value(kinds.test_kind, p) for p in ("e2e/a.ts", "x/FooIT.java", "a.test.ts")] == ["e2e", "integration", "unit"]


NARROWINGS = [
    ("BIGINT", "int4", "range"), ("text", "varchar(50)", "length"), ("varchar(50)", "text", None), ("numeric(10, 2)", "decimal(8,2)", "precision"), ("character varying (20)", "varchar(20)", None),
    ("timestamp with time zone", "date", "detail"), ("numeric", "int", "fraction"), ("float8", "real", "precision"), ("longtext", "text", "length"), ("numeric", "numeric(5)", "precision"), ("integer", "bigint", None),
    ("nvarchar(20)", "varchar(10)", "length"), ("mediumint", "smallint", "range"), ("double", "real", "precision"), ("tinyint(1)", "boolean", None), ("ENUM('A')", "enum('a')", None), ("varchar", "char(3)", "length"), ("varchar(9)", "char(3)", None), ("tinytext", "varchar(5)", None),
    ("timestamptz(6)", "timestamptz(3)", "precision"), ("timestamptz", "timestamp", "detail"), ("longtext", "tinytext", "length"), ("text", "tinytext", None), ("real", "int", "fraction"), ("geometry", "int", None),
]


def test_type_narrowing(spark):
    """All pairs in one table: the expression is large to compile."""
    frame = spark.createDataFrame([(i, *pair) for i, pair in enumerate(NARROWINGS)] + [(-1, None, "int", None)], "i int, a string, b string, why string")
    got = {r.i: (r.a, r.b, r.got) for r in frame.withColumn("got", kinds.type_narrowing(F.col("a"), F.col("b"))).collect()}
    assert got == {i: pair for i, pair in enumerate(NARROWINGS)} | {-1: (None, "int", None)}


def test_numbers(value):
    assert value(lambda d, n: numbers.backoff(d, n), 100, 3) == 400 and value(lambda d, n: numbers.backoff(d, n), 100, 0) == 100
    assert value(numbers.version_key, "v1.10") > value(numbers.version_key, "1.9.5") and value(numbers.version_key, "2") == [2, 0, 0, 0]
    assert value(numbers.author_day, "2024-05-01T23:30:00-07:00") == "2024-05-01"
    assert [value(numbers.age_text, d) for d in (10, 100, 1000)] == ["10 days", "3 months", "2.7 years"]


def test_merged_ranges(spark):
    row = spark.sql("SELECT array(named_struct('first', 5, 'last', 7), named_struct('first', 1, 'last', 2), named_struct('first', 3, 'last', 3), named_struct('first', 6, 'last', 9)) r")
    assert [tuple(x) for x in row.select(numbers.merged_ranges(F.col("r")).alias("m")).first()["m"]] == [(1, 3), (5, 9)]
