"""Catalogs: pages of history, test frameworks, tests of a change, tags of settings, findings by contract, quoted words and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeloom.functions import text as T
from changeloom.functions.declarations import declared
from changeloom.operators import catalogs
from changeloom.plans.registry import query, table
from changeloom.plans.standins import longs, sql, told

#: Orders as commits of nations' repositories, with the files of their lines' parts.
COMMITS = "SELECT o_custkey % 25 AS repo, o_orderkey AS sha, o_orderdate AS authored_at, o_orderstatus AS author FROM {orders}"
BEFORE = "SELECT o_custkey % 25 AS repo, max(o_orderdate) AS authored_at, max(o_orderkey) AS sha FROM {orders} WHERE o_custkey % 25 < 20 AND o_orderkey % 5 = 0 GROUP BY o_custkey % 25"


@query(f"""
WITH c AS ({told(COMMITS)}), b AS ({told(BEFORE)})
SELECT c.repo, c.sha, c.authored_at, c.author, row_number() OVER w AS nth FROM c LEFT JOIN b ON c.repo = b.repo WHERE b.repo IS NULL OR c.authored_at < b.authored_at OR c.authored_at = b.authored_at AND c.sha > b.sha
WINDOW w AS (PARTITION BY c.repo ORDER BY c.authored_at DESC, c.sha) QUALIFY row_number() OVER w <= 50
""")
def commit_pages(spark, sf_dir):
    return longs(catalogs.history_page(sql(spark, sf_dir, COMMITS, "orders"), before=sql(spark, sf_dir, BEFORE, "orders")), "nth")


TOUCHED = "SELECT l_orderkey AS sha, l_shipdate AS authored_at, 'src/' || CAST(l_suppkey % 10 AS varchar(9)) || '/' || CAST(l_partkey % 97 AS varchar(9)) || '.ts' AS file FROM {lineitem}"


@query(f"""
WITH t AS ({told(TOUCHED)}), p(path) AS (VALUES ('src'), ('src/3'), ('src/3/17.ts'), (''), ('src/3/1')), f AS (SELECT DISTINCT path, sha, authored_at FROM t JOIN p ON path = '' OR file = path OR starts_with(file, path || '/'))
SELECT path, sha, authored_at, row_number() OVER w AS nth FROM f WINDOW w AS (PARTITION BY path ORDER BY authored_at DESC, sha) QUALIFY row_number() OVER w <= 20
""")
def commits_by_path(spark, sf_dir):
    paths = spark.createDataFrame([("src",), ("src/3",), ("src/3/17.ts",), ("",), ("src/3/1",)], "path string")
    return longs(catalogs.path_history(sql(spark, sf_dir, TOUCHED, "lineitem"), paths), "nth")


#: A tree with setup files and manifests in folders by brand and type.
SETUP = """SELECT p_brand || '/' || lower(p_type) || '/' || (CASE p_size % 8 WHEN 0 THEN 'vitest.config.ts' WHEN 1 THEN 'package.json' WHEN 2 THEN 'pyproject.toml' WHEN 3 THEN 'pom.xml' WHEN 4 THEN '.mocharc.yml' WHEN 5 THEN 'go.mod' WHEN 6 THEN 'playwright.config.ts' ELSE 'readme.md' END) AS path,
    (CASE p_size % 8 WHEN 1 THEN (CASE WHEN p_partkey % 3 = 0 THEN '{"devDependencies":{"ts-jest":"1"},"scripts":{"t":"node  --test x"}}' WHEN p_partkey % 3 = 1 THEN '{"scripts":{"e2e":"cypress run"},"jest":{"a":"b"}}' ELSE 'no json' END) WHEN 2 THEN 'x = ["pytest>=7"]' WHEN 3 THEN '<a>JUnit</a>' END) AS text, p_size, p_partkey, p_brand, p_type
    FROM {part} WHERE p_partkey % 4 = 0 UNION ALL SELECT 'a_test.go', NULL, 0, 0, '', '' FROM {region} WHERE r_regionkey = 0"""
USES_SQL = f"""s AS (SELECT *, CASE WHEN path = 'a_test.go' THEN '' ELSE p_brand || '/' || lower(p_type) END AS root, p_size % 8 AS k, p_partkey % 3 AS m FROM ({told(SETUP)}) WHERE path <> 'a_test.go'), uses AS (
    SELECT DISTINCT unnest(CASE k WHEN 0 THEN ['vitest'] WHEN 1 THEN (CASE m WHEN 0 THEN ['jest', 'node'] WHEN 1 THEN ['cypress', 'jest'] ELSE [] END) WHEN 2 THEN ['pytest'] WHEN 3 THEN ['junit'] WHEN 4 THEN ['mocha'] WHEN 5 THEN ['go'] WHEN 6 THEN ['playwright'] ELSE [] END) AS framework, root FROM s
)"""


def uses(spark, sf_dir):
    return catalogs.framework_uses(sql(spark, sf_dir, SETUP, "part", "region").select("path", "text"))


@query(f"WITH {USES_SQL} SELECT * FROM uses")
def test_frameworks(spark, sf_dir):
    return uses(spark, sf_dir)


TESTS = """SELECT DISTINCT p_brand || '/' || lower(p_type) || (CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '/deep/er' ELSE '/e2e' END) || '/' || CAST(p_partkey % 50 AS varchar(9)) || (CASE p_size % 6 WHEN 0 THEN '.test.ts' WHEN 1 THEN '_test.go' WHEN 2 THEN '.py' WHEN 3 THEN '.cy.ts' WHEN 4 THEN '.rb' ELSE '.spec.jsx' END) AS path FROM {part}"""


@query(f"""
WITH {USES_SQL}, t AS (SELECT path, regexp_extract(path, '([^.]+)$', 1) AS ext, contains(path, '/e2e/') OR regexp_matches(path, '\\.cy\\.') AS e2e, CASE WHEN ends_with(path, '.rb') AND regexp_extract(path, '/([0-9]+)[^/]*$', 1) = '7' THEN 'mocha' END AS hint FROM ({told(TESTS)})),
n AS (SELECT path, framework, length(root) AS n FROM t JOIN uses u ON starts_with(path, root || '/')),
u AS (SELECT path, arg_min(framework, [-n, list_position(['vitest', 'jest', 'mocha', 'node'], framework)]) FILTER (WHERE framework IN ('vitest', 'jest', 'mocha', 'node')) AS unit FROM n GROUP BY path),
e AS (SELECT path, min(framework) AS e2e_use FROM n WHERE framework IN ('playwright', 'cypress') GROUP BY path)
SELECT t.path, CASE WHEN hint IS NOT NULL THEN hint WHEN ext = 'go' THEN 'go' WHEN ext = 'py' THEN 'pytest' WHEN regexp_matches(t.path, '\\.cy\\.') THEN 'cypress' WHEN ext = 'rb' THEN 'other' WHEN e2e AND e2e_use IS NOT NULL THEN e2e_use ELSE coalesce(unit, 'other') END AS framework
FROM t LEFT JOIN u ON t.path = u.path LEFT JOIN e ON t.path = e.path
""")
def framework_of_tests(spark, sf_dir):
    tests = sql(spark, sf_dir, TESTS, "part")
    imports = tests.where("path RLIKE '/7\\\\.rb$'").select("path", F.lit(1).alias("nth"), F.lit("mocha").alias("source")).unionByName(tests.select("path", F.lit(0).alias("nth"), F.lit("./x").alias("source")))
    return catalogs.framework_of(tests, imports, uses(spark, sf_dir))


#: Parts as files: every seventh a test of the part a thousandth before it and the next; lines of orders as written lines and reported ones.
CODE = "SELECT 'lib/' || p_brand || '/f' || CAST(p_partkey AS varchar(12)) || (CASE WHEN p_size % 2 = 0 THEN '.ts' ELSE '.py' END) AS file, p_partkey AS id, p_brand FROM {part} WHERE p_partkey % 7 > 0"
TEST_FILES = "SELECT 'tests/t' || CAST(p_partkey AS varchar(12)) || '.ts' AS file, p_partkey AS id, p_size AS cases FROM {part} WHERE p_partkey % 7 = 0"
WRITTEN = "SELECT l_partkey AS id, CAST(l_linenumber + 10 AS int) AS line FROM {lineitem} WHERE l_quantity > 30 AND l_partkey % 3 = 0"
REPORTED = "SELECT l_partkey AS id, CAST(l_linenumber + 10 AS int) AS line, CAST(l_suppkey % 4 AS bigint) AS hits FROM {lineitem} WHERE l_partkey % 5 > 0 AND l_discount > 0.03"
C_SQL = f"""code AS ({told(CODE)}), tests AS ({told(TEST_FILES)}), head AS (SELECT * FROM tests WHERE id % 5 > 0), base AS (SELECT * FROM tests WHERE id % 11 > 0), sources AS (SELECT * FROM code WHERE id % 13 > 0), base_sources AS (SELECT * FROM code WHERE id % 17 > 0),
    reach AS (SELECT c.file, t.file AS test, c.id - t.id AS hops FROM tests t JOIN sources c ON c.id > t.id AND c.id <= t.id + 2 AND t.id % 2 = 0), added AS (SELECT DISTINCT f.file, w.line FROM ({told(WRITTEN)}) w JOIN (SELECT file, id FROM code UNION ALL SELECT file, id FROM tests) f USING (id)),
    hits AS (SELECT c.file, r.line, max(r.hits) AS hits FROM ({told(REPORTED)}) r JOIN code c USING (id) GROUP BY ALL), r AS (SELECT file, test, min(hops) AS hops FROM reach WHERE test IN (SELECT file FROM head) GROUP BY ALL),
    o AS (SELECT file, count(*) AS n_tests, count(*) FILTER (WHERE test IN (SELECT file FROM added)) AS n_changed_tests, min(hops) AS hops FROM r GROUP BY file),
    l AS (SELECT a.file, count(*) AS n_lines, min(a.line) AS first, count(h.hits) AS n_instrumented, count(*) FILTER (WHERE h.hits = 0) AS n_missed, min(a.line) FILTER (WHERE h.hits = 0) AS missed FROM added a LEFT JOIN hits h ON a.file = h.file AND a.line = h.line WHERE a.file IN (SELECT file FROM sources) GROUP BY a.file)"""


def tested_change(spark, sf_dir):
    of = lambda s, *t: sql(spark, sf_dir, s, *t)
    code, tests = of(CODE, "part"), of(TEST_FILES, "part")
    sources = code.where("id % 13 > 0")
    t, c = tests.select(F.col("file").alias("test"), F.explode(F.expr("sequence(id + 1, id + 2)")).alias("id"), F.col("id").alias("t_id")).where("t_id % 2 = 0"), sources.select("file", "id")
    reach = t.join(c, "id").select("file", "test", (F.col("id") - F.col("t_id")).alias("hops"))
    files = code.select("file", "id").unionByName(tests.select("file", "id"))
    added = of(WRITTEN, "lineitem").join(files, "id").select("file", "line")
    coverage = of(REPORTED, "lineitem").join(code, "id").select("file", "line", "hits")
    head, base = tests.where("id % 5 > 0"), tests.where("id % 11 > 0")
    return base, head, sources, reach, added, coverage, code.where("id % 17 > 0"), reach.select("test", "file")


@query(f"WITH {C_SQL} SELECT l.file, CASE WHEN l.file IN (SELECT file FROM base_sources) THEN 'modified' ELSE 'added' END AS status, n_lines, coalesce(n_tests, 0) AS n_tests, coalesce(n_changed_tests, 0) AS n_changed_tests, hops, n_instrumented, n_missed FROM l LEFT JOIN o USING (file)")
def changed_code_tests(spark, sf_dir):
    return catalogs.test_changes(*tested_change(spark, sf_dir))[0]


@query(f"""
WITH {C_SQL}, places AS (SELECT DISTINCT regexp_extract(file, '^(.*)/', 1) AS folder, regexp_extract(file, '([^.]*)$', 1) AS ext FROM o WHERE file IN (SELECT file FROM sources))
SELECT 'untested' AS rule, file, first AS line FROM l WHERE file NOT IN (SELECT file FROM o) AND (regexp_extract(file, '^(.*)/', 1), regexp_extract(file, '([^.]*)$', 1)) IN (SELECT (folder, ext) FROM places)
UNION ALL SELECT 'uncovered-lines', file, missed FROM l WHERE n_missed > 0 AND n_missed = n_instrumented
UNION ALL SELECT DISTINCT 'deleted-test', test, NULL FROM reach WHERE test IN (SELECT file FROM base) AND test NOT IN (SELECT file FROM head)
""")
def test_change_findings(spark, sf_dir):
    return catalogs.test_changes(*tested_change(spark, sf_dir))[1]


@query(f"WITH {C_SQL}, n AS (SELECT test AS file, count(*) AS n FROM (SELECT DISTINCT file, test FROM reach) GROUP BY test) SELECT t.file, 'other' AS framework, 'unit' AS kind, cases, coalesce(n.n, 0) AS n_sources FROM tests t LEFT JOIN n USING (file)")
def test_files(spark, sf_dir):
    _, _, sources, reach, _, coverage, _, _ = tested_change(spark, sf_dir)
    return catalogs.test_catalog(sql(spark, sf_dir, TEST_FILES, "part"), spark.createDataFrame([], "path string, framework string"), reach, sources, coverage)[0]


#: Settings by part name: reads in files of the brand, declarations and values in folders.
E_NAME = "CASE p_partkey % 40 WHEN 0 THEN 'NODE_ENV' WHEN 1 THEN 'NEXT_PUBLIC_' || upper(p_type) WHEN 2 THEN 'API_KEY_' || upper(p_type) ELSE upper(replace(p_name, ' ', '_')) || CAST(p_partkey % 31 AS varchar(9)) END"
READS = f"SELECT {E_NAME} AS name, 'app/' || p_brand || '/x.ts' AS file, p_partkey AS line, (CASE WHEN p_size % 9 = 0 THEN 'y' END) AS fallback, p_size % 11 = 0 AS test, p_size % 6 = 0 AS client FROM {{part}} WHERE p_partkey % 3 > 0"
DECLS = f"SELECT {E_NAME} AS name, 'app' AS scope, (CASE WHEN p_size % 2 = 0 THEN 'example' ELSE 'zod' END) AS via, p_size = 7 AS client FROM {{part}} WHERE p_size % 5 = 0"
SETS = f"SELECT {E_NAME} AS name, (CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'app' ELSE 'app/' || p_brand END) AS scope, (CASE WHEN p_size % 10 = 0 THEN 'example' ELSE 'default' END) AS target, p_partkey % 4 = 0 AS ref, p_size = 33 AS secret, p_size = 21 AS client FROM {{part}} WHERE p_partkey % 2 = 0"


@query(f"""
WITH r AS ({told(READS)}), d AS ({told(DECLS)}), s AS (SELECT * FROM ({told(SETS)}) WHERE target <> 'example'), own AS (SELECT 'NODE_ENV' AS name),
open AS (SELECT * FROM r WHERE NOT test AND fallback IS NULL AND name <> 'NODE_ENV'),
g AS (SELECT name, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.name = o.name AND s.ref AND (s.scope = '' OR starts_with(o.file, s.scope || '/'))) THEN 'maybe-set' WHEN EXISTS (SELECT 1 FROM d WHERE d.name = o.name) THEN 'not-set' ELSE 'undeclared' END AS gap
    FROM open o WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.name = o.name AND NOT s.ref AND (s.scope = '' OR starts_with(o.file, s.scope || '/')))),
n AS (SELECT name FROM r UNION SELECT name FROM d UNION SELECT name FROM s),
v AS (SELECT name, (SELECT count(*) FROM r WHERE r.name = n.name) AS n_reads, (SELECT count(*) FROM d WHERE d.name = n.name) AS n_decls, (SELECT count(*) FROM s WHERE s.name = n.name) AS n_sets,
    name = 'NODE_ENV' AS own, starts_with(name, 'NEXT_PUBLIC_') OR name IN (SELECT name FROM d WHERE client) OR name IN (SELECT name FROM s WHERE client) AS client FROM n)
SELECT name, n_reads, n_decls, n_sets, array_to_string(list_filter([CASE WHEN own THEN 'platform' END, CASE WHEN (name, 'undeclared') IN (SELECT (name, gap) FROM g) THEN 'undeclared' END, CASE WHEN (name, 'not-set') IN (SELECT (name, gap) FROM g) THEN 'not-set' END,
    CASE WHEN (name, 'maybe-set') IN (SELECT (name, gap) FROM g) THEN 'maybe-set' END, CASE WHEN NOT own AND n_sets > 0 AND n_reads = 0 AND name NOT IN (SELECT name FROM d WHERE via <> 'example') THEN 'set-not-read' END,
    CASE WHEN starts_with(name, 'API_KEY_') OR name IN (SELECT name FROM s WHERE secret) THEN 'secret' END, CASE WHEN client THEN 'client' END, CASE WHEN NOT own AND NOT client AND name IN (SELECT name FROM r WHERE client AND NOT test) THEN 'undefined-in-client' END], lambda x: x IS NOT NULL), ' ') AS tags FROM v
""")
def env_tags(spark, sf_dir):
    found = catalogs.env_catalog(*[sql(spark, sf_dir, s, "part") for s in (READS, DECLS, SETS)])
    return found.withColumn("tags", F.array_join("tags", " "))


VERDICTS = "SELECT 'c' || CAST(l_suppkey AS varchar(12)) AS contract, 'f' || CAST(l_partkey % 20 AS varchar(12)) AS file, l_linenumber + l_partkey % 3 AS line, (CASE WHEN l_tax > 0.06 THEN ' ' WHEN l_tax > 0.04 THEN NULL ELSE ' ' || l_returnflag END) AS reason FROM {lineitem}"


@query(f"""
WITH t AS (SELECT contract, file, line, coalesce(min(nullif(trim(reason), '')), 'this usage no longer fits.') AS reason FROM ({told(VERDICTS)}) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY contract, file ORDER BY line) AS n FROM t)
SELECT contract, file, CASE WHEN CAST(file[2:] AS INT) % 2 = 0 THEN 'even' END AS component, min(line) AS line, count(*) AS n_lines, arg_min(reason, line) AS reason, string_agg('line ' || line || ': ' || reason, chr(10) ORDER BY line) FILTER (WHERE n <= 20) AS places FROM r GROUP BY contract, file
""")
def impact_by_file(spark, sf_dir):
    verdicts = sql(spark, sf_dir, VERDICTS, "lineitem")
    owners = verdicts.select("file").distinct().where("cast(substr(file, 2) AS int) % 2 = 0").withColumn("component", F.lit("even"))
    return catalogs.impact_findings(verdicts, owners)


@query("SELECT p_partkey AS id, array_to_string([p_name, CAST(p_size AS VARCHAR) || 'x ' || p_type, 'a\"' || p_brand], '|') AS words, 'dir ' || p_name || chr(9) || 'é\"' AS path FROM part")
def quoted_texts(spark, sf_dir):
    """Command lines with quoted words, and paths with octal bytes, as their words and names."""
    p = table(spark, sf_dir, "part")
    line = F.concat(F.lit('  "'), "p_name", F.lit('" '), F.col("p_size").cast("string"), F.lit("'x '\""), "p_type", F.lit('"  "a\\"'), "p_brand", F.lit('"'))
    path = F.concat(F.lit('"dir '), "p_name", F.lit('\\t\\303\\251\\""'))
    return p.select(F.col("p_partkey").alias("id"), F.array_join(T.shell_words(line), "|").alias("words"), T.unquoted_path(path).alias("path"))


@query("""
SELECT p_partkey AS id, CASE p_size % 6 WHEN 0 THEN 'callable' WHEN 1 THEN 'type' WHEN 2 THEN 'value' WHEN 3 THEN 'callable' WHEN 4 THEN 'callable' END AS kind, CASE WHEN p_size % 6 < 5 THEN 'n' || p_partkey END AS name FROM part
""")
def declaration_lines(spark, sf_dir):
    n = F.concat(F.lit("n"), F.col("p_partkey").cast("string"))
    shapes = {0: "  export async function {}(a) {", 1: "pub struct {} {", 2: "static {} = 1", 3: "const {} = (a) => 1", 4: "func (s *T) {}() error", 5: "return {}"}
    line = F.coalesce(*[F.when(F.col("p_size") % 6 == k, F.concat(F.lit(s.split("{}", 1)[0]), n, F.lit(s.split("{}", 1)[1]))) for k, s in shapes.items()])
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), declared(line).alias("d")).select("id", "d.kind", "d.name")
