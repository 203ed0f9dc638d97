"""What files, types and names are, over paths and types made from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeloom.functions import kinds, names
from changeloom.plans.registry import query, table
from changeloom.plans.standins import FILES, sql, told

@query(f"""
WITH f AS ({told(FILES)}), b AS (SELECT id, path, regexp_extract(path, '([^/]*)$', 1) AS name, lower(regexp_extract(path, '([^/]*)$', 1)) AS low FROM f),
t AS (SELECT *, regexp_matches(name, '{kinds.TEST_NAME}') AS named, regexp_matches(path, '{kinds.TEST_DIR}') AS inside FROM b)
SELECT id, path, CASE WHEN low IN ({", ".join(f"'{x}'" for x in kinds.DEPENDENCY_FILES)}) OR ends_with(low, '.csproj') THEN 'dependency' WHEN named OR inside THEN 'test' WHEN (regexp_matches(name, '{kinds.DOC_EXTENSION}') OR regexp_matches(name, '{kinds.DOC_FILE}')) THEN 'docs'
    WHEN regexp_matches(path, '{kinds.DOC_DIR}') THEN 'code' WHEN regexp_matches(path, '{kinds.CONFIG_DIR}') OR regexp_matches(name, '{kinds.CONFIG_NAME}') THEN 'config' ELSE 'code' END AS role,
    CASE WHEN named THEN CASE WHEN regexp_matches(path, '{kinds.SUPPORT_DIR}') AND id % 3 = 0 THEN 'support' ELSE 'test' END
        WHEN inside AND regexp_matches(name, '{kinds.SUPPORT_NAME}') THEN 'support' WHEN inside AND id % 3 > 0 THEN 'test' WHEN inside THEN 'support' END AS test_role,
    CASE WHEN id % 5 = 0 OR regexp_matches(path, '{kinds.E2E_PATH}') THEN 'e2e' WHEN regexp_matches(path, '{kinds.INTEGRATION_PATH}') OR regexp_matches(path, '{kinds.INTEGRATION_NAME}') THEN 'integration' ELSE 'unit' END AS test_kind
FROM t
""")
def file_roles(spark, sf_dir):
    path, framework = F.col("path"), F.when(F.col("id") % 5 == 0, "cypress")
    return sql(spark, sf_dir, FILES, "part").select("id", "path", kinds.file_role(path).alias("role"), kinds.test_role(path, F.col("id") % 3).alias("test_role"), kinds.test_kind(path, framework).alias("test_kind"))


def _any(words: list[str], where: str) -> str:
    return f"list_has_any({where}, [{', '.join(repr(w) for w in words)}])"


LAYER_SQL = f"""
WITH f AS ({told(FILES)}), b AS (SELECT id, path, regexp_extract(path, '([^/]*)$', 1) AS name, list_transform(string_split(regexp_extract(path, '^(.*)/[^/]*$', 1), '/'), lambda s: lower(s)) AS folders FROM f),
s AS (SELECT *, regexp_replace(regexp_replace(name, '(?i)\\.(test|spec|e2e|stories|d)\\.[^.]+$', ''), '\\.[^.]+$', '') AS stem FROM b),
w AS (SELECT *, string_split_regex(lower(regexp_replace(regexp_replace(stem, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z0-9]+') AS parts,
    lower(name) IN ({", ".join(f"'{x}'" for x in kinds.DEPENDENCY_FILES)}) OR ends_with(lower(name), '.csproj') AS dep, regexp_matches(name, '{kinds.TEST_NAME}') OR regexp_matches(path, '{kinds.TEST_DIR}') AS test FROM s)
SELECT id, path, CASE WHEN test AND NOT dep OR regexp_matches(stem, '(?i)^smoke-test') OR list_contains(folders, '__fixtures__') THEN 'tests' WHEN regexp_matches(path, '(?i)\\.(sql|prisma)$') THEN 'data'
    WHEN dep OR NOT (regexp_matches(name, '{kinds.DOC_EXTENSION}') OR regexp_matches(name, '{kinds.DOC_FILE}')) AND NOT regexp_matches(path, '{kinds.DOC_DIR}') AND (regexp_matches(path, '{kinds.CONFIG_DIR}') OR regexp_matches(name, '{kinds.CONFIG_NAME}')) OR (regexp_matches(path, '{kinds.INFRA_DIR}') OR regexp_matches(path, '{kinds.INFRA_EXTENSION}') OR regexp_matches(path, '{kinds.IMAGE_FILE}') OR regexp_matches(path, '{kinds.CHART_FILE}')) THEN 'infrastructure'
    WHEN (regexp_matches(path, '{kinds.PAGES_API}') OR regexp_matches(path, '{kinds.SERVER_DIR}')) OR regexp_matches(stem, '{kinds.SERVER_STEM}') THEN 'server' WHEN regexp_matches(path, '{kinds.COMPONENT_FILE}') THEN 'ui'
    WHEN {_any(kinds.DATA_WORDS, "list_concat(folders, parts)")} THEN 'data' WHEN {_any(kinds.INTEGRATION_WORDS, "list_concat(folders, parts)")} THEN 'integrations'
    WHEN (regexp_matches(path, '{kinds.UI_DIR}') OR regexp_matches(path, '{kinds.UI_EXTENSION}')) OR regexp_matches(stem, '{kinds.UI_STEM}') THEN 'ui' WHEN {_any(kinds.INFRA_WORDS, "parts")} THEN 'infrastructure' ELSE 'logic' END AS layer FROM w
"""


@query(LAYER_SQL)
def layer_classify(spark, sf_dir):
    return sql(spark, sf_dir, FILES, "part").select("id", "path", kinds.layer(F.col("path")).alias("layer"))


@query(f"""
WITH f AS ({told(FILES)}), e AS (SELECT unnest(string_split(es, ' ')) AS ext, name FROM (VALUES {", ".join(f"('{n}', '{es}')" for (n, _), es in kinds.LANGUAGES.items())}) t(name, es)),
b AS (SELECT *, lower(regexp_extract(path, '([^/]*)$', 1)) AS low FROM f)
SELECT coalesce(CASE WHEN regexp_matches(path, '{kinds.UNCOUNTED}') OR regexp_matches(path, '{kinds.UNCOUNTED_DIR}') THEN NULL WHEN low = 'dockerfile' OR starts_with(low, 'dockerfile.') OR ends_with(low, '.dockerfile') THEN 'Dockerfile'
    WHEN low = 'makefile' THEN 'Makefile' WHEN low = 'jenkinsfile' THEN 'Groovy' WHEN regexp_matches(low, '^[^.].*\\.') THEN e.name END, '-') AS language, count(*) AS files, min(path) AS example
FROM b LEFT JOIN e ON e.ext = regexp_extract(low, '\\.([^.]*)$', 1) GROUP BY 1
""")
def file_languages(spark, sf_dir):
    return sql(spark, sf_dir, FILES, "part").groupBy(F.coalesce(kinds.language(F.col("path")), F.lit("-")).alias("language")).agg(F.count("*").alias("files"), F.min("path").alias("example"))


#: Type names by number, in both dialects' SQL; and what they are, told apart from the operator's own tables.
TYPES = """SELECT p_partkey AS id, CASE p_partkey % 26 WHEN 0 THEN 'SMALLINT' WHEN 1 THEN 'int4' WHEN 2 THEN 'BigInt' WHEN 3 THEN 'serial8' WHEN 4 THEN 'float4' WHEN 5 THEN 'double' WHEN 6 THEN 'numeric' WHEN 7 THEN 'decimal( 10 , 2 )'
    WHEN 8 THEN 'dec(8,3)' WHEN 9 THEN 'text' WHEN 10 THEN 'LONGTEXT' WHEN 11 THEN 'tinytext' WHEN 12 THEN 'character varying (80)' WHEN 13 THEN 'nvarchar(20)' WHEN 14 THEN 'varchar' WHEN 15 THEN 'character(5)'
    WHEN 16 THEN 'timestamp with time zone' WHEN 17 THEN 'timestamp(3)' WHEN 18 THEN 'timestamptz(6)' WHEN 19 THEN 'date' WHEN 20 THEN 'time without time zone' WHEN 21 THEN 'tinyint(1)' WHEN 22 THEN 'bool' WHEN 23 THEN 'mediumint'
    WHEN 24 THEN 'uuid' ELSE 'numeric(6)' END AS kind FROM {part}"""
KNOWN_SQL = """known(kind, base, cls, place, p, s) AS (VALUES ('SMALLINT', 'smallint', 'i', 1, NULL, NULL), ('int4', 'integer', 'i', 2, NULL, NULL), ('BigInt', 'bigint', 'i', 3, NULL, NULL), ('serial8', 'bigserial', 'i', 3, NULL, NULL), ('mediumint', 'integer', 'i', 2, NULL, NULL),
    ('float4', 'real', 'f', 1, NULL, NULL), ('double', 'double precision', 'f', 2, NULL, NULL), ('numeric', 'numeric', 'n', 0, NULL, NULL), ('decimal( 10 , 2 )', 'numeric', 'n', 0, 10, 2), ('dec(8,3)', 'numeric', 'n', 0, 8, 3), ('numeric(6)', 'numeric', 'n', 0, 6, NULL),
    ('text', 'text', 't', 2, NULL, NULL), ('LONGTEXT', 'longtext', 't', 3, NULL, NULL), ('tinytext', 'tinytext', 't', 1, NULL, NULL), ('character varying (80)', 'varchar', 'v', 0, 80, NULL), ('nvarchar(20)', 'varchar', 'v', 0, 20, NULL), ('varchar', 'varchar', 'v', 0, NULL, NULL),
    ('character(5)', 'char', 'v', 0, 5, NULL), ('timestamp with time zone', 'timestamptz', 'm', 2, NULL, NULL), ('timestamp(3)', 'timestamp', 'm', 1, 3, NULL), ('timestamptz(6)', 'timestamptz', 'm', 2, 6, NULL), ('date', 'date', 'd', 0, NULL, NULL),
    ('time without time zone', 'time', 'c', 0, NULL, NULL), ('tinyint(1)', 'boolean', 'b', 0, NULL, NULL), ('bool', 'boolean', 'b', 0, NULL, NULL), ('uuid', 'uuid', 'u', 0, NULL, NULL))"""


@query(f"""
WITH {KNOWN_SQL}, t AS ({told(TYPES)}), pairs AS (SELECT DISTINCT a.kind AS before, b.kind AS after FROM lineitem JOIN t a ON a.id = l_partkey JOIN t b ON b.id = l_suppkey + l_linenumber)
SELECT before, after, CASE WHEN a.base = b.base AND a.p IS NOT DISTINCT FROM b.p AND a.s IS NOT DISTINCT FROM b.s THEN NULL WHEN a.cls = 'i' AND b.cls = 'i' AND b.place < a.place THEN 'range' WHEN a.cls = 'f' AND b.cls = 'f' AND b.place < a.place THEN 'precision'
    WHEN (a.base IN ('text', 'longtext') OR a.base = 'varchar' AND a.p IS NULL) AND b.cls = 'v' AND b.p IS NOT NULL THEN 'length' WHEN a.cls = 'v' AND a.base = b.base AND b.p < a.p THEN 'length' WHEN a.base = 'longtext' AND b.cls = 't' THEN 'length'
    WHEN a.base = b.base AND a.cls IN ('n', 'm', 'c') AND b.p < a.p THEN 'precision' WHEN a.base = b.base AND a.cls IN ('n', 'm', 'c') AND b.s < a.s THEN 'scale' WHEN a.cls = 'n' AND b.cls = 'n' AND a.p IS NULL AND b.p IS NOT NULL THEN 'precision'
    WHEN a.cls IN ('n', 'f') AND b.cls = 'i' THEN 'fraction' WHEN a.cls = 'm' AND (b.cls = 'd' OR b.base = 'timestamp' AND a.base = 'timestamptz') THEN 'detail' END AS why
FROM pairs JOIN known a ON a.kind = before JOIN known b ON b.kind = after
""")
def type_narrowing(spark, sf_dir):
    types = sql(spark, sf_dir, TYPES, "part")
    lines = table(spark, sf_dir, "lineitem")
    before, after = types.select(F.col("id").alias("l_partkey"), F.col("kind").alias("before")), types.select(F.col("id").alias("_b"), F.col("kind").alias("after"))
    pairs = lines.join(before, "l_partkey").join(after, F.col("_b") == F.col("l_suppkey") + F.col("l_linenumber")).select("before", "after").distinct()
    return pairs.withColumn("why", kinds.type_narrowing(F.col("before"), F.col("after")))


@query("""
SELECT l_orderkey AS file, CASE WHEN c > 0 AND c >= a THEN 'schema' WHEN a > 0 OR i > 0 THEN 'changes' ELSE 'other' END AS kind
FROM (SELECT l_orderkey, count(*) FILTER (WHERE l_shipdate >= TIMESTAMP '2000-01-01') AS c, count(*) FILTER (WHERE l_returnflag = 'R') AS a, count(*) FILTER (WHERE l_linenumber = 7) AS i FROM lineitem GROUP BY 1)
""")
def sql_file_kinds(spark, sf_dir):
    ops = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("file")).agg(F.count_if(F.col("l_shipdate") >= F.expr("timestamp_ntz'2000-01-01'")).alias("c"), F.count_if(F.col("l_returnflag") == "R").alias("a"), F.count_if(F.col("l_linenumber") == 7).alias("i"))
    return ops.select("file", kinds.sql_file_kind(F.col("c"), F.col("a"), F.col("i")).alias("kind"))


SIGNATURES = """SELECT p_partkey AS id, (CASE p_partkey % 4 WHEN 0 THEN 'export ' ELSE '' END) || (CASE p_size % 11 WHEN 0 THEN 'interface ' WHEN 1 THEN 'const ' WHEN 2 THEN 'function ' WHEN 3 THEN 'type ' WHEN 4 THEN 'let ' WHEN 5 THEN 'class ' WHEN 6 THEN 'enum ' WHEN 7 THEN 'static ' WHEN 8 THEN 'def ' WHEN 9 THEN 'var ' ELSE 'struct ' END)
    || replace(p_name, ' ', '_') || (CASE p_partkey % 3 WHEN 0 THEN ' = (x) => x' WHEN 1 THEN ' = 1' ELSE '(function f)' END) AS signature FROM {part}"""


@query(f"""
SELECT id, CASE WHEN regexp_matches(signature, '\\b(interface|type|enum|struct|trait|record|typealias)\\s+[A-Za-z_$]') AND NOT regexp_matches(signature, '\\bfunction\\b') THEN 'type'
    WHEN regexp_matches(signature, '\\b(const|let|var|static)\\s+[A-Za-z_$]') AND NOT regexp_matches(signature, '=>|\\bfunction\\b') THEN 'value' ELSE 'callable' END AS kind FROM ({told(SIGNATURES)})
""")
def contract_kinds(spark, sf_dir):
    return sql(spark, sf_dir, SIGNATURES, "part").select("id", kinds.contract_kind(F.col("signature")).alias("kind"))


QUALIFIED = "SELECT p_partkey AS id, (CASE p_partkey % 6 WHEN 0 THEN 'public.' WHEN 1 THEN 'DBO.' WHEN 2 THEN 'main.' WHEN 3 THEN 'db.Audit.' WHEN 4 THEN 'sales..' ELSE '' END) || replace(p_name, ' ', '_') AS qualified FROM {part}"


@query(f"""
WITH q AS (SELECT id, list_filter(string_split(qualified, '.'), lambda x: x <> '') AS parts FROM ({told(QUALIFIED)})), s AS (SELECT id, parts[-1] AS name, CASE WHEN len(parts) >= 2 AND lower(parts[-2]) NOT IN ('public', 'dbo', 'main') THEN parts[-2] END AS schema FROM q)
SELECT id, name, schema, lower(coalesce(schema || '.', '') || name) AS "key" FROM s
""")
def table_names(spark, sf_dir):
    q = F.col("qualified")
    return sql(spark, sf_dir, QUALIFIED, "part").select("id", names.table_name(q)["name"].alias("name"), names.table_name(q)["schema"].alias("schema"), names.table_key(q).alias("key"))


IMAGES = """SELECT p_partkey AS id, (CASE p_partkey % 5 WHEN 0 THEN 'ghcr.io/' WHEN 1 THEN 'localhost:5000/' WHEN 2 THEN '${REGISTRY}/' WHEN 3 THEN 'Acme/' ELSE '' END) || replace(p_name, ' ', '/') || (CASE p_size % 4 WHEN 0 THEN ':1.2' WHEN 1 THEN ':{{ .Tag }}' WHEN 2 THEN '@sha256:0a1b' ELSE ':$TAG' END) AS image FROM {part}"""


@query(rf"""
WITH c AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(image, '\{{\{{[^}}]*\}}\}}', '', 'g'), '\[\[[^\]]*\]\]', '', 'g'), '\$\{{[^}}]*\}}', '', 'g'), '\$[A-Za-z_][A-Za-z0-9_]*', '', 'g'), '^/+', '') AS i FROM ({told(IMAGES)})),
n AS (SELECT id, list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(i, '@sha256:[0-9a-f]+$', ''), ':[^:/]+$', ''), ':$', ''), '/'), lambda x: x <> '') AS parts FROM c),
r AS (SELECT id, CASE WHEN len(parts) > 1 AND (regexp_matches(parts[1], '[.:]') OR parts[1] = 'localhost') THEN parts[2:] ELSE parts END AS parts FROM n)
SELECT id, lower(array_to_string(parts, '/')) AS "full", lower(regexp_replace(parts[-1], '[^A-Za-z0-9_.-]', '', 'g')) AS "last" FROM r
""")
def image_keys(spark, sf_dir):
    key = names.image_key(F.col("image"))
    return sql(spark, sf_dir, IMAGES, "part").select("id", key["full"].alias("full"), key["last"].alias("last"))


SPECS = """SELECT p_partkey AS id, CASE p_partkey % 12 WHEN 0 THEN 'github.com/acme/' || replace(p_name, ' ', '/') || '/v2' WHEN 1 THEN 'net/http/' || replace(p_name, ' ', '/') WHEN 2 THEN 'gopkg.in/yaml.v3/' || replace(p_name, ' ', '/') WHEN 3 THEN 'example.org/' || replace(p_name, ' ', '/')
    WHEN 4 THEN 'github.com/acme/tool/v' || CAST(p_size AS STRING) || '/sub' WHEN 5 THEN 'C' WHEN 6 THEN 'com.acme.' || replace(p_name, ' ', '.') || '.Widget' WHEN 7 THEN 'kotlin.text.' || replace(p_name, ' ', '.') WHEN 8 THEN 'org.x.' || replace(p_name, ' ', '.') || '.*'
    WHEN 9 THEN 'serde-json::' || replace(p_name, ' ', '::') WHEN 10 THEN 'crate::' || replace(p_name, ' ', '::') ELSE 'extern crate my-lib' END AS spec FROM {part}"""


@query(rf"""
WITH s AS (SELECT id, trim(spec) AS spec, string_split(trim(spec), '/') AS seg FROM ({told(SPECS)})),
g AS (SELECT *, CASE WHEN seg[1] IN ('github.com', 'gitlab.com', 'bitbucket.org', 'gitea.com', 'codeberg.org', 'golang.org') THEN 3 WHEN seg[1] = 'gopkg.in' THEN coalesce(list_position(list_transform(seg[2:], lambda x: regexp_matches(x, '\.v[0-9]+$')), true) + 1, 2) ELSE 2 END AS n FROM s)
SELECT id, CASE WHEN spec IN ('', 'C') THEN NULL WHEN NOT contains(seg[1], '.') THEN array_to_string(seg[1:2], '/') WHEN len(seg) > least(n, len(seg)) AND regexp_matches(seg[n + 1], '^v[0-9]+$') THEN array_to_string(seg[1:n + 1], '/') ELSE array_to_string(seg[1:n], '/') END AS go FROM g WHERE id % 12 <= 5
""")
def external_go_packages(spark, sf_dir):
    return sql(spark, sf_dir, SPECS, "part").where("id % 12 <= 5").select("id", names.go_package(F.col("spec")).alias("go"))


@query(rf"""
WITH s AS (SELECT id, list_filter(string_split(regexp_replace(trim(spec), '\.\*$', ''), '.'), lambda x: x <> '') AS seg FROM ({told(SPECS)}) WHERE id % 12 BETWEEN 6 AND 8),
u AS (SELECT id, seg, list_filter(range(1, len(seg) + 1), lambda i: regexp_matches(seg[i], '^[A-Z]'))[1] AS upper FROM s), p AS (SELECT id, seg, seg[1:coalesce(upper - 1, len(seg))] AS pkg FROM u)
SELECT id, CASE WHEN len(pkg) = 0 THEN seg[1] ELSE array_to_string(pkg[1:CASE WHEN pkg[1] IN ({", ".join(f"'{d}'" for d in names.DOMAIN_ROOTS)}) THEN 3 ELSE 2 END], '.') END AS jvm FROM p
""")
def external_jvm_packages(spark, sf_dir):
    return sql(spark, sf_dir, SPECS, "part").where("id % 12 BETWEEN 6 AND 8").select("id", names.jvm_package(F.col("spec")).alias("jvm"))


@query(f"""
SELECT id, CASE WHEN starts_with(spec, 'extern crate ') THEN replace(substr(spec, 14), '-', '_') WHEN string_split(spec, '::')[1] IN ('crate', 'self', 'super', '') THEN NULL ELSE replace(string_split(spec, '::')[1], '-', '_') END AS rust FROM ({told(SPECS)}) WHERE id % 12 >= 9
""")
def external_rust_packages(spark, sf_dir):
    return sql(spark, sf_dir, SPECS, "part").where("id % 12 >= 9").select("id", names.rust_package(F.col("spec")).alias("rust"))


@query("""
SELECT o_orderkey AS id, 'http ' || split_part(o_orderpriority, '-', 2) || ' /orders/{}' AS endpoint FROM orders WHERE o_orderkey % 4 = 0
UNION ALL SELECT o_orderkey, 'action src/' || o_orderstatus || '.ts#' || '/Orders/' || '{id}' FROM orders WHERE o_orderkey % 4 = 1
UNION ALL SELECT o_orderkey, 'trpc /Orders/' || '{id}' FROM orders WHERE o_orderkey % 4 = 2
UNION ALL SELECT o_orderkey, 'graphql ' || split_part(o_orderpriority, '-', 2) || ' /Orders/' || '{id}' FROM orders WHERE o_orderkey % 4 = 3
""")
def endpoint_ids(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("http", "action", "trpc", "graphql"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), kind.alias("kind"), F.split_part("o_orderpriority", F.lit("-"), F.lit(2)).alias("method"), F.lit("/Orders/{id}").alias("path"), F.concat(F.lit("src/"), "o_orderstatus", F.lit(".ts")).alias("file"))
    return rows.select("id", names.endpoint_id(F.col("kind"), F.col("method"), F.col("path"), F.col("file")).alias("endpoint"))


@query("""
SELECT p_partkey AS id, upper(substr(t, 1, 1)) || substr(t, 2) AS title FROM (SELECT p_partkey, array_to_string(list_transform(string_split(CASE p_size % 5 WHEN 0 THEN 'pr ' WHEN 1 THEN 'github ' WHEN 2 THEN 'oauth ' ELSE '' END || p_name, ' '),
    lambda w: CASE w WHEN 'pr' THEN 'PR' WHEN 'github' THEN 'GitHub' WHEN 'oauth' THEN 'OAuth' ELSE w END), ' ') AS t FROM part)
""")
def feature_titles(spark, sf_dir):
    given = F.split(F.concat(F.when(F.col("p_size") % 5 == 0, "pr ").when(F.col("p_size") % 5 == 1, "github ").when(F.col("p_size") % 5 == 2, "oauth ").otherwise(""), "p_name"), " ")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), names.feature_title(given).alias("title"))


GLOBS = "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'packages/*/src/**' WHEN 1 THEN 'src/**/*.ts' WHEN 2 THEN '*' WHEN 3 THEN 'lib/db/*.test.ts' ELSE '**/docs/*' END AS pattern FROM {part}"


@query(f"""
SELECT f.id, regexp_full_match(path, CASE f.id % 5 WHEN 0 THEN 'packages/[^/]*/src/.*' WHEN 1 THEN 'src/.*[^/]*\\.ts' WHEN 2 THEN '[^/]*' WHEN 3 THEN 'lib/db/[^/]*\\.test\\.ts' ELSE '.*docs/[^/]*' END) AS fits FROM ({told(FILES)}) f
""")
def workspace_globs(spark, sf_dir):
    return sql(spark, sf_dir, FILES, "part").join(sql(spark, sf_dir, GLOBS, "part"), "id").select("id", F.rlike("path", names.glob_regex(F.col("pattern"))).alias("fits"))


MANIFESTS = """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'package.json' WHEN 1 THEN 'api/go.mod' WHEN 2 THEN 'requirements.txt' ELSE 'yarn.lock' END AS path, '--- a~+++ b~@@ -1 +1 @@~' || CASE p_partkey % 4
    WHEN 0 THEN '+  "@acme/' || replace(p_name, ' ', '-') || '": "^1.' || CAST(p_size AS STRING) || '",~-  "name": "left",~+  "react": "18.0"' WHEN 1 THEN '+  require github.com/acme/' || replace(p_name, ' ', '/') || ' v1.2.3~ example.org/other v1' WHEN 2 THEN '-' || replace(p_name, ' ', '_') || '==1.0~+numpy[all]>=2' ELSE '+left@1.0' END AS patch FROM {part}"""


@query(rf"""
WITH m AS ({told(MANIFESTS)})
SELECT id, CASE id % 4 WHEN 0 THEN '@acme/' || regexp_extract(patch, '@acme/([a-z-]+)', 1) || ',react' WHEN 1 THEN regexp_extract(patch, 'require (\S+) v', 1) WHEN 2 THEN list_aggregate(list_sort([regexp_extract(patch, '-([a-z_]+)==', 1), 'numpy']), 'string_agg', ',') ELSE '' END AS packages FROM m
""")
def changed_packages(spark, sf_dir):
    rows = sql(spark, sf_dir, MANIFESTS, "part").withColumn("patch", F.replace("patch", F.lit("~"), F.lit("\n")))  # the stand-in writes ~ for line ends
    return rows.select("id", F.array_join(F.array_sort(names.changed_packages(F.col("path"), F.col("patch"))), ",").alias("packages"))
