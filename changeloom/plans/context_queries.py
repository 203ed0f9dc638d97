"""What belongs to a change, and cards of a map, over the given tables in their roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeloom.functions import resources
from changeloom.operators import context
from changeloom.plans.kind_queries import LAYER_SQL
from changeloom.plans.registry import ORACLE_SQL, query, table
from changeloom.plans.standins import EDGES_SQL, FILES, edges, longs, sql, told

PATHS = "SELECT DISTINCT p_brand AS path FROM {part} WHERE p_size = 3"


@query(f"""
WITH {EDGES_SQL}, changed AS (SELECT p_partkey AS file FROM part WHERE p_size = 7), near AS (SELECT src AS file, dst AS other FROM edges UNION SELECT dst, src FROM edges), f AS (SELECT DISTINCT file FROM near WHERE other IN (SELECT file FROM changed) AND file NOT IN (SELECT file FROM changed)),
m AS (SELECT DISTINCT l_partkey AS file, l_suppkey AS i FROM lineitem), ids AS (SELECT DISTINCT l_suppkey AS i FROM lineitem WHERE l_partkey IN (SELECT file FROM changed))
SELECT file, count(*) AS shared FROM m WHERE file IN (SELECT file FROM f) AND i IN (SELECT i FROM ids) GROUP BY 1 ORDER BY shared DESC, file LIMIT 12
""")
def related_files(spark, sf_dir):
    changed = table(spark, sf_dir, "part").where("p_size = 7").select(F.col("p_partkey").alias("file"))
    mentions = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("file"), F.col("l_suppkey").alias("identifier")).distinct()
    return context.related_files(changed, edges(spark, sf_dir), mentions, mentions.join(changed, "file").select("identifier"))


CALLS = "SELECT l_partkey AS src, l_suppkey + 5 AS dst FROM {lineitem}"


@query(f"""
WITH c AS ({told(CALLS)}), ch AS (SELECT p_partkey AS id FROM part WHERE p_size = 7)
SELECT * FROM (SELECT dst AS id, 'definition' AS role, count(*) AS n FROM c WHERE src IN (SELECT id FROM ch) AND dst NOT IN (SELECT id FROM ch) GROUP BY 1 ORDER BY n DESC, id LIMIT 12)
UNION ALL SELECT * FROM (SELECT src, 'caller', count(*) AS n FROM c WHERE dst IN (SELECT id FROM ch) AND src NOT IN (SELECT id FROM ch) GROUP BY 1 ORDER BY n DESC, src LIMIT 8)
""")
def related_declarations(spark, sf_dir):
    changed = table(spark, sf_dir, "part").where("p_size = 7").select(F.col("p_partkey").alias("id"))
    return context.related_declarations(changed, sql(spark, sf_dir, CALLS, "lineitem"))


@query("""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, 1 + doc_id % 3 AS a, 2 + doc_id % 5 AS b FROM documents), m AS (SELECT x.doc_id AS before_id, y.doc_id AS after_id, CASE WHEN x.doc_id % 4 = 0 THEN 'body' ELSE 'signature' END AS change FROM d x JOIN d y ON y.doc_id = x.doc_id + 1 WHERE x.doc_id % 3 > 0)
SELECT before_id, after_id, change, array_to_string(x.ls[x.a:greatest(x.a - 1, x.b)], chr(10)) AS before, array_to_string(y.ls[y.a:greatest(y.a - 1, y.b)], chr(10)) AS after FROM m JOIN d x ON x.doc_id = before_id JOIN d y ON y.doc_id = after_id WHERE x.b >= x.a AND y.b >= y.a
""")
def moved_texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (1 + F.col("doc_id") % 3).cast("int").alias("start_line"), (2 + F.col("doc_id") % 5).cast("int").alias("end_line"), F.coalesce("text", F.lit("")).alias("text")).where("end_line >= start_line")
    ids = table(spark, sf_dir, "documents").select("doc_id")
    change = F.when(F.col("before_id") % 3 > 0, F.when(F.col("before_id") % 4 == 0, "body").otherwise("signature"))
    return context.moved_texts(ids.select(F.col("doc_id").alias("before_id"), (F.col("doc_id") + 1).alias("after_id")).withColumn("change", change), docs, docs)


@query("SELECT doc_id + 1 AS id, doc_id AS before_id, 'body' AS kind FROM documents WHERE doc_id % 4 = 0")
def moved_contracts(spark, sf_dir):
    moves = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("before_id"), (F.col("doc_id") + 1).alias("after_id"), F.when(F.col("doc_id") % 4 == 0, "body").otherwise("signature").alias("change"))
    return context.moved_contracts(moves)


@query(f"""
WITH p AS ({told(PATHS)}) SELECT DISTINCT l_suppkey AS "table" FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 40 AND p_brand IN (SELECT path FROM p) UNION SELECT p_size FROM part WHERE p_type = 'SMALL' AND p_brand IN (SELECT path FROM p)
""")
def tables_touching(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    uses = table(spark, sf_dir, "lineitem").where("l_quantity > 40").join(parts, F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_suppkey").alias("table"), F.col("p_brand").alias("file"))
    history = parts.where("p_type = 'SMALL'").select(F.col("p_size").cast("long").alias("table"), F.col("p_brand").alias("file"))
    return context.tables_touching(sql(spark, sf_dir, PATHS, "part"), uses, history)


@query("SELECT s_name AS \"table\", CASE WHEN s_acctbal < 1000 THEN 'changed' END AS status, row_number() OVER (ORDER BY s_acctbal >= 1000, s_name) AS place FROM supplier")
def annotated_tables(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier")
    return longs(context.annotated_tables(suppliers.select(F.col("s_name").alias("table")), suppliers.where("s_acctbal < 1000").select(F.col("s_name").alias("table"), F.lit("changed").alias("status"))), "place")


LINKS = "SELECT DISTINCT 'w' || CAST(p_size AS STRING) AS workload, (CASE p_size % 5 WHEN 0 THEN 'src' WHEN 1 THEN 'lib/db' WHEN 2 THEN 'packages/core' WHEN 3 THEN 'docs' ELSE '' END) AS folder, p_size % 3 > 0 AS resolved FROM {part}"
SOME = FILES + " WHERE p_partkey % 19 IN (1, 5)"


@query(f"SELECT DISTINCT workload FROM ({told(LINKS)}) l JOIN ({told(SOME)}) f ON folder = '' OR path = folder OR starts_with(path, folder || '/') WHERE resolved")
def workloads_deploying(spark, sf_dir):
    return context.workloads_deploying(sql(spark, sf_dir, LINKS, "part"), sql(spark, sf_dir, SOME, "part"))


@query("WITH i AS (SELECT DISTINCT p_brand || '/' || p_type AS id FROM part WHERE p_size < 4) SELECT DISTINCT c.id FROM (SELECT DISTINCT p_brand || '/' || p_type || '/' || p_name AS id FROM part UNION SELECT DISTINCT p_brand || '/' || p_type FROM part) c JOIN i ON c.id = i.id OR starts_with(c.id, i.id || '/')")
def infra_with_parents(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    ids = parts.select(F.concat_ws("/", "p_brand", "p_type").alias("id"))
    return context.with_parents(parts.select(F.concat_ws("/", "p_brand", "p_type", "p_name").alias("id")).union(ids).distinct(), parts.where("p_size < 4").select(F.concat_ws("/", "p_brand", "p_type").alias("id")).distinct())


@query("SELECT p_partkey AS file, t.tests FROM part LEFT JOIN (SELECT l_partkey, string_agg(CAST(l_suppkey AS VARCHAR), ', ' ORDER BY n) AS tests FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY hops, CAST(l_suppkey AS VARCHAR)) AS n FROM (SELECT l_partkey, l_suppkey, min(l_linenumber) AS hops FROM lineitem GROUP BY 1, 2)) WHERE n <= 4 GROUP BY 1) t ON l_partkey = p_partkey")
def tests_of_files(spark, sf_dir):
    reach = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("file"), F.col("l_suppkey").cast("string").alias("test")).agg(F.min("l_linenumber").alias("hops"))
    return context.tests_of_files(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file")), reach, 4)


@query("SELECT l_partkey AS file, arg_min(l_suppkey, l_linenumber * 1000000 + l_suppkey) AS report FROM lineitem GROUP BY 1")
def first_covering(spark, sf_dir):
    return context.first_covering(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("file"), F.col("l_suppkey").alias("report"), F.col("l_linenumber").alias("ord")))


@query("""
WITH e AS (SELECT DISTINCT n_name AS a, r_name AS b FROM nation JOIN region ON r_regionkey = n_regionkey UNION SELECT DISTINCT r_name, 'root' FROM region), c AS (SELECT n_name AS id FROM nation UNION SELECT r_name FROM region UNION SELECT 'alone')
SELECT id, coalesce((SELECT string_agg(b, ',' ORDER BY b) FROM e WHERE a = id), '') AS uses, coalesce((SELECT string_agg(a, ',' ORDER BY a) FROM e WHERE b = id), '') AS used_by FROM c
""")
def neighbour_summaries(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    links = nation.join(region, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_name").alias("src"), F.col("r_name").alias("dst")).union(region.select("r_name", F.lit("root"))).distinct()
    components = nation.select(F.col("n_name").alias("id")).union(region.select("r_name")).union(spark.range(1).select(F.lit("alone")))
    return context.neighbour_summaries(components, links).select("id", *[F.array_join(c, ",").alias(c) for c in ("uses", "used_by")])


@query("""
WITH l AS (SELECT o_custkey AS file, o_orderkey AS line, CASE o_orderstatus WHEN 'P' THEN '-- ' || o_orderpriority WHEN 'F' THEN '/* ' || o_orderpriority || ' */' ELSE CASE WHEN o_orderkey % 4 = 0 THEN ' ' ELSE 'SELECT 1' END END AS content FROM orders), t AS (SELECT *, starts_with(content, '--') OR starts_with(content, '/*') AS c FROM l WHERE trim(content) <> ''),
w AS (SELECT *, lag(c) OVER (PARTITION BY file ORDER BY line) AS b FROM t) SELECT file, line, trim(regexp_replace(regexp_replace(content, '^(--|/\\*)\\s*', ''), '\\*/$', '')) AS title FROM w WHERE c AND NOT coalesce(b, false)
""")
def comment_titles(spark, sf_dir):
    content = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("-- "), "o_orderpriority")).when(F.col("o_orderstatus") == "F", F.concat(F.lit("/* "), "o_orderpriority", F.lit(" */"))).when(F.col("o_orderkey") % 4 == 0, " ").otherwise("SELECT 1")
    return context.comment_titles(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("line"), content.alias("content")), "file")


@query("""
SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN CASE WHEN o_orderstatus = 'F' THEN 'up_to_date' ELSE 'error' END WHEN o_orderpriority = '2-HIGH' THEN CASE WHEN o_orderstatus = 'F' THEN 'stale' ELSE 'analyzing' END WHEN o_orderpriority = '3-MEDIUM' THEN 'error'
    WHEN o_orderstatus <> 'F' THEN CASE WHEN o_totalprice > 100000 THEN 'analyzing' ELSE 'error' END WHEN o_orderkey % 3 = 0 THEN 'stale' ELSE 'up_to_date' END AS status FROM orders
""")
def repo_statuses(spark, sf_dir):
    state = F.when(F.col("o_orderpriority") == "1-URGENT", "unreadable").when(F.col("o_orderpriority") == "2-HIGH", "delayed").when(F.col("o_orderpriority") == "3-MEDIUM", "failed").otherwise("completed")
    stale = F.when(F.col("o_orderkey") % 3 == 0, True).when(F.col("o_orderkey") % 3 == 1, False)
    return table(spark, sf_dir, "orders").select("o_orderkey", context.repo_status(state, F.col("o_orderstatus") == "F", F.col("o_totalprice") > 100000, stale).alias("status"))


@query("SELECT doc_id, substr(sha1(lang || chr(0) || source || chr(0) || '' || chr(0) || trim(regexp_replace(text, '\\s+', ' ', 'g'))), 1, 20) AS fingerprint FROM documents")
def finding_fingerprints(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", context.finding_fingerprint(F.col("lang"), F.col("source"), F.lit(None).cast("string"), F.col("text")).alias("fingerprint"))


@query("SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') THEN 'new' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def restamped_findings(spark, sf_dir):
    kept = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return context.restamped(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), kept, ["o_custkey"], o_orderstatus=F.lit("new")).drop("o_custkey")


KINDS = "CASE p_size % 9 WHEN 0 THEN 'aws_db_instance' WHEN 1 THEN 'aws_instance' WHEN 2 THEN 'google_storage_bucket' WHEN 3 THEN 'Service' WHEN 4 THEN 'azurerm_mssql_database' WHEN 5 THEN 'StatefulSet' WHEN 6 THEN 'aws_iam_role' WHEN 7 THEN 'google_sql_database_instance' ELSE 'Deployment' END"
ATTRS = "CASE p_partkey % 7 WHEN 0 THEN 'engine' WHEN 1 THEN 'ami' WHEN 2 THEN 'name' WHEN 3 THEN 'spec.clusterIP' WHEN 4 THEN 'location.zone' WHEN 5 THEN 'spec.volumeClaimTemplates[0]' ELSE 'tags' END"


@query(f"""
SELECT p_partkey AS id, k IN ('aws_db_instance', 'google_storage_bucket', 'azurerm_mssql_database', 'StatefulSet', 'google_sql_database_instance') AS stateful,
    (k, a) IN (('aws_db_instance', 'engine'), ('aws_instance', 'ami'), ('Service', 'spec.clusterIP'), ('StatefulSet', 'spec.volumeClaimTemplates[0]'), ('google_storage_bucket', 'name'), ('google_sql_database_instance', 'name'), ('azurerm_mssql_database', 'name')) AS forces_new
FROM (SELECT p_partkey, {KINDS} AS k, {ATTRS} AS a FROM part)
""")
def resource_lookups(spark, sf_dir):
    rows = sql(spark, sf_dir, f"SELECT p_partkey AS id, {KINDS} AS kind, {ATTRS} AS attribute FROM {{part}}", "part")
    return resources.replaced(rows, resources.rules(spark)).select("id", resources.stateful(F.col("kind")).alias("stateful"), "forces_new")


@query("SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN NULL ELSE CASE WHEN p_size % 2 = 0 THEN 'DB_' || p_size || ',HOST' ELSE 'DB_' || p_size END END AS keys FROM part")
def template_keys(spark, sf_dir):
    text = F.concat(F.lit("<<EOT\nDB_"), "p_size", F.lit(" = 1\n"), F.when(F.col("p_size") % 2 == 0, "export HOST=x\nDB_").otherwise("# DB_"), "p_size", F.lit("=2\n"), F.when(F.col("p_size") % 3 == 0, "{{ range service }}\n").otherwise(""), F.lit("EOT"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(context.template_keys(text), ",").alias("keys"))


TAGS = "SELECT s_suppkey AS service, CASE s_suppkey % 4 WHEN 0 THEN 'traefik.http.routers.r1.rule=Host(`h' || CAST(s_nationkey AS STRING) || '`) && PathPrefix(`/api`)' WHEN 1 THEN 'urlprefix-h' || CAST(s_nationkey AS STRING) || '/v1 strip' WHEN 2 THEN 'urlprefix-/plain' ELSE 'traefik.enable=true' END AS tag FROM {supplier}"


@query("""
SELECT s_suppkey AS service, 'h' || s_nationkey AS host, '/api' AS path, 'r1' AS router FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT s_suppkey, 'h' || s_nationkey, '/v1', NULL FROM supplier WHERE s_suppkey % 4 = 1 UNION ALL SELECT s_suppkey, NULL, '/plain', NULL FROM supplier WHERE s_suppkey % 4 = 2
""")
def proxy_routes(spark, sf_dir):
    return context.proxy_routes(sql(spark, sf_dir, TAGS, "supplier"))


CHANGED = "SELECT id, path, CASE WHEN id % 4 = 0 THEN CAST(NULL AS STRING) ELSE 'c' || CAST(id % 6 AS STRING) END AS owner, CASE WHEN id % 5 = 0 THEN 'removed' ELSE 'modified' END AS status FROM (" + FILES + ") f"
@query(f"""
WITH c AS ({told(CHANGED)}), r AS (SELECT c.*, role, coalesce(nullif(regexp_extract(c.path, '^(.*)/[^/]*$', 1), ''), '.') AS folder FROM c JOIN ({ORACLE_SQL["file_roles"]}) x ON x.id = c.id),
k AS (SELECT *, CASE role WHEN 'dependency' THEN 'dep' WHEN 'config' THEN 'config' WHEN 'docs' THEN 'docs' WHEN 'test' THEN 'test:' || coalesce(owner, folder) ELSE CASE WHEN owner IS NOT NULL THEN 'code:' || owner ELSE 'new:' || folder END END AS card FROM r)
SELECT card AS id, count(*) AS files, CASE WHEN count(DISTINCT status) = 1 THEN min(status) END AS status, CASE card WHEN 'dep' THEN 'Dependencies' WHEN 'config' THEN 'Build & config' WHEN 'docs' THEN 'Documentation' ELSE CASE WHEN starts_with(card, 'test:') THEN 'Tests (' || substr(card, 6) || ')' ELSE regexp_replace(card, '^(code|new):', '') END END AS name FROM k GROUP BY card
""")
def change_groups(spark, sf_dir):
    return context.change_groups(sql(spark, sf_dir, CHANGED, "part"))


@query(f"""
WITH c AS (SELECT id, 'card' || id % 9 AS card, status FROM ({told(CHANGED)})), n AS (SELECT *, count(*) OVER (PARTITION BY card) AS n, count(*) FILTER (WHERE status = 'removed') OVER (PARTITION BY card) AS gone FROM c)
SELECT id, card || CASE WHEN n > 8 AND gone >= 2 AND n - gone >= 2 AND status = 'removed' THEN ':removed' ELSE '' END AS card FROM n
""")
def removed_apart(spark, sf_dir):
    files = sql(spark, sf_dir, CHANGED, "part").select("id", F.concat(F.lit("card"), F.col("id") % 9).alias("card"), "status")
    return context.removed_apart(files).select("id", "card")


MEMBERS = "SELECT DISTINCT (CASE p_partkey % 7 WHEN 0 THEN 'src' WHEN 1 THEN 'src/api' WHEN 2 THEN 'lib' WHEN 3 THEN 'lib/db' WHEN 4 THEN 'tests/e2e' WHEN 5 THEN 'packages/core/src' ELSE 'docs' END) AS member, 'card' || CAST(p_partkey % 7 AS STRING) AS card FROM {part}"
MATCH_SQL = f"m AS ({told(MEMBERS)}), f AS ({told(FILES)}), hit AS (SELECT f.id, arg_max(m.card, length(m.member)) AS card, arg_max(m.member, length(m.member)) AS member FROM f JOIN m ON f.path = m.member OR starts_with(f.path, m.member || '/') GROUP BY 1)"


@query(f"WITH {MATCH_SQL} SELECT f.id, coalesce(hit.card, 'rest') AS card FROM f LEFT JOIN hit ON hit.id = f.id")
def grouped_files(spark, sf_dir):
    return context.grouped(sql(spark, sf_dir, FILES, "part"), sql(spark, sf_dir, MEMBERS, "part")).select("id", "card")


@query(f"WITH {MATCH_SQL} SELECT id, path FROM f WHERE id NOT IN (SELECT id FROM hit)")
def uncovered_files(spark, sf_dir):
    return context.uncovered_files(sql(spark, sf_dir, FILES, "part"), sql(spark, sf_dir, MEMBERS, "part"))


@query(f"WITH {MATCH_SQL} SELECT f.id, coalesce(hit.card, l.layer) AS layer FROM f JOIN ({LAYER_SQL}) l ON l.id = f.id LEFT JOIN hit ON hit.id = f.id")
def resolved_layers(spark, sf_dir):
    return context.resolved_layers(sql(spark, sf_dir, FILES, "part"), sql(spark, sf_dir, MEMBERS, "part").withColumnRenamed("card", "layer")).select("id", "layer")


@query(f"""
WITH f AS ({told(CHANGED)}), l AS ({LAYER_SQL})
SELECT 'architecture' AS level, layer AS card, count(*) AS files FROM l GROUP BY 2 UNION ALL SELECT 'features', CASE WHEN id % 3 = 0 THEN 'f' ELSE 'other' END, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'modules', coalesce(owner, 'unowned'), count(*) FROM f GROUP BY 2
""")
def groups_by_level(spark, sf_dir):
    files = sql(spark, sf_dir, CHANGED, "part").select("path", F.when(F.col("id") % 3 == 0, "f").alias("feature"), F.col("owner").alias("module"))
    return context.groups_by_level(files)


@query(f"SELECT owner, md5(string_agg(DISTINCT path, chr(10) ORDER BY path)) AS key FROM ({told(CHANGED)}) WHERE owner IS NOT NULL GROUP BY 1")
def path_set_keys(spark, sf_dir):
    return sql(spark, sf_dir, CHANGED, "part").where("owner IS NOT NULL").groupBy("owner").agg(F.md5(context.paths_key(F.col("path"))).alias("key"))


CARDS = "SELECT 'k' || CAST(p_size % 9 AS STRING) AS card, p_partkey AS member, CASE WHEN p_size % 9 IN (0, 8) THEN CAST(NULL AS STRING) ELSE 'k' || CAST(floor((p_size % 9) / 2) AS STRING) END AS origin FROM {part}"


@query(f"WITH c AS ({told(CARDS).replace('floor((p_size % 9) / 2)', '(p_size % 9) // 2')}) SELECT CASE WHEN card = 'k3' AND member % 2 = 0 THEN 'k3-even' ELSE card END AS card, member, CASE WHEN card = 'k3' AND member % 2 = 0 THEN 'k3' ELSE origin END AS origin FROM c")
def split_card(spark, sf_dir):
    cards = sql(spark, sf_dir, CARDS, "part")
    return context.split_card(cards, "k3", cards.where("card = 'k3' AND member % 2 = 0").select(F.lit("k3-even").alias("part"), "member"))


@query(f"""
WITH RECURSIVE c AS ({told(CARDS).replace('floor((p_size % 9) / 2)', '(p_size % 9) // 2')}), back AS (SELECT 'k1' AS card UNION SELECT c.card FROM back b JOIN c ON c.origin = b.card)
SELECT CASE WHEN card IN (SELECT card FROM back) THEN 'k1' ELSE card END AS card, member, CASE WHEN card IN (SELECT card FROM back) THEN 'k0' ELSE origin END AS origin FROM c
""")
def merged_back(spark, sf_dir):
    return context.merged_back(sql(spark, sf_dir, CARDS, "part"), "k1")


@query("""
WITH r AS (SELECT DISTINCT 'h' || s_nationkey AS host, 'g' || s_nationkey % 3 AS a, 's' || s_suppkey AS b FROM supplier WHERE s_acctbal > 2000), u AS (SELECT DISTINCT 's' || l_suppkey AS a, 't' || l_partkey % 50 AS b FROM lineitem WHERE l_quantity > 30), c AS (SELECT DISTINCT 's' || s_suppkey AS a, 'h' || (s_nationkey + 1) % 25 AS host FROM supplier)
SELECT a AS "from", b AS "to", 'route' AS kind FROM r UNION SELECT a, b, 'uses' FROM u UNION SELECT c.a, r.b, 'calls' FROM c JOIN r ON r.host = c.host WHERE c.a <> r.b
""")
def infra_topology(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier")
    tag = lambda letter, column: F.concat(F.lit(letter), F.col(column) if isinstance(column, str) else column)
    routes = suppliers.where("s_acctbal > 2000").select(tag("h", "s_nationkey").alias("host"), tag("g", F.col("s_nationkey") % 3).alias("from"), tag("s", "s_suppkey").alias("to"))
    uses = table(spark, sf_dir, "lineitem").where("l_quantity > 30").select(tag("s", "l_suppkey").alias("from"), tag("t", F.col("l_partkey") % 50).alias("to"))
    return context.topology(routes, uses, suppliers.select(tag("s", "s_suppkey").alias("from"), tag("h", (F.col("s_nationkey") + 1) % 25).alias("host")))


@query("""
WITH r AS (SELECT n_name AS route, n_regionkey AS workload, CAST(n_nationkey % 3 AS VARCHAR) AS prefix FROM nation), e AS (SELECT s_suppkey AS endpoint, s_nationkey % 5 AS workload, CAST(s_suppkey AS VARCHAR) AS path FROM supplier), d AS (SELECT DISTINCT l_suppkey AS endpoint, l_linenumber AS t FROM lineitem WHERE l_quantity > 48),
x AS (SELECT r.route, e.endpoint FROM r JOIN e ON e.workload = r.workload AND starts_with(e.path, r.prefix))
SELECT route, 1 AS hop, route AS step FROM r UNION SELECT route, 2, CAST(workload AS VARCHAR) FROM r UNION SELECT route, 3, CAST(endpoint AS VARCHAR) FROM x UNION SELECT route, 4, CAST(t AS VARCHAR) FROM x JOIN d ON d.endpoint = x.endpoint
""")
def request_journeys(spark, sf_dir):
    text = lambda c: F.col(c).cast("string")
    routes = table(spark, sf_dir, "nation").select(F.col("n_name").alias("route"), text("n_regionkey").alias("workload"), (F.col("n_nationkey") % 3).cast("string").alias("prefix"))
    endpoints = table(spark, sf_dir, "supplier").select(text("s_suppkey").alias("endpoint"), (F.col("s_nationkey") % 5).cast("string").alias("workload"), text("s_suppkey").alias("path"))
    reads = table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(text("l_suppkey").alias("endpoint"), text("l_linenumber").alias("table")).distinct()
    return context.journeys(routes, endpoints, reads)


@query("""
WITH d AS (SELECT p_partkey AS id, p_partkey - p_partkey % 4 AS parent, p_size > 25 AS exported, CASE WHEN p_size % 6 = 0 THEN '_' ELSE '' END || p_name AS name FROM part)
SELECT id FROM d WHERE exported UNION ALL SELECT id FROM d WHERE NOT exported AND parent IN (SELECT id FROM d WHERE exported) AND NOT regexp_matches(name, '^[#_]')
""")
def public_declarations(spark, sf_dir):
    decls = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") - F.col("p_partkey") % 4).alias("parent"), (F.col("p_size") > 25).alias("exported"), F.concat(F.when(F.col("p_size") % 6 == 0, "_").otherwise(""), "p_name").alias("name"))
    return context.public_declarations(decls).select("id")
