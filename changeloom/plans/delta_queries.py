"""Differences of declarations, schemas, resources and endpoints, and the named facade, over the given tables in their roles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from changeloom.api import Review
from changeloom.functions import numbers, paths, text
from changeloom.operators import relational, review, snapshots
from changeloom.plans.registry import query, table
from changeloom.plans.standins import EDGES_SQL, edges, longs, owners, sql, told

# --- declarations ----------------------------------------------------------------------------------------------

#: Declarations of two sides by part: some gone, some new, signatures and texts that differ, and some moved from file to file.
BASE_DECLS = "SELECT p_brand || '#' || CAST(p_partkey AS STRING) AS id, p_brand AS file, CASE WHEN p_size % 7 = 0 THEN 'class' ELSE 'function' END AS kind, 'n' || CAST(p_partkey AS STRING) AS qualified, p_type AS signature, p_name AS text_hash, p_partkey * 3 AS start_line, p_partkey * 3 + 2 AS end_line FROM {part} WHERE p_size % 11 <> 0"
HEAD_DECLS = "SELECT CASE WHEN p_size % 5 = 0 THEN 'Brand#0' ELSE p_brand END || '#' || CAST(p_partkey AS STRING) AS id, CASE WHEN p_size % 5 = 0 THEN 'Brand#0' ELSE p_brand END AS file, CASE WHEN p_size % 7 = 0 THEN 'class' ELSE 'function' END AS kind, 'n' || CAST(p_partkey AS STRING) AS qualified, CASE WHEN p_size % 4 = 0 THEN p_type || '2' ELSE p_type END AS signature, CASE WHEN p_size % 3 = 0 THEN p_name || '2' ELSE p_name END AS text_hash, p_partkey * 3 AS start_line, p_partkey * 3 + 2 AS end_line FROM {part} WHERE p_size % 13 <> 0"
TOUCHED = "SELECT DISTINCT file, side, line FROM (SELECT p_brand AS file, CASE WHEN p_size % 2 = 0 THEN 'new' ELSE 'old' END AS side, p_partkey * 3 + 1 AS line FROM {part} WHERE p_size % 6 <> 1 UNION ALL SELECT 'Brand#0', 'new', 1 FROM {part})"


def _decls(spark, sf_dir):
    return tuple(sql(spark, sf_dir, t, "part") for t in (BASE_DECLS, HEAD_DECLS, TOUCHED))


MOVES_SQL = """files AS (SELECT DISTINCT file FROM t), gone AS (SELECT * FROM b WHERE file IN (SELECT file FROM files) AND id NOT IN (SELECT id FROM h)), fresh AS (SELECT * FROM h WHERE file IN (SELECT file FROM files) AND id NOT IN (SELECT id FROM b)),
pairs AS (SELECT g.id AS before_id, f.id AS after_id, CASE WHEN g.signature <> f.signature THEN 'signature' WHEN g.text_hash <> f.text_hash THEN 'body' END AS change, count(*) OVER (PARTITION BY g.id) AS x, count(*) OVER (PARTITION BY f.id) AS y FROM gone g JOIN fresh f ON f.kind = g.kind AND f.qualified = g.qualified AND f.file <> g.file), moves AS (SELECT * FROM pairs WHERE x = 1 AND y = 1)"""


@query(f"""
WITH b AS ({told(BASE_DECLS)}), h AS ({told(HEAD_DECLS)}), t AS ({told(TOUCHED)}), {MOVES_SQL},
s AS (SELECT h.id, h.file, CASE WHEN m.after_id IS NOT NULL THEN coalesce(m.change, 'moved') WHEN b.id IS NULL THEN 'added' WHEN b.signature <> h.signature THEN 'signature'
    WHEN h.kind <> 'class' AND (EXISTS (SELECT 1 FROM t WHERE t.file = h.file AND side = 'new' AND line BETWEEN h.start_line AND h.end_line) OR EXISTS (SELECT 1 FROM t WHERE t.file = b.file AND side = 'old' AND line BETWEEN b.start_line AND b.end_line)) THEN 'body' END AS status
    FROM h LEFT JOIN b ON b.id = h.id LEFT JOIN moves m ON m.after_id = h.id WHERE h.file IN (SELECT file FROM files))
SELECT id, file, status FROM s WHERE status IS NOT NULL UNION ALL SELECT id, file, 'removed' FROM gone WHERE id NOT IN (SELECT before_id FROM moves)
""")
def declaration_changes(spark, sf_dir):
    return snapshots.declaration_changes(*_decls(spark, sf_dir))


@query(f"WITH b AS ({told(BASE_DECLS)}), h AS ({told(HEAD_DECLS)}), t AS ({told(TOUCHED)}), {MOVES_SQL} SELECT before_id, after_id, change FROM moves")
def declaration_moves(spark, sf_dir):
    return snapshots.declaration_moves(*_decls(spark, sf_dir))


@query(f"SELECT DISTINCT id, true AS hit FROM ({told(HEAD_DECLS)}) h JOIN ({told(TOUCHED)}) t ON t.file = h.file AND t.line BETWEEN h.start_line AND h.end_line")
def touched_declarations(spark, sf_dir):
    _, head, touched = _decls(spark, sf_dir)
    return snapshots.overlaps(head, touched, "hit")


# --- schema, resources, endpoints ------------------------------------------------------------------------------

def _schema(spark, sf_dir):
    """Tables by brand, a column for each of its names; of a name that comes again the first part's."""

    def side(retyped: int, gone: int):
        parts = table(spark, sf_dir, "part").where(F.col("p_partkey") % 10 != gone)
        first = parts.withColumn("_n", F.row_number().over(Window.partitionBy("p_brand", "p_name").orderBy("p_partkey"))).where("_n = 1")
        return first.select(F.col("p_brand").alias("table"), F.col("p_name").alias("column"), F.when(F.col("p_partkey") % 9 == retyped, "bigint").otherwise("int").alias("type"), F.lit(True).alias("nullable"), F.lit(None).cast("string").alias("default"))

    renames = spark.createDataFrame([], "table_before string, table_after string")
    return side(0, 3), side(1, 4), renames


SIDE = "SELECT p_brand AS t, p_name AS c, CASE WHEN p_partkey % 9 = {0} THEN 'bigint' ELSE 'int' END AS type FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS n FROM part WHERE p_partkey % 10 <> {1}) WHERE n = 1"
SCHEMA_SQL = f"b AS ({SIDE.format(0, 3)}), h AS ({SIDE.format(1, 4)}), d AS (SELECT coalesce(h.t, b.t) AS t, coalesce(h.c, b.c) AS c, CASE WHEN b.t IS NULL THEN 'added' WHEN h.t IS NULL THEN 'removed' WHEN b.type <> h.type THEN 'changed' END AS status FROM b FULL JOIN h ON b.t = h.t AND b.c = h.c)"


@query(f"WITH {SCHEMA_SQL} SELECT t AS \"table\", c AS \"column\", status, CASE WHEN status = 'changed' THEN 'type' ELSE '' END AS aspects FROM d WHERE status IS NOT NULL")
def schema_changes(spark, sf_dir):
    base, head, renames = _schema(spark, sf_dir)
    return Review({"base_schema_columns": base, "schema_columns": head, "table_renames": renames}).get_schema_changes().select("table", "column", "status", "aspects")


@query(f"WITH {SCHEMA_SQL} SELECT count(*) FILTER (WHERE status = 'added') AS added, count(*) FILTER (WHERE status = 'removed') AS removed, count(*) FILTER (WHERE status = 'changed') AS changed, count(*) FILTER (WHERE status IN ('removed', 'changed')) AS destructive FROM d")
def schema_change_counts(spark, sf_dir):
    base, head, renames = _schema(spark, sf_dir)
    return Review({"base_schema_columns": base, "schema_columns": head, "table_renames": renames}).schema_change_counts()


RESOURCES = "SELECT CAST(s_suppkey AS STRING) AS id, 'tf' AS tool, CAST(s_nationkey AS STRING) AS stack, 'k' AS kind, s_name AS address FROM {supplier} WHERE "
ATTRIBUTES = "SELECT CAST(s_suppkey AS STRING) AS id, CASE WHEN n = 0 THEN 'name' ELSE 'nation' END AS name, CASE WHEN n = 0 THEN s_name ELSE CAST(s_nationkey AS STRING) END AS value FROM {supplier}, (SELECT 0 AS n UNION ALL SELECT 1) x WHERE "


@query("""
SELECT CASE WHEN s_suppkey % 6 > 0 THEN CAST(s_suppkey AS VARCHAR) END AS before_id, CASE WHEN s_suppkey % 5 > 0 THEN CAST(s_suppkey AS VARCHAR) END AS after_id, CASE WHEN s_suppkey % 5 = 0 THEN 'destroy' WHEN s_suppkey % 6 = 0 THEN 'create' ELSE 'update' END AS action
FROM supplier WHERE (s_suppkey % 5 = 0) <> (s_suppkey % 6 = 0) OR s_suppkey % 5 > 0 AND s_suppkey % 6 > 0 AND s_suppkey % 7 = 0
""")
def infra_changes(spark, sf_dir):
    of = lambda text, condition: sql(spark, sf_dir, text + condition, "supplier")
    changed = of(ATTRIBUTES, "s_suppkey % 5 > 0").withColumn("value", F.when((F.col("id").cast("long") % 7 == 0) & (F.col("name") == "name"), F.concat("value", F.lit("!"))).otherwise(F.col("value")))
    tables = {"base_resources": of(RESOURCES, "s_suppkey % 6 > 0"), "resources": of(RESOURCES, "s_suppkey % 5 > 0"), "base_attributes": of(ATTRIBUTES, "s_suppkey % 6 > 0"), "attributes": changed, "resource_moves": spark.createDataFrame([], "before_id string, after_id string")}
    return Review(tables).get_infra_changes()


ENDPOINTS = "SELECT {0} || '/' || CAST(o_orderkey AS STRING) AS id, CASE WHEN o_orderkey % 9 = 0 THEN 'action' ELSE 'http' END AS kind, substr(o_orderpriority, 1, 1) AS method, {0} AS path, 'h' || CAST(o_orderkey AS STRING) AS handler, array({1}) AS auth FROM {{orders}} WHERE {2}"


@query("""
SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'b' ELSE 'a' END || '/' || o_orderkey AS id, 'moved' AS status, 'a/' || o_orderkey AS before_id, CASE WHEN o_orderkey % 3 = 0 THEN 'path,auth' ELSE 'path' END AS aspects, o_orderkey % 9 > 0 OR o_orderkey % 3 = 0 AS breaking FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 8 > 0 AND o_orderkey % 7 > 0
UNION ALL SELECT 'a/' || o_orderkey, 'changed', 'a/' || o_orderkey, 'auth', true FROM orders WHERE o_orderkey % 5 > 0 AND o_orderkey % 3 = 0 AND o_orderkey % 8 > 0 AND o_orderkey % 7 > 0
UNION ALL SELECT 'a/' || o_orderkey, 'removed', 'a/' || o_orderkey, '', true FROM orders WHERE o_orderkey % 8 > 0 AND o_orderkey % 7 = 0
UNION ALL SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'b' ELSE 'a' END || '/' || o_orderkey, 'added', NULL, '', false FROM orders WHERE o_orderkey % 8 = 0 AND o_orderkey % 7 > 0
""")
def api_changes(spark, sf_dir):
    base = sql(spark, sf_dir, ENDPOINTS.format("'a'", "'user'", "o_orderkey % 8 > 0"), "orders")
    head = sql(spark, sf_dir, ENDPOINTS.format("CASE WHEN o_orderkey % 5 = 0 THEN 'b' ELSE 'a' END", "CASE WHEN o_orderkey % 3 = 0 THEN 'admin' ELSE 'user' END", "o_orderkey % 7 > 0"), "orders")
    return Review({"base_endpoints": base, "endpoints": head}).get_api_changes()


@query("""
WITH b AS (SELECT c_name AS name, 'read' AS part, 'k' AS key, c_mktsegment AS value FROM customer WHERE c_custkey % 4 > 0 UNION ALL SELECT c_name, 'set', 'k', 'v' FROM customer WHERE c_custkey % 6 > 0), h AS (SELECT c_name AS name, 'read' AS part, 'k' AS key, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS value FROM customer UNION ALL SELECT c_name, 'set', 'k', 'v' FROM customer WHERE c_custkey % 7 > 0),
j AS (SELECT coalesce(b.name, h.name) AS name, coalesce(b.part, h.part) AS part, b.value AS x, h.value AS y FROM b FULL JOIN h ON b.name = h.name AND b.part = h.part AND b.key = h.key),
g AS (SELECT name, count(x) AS nb, count(y) AS nh, count(*) FILTER (WHERE part = 'read' AND x IS DISTINCT FROM y) AS read, CAST(0 AS BIGINT) AS decl, count(*) FILTER (WHERE part = 'set' AND x IS DISTINCT FROM y) AS "set" FROM j GROUP BY 1)
SELECT name, read, decl, "set", CASE WHEN nb = 0 THEN 'new' WHEN nh = 0 THEN 'gone' ELSE 'changed' END AS status FROM g WHERE nb = 0 OR nh = 0 OR read + "set" > 0
""")
def env_change_list(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    fact = lambda df, part, value: df.select(F.col("c_name").alias("name"), F.lit(part).alias("part"), F.lit("k").alias("key"), value.alias("value"))
    base = fact(customers.where("c_custkey % 4 > 0"), "read", F.col("c_mktsegment")).union(fact(customers.where("c_custkey % 6 > 0"), "set", F.lit("v")))
    head = fact(customers, "read", F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.col("c_mktsegment"))).union(fact(customers.where("c_custkey % 7 > 0"), "set", F.lit("v")))
    return Review({"base_variable_facts": base, "variable_facts": head}).get_env_changes()


# --- the listings ----------------------------------------------------------------------------------------------


def _facade(spark, sf_dir) -> Review:
    """Orders as findings of customers, parts as changed files and endpoints, suppliers as resources and tables, nations as repositories."""
    orders, parts, suppliers = (table(spark, sf_dir, n) for n in ("orders", "part", "supplier"))
    findings = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("target"), F.col("o_orderpriority").alias("component"), F.col("o_orderstatus").alias("severity"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("resolved_at"), F.array().cast("array<string>").alias("responses"))
    files = parts.select(F.col("p_size").alias("target"), F.col("p_name").alias("file"), F.col("p_partkey").alias("additions"), (F.col("p_partkey") % 7).alias("deletions"), F.lit("").alias("patch"))
    return Review({
        "findings": findings, "changed_files": files, "component_files": parts.groupBy(F.col("p_name").alias("file")).agg(F.min("p_type").alias("component")),
        "endpoints": parts.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("kind"), F.col("p_name").alias("path"), F.col("p_type").alias("handler")),
        "resources": suppliers.select(F.col("s_name").alias("id"), (F.col("s_suppkey") % 3).cast("string").alias("tool"), F.concat(F.lit("a."), F.col("s_nationkey")).alias("address")),
        "variables": suppliers.select(F.col("s_name").alias("name"), F.array((F.col("s_suppkey") % 3).cast("string")).alias("tags")), "schema_tables": suppliers.select(F.col("s_name").alias("table"), F.col("s_nationkey").alias("database")),
        "edges": edges(spark, sf_dir), "repos": table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("git").alias("provider"), F.lit("main").alias("default_branch"), F.lit(None).cast("string").alias("url")),
    })


@query("SELECT n_nationkey AS id, n_name AS name, 'git' AS provider, 'main' AS default_branch, CAST(NULL AS VARCHAR) AS url FROM nation")
def list_repos(spark, sf_dir):
    return _facade(spark, sf_dir).list_repos()


@query("SELECT o_custkey AS target, count(*) AS findings, count(*) FILTER (WHERE o_orderstatus <> 'F') AS open FROM orders GROUP BY 1")
def list_reviews(spark, sf_dir):
    return _facade(spark, sf_dir).list_reviews()


@query("SELECT o_orderkey AS id, o_orderpriority AS component FROM orders WHERE o_custkey = 7 AND o_orderstatus <> 'F'")
def get_review(spark, sf_dir):
    return _facade(spark, sf_dir).get_review(7).select("id", "component")


@query("WITH c AS (SELECT p_name, min(p_type) AS component FROM part GROUP BY 1) SELECT c.component, count(*) AS files, CAST(sum(p_partkey) AS BIGINT) AS additions, CAST(sum(p_partkey % 7) AS BIGINT) AS deletions FROM part JOIN c ON c.p_name = part.p_name WHERE p_size = 9 GROUP BY 1")
def changed_components(spark, sf_dir):
    return _facade(spark, sf_dir).changed_components(9)


@query("WITH c AS (SELECT p_name, min(p_type) AS component FROM part GROUP BY 1) SELECT part.p_name AS file, p_partkey AS additions FROM part JOIN c ON c.p_name = part.p_name WHERE p_size = 9 AND component = 'ECONOMY'")
def component_diff(spark, sf_dir):
    return _facade(spark, sf_dir).component_diff(9, "ECONOMY").select("file", "additions")


@query("SELECT p_name AS file, p_partkey AS additions FROM part WHERE p_size = 9 AND p_name = 'red bolt'")
def file_diff(spark, sf_dir):
    return _facade(spark, sf_dir).file_diff(9, "red bolt").select("file", "additions")


@query("SELECT p_partkey AS id FROM part WHERE p_brand = 'Brand#3' AND (contains(lower(p_name), 'e') OR contains(lower(p_type), 'e'))")
def list_endpoints(spark, sf_dir):
    return _facade(spark, sf_dir).list_endpoints(kind="Brand#3", query="E").select("id")


@query("SELECT s_name AS id FROM supplier WHERE s_suppkey % 3 = 1 AND (contains(lower(s_name), '1') OR contains('a.' || s_nationkey, '1'))")
def list_infra(spark, sf_dir):
    return _facade(spark, sf_dir).list_infra(tool="1", query="1").select("id")


@query("SELECT s_name AS name FROM supplier WHERE s_suppkey % 3 = 2")
def list_env(spark, sf_dir):
    return _facade(spark, sf_dir).list_env(tag="2", query="supp").select("name")


@query("SELECT s_name AS \"table\" FROM supplier WHERE s_nationkey = 4 OR s_nationkey = 4 AND contains(lower(s_name), 'supp')")
def list_tables(spark, sf_dir):
    return _facade(spark, sf_dir).list_tables(database=4, query="supp").select("table")


@query(f"WITH {EDGES_SQL} SELECT src, dst FROM edges WHERE dst = 5 UNION ALL SELECT src, dst FROM edges WHERE src = 4")
def callers_and_callees(spark, sf_dir):
    facade = _facade(spark, sf_dir)
    return facade.callers(5).union(facade.callees(4)).select("src", "dst")


@query("SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey = 3 THEN 1 ELSE 0 END AS BIGINT) AS responses FROM orders")
def respond_to_finding(spark, sf_dir):
    return _facade(spark, sf_dir).respond_to_finding(3, "fixing").select("id", F.size("responses").cast("long").alias("responses"))


# --- smaller ones ----------------------------------------------------------------------------------------------


@query("""
WITH c AS (SELECT l_partkey AS id, CASE l_returnflag WHEN 'R' THEN 'signature' WHEN 'A' THEN 'removed' ELSE 'body' END AS status FROM lineitem GROUP BY 1, 2), e AS (SELECT p_partkey AS id, p_brand AS file, p_name AS name FROM part WHERE p_size > 10), s AS (SELECT DISTINCT p_brand AS file, p_name AS name FROM part WHERE p_type = 'SMALL')
SELECT c.id, c.status FROM c JOIN e ON e.id = c.id WHERE status = 'signature' OR status = 'removed' AND (e.file, e.name) NOT IN (SELECT file, name FROM s)
""")
def contract_changes(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("file"), F.col("p_name").alias("name"), "p_size", "p_type")
    status = F.when(F.col("l_returnflag") == "R", "signature").when(F.col("l_returnflag") == "A", "removed").otherwise("body")
    changes = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), status.alias("status")).distinct()
    return review.contract_changes(changes, parts.where("p_size > 10").select("id", "file", "name"), parts.where("p_type = 'SMALL'").select("file", "name").distinct()).select("id", "status")


@query("SELECT DISTINCT l_orderkey AS file, l_partkey AS source, l_returnflag AS name FROM lineitem WHERE l_linenumber = 3 EXCEPT SELECT l_orderkey, l_partkey, l_returnflag FROM lineitem WHERE l_quantity > 25")
def new_dead_imports(spark, sf_dir):
    imports = lambda condition: table(spark, sf_dir, "lineitem").where(condition).select(F.col("l_orderkey").alias("file"), F.col("l_partkey").alias("source"), F.col("l_returnflag").alias("name")).distinct()
    return review.new_dead_imports(imports("l_quantity > 25"), imports("l_linenumber = 3"))


@query(f"""
WITH {EDGES_SQL}, pairs AS (SELECT a.p_brand AS src_owner, b.p_brand AS dst_owner, src FROM edges JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE a.p_brand <> b.p_brand), b AS (SELECT DISTINCT src_owner, dst_owner FROM pairs WHERE src % 3 > 0), h AS (SELECT DISTINCT src_owner, dst_owner FROM pairs WHERE src % 4 > 0)
SELECT *, 'added' AS change FROM (SELECT * FROM h EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM b EXCEPT SELECT * FROM h)
""")
def component_edge_changes(spark, sf_dir):
    e = edges(spark, sf_dir)
    return review.component_edge_changes(e.where("src % 3 > 0"), e.where("src % 4 > 0"), owners(spark, sf_dir))


@query("""
SELECT l_orderkey AS id, l_partkey AS file, CAST(CASE WHEN l_linenumber < 7 THEN l_linenumber END AS BIGINT) AS line, CASE WHEN l_linenumber = 7 THEN 'no-line' WHEN l_partkey IN (SELECT l_partkey FROM lineitem x WHERE x.l_linenumber = l.l_linenumber AND x.l_quantity > 48) THEN 'inline' WHEN l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48) THEN 'line-not-in-diff' ELSE 'file-not-in-diff' END AS placement FROM lineitem l WHERE l_returnflag = 'R'
""")
def placed_comments(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    findings = lines.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("file"), F.when(F.col("l_linenumber") < 7, F.col("l_linenumber")).cast("long").alias("line"))
    shown = lines.where("l_quantity > 48").select(F.col("l_partkey").alias("file"), F.col("l_linenumber").cast("long").alias("line"))
    return review.placed_comments(findings, shown, shown.select("file"))


@query("SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]{2,}')) AS identifier FROM documents")
def diff_identifiers(spark, sf_dir):
    return review.diff_identifiers(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")), "doc_id")


@query("SELECT o_orderkey, CASE WHEN b IS NULL AND a IS NULL THEN NULL WHEN b = 'failed' AND a = 'failed' THEN 'failed' WHEN b IS NULL THEN CASE WHEN a = 'failed' THEN 'failed' ELSE 'new' END WHEN a IS NULL THEN 'removed' WHEN a = 'failed' THEN 'breaks' WHEN b = 'failed' THEN 'recovers' WHEN a = b THEN 'same' ELSE 'different' END AS outcome FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'failed' WHEN 1 THEN NULL ELSE o_orderstatus END AS b, CASE o_orderkey % 5 WHEN 0 THEN 'failed' WHEN 1 THEN NULL WHEN 2 THEN 'x' ELSE o_orderstatus END AS a FROM orders)")
def outcomes(spark, sf_dir):
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    before, after = F.when(k % 4 == 0, "failed").when(k % 4 != 1, status), F.when(k % 5 == 0, "failed").when(k % 5 == 2, "x").when(k % 5 != 1, status)
    return table(spark, sf_dir, "orders").select("o_orderkey", review.outcome(before, after).alias("outcome"))


@query("SELECT o_orderkey AS id, o_orderdate AS posted_at FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o.o_orderkey, min(l.o_orderdate) FROM orders o JOIN orders l ON l.o_custkey = o.o_custkey AND l.o_orderkey % 2 = 0 WHERE o.o_orderkey % 2 = 1 GROUP BY 1")
def posted_records(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("fingerprint"), F.col("o_orderdate").alias("posted_at"))
    return review.posted_record(orders.select("id", "fingerprint"), orders.where("id % 2 = 0").withColumnRenamed("id", "finding_id"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey % 3 > 0 OR (o_custkey, o_orderpriority) IN (SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'P')")
def swept_findings(spark, sf_dir):
    findings = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("target"), F.col("o_orderpriority").alias("component"), "o_orderstatus")
    return review.swept(findings, findings.where("target % 3 = 0").select("target").distinct(), findings.where("o_orderstatus = 'P'").select("target", "component").distinct()).select("o_orderkey")


@query("WITH m AS (SELECT p_partkey AS path, p_size AS line, p_name AS content FROM part WHERE contains(p_name, 'bolt')) SELECT *, (SELECT count(*) FROM m) AS total FROM (SELECT * FROM m ORDER BY path, line LIMIT 60)")
def code_search(spark, sf_dir):
    return review.code_search(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("line"), F.col("p_name").alias("content")), "bolt")


@query("""
WITH l AS (SELECT l_returnflag AS kind, l_partkey AS text, l_suppkey AS target, l_linenumber AS line, l_orderkey * 100000 + l_suppkey * 10 + l_linenumber AS ord FROM lineitem), f AS (SELECT kind, text, arg_min(target, ord) AS target FROM l GROUP BY 1, 2)
SELECT l.kind, l.text, l.target, string_agg(DISTINCT CAST(line AS VARCHAR), ',' ORDER BY CAST(line AS VARCHAR)) AS lines FROM l JOIN f ON f.kind = l.kind AND f.text = l.text AND f.target = l.target GROUP BY 1, 2, 3
""")
def link_index(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("kind"), F.col("l_partkey").alias("text"), F.col("l_suppkey").alias("target"), F.col("l_linenumber").alias("line"), (F.col("l_orderkey") * 100000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return review.link_index(rows).withColumn("lines", F.array_join(F.transform("lines", lambda x: x.cast("string")), ","))


@query("SELECT l_partkey AS id, CASE WHEN bool_or(l_returnflag = 'R') AND bool_or(l_returnflag = 'A') THEN 'both' WHEN bool_or(l_returnflag = 'A') THEN 'write' WHEN bool_or(l_returnflag = 'R') THEN 'read' END AS access FROM lineitem GROUP BY 1")
def table_access(spark, sf_dir):
    folded = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("r"), F.bool_or(F.col("l_returnflag") == "A").alias("w"))
    return folded.select("id", review.access(F.col("r"), F.col("w")).alias("access"))


@query("SELECT p_partkey AS id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS uuid, array_to_string(string_split(p_name, ' '), ',') || ',x2' AS words FROM (SELECT *, sha1(p_name) AS h FROM part)")
def identities_and_words(spark, sf_dir):
    camel = F.concat(F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")), F.lit("_x2"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.stable_uuid(F.col("p_name")).alias("uuid"), F.array_join(text.words(camel), ",").alias("words"))


@query("SELECT p_partkey AS id, 'a/' || p_type || '/' || p_name AS normal, 'gz' AS extension, CAST(CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS shared, '/v1/' || p_type AS joined, 'x/' || p_type AS image, CASE WHEN p_size % 2 = 0 THEN 't' || p_size END AS tag, CAST(least(p_size, 20) AS BIGINT) AS first, CAST(greatest(p_size, 20) AS BIGINT) AS last FROM part")
def path_parts(spark, sf_dir):
    even = F.col("p_size") % 2 == 0
    lines, image = paths.line_range(F.concat(F.lit("L"), "p_size", F.lit("-20"))), paths.image_parts(F.concat(F.lit("x/"), "p_type", F.when(even, F.concat(F.lit(":t"), "p_size")).otherwise("")))
    shared = paths.shared_depth(F.concat(F.lit("a/"), F.when(even, F.col("p_type")).otherwise("z"), F.lit("/f")), F.concat(F.lit("a/"), "p_type", F.lit("/g")))
    return longs(table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), paths.normal_path(F.concat(F.lit("./a/b/../"), "p_type", F.lit("//"), "p_name")).alias("normal"), paths.extension(F.concat("p_name", F.lit("/x.tar.GZ"))).alias("extension"), shared.alias("shared"),
        paths.join_path(F.lit("/v1/"), F.concat(F.lit("/"), "p_type", F.lit("/"))).alias("joined"), image["image"].alias("image"), image["tag"].alias("tag"), lines["first"].alias("first"), lines["last"].alias("last"),
    ), "shared", "first", "last")


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS author_day, CAST(o_orderdate - INTERVAL 5 HOUR AS DATE) AS local_day, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INTEGER) AS later, '1,' || o_orderkey % 7 || ',0,0' AS version, CASE WHEN o_orderkey % 9 >= 3 THEN CAST(o_orderkey % 9 - 2 AS BIGINT) END AS n FROM orders")
def dates_and_versions(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders")
    return longs(rows.select(
        k.alias("id"), numbers.author_day(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T23:00:00-07:00"))).alias("author_day"), numbers.local_day(F.col("o_orderdate").cast("timestamp"), "-05:00").alias("local_day"),
        F.date_add(F.to_date("o_orderdate"), (k % 40).cast("int")).alias("later"), F.array_join(numbers.version_key(F.concat(F.lit("v1."), k % 7)), ",").alias("version"), F.nullif(F.size(F.coalesce(numbers.range_list(F.lit(3), (k % 9).cast("int")), F.array().cast("array<int>"))), F.lit(0)).alias("n"),
    ), "n")


@query("""
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'new' END ELSE o_orderpriority END AS note, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'P2' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 4 = 0 OR o_orderdate > TIMESTAMP '1997-01-01'
""")
def patched_and_alive(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    base = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("note"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate")).alias("until"))
    even = F.col("id") % 2 == 0
    patch = base.where("id % 3 = 0").select("id", F.when(~even, "new").alias("note"), F.when(even, "P2").alias("status"), F.when(even, F.array(F.lit("note"))).otherwise(F.array().cast("array<string>")).alias("cleared"))
    return relational.keep_alive(relational.patch_merge(base, patch, ["id"]), "until", F.expr("timestamp_ntz'1997-01-01'")).drop("until")
