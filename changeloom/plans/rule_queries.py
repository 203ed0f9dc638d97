"""Rules over facts and differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeloom.operators import rules
from changeloom.plans.registry import query, table
from changeloom.plans.standins import longs


@query("""
WITH f AS (SELECT o_orderkey AS target, o_orderstatus <> 'F' AS is_pr, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderpriority END AS description, o_custkey % 3 AS n_issues FROM orders),
l AS (SELECT l_orderkey AS target, count(*) AS n_files, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n_lines, count(*) FILTER (WHERE l_returnflag = 'R') AS touched FROM lineitem GROUP BY 1)
SELECT f.target, item_id, CASE kind WHEN 'description' THEN CASE WHEN NOT is_pr THEN 'not_applicable' WHEN length(trim(description)) >= lim THEN 'pass' ELSE 'fail' END
    WHEN 'linked-issue' THEN CASE WHEN NOT is_pr THEN 'not_applicable' WHEN n_issues > 0 THEN 'pass' ELSE 'fail' END
    WHEN 'max-files' THEN CASE WHEN n_files <= lim THEN 'pass' ELSE 'fail' END WHEN 'max-lines' THEN CASE WHEN n_lines <= lim THEN 'pass' ELSE 'fail' END
    ELSE CASE WHEN touched = 0 THEN 'pass' ELSE 'fail' END END AS status
FROM f JOIN l ON f.target = l.target, (VALUES (1, 'description', 6), (2, 'linked-issue', 0), (3, 'max-files', 4), (4, 'max-lines', 120), (5, 'protected-paths', 0)) i(item_id, kind, lim)
""")
def checklist_eval(spark, sf_dir):
    items = [(1, "description", 6), (2, "linked-issue", None), (3, "max-files", 4), (4, "max-lines", 120), (5, "protected-paths", None)]
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("target")).agg(F.count("*").alias("n_files"), F.sum(F.col("l_quantity").cast("long")).alias("n_lines"), F.count_if(F.col("l_returnflag") == "R").alias("touched"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("target"), (F.col("o_orderstatus") != "F").alias("is_pr"), F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.col("o_orderpriority")).alias("description"), (F.col("o_custkey") % 3).alias("n_issues"))
    return rules.checklist(items, orders.join(lines, "target")).select("target", "item_id", "status")


@query("""
WITH b AS (SELECT p_brand AS id, p_type AS name, CAST(min(p_size) AS VARCHAR) AS type, bool_or(p_size > 25) AS required FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1, 2), h AS (SELECT p_brand AS id, p_type AS name, CAST(min(p_size) AS VARCHAR) AS type, bool_or(p_size > 25) AS required FROM part WHERE p_partkey % 5 <> 0 GROUP BY 1, 2),
j AS (SELECT coalesce(b.id, h.id) AS id, coalesce(b.name, h.name) AS name, b.id IS NULL AS added, h.id IS NULL AS gone, b.type AS bt, h.type AS ht, b.required AS br, h.required AS hr FROM b FULL JOIN h ON b.id = h.id AND b.name = h.name)
SELECT id, name, aspect, CASE WHEN added THEN 'added' WHEN gone THEN 'removed' ELSE 'changed' END AS status,
    CASE WHEN aspect = 'response' THEN coalesce(gone OR (NOT added AND (bt <> ht OR (br AND NOT hr))), false) ELSE coalesce((added AND hr) OR (NOT added AND NOT gone AND (bt <> ht OR (hr AND NOT br))), false) END AS breaking
FROM j, (SELECT unnest(['request', 'response']) AS aspect) WHERE added OR gone OR bt IS DISTINCT FROM ht OR br IS DISTINCT FROM hr
""")
def endpoint_field_deltas(spark, sf_dir):
    side = lambda n: table(spark, sf_dir, "part").where(F.col("p_partkey") % n != 0).groupBy(F.col("p_brand").alias("id"), F.col("p_type").alias("name")).agg(F.min("p_size").cast("string").alias("type"), F.bool_or(F.col("p_size") > 25).alias("required"))
    b, h = side(3), side(5)
    return rules.field_deltas(b, h, ["id"], "request").unionByName(rules.field_deltas(b, h, ["id"], "response"))


@query("""
WITH b AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN ['session'] ELSE [] END AS auth FROM supplier WHERE s_suppkey % 4 <> 0), h AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN ['session'] ELSE [] END AS auth FROM supplier),
f AS (SELECT CASE WHEN b.id IS NULL AND len(h.auth) = 0 THEN 'new-endpoint-open' WHEN len(b.auth) > 0 AND len(h.auth) = 0 THEN 'auth-removed' END AS rule, h.id FROM h LEFT JOIN b ON h.id = b.id),
r AS (SELECT rule, id, row_number() OVER (PARTITION BY rule ORDER BY id) AS rn, count(*) OVER (PARTITION BY rule) AS c FROM f WHERE rule IS NOT NULL)
SELECT rule, CAST(id AS VARCHAR) AS subject, CAST(1 AS BIGINT) AS n FROM r WHERE rn <= 6 UNION ALL SELECT rule, '(others)', max(c) - 6 FROM r GROUP BY rule HAVING max(c) > 6
""")
def endpoint_auth(spark, sf_dir):
    auth = lambda n: F.when(F.col("s_suppkey") % n == 0, F.array(F.lit("session"))).otherwise(F.array().cast("array<string>")).alias("auth")
    suppliers = table(spark, sf_dir, "supplier")
    b = suppliers.where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("id"), auth(3))
    out = rules.auth_findings(b, suppliers.select(F.col("s_suppkey").alias("id"), auth(5)))
    return longs(out, "n")


@query("""
WITH o AS (SELECT p_brand AS database, p_partkey AS ord, CASE p_partkey % 8 WHEN 0 THEN 'drop_table' WHEN 1 THEN 'drop_column' WHEN 2 THEN 'rename_table' WHEN 3 THEN 'rename_column' WHEN 4 THEN 'add_column' WHEN 5 THEN 'alter_type' WHEN 6 THEN 'create_index' ELSE 'add_foreign_key' END AS op, p_type AS "table", p_name AS "column", p_size AS s FROM part)
SELECT database, ord, CASE op WHEN 'drop_table' THEN 'drop-table' WHEN 'drop_column' THEN 'drop-column' WHEN 'rename_table' THEN 'rename-table' WHEN 'rename_column' THEN 'rename-column' WHEN 'add_column' THEN 'not-null-no-default' WHEN 'alter_type' THEN 'type-narrowing' WHEN 'create_index' THEN 'index-not-concurrent' ELSE 'fk-no-index' END AS rule,
    "table", CASE WHEN op = 'add_foreign_key' THEN 'a,b' ELSE "column" END AS "column"
FROM o WHERE CASE op WHEN 'add_column' THEN s > 10 AND s % 5 <> 0 WHEN 'alter_type' THEN s > 10 AND s % 2 = 0 WHEN 'create_index' THEN s > 10 AND s % 2 = 1 WHEN 'add_foreign_key' THEN s % 3 <> 0 ELSE s > 10 END
""")
def migration_findings(spark, sf_dir):
    part, s, i = table(spark, sf_dir, "part"), F.col("p_size"), F.col("p_partkey") % 8
    names = F.array(*map(F.lit, ["drop_table", "drop_column", "rename_table", "rename_column", "add_column", "alter_type", "create_index", "add_foreign_key"]))
    # A table of its own for each operation, so that indexes meet one foreign key each.
    ops = part.select(
        F.col("p_brand").alias("database"), F.col("p_partkey").alias("ord"), F.element_at(names, (i + 1).cast("int")).alias("op"), F.concat_ws("#", "p_type", F.col("p_partkey").cast("string")).alias("table"), F.col("p_name").alias("column"),
        F.when(s % 2 == 0, "integer").otherwise("bigint").alias("type"), F.lit("bigint").alias("old_type"), F.lit(False).alias("nullable"), F.when(s % 5 == 0, "0").alias("default"),
        (s % 2 == 0).alias("concurrently"), (s <= 10).alias("created_here"), F.array(F.lit("a"), F.lit("b")).alias("columns"),
    )
    indexes = part.select(
        F.col("p_brand").alias("database"), F.concat_ws("#", "p_type", F.col("p_partkey").cast("string")).alias("table"), F.when(s % 3 == 0, F.array(*map(F.lit, "abc"))).otherwise(F.array(F.lit("b"))).alias("columns"))
    return rules.migration_findings(ops, indexes).select("database", "ord", "rule", F.split_part("table", F.lit("#"), F.lit(1)).alias("table"), "column")


@query("""
WITH r AS (SELECT event_type AS name, user_id, event_id AS line FROM events WHERE event_id % 7 <> 0 AND event_type <> 'login')
SELECT name, 'app/u' || CAST(user_id % 20 AS VARCHAR) || '/f' || CAST(user_id AS VARCHAR) AS file, line, CASE WHEN user_id % 20 < 6 THEN 'maybe-set' WHEN name IN ('click', 'view') THEN 'not-set' ELSE 'undeclared' END AS gap FROM r WHERE user_id % 20 >= 3
""")
def env_gaps(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), "user_id", F.col("event_id").alias("line"))
    folder = lambda c: F.concat(F.lit("app/u"), (c % 20).cast("string"))
    reads = e.select("name", F.concat(folder(F.col("user_id")), F.lit("/f"), F.col("user_id").cast("string")).alias("file"), "line", F.when(F.col("line") % 7 == 0, "x").alias("fallback"), F.lit(False).alias("test"))
    names = e.select("name").distinct()
    sets = names.select("name", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i")).select("name", folder(F.col("i")).alias("scope"), (F.col("i") >= 3).alias("ref"))
    decls = names.where("name IN ('click', 'view')").select("name", F.lit("app").alias("scope"))
    return rules.env_gaps(reads, decls, sets, platform=["login"])
