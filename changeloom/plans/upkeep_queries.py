"""Stored tables kept up, and imports resolved, over the given tables in their roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeloom.functions import names
from changeloom.operators import resolve, upkeep
from changeloom.plans.registry import query, table
from changeloom.plans.standins import FILES, longs, sql, told

STORED = "SELECT o_orderkey AS id, o_custkey AS target, o_orderstatus AS category, o_orderpriority AS note FROM {orders} WHERE o_orderkey % 10 <> 0"
INCOMING = "SELECT o_orderkey AS id, o_custkey AS target, o_orderstatus AS category, CAST(NULL AS STRING) AS note FROM {orders} WHERE o_orderkey % 7 <> 0 AND o_orderstatus = 'P'"


def _stored(spark, sf_dir):
    return sql(spark, sf_dir, STORED, "orders"), sql(spark, sf_dir, INCOMING, "orders")


@query(f"WITH o AS ({told(STORED)}), n AS ({told(INCOMING)}) SELECT * FROM o WHERE (target, category) NOT IN (SELECT target, category FROM n) UNION ALL SELECT * FROM n")
def replace_slots(spark, sf_dir):
    old, new = _stored(spark, sf_dir)
    return upkeep.replace_slots(old, new, new, ["target", "category"])


@query(f"WITH o AS ({told(STORED)}), n AS ({told(INCOMING)}) SELECT n.id, n.target, n.category, coalesce(o.note, n.note) AS note FROM n LEFT JOIN o ON o.id = n.id")
def sync_by_id(spark, sf_dir):
    return upkeep.sync_by_id(*_stored(spark, sf_dir), ["id"], ["note"])


@query("""
SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN p_size > 10 THEN p_brand END, CASE WHEN s_nationkey < 12 THEN n_name END, CAST(l_suppkey AS VARCHAR)) AS component
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey
""")
def relinked_findings(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("file"), F.col("l_suppkey").cast("string").alias("component"))
    owners = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("file"), F.col("p_brand").alias("owner"))
    supplier, nation = table(spark, sf_dir, "supplier").where("s_nationkey < 12"), table(spark, sf_dir, "nation")
    parents = supplier.join(nation, F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").cast("string").alias("component"), F.col("n_name").alias("parent"))
    return upkeep.relinked(rows, owners, parents).drop("file")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def without_children(spark, sf_dir):
    children = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return upkeep.without_children(table(spark, sf_dir, "customer"), children, "c_custkey").select("c_custkey")


@query("SELECT l_orderkey, CAST(max(l_linenumber) + 1 AS BIGINT) AS \"next\" FROM lineitem GROUP BY 1")
def next_sequence(spark, sf_dir):
    return longs(upkeep.next_sequence(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber"), "next")


LOG = "SELECT user_id AS job, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS seq, event_id AS line FROM {events} WHERE event_type <> 'view'"


@query(f"""
WITH l AS ({told(LOG)}), m AS (SELECT job, max(seq) AS last FROM l GROUP BY 1)
SELECT * FROM l UNION ALL SELECT user_id, coalesce(last, 0) + row_number() OVER (PARTITION BY user_id ORDER BY event_id), event_id FROM events LEFT JOIN m ON job = user_id WHERE event_type = 'view'
""")
def appended_logs(spark, sf_dir):
    lines = table(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("user_id").alias("job"), F.col("event_id").alias("line"))
    return upkeep.appended(sql(spark, sf_dir, LOG, "events"), lines, ["job"], "line")


@query(f"WITH l AS ({told(LOG)}), n AS (SELECT *, count(*) OVER (PARTITION BY job) AS n FROM l) SELECT job, seq, line FROM n WHERE seq - 1 BETWEEN n - 5 AND n - 2")
def log_tails(spark, sf_dir):
    return upkeep.log_slice(sql(spark, sf_dir, LOG, "events"), ["job"], -5, -2)


@query("""
WITH h AS (SELECT o_custkey AS grp, o_orderpriority AS pick, count(*) AS uses, max(o_orderdate) AS last_used FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2 UNION ALL SELECT o_custkey, o_orderpriority, 1, o_orderdate FROM orders WHERE o_orderstatus <> 'F'),
s AS (SELECT grp, pick, CAST(sum(uses) AS BIGINT) AS uses, max(last_used) AS last_used FROM h GROUP BY 1, 2)
SELECT grp, pick, uses, last_used FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY last_used DESC, pick) AS n FROM s) WHERE n <= 3
""")
def picks_recorded(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderpriority").alias("pick"), F.col("o_orderdate").alias("at"), "o_orderstatus")
    history = rows.where("o_orderstatus = 'F'").groupBy("grp", "pick").agg(F.count("*").alias("uses"), F.max("at").alias("last_used"))
    return upkeep.picks_recorded(history, rows.where("o_orderstatus <> 'F'"), ["grp"], "pick", 3)


@query("SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) > 70 OR json_extract_string(props, '$.k') IS NULL")
def unexpired(spark, sf_dir):
    return upkeep.unexpired(table(spark, sf_dir, "events"), F.lit(70.0), "props", "$.k").select("event_id")


@query("SELECT DISTINCT l_partkey AS blob, l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 25) AS cached FROM lineitem")
def parse_cache(spark, sf_dir):
    blobs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("blob"))
    known, fresh = upkeep.to_parse(blobs, table(spark, sf_dir, "part").where("p_size < 25").select(F.col("p_partkey").alias("blob")))
    return known.select("blob", F.lit(True).alias("cached")).unionByName(fresh.select("blob", F.lit(False).alias("cached")))


@query("""
SELECT o_orderkey AS id FROM (SELECT *, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS finished FROM orders) WHERE finished IS NULL
UNION ALL SELECT id FROM (SELECT o_orderkey AS id, o_orderdate AS finished, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders WHERE o_orderstatus <> 'P') WHERE n <= 3 AND finished >= TIMESTAMP '1997-01-01'
""")
def retained_jobs(spark, sf_dir):
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("finished"))
    return upkeep.retained(jobs, ["o_custkey"], 3, "finished", F.expr("timestamp_ntz'1997-01-01'")).select("id")


@query("SELECT l_orderkey * 10 + l_linenumber AS pos, l_partkey AS p_partkey, p_brand FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) l LEFT JOIN part p ON p.p_partkey = l.l_partkey AND p_size < 30")
def lookups_with_misses(spark, sf_dir):
    asked = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct().select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_partkey").alias("p_partkey"))
    return upkeep.in_asked_order(asked, table(spark, sf_dir, "part").where("p_size < 30").select("p_partkey", "p_brand"), "p_partkey")


@query("""SELECT p_partkey, '{' || '"p_name":"' || p_name || '"' || CASE WHEN p_size > 25 THEN ',"size":' || p_size ELSE '' END || '}' AS packed FROM part""")
def packed_rows(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumn("size", F.when(F.col("p_size") > 25, F.col("p_size")))
    return parts.select("p_partkey", upkeep.packed("p_name", "size").alias("packed"))


@query("SELECT p_partkey FROM part WHERE p_brand IN ('Brand#1', 'Brand#2') AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def listed_but_not(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").where(F.col("p_brand").isin("Brand#1", "Brand#2")).join(used, "p_partkey", "left_anti").select("p_partkey")


# --- imports ---------------------------------------------------------------------------------------------------

PACKAGES = "SELECT DISTINCT '@acme/' || lower(p_brand) AS name, 'packages/' || lower(p_brand) AS dir, CASE WHEN p_brand < 'Brand#2' THEN './main' END AS main FROM {part}"
EXPORTS = "SELECT DISTINCT '@acme/' || lower(p_brand) AS name, './' || lower(p_type) AS key, './lib/' || lower(p_type) || '.ts' AS target FROM {part} WHERE p_size < 20 UNION SELECT DISTINCT '@acme/' || lower(p_brand), './x/*', './deep/*.js' FROM {part}"
SPECS = "SELECT DISTINCT '@acme/' || lower(p_brand) || (CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '/' || lower(p_type) WHEN 2 THEN '/x/' || replace(p_name, ' ', '-') ELSE '/src/' || replace(p_name, ' ', '_') END) AS specifier FROM {part}"
SOURCES = """SELECT DISTINCT 'packages/' || lower(p_brand) || (CASE p_partkey % 5 WHEN 0 THEN '/main.ts' WHEN 1 THEN '/lib/' || lower(p_type) || '.ts' WHEN 2 THEN '/deep/' || replace(p_name, ' ', '-') || '.js' WHEN 3 THEN '/src/' || replace(p_name, ' ', '_') || '/index.tsx' ELSE '/index.js' END) AS path FROM {part}"""
ENDS = "(VALUES " + ", ".join(f"({i}, '{e}')" for i, e in enumerate(resolve.ENDINGS)) + ") e(n, ending)"


@query(rf"""
WITH s AS (SELECT specifier, regexp_extract(specifier, '^(@[^/]+/[^/]+)', 1) AS name, regexp_replace(specifier, '^@[^/]+/[^/]+/?', '') AS sub FROM ({told(SPECS)})), k AS (SELECT s.*, dir, main FROM s JOIN ({told(PACKAGES)}) p ON p.name = s.name), x AS ({told(EXPORTS)}), f AS ({told(SOURCES)}),
c AS (SELECT specifier, 0 AS rank, dir || substr(target, 2) AS base FROM k JOIN x ON x.name = k.name AND x.key = './' || sub WHERE sub <> ''
    UNION ALL SELECT specifier, 1, dir || '/deep/' || substr(sub, 3) || '.js' FROM k WHERE starts_with(sub, 'x/') UNION ALL SELECT specifier, 2, dir || '/' || sub FROM k WHERE sub <> ''
    UNION ALL SELECT specifier, 3, dir || substr(main, 2) FROM k WHERE sub = '' AND main IS NOT NULL UNION ALL SELECT specifier, 4, dir || '/src/index' FROM k WHERE sub = '' UNION ALL SELECT specifier, 5, dir || '/index' FROM k WHERE sub = '')
SELECT specifier, arg_min(path, rank * 100 + n) AS path FROM c, {ENDS} JOIN f ON f.path = base || ending GROUP BY 1
""")
def workspace_imports(spark, sf_dir):
    of = lambda text: sql(spark, sf_dir, text, "part")
    return resolve.workspace_imports(of(SPECS), of(PACKAGES), of(EXPORTS), of(SOURCES))


GO_MODULES = "SELECT DISTINCT 'example.org/' || lower(p_brand) || (CASE WHEN p_size > 40 THEN '/' || lower(p_type) ELSE '' END) AS module, 'go/' || lower(p_brand) || (CASE WHEN p_size > 40 THEN '/nested-' || lower(p_type) ELSE '' END) AS dir FROM {part}"
GO_SPECS = "SELECT DISTINCT 'example.org/' || lower(p_brand) || '/' || lower(p_type) || (CASE WHEN p_partkey % 3 = 0 THEN '/' || replace(p_name, ' ', '/') ELSE '' END) AS spec FROM {part}"
GO_FILES = "SELECT DISTINCT (CASE WHEN p_size % 2 = 0 THEN 'go/' || lower(p_brand) || '/' ELSE 'go/' || lower(p_brand) || '/nested-' END) || lower(p_type) || (CASE WHEN p_partkey % 2 = 0 THEN '/' || replace(p_name, ' ', '/') ELSE '' END) || '/f' || CAST(p_size AS STRING) || '.go' AS path FROM {part}"


@query(f"""
WITH m AS ({told(GO_MODULES)}), s AS ({told(GO_SPECS)}), o AS (SELECT spec, arg_max(module, length(module)) AS module, arg_max(dir, length(module)) AS dir FROM s JOIN m ON spec = module OR starts_with(spec, module || '/') GROUP BY 1)
SELECT spec, path FROM o JOIN ({told(GO_FILES)}) f ON regexp_extract(path, '^(.*)/[^/]*$', 1) = dir || substr(spec, length(module) + 1)
""")
def module_imports(spark, sf_dir):
    of = lambda text: sql(spark, sf_dir, text, "part")
    return resolve.module_imports(of(GO_SPECS), of(GO_MODULES), of(GO_FILES))


FQN_USES = "SELECT DISTINCT lower(p_brand) || '/src/' || (CASE WHEN p_size % 2 = 0 THEN 'main' ELSE 'test' END) || '/' || lower(p_type) || '/F' || CAST(p_size AS STRING) || '.java' AS file, 'com.' || replace(p_name, ' ', '.') AS fqn FROM {part}"
FQN_DECLS = "SELECT DISTINCT lower(p_brand) || '/src/' || (CASE WHEN p_size % 3 = 0 THEN 'main' ELSE 'test' END) || '/' || lower(p_type) || '/D.java' AS file, 'com.' || replace(p_name, ' ', '.') AS fqn FROM {part} WHERE p_size > 20"


@query(f"""
WITH j AS (SELECT u.file, u.fqn, d.file AS path, list_filter(range(1, 5), lambda i: string_split(u.file, '/')[1:i] = string_split(d.file, '/')[1:i]) AS same FROM ({told(FQN_USES)}) u JOIN ({told(FQN_DECLS)}) d ON d.fqn = u.fqn)
SELECT file, fqn, path FROM (SELECT *, row_number() OVER (PARTITION BY file, fqn ORDER BY least(len(same), 4) DESC, path) AS n FROM j) WHERE n = 1
""")
def nearest_declared(spark, sf_dir):
    return resolve.nearest_declared(sql(spark, sf_dir, FQN_USES, "part"), sql(spark, sf_dir, FQN_DECLS, "part"))


PY_USES = "SELECT DISTINCT 'src/' || lower(p_brand) || '/' || lower(p_type) || '/m' || CAST(p_size AS STRING) || '.py' AS file, (CASE p_partkey % 4 WHEN 0 THEN '.' WHEN 1 THEN '..' WHEN 2 THEN lower(p_brand) || '.' ELSE '..' || lower(p_type) || '.' END) || replace(p_name, ' ', '.') AS module FROM {part}"
PY_FILES = "SELECT DISTINCT (CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'src/' END) || lower(p_brand) || '/' || (CASE WHEN p_size % 2 = 0 THEN lower(p_type) || '/' ELSE '' END) || replace(p_name, ' ', '/') || (CASE WHEN p_partkey % 2 = 0 THEN '.py' ELSE '/__init__.py' END) AS path FROM {part}"


@query(f"""
WITH u AS ({told(PY_USES)}), f AS ({told(PY_FILES)}), t AS (SELECT *, length(regexp_extract(module, '^(\\.*)', 1)) AS dots FROM u), b AS (SELECT *, replace(substr(module, dots + 1), '.', '/') AS tail, string_split(file, '/') AS p FROM t),
c AS (SELECT file, module, 0 AS n, array_to_string(p[1:len(p) - dots], '/') || '/' || tail AS base FROM b WHERE dots > 0 UNION ALL SELECT file, module, 0, tail FROM b WHERE dots = 0 UNION ALL SELECT file, module, 2, 'src/' || tail FROM b WHERE dots = 0)
SELECT c.file, c.module, arg_min(path, n + k) AS path FROM c, (VALUES (0, '.py'), (1, '/__init__.py')) e(k, ending) JOIN f ON f.path = base || ending GROUP BY 1, 2
""")
def python_imports(spark, sf_dir):
    return resolve.python_imports(sql(spark, sf_dir, PY_USES, "part"), sql(spark, sf_dir, PY_FILES, "part"))


@query("""
WITH m AS (SELECT DISTINCT 'crate::' || lower(p_brand) AS module, lower(p_brand) || '/mod.rs' AS path FROM part UNION SELECT DISTINCT 'crate::' || lower(p_brand) || '::' || lower(p_type), lower(p_brand) || '/' || lower(p_type) || '.rs' FROM part WHERE p_size < 10),
s AS (SELECT DISTINCT 'crate::' || lower(p_brand) || '::' || lower(p_type) || '::' || replace(p_name, ' ', '::') AS spec FROM part)
SELECT spec, arg_max(path, length(module)) AS path FROM s JOIN m ON spec = module OR starts_with(spec, module || '::') GROUP BY 1
""")
def rust_imports(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_size", F.lower("p_brand").alias("b"), F.lower("p_type").alias("t"), F.replace("p_name", F.lit(" "), F.lit("::")).alias("n"))
    modules = parts.select(F.concat(F.lit("crate::"), "b").alias("module"), F.concat("b", F.lit("/mod.rs")).alias("path")).union(parts.where("p_size < 10").select(F.concat_ws("::", F.lit("crate"), "b", "t"), F.concat("b", F.lit("/"), "t", F.lit(".rs")))).distinct()
    return resolve.rust_imports(parts.select(F.concat_ws("::", F.lit("crate"), "b", "t", "n").alias("spec")), modules)


@query(f"""
WITH f AS ({told(FILES)}), r AS (SELECT DISTINCT regexp_extract(path, '([^/]+/[^/]+)$', 1) AS reported FROM f WHERE contains(path, '/')), j AS (SELECT reported, path FROM r LEFT JOIN (SELECT DISTINCT path FROM f) ON ends_with(path, '/' || reported) OR path = reported)
SELECT reported, count(path) AS n_files FROM j GROUP BY 1
""")
def reported_suffixes(spark, sf_dir):
    files = sql(spark, sf_dir, FILES, "part").select("path").distinct()
    tail = lambda c: F.regexp_extract(c, r"([^/]+/[^/]+)$", 1)
    reported = files.where(F.col("path").contains("/")).select(tail("path").alias("reported")).distinct()
    keyed = files.select("path", F.when(F.col("path").contains("/"), tail("path")).otherwise(F.col("path")).alias("reported"))
    return reported.join(keyed, "reported", "left").groupBy("reported").agg(F.count("path").alias("n_files"))


@query(f"""
WITH f AS (SELECT id, path, lower(regexp_extract(path, '([^/]*)$', 1)) AS n FROM ({told(FILES)}))
SELECT id, CASE WHEN regexp_matches(path, '^\\.github/workflows/[^/]+\\.ya?ml$') THEN 'gha' WHEN n = 'jenkinsfile' THEN 'jenkins' WHEN regexp_matches(n, '^(docker-)?compose([.-][a-z0-9_.-]+)?\\.ya?ml$') THEN 'compose' WHEN regexp_matches(n, '^next\\.config\\.(js|mjs|cjs|ts|mts)$') THEN 'next' WHEN n = '.env' OR starts_with(n, '.env.') THEN 'dotenv' END AS reader,
    CASE WHEN n = '.env.production.local' THEN 'production (local)' END AS target, CASE WHEN ends_with(n, '.tfvars') THEN 'prod' END AS environment FROM f
""")
def env_readers(spark, sf_dir):
    path = F.col("path")
    files = sql(spark, sf_dir, FILES, "part")
    return files.select("id", names.env_reader(path).alias("reader"), F.when(names.env_reader(path) == "dotenv", names.dotenv_target(path)).alias("target"), F.when(path.endswith(".tfvars"), names.values_environment(path)).alias("environment"))
