"""Joins by prefix, suffix, interval and rank."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeloom.functions import paths
from changeloom.operators import relational
from changeloom.plans.registry import query, table
from changeloom.plans.standins import EDGES_SQL, edges, longs, owners

PATH_SQL = "regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)"


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.concat(paths.url_host(F.col("url")), paths.url_path(F.col("url"))), "/+$", "").alias("path"))


PAGES_SQL = f"pages2 AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://(?:[^/@]*@)?([^/:?#]+)', 1)) || {PATH_SQL}, '/+$', '') AS path FROM pages)"


@query(f"""
WITH {PAGES_SQL}, owners AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS prefix, min(page_id) AS owner_id FROM pages2 WHERE page_id % 3 = 0 GROUP BY 1),
hits AS (SELECT page_id, path, prefix, owner_id, row_number() OVER (PARTITION BY page_id ORDER BY length(prefix) DESC) AS rn FROM pages2 LEFT JOIN owners ON prefix = '' OR path = prefix OR starts_with(path, prefix || '/'))
SELECT page_id, prefix, owner_id FROM hits WHERE rn = 1
""")
def longest_prefix_owner(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    own = pages.where("page_id % 3 = 0").groupBy(paths.dir_name(F.col("path")).alias("prefix")).agg(F.min("page_id").alias("owner_id"))
    return relational.longest_prefix(pages, own).select("page_id", "prefix", "owner_id")


@query("""
WITH r AS (SELECT DISTINCT 'build/' || source || '/' || lang || '/f' || CAST(doc_id % 40 AS VARCHAR) || '.c' AS path, source, lang, doc_id % 40 AS k FROM documents),
f AS (SELECT DISTINCT 'src/' || source || '/' || lang || '/f' || CAST(doc_id % 40 AS VARCHAR) || '.c' AS path, source, lang, doc_id % 40 AS k FROM documents WHERE doc_id % 2 = 0)
SELECT r.path AS reported, f.path AS file, CAST(3 AS BIGINT) AS depth FROM r JOIN f USING (source, lang, k)
UNION ALL
SELECT reported, file, depth FROM (
    SELECT r.path AS reported, min(f.path) AS file, CAST(1 AS BIGINT) AS depth FROM r JOIN f USING (k)
    WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.k = r.k AND g.lang = r.lang) GROUP BY r.path HAVING count(*) = 1)
UNION ALL
SELECT reported, file, depth FROM (
    SELECT r.path AS reported, min(f.path) AS file, CAST(2 AS BIGINT) AS depth FROM r JOIN f USING (k, lang)
    WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.k = r.k AND g.lang = r.lang AND g.source = r.source) GROUP BY r.path HAVING count(*) = 1)
""")
def suffix_match_unique(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    name = lambda top: F.concat_ws("/", F.lit(top), "source", "lang", F.concat(F.lit("f"), (F.col("doc_id") % 40).cast("string"), F.lit(".c"))).alias("path")
    return longs(relational.suffix_match(docs.select(name("build")).distinct(), docs.where("doc_id % 2 = 0").select(name("src")).distinct()), "depth")


@query("""
WITH spans AS (SELECT user_id, event_id AS span_id, event_id AS a, event_id + 10 + event_id % 90 AS b FROM events WHERE event_type = 'click'), points AS (SELECT event_id, user_id FROM events WHERE event_type = 'purchase')
SELECT p.event_id, p.user_id, arg_min(s.span_id, (s.b - s.a) * 100000000 + s.span_id) AS span_id FROM points p JOIN spans s ON p.user_id = s.user_id AND p.event_id BETWEEN s.a AND s.b GROUP BY 1, 2
""")
def innermost_interval(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    spans = events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("span_id"), F.col("event_id").alias("a"), (F.col("event_id") + 10 + F.col("event_id") % 90).alias("b"))
    points = events.where("event_type = 'purchase'").select("event_id", "user_id")
    return relational.innermost_interval(points, spans, "user_id", "event_id", "a", "b", "span_id")


@query(f"""
WITH {PAGES_SQL}, routes AS (SELECT DISTINCT regexp_extract(path, '^([^/]+/[^/]+)', 1) AS route FROM pages2 WHERE page_id % 5 = 0)
SELECT page_id, route FROM pages2 JOIN routes ON route <> '' AND (path = route OR starts_with(path, route || '/'))
""")
def route_prefix_endpoints(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    routes = pages.where("page_id % 5 = 0").select(F.regexp_extract("path", "^([^/]+/[^/]+)", 1).alias("route")).where("route <> ''").distinct()
    opened = pages.select("page_id", F.explode(paths.ancestors(F.col("path"))).alias("route"))
    return opened.join(routes, "route").select("page_id", "route")


@query(f"WITH {EDGES_SQL} SELECT a.p_brand AS src_owner, b.p_brand AS dst_owner, CAST(sum(weight) AS BIGINT) AS weight, count(*) AS n_edges FROM edges JOIN part a ON src = a.p_partkey JOIN part b ON dst = b.p_partkey WHERE a.p_brand <> b.p_brand GROUP BY 1, 2")
def component_deps(spark, sf_dir):
    from changeloom.operators.graph import rolled_up

    return rolled_up(edges(spark, sf_dir), owners(spark, sf_dir))


@query(f"""
WITH {EDGES_SQL} SELECT src, dst, weight, a.p_brand AS src_owner, b.p_brand AS dst_owner FROM edges LEFT JOIN (SELECT * FROM part WHERE p_size > 20) a ON src = a.p_partkey LEFT JOIN (SELECT * FROM part WHERE p_size > 20) b ON dst = b.p_partkey
""")
def pr_map_imports(spark, sf_dir):
    known = table(spark, sf_dir, "part").where("p_size > 20")
    a = known.select(F.col("p_partkey").alias("src"), F.col("p_brand").alias("src_owner"))
    b = known.select(F.col("p_partkey").alias("dst"), F.col("p_brand").alias("dst_owner"))
    return edges(spark, sf_dir).join(a, "src", "left").join(b, "dst", "left").select("src", "dst", "weight", "src_owner", "dst_owner")


@query("""
SELECT n_name, r_name, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2
""")
def owners_of_files(spark, sf_dir):
    per_customer = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    per_nation = table(spark, sf_dir, "customer").join(per_customer, "c_custkey", "left").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"), F.sum("n").alias("orders"))
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return nations.join(per_nation, "n_nationkey", "left").select("n_name", "r_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("orders", F.lit(0)).alias("orders"))


@query("""
WITH c AS (SELECT o_orderkey, o_custkey, o_custkey + i AS candidate, i FROM orders, (SELECT unnest([0, 1, 2, 3]) AS i))
SELECT o_orderkey, arg_min(s_suppkey, i) AS supplier FROM c JOIN supplier ON s_suppkey = candidate GROUP BY o_orderkey
""")
def first_existing(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("specifier"), "o_custkey", F.posexplode(F.array(*map(F.lit, range(4)))).alias("nth", "i"))
    candidates = orders.select("specifier", "nth", (F.col("o_custkey") + F.col("i")).alias("path"))
    return relational.first_existing(candidates, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("path"))).select(F.col("specifier").alias("o_orderkey"), F.col("path").alias("supplier"))
