"""Groupings, verdicts and usages of a review over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeloom.functions import paths
from changeloom.operators import review
from changeloom.plans.registry import query, table
from changeloom.plans.standins import longs


@query("""
SELECT user_id AS sha, CASE WHEN bool_or(event_type = 'error' AND event_id % 50 = 0) THEN 'failure' WHEN bool_or(event_type = 'view' AND event_id % 9 = 0) THEN 'pending' ELSE 'success' END AS state FROM events GROUP BY user_id
""")
def ci_state(spark, sf_dir):
    e, i = F.col("event_type"), F.col("event_id")
    state = F.when((e == "error") & (i % 50 == 0), "failure").when((e == "view") & (i % 9 == 0), "pending").otherwise("success")
    return review.ci_state(table(spark, sf_dir, "events").select(F.col("user_id").alias("sha"), state.alias("state")))


@query("""
WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS rn FROM c)
SELECT p_brand, CASE WHEN rn < 3 THEN p_type ELSE 'Other' END AS part, CAST(sum(n) AS BIGINT) AS files FROM r GROUP BY 1, 2
""")
def card_split(spark, sf_dir):
    return review.card_split(table(spark, sf_dir, "part"), "p_brand", "p_type", cards=3).groupBy("p_brand", "part").agg(F.count("*").alias("files"))


@query("""
WITH u AS (SELECT DISTINCT string_split(regexp_replace(url, '^[a-z]+://|[?#].*$|/+$', '', 'g'), '/') AS p, CASE WHEN contains(url, '1') THEN 'one' ELSE 'rest' END AS key FROM pages),
o AS (SELECT p, key, unnest(generate_series(0, len(p))) AS n FROM u), x AS (SELECT array_to_string(p, '/') AS path, key, n, array_to_string(p[1:n], '/') AS prefix FROM o),
g AS (SELECT prefix, min(key) AS key FROM x GROUP BY prefix HAVING count(DISTINCT key) = 1), b AS (SELECT x.path, arg_min(g.prefix, length(g.prefix)) AS prefix FROM x JOIN g ON x.prefix = g.prefix GROUP BY x.path)
SELECT DISTINCT b.prefix, g.key FROM b JOIN g ON b.prefix = g.prefix
""")
def compact_placements(spark, sf_dir):
    path = F.regexp_replace("url", r"^[a-z]+://|[?#].*$|/+$", "")
    files = table(spark, sf_dir, "pages").select(path.alias("path"), F.when(F.col("url").contains("1"), "one").otherwise("rest").alias("key")).distinct()
    return review.compact_placements(files)


@query("""
WITH w AS (SELECT p_brand, p_name, unnest(list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: x <> ''))) AS key FROM part)
SELECT key, count(*) AS files, count(DISTINCT p_name) AS names, count(DISTINCT p_brand) AS folders FROM w GROUP BY key
""")
def feature_keys(spark, sf_dir):
    return review.feature_keys(table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", "p_name").alias("path")))


@query("""
SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_brand || p_type) >= 2 THEN p_brand || p_type END AS "group" FROM part
""")
def prefix_groups(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", "p_type", F.lit("-"), "p_name").alias("n"))
    found = review.prefix_groups(parts, "n", r"^([^-]+)-")
    return found.select("p_partkey", "group")


@query("""
SELECT l_partkey AS id, l_orderkey AS file, string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) AS lines, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS names, count(DISTINCT l_linenumber) AS weight FROM lineitem GROUP BY 1, 2
""")
def usage_index(spark, sf_dir):
    uses = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("name"))
    found = review.usage_index(uses.where("line <= 3"), uses.where("line > 3"))
    return longs(found.select("id", "file", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"), F.array_join("names", ",").alias("names"), "weight"), "weight")


@query("""
WITH b AS (SELECT o_custkey AS name, CASE o_orderstatus WHEN 'F' THEN 'read' WHEN 'O' THEN 'decl' ELSE 'set' END AS part, o_orderkey AS key, o_orderpriority AS v FROM orders WHERE o_orderkey % 10 <> 0),
h AS (SELECT o_custkey AS name, CASE o_orderstatus WHEN 'F' THEN 'read' WHEN 'O' THEN 'decl' ELSE 'set' END AS part, o_orderkey AS key, CASE WHEN o_orderkey % 11 = 0 THEN 'moved' ELSE o_orderpriority END AS v FROM orders WHERE o_orderkey % 7 <> 0),
j AS (SELECT coalesce(b.name, h.name) AS name, coalesce(b.part, h.part) AS part, b.v AS bv, h.v AS hv FROM b FULL JOIN h ON b.name = h.name AND b.part = h.part AND b.key = h.key),
s AS (SELECT name, count(bv) AS nb, count(hv) AS nh, count(*) FILTER (WHERE part = 'read' AND bv IS DISTINCT FROM hv) AS "read", count(*) FILTER (WHERE part = 'decl' AND bv IS DISTINCT FROM hv) AS decl, count(*) FILTER (WHERE part = 'set' AND bv IS DISTINCT FROM hv) AS "set" FROM j GROUP BY name)
SELECT name, "read", decl, "set", CASE WHEN nb = 0 THEN 'new' WHEN nh = 0 THEN 'gone' ELSE 'changed' END AS status FROM s WHERE nb = 0 OR nh = 0 OR "read" + decl + "set" > 0
""")
def env_changes(spark, sf_dir):
    part = F.when(F.col("o_orderstatus") == "F", "read").when(F.col("o_orderstatus") == "O", "decl").otherwise("set")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name"), part.alias("part"), F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("value"))
    return review.env_changes(o.where("key % 10 <> 0"), o.where("key % 7 <> 0").withColumn("value", F.when(F.col("key") % 11 == 0, "moved").otherwise(F.col("value"))))


@query("""
WITH c AS (SELECT p_brand AS target, p_partkey AS ord, p_name AS text, trim(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS k FROM part),
f AS (SELECT target, k, min(ord) AS ord, arg_min(text, ord) AS text FROM c WHERE k <> '' GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY ord) AS rn FROM f)
SELECT target, 'c' || CAST(rn AS VARCHAR) AS id, text FROM n WHERE rn <= 40
""")
def numbered_criteria(spark, sf_dir):
    return review.numbered_criteria(table(spark, sf_dir, "part").select(F.col("p_brand").alias("target"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("text")))


@query("""
SELECT o_custkey AS origin, l_suppkey AS "table", bool_or(l_returnflag = 'R') AS writes, bool_or(l_returnflag <> 'R') AS reads, count(DISTINCT o_orderkey) AS n_via FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2
""")
def endpoint_tables(spark, sf_dir):
    reached = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("origin"), F.col("o_orderkey").alias("id"))
    uses = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("table"), (F.col("l_returnflag") == "R").alias("write"))
    return longs(review.endpoint_tables(reached, uses).select("origin", "table", "writes", "reads", F.size("via").alias("n_via")), "n_via")


@query("""
WITH RECURSIVE c AS (SELECT p_partkey AS id, CASE WHEN p_partkey >= 4 THEN p_partkey // 4 END AS parent FROM part), s AS (SELECT p_partkey AS id, p_type AS key, p_size AS v FROM part WHERE p_retailprice > 1000 OR p_size > 20),
a AS (SELECT id AS origin, id, 0 AS hops FROM c UNION ALL SELECT a.origin, c.parent, a.hops + 1 FROM a JOIN c ON c.id = a.id WHERE c.parent IS NOT NULL)
SELECT origin AS id, key, arg_min(v, hops) AS value FROM a JOIN s ON s.id = a.id GROUP BY 1, 2
""")
def inherited_settings(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    configs = parts.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") >= 4, F.floor(F.col("p_partkey") / 4)).alias("parent"))
    settings = parts.where("p_retailprice > 1000 OR p_size > 20").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("key"), F.col("p_size").alias("value"))
    return review.inherited_settings(configs, settings)


@query("""
WITH f AS (SELECT p_brand AS cluster, p_partkey, p_type AS fo, count(*) OVER (PARTITION BY p_brand, p_type) AS n FROM part), g AS (SELECT *, CASE WHEN n >= 3 THEN fo ELSE '' END AS f2 FROM f), h AS (SELECT *, count(*) OVER (PARTITION BY cluster, f2) AS n2, count(*) OVER (PARTITION BY cluster) AS total FROM g),
m AS (SELECT *, max(n2) OVER (PARTITION BY cluster) AS biggest FROM h)
SELECT cluster, p_partkey, CASE WHEN biggest / CAST(total AS DOUBLE) <= 0.75 THEN f2 END AS part FROM m
""")
def folder_cut(spark, sf_dir):
    files = table(spark, sf_dir, "part").select(F.col("p_brand").alias("cluster"), "p_partkey", F.concat_ws("/", "p_brand", F.replace("p_type", F.lit("/"), F.lit("_")), F.col("p_partkey").cast("string")).alias("path"))
    return review.folder_cut(files).select("cluster", "p_partkey", "part")


@query("SELECT page_id, lower(regexp_extract(url, '^[a-z]+://(?:[^/@]*@)?([^/:?#]+)', 1)) AS host, length(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)) AS path_length FROM pages")
def url_hosts(spark, sf_dir):
    return longs(table(spark, sf_dir, "pages").select("page_id", paths.url_host(F.col("url")).alias("host"), F.length(paths.url_path(F.col("url"))).alias("path_length")), "path_length")
