"""Matches between facts: specifications, selectors, images, mounts, exports, attributes, replayed schemas."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeloom.operators import replay, snapshots
from changeloom.plans.registry import query, table
from changeloom.plans.standins import BASE_SQL, HEAD_SQL, longs, orders_base, orders_head


@query("""
WITH c AS (SELECT DISTINCT p_brand AS method, p_type AS path_key FROM part WHERE p_partkey % 3 <> 0), s AS (SELECT DISTINCT p_brand AS method, p_type AS path_key FROM part WHERE p_partkey % 4 <> 0)
SELECT coalesce(c.method, s.method) AS method, coalesce(c.path_key, s.path_key) AS path_key, CASE WHEN s.method IS NULL THEN 'code-only' WHEN c.method IS NULL THEN 'spec-only' ELSE 'both' END AS "where" FROM c FULL JOIN s ON c.method = s.method AND c.path_key = s.path_key
""")
def spec_drift(spark, sf_dir):
    side = lambda n: table(spark, sf_dir, "part").where(F.col("p_partkey") % n != 0).select(F.col("p_brand").alias("method"), F.col("p_type").alias("path_key"))
    return snapshots.spec_drift(side(3), side(4))


@query("""
SELECT s_suppkey AS service, c_custkey AS workload FROM supplier JOIN customer ON c_nationkey = s_nationkey AND c_custkey % 7 = s_suppkey % 7
""")
def selected_workloads(spark, sf_dir):
    pairs = lambda nation, key: F.create_map(F.lit("nation"), F.col(nation).cast("string"), F.lit("group"), (F.col(key) % 7).cast("string"))
    services = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("service"), pairs("s_nationkey", "s_suppkey").alias("selector"))
    loads = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("workload"), F.map_concat(pairs("c_nationkey", "c_custkey"), F.create_map(F.lit("segment"), "c_mktsegment")).alias("labels"))
    return snapshots.selected_workloads(services, loads)


@query("""
WITH i AS (SELECT DISTINCT p_brand || '/' || p_name AS image FROM part WHERE p_partkey % 2 = 0), b AS (SELECT DISTINCT p_partkey AS build, p_brand || '/' || p_name AS image FROM part WHERE p_size = 7),
f AS (SELECT image, count(DISTINCT build) AS n, min(build) AS build FROM b GROUP BY image), t AS (SELECT string_split(image, '/')[2] AS tail, count(DISTINCT build) AS n, min(build) AS build FROM b GROUP BY 1)
SELECT i.image, CASE WHEN f.n > 1 THEN NULL WHEN f.n = 1 THEN f.build WHEN t.n = 1 THEN t.build END AS build FROM i LEFT JOIN f ON i.image = f.image LEFT JOIN t ON string_split(i.image, '/')[2] = t.tail
""")
def images_to_builds(spark, sf_dir):
    image = F.concat_ws("/", "p_brand", "p_name").alias("image")
    parts = table(spark, sf_dir, "part")
    return snapshots.images_to_builds(parts.where("p_partkey % 2 = 0").select(image).distinct(), parts.where("p_size = 7").select(F.col("p_partkey").alias("build"), image))


@query("""
WITH RECURSIVE m AS (SELECT p_partkey // 3 AS parent, p_partkey AS router, '/' || CAST(p_size AS VARCHAR) AS prefix FROM part WHERE p_partkey % 5 <> 0 AND p_partkey >= 3),
r AS (SELECT id AS router, '' AS prefix FROM (SELECT p_partkey AS id FROM part UNION SELECT parent FROM m) WHERE id NOT IN (SELECT router FROM m) UNION ALL SELECT m.router, r.prefix || m.prefix FROM r JOIN m ON m.parent = r.router)
SELECT p_partkey AS router, p_brand AS method, r.prefix || '/' || CAST(p_partkey AS VARCHAR) AS path FROM part JOIN r ON r.router = p_partkey
""")
def mounted_routes(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    mounts = parts.where("p_partkey % 5 <> 0 AND p_partkey >= 3").select(F.floor(F.col("p_partkey") / 3).alias("parent"), F.col("p_partkey").alias("router"), F.concat(F.lit("/"), F.col("p_size").cast("string")).alias("prefix"))
    routes = parts.select(F.col("p_partkey").alias("router"), F.col("p_brand").alias("method"), F.concat(F.lit("/"), F.col("p_partkey").cast("string")).alias("path"))
    return snapshots.mounted_routes(mounts, routes, max_depth=16)


@query("""
WITH RECURSIVE e AS (SELECT p_partkey AS file, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_partkey // 2 END AS target FROM part),
r AS (SELECT file, file AS decl FROM e WHERE target IS NULL UNION ALL SELECT e.file, r.decl FROM e JOIN r ON e.target = r.file)
SELECT file, decl AS decl_file FROM r
""")
def resolved_exports(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    target = F.when(F.col("p_partkey") % 4 != 0, F.floor(F.col("p_partkey") / 2))
    exports = parts.select(F.col("p_partkey").alias("file"), F.lit("x").alias("name"), target.alias("target_file"), F.lit("x").alias("target_name"))
    return snapshots.resolved_exports(exports, max_hops=20).select("file", "decl_file")


@query("""
WITH l AS (SELECT l_orderkey AS block, l_partkey AS content, CASE WHEN l_returnflag = 'R' THEN 'old' ELSE 'new' END AS side, row_number() OVER (PARTITION BY l_orderkey, l_returnflag = 'R' ORDER BY l_linenumber, l_partkey) AS nth FROM lineitem)
SELECT coalesce(o.block, n.block) AS block, coalesce(o.nth, n.nth) AS nth, o.content AS "old", n.content AS "new" FROM (SELECT * FROM l WHERE side = 'old') o FULL JOIN (SELECT * FROM l WHERE side = 'new') n ON o.block = n.block AND o.nth = n.nth
""")
def paired_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("block"), F.col("l_partkey").alias("content"), F.when(F.col("l_returnflag") == "R", "old").otherwise("new").alias("side"), F.struct("l_linenumber", "l_partkey").alias("pos"))
    return longs(snapshots.paired_lines(lines), "nth")


@query(f"""
WITH {BASE_SQL}, {HEAD_SQL}, b AS (SELECT o_custkey AS id, o_orderkey AS name, o_orderpriority AS v FROM base), h AS (SELECT o_custkey AS id, o_orderkey AS name, o_orderpriority AS v FROM head),
p AS (SELECT DISTINCT id FROM b INTERSECT SELECT DISTINCT id FROM h), j AS (SELECT coalesce(b.id, h.id) AS id, b.v IS NOT DISTINCT FROM h.v AS same FROM (SELECT * FROM b WHERE id IN (SELECT id FROM p)) b FULL JOIN (SELECT * FROM h WHERE id IN (SELECT id FROM p)) h ON b.id = h.id AND b.name = h.name)
SELECT id, round(count(*) FILTER (WHERE same) / CAST(count(*) AS DOUBLE), 6) AS score FROM j GROUP BY id
""")
def attribute_similarity(spark, sf_dir):
    attrs = lambda df: df.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("name"), F.col("o_orderpriority").alias("value"))
    b, h = attrs(orders_base(spark, sf_dir)), attrs(orders_head(spark, sf_dir))
    pairs = b.select("id").intersect(h.select("id")).select(F.col("id").alias("before_id"), F.col("id").alias("after_id"))
    return snapshots.attribute_similarity(pairs, b, h).select(F.col("before_id").alias("id"), F.round("score", 6).alias("score"))


@query()
def schema_replay(spark, sf_dir):
    return replay.replay(part_history(spark, sf_dir))


def part_history(spark, sf_dir):
    """A history of schema operations for each brand."""
    part = table(spark, sf_dir, "part")
    names = F.array(*map(F.lit, ["create_table", "add_column", "add_column", "rename_column", "alter_type", "drop_column", "set_not_null"]))
    return part.select(
        F.col("p_brand").alias("database"), F.lit(1).alias("ord"), F.col("p_partkey").alias("seq"), F.element_at(names, (F.col("p_partkey") % 7 + 1).cast("int")).alias("op"), F.col("p_type").alias("table"),
        F.concat(F.lit("c"), (F.col("p_size") % 5).cast("string")).alias("column"), F.concat(F.lit("r"), (F.col("p_size") % 5).cast("string")).alias("to"), F.lit("int").alias("type"), F.lit(True).alias("nullable"),
    )
