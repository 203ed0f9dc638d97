"""Differences between two snapshots of the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeloom.operators import relational
from changeloom.plans.registry import query, table
from changeloom.plans.standins import BASE_SQL, HEAD_SQL, orders_base, orders_head

COLUMNS = ["o_custkey", "o_orderstatus", "o_orderpriority"]
DIFF_SQL = f"""WITH {BASE_SQL}, {HEAD_SQL}, diff AS (
    SELECT coalesce(b.o_orderkey, h.o_orderkey) AS o_orderkey,
        CASE WHEN b.o_orderkey IS NULL THEN 'added' WHEN h.o_orderkey IS NULL THEN 'removed'
            WHEN b.o_orderpriority IS DISTINCT FROM h.o_orderpriority OR b.o_custkey IS DISTINCT FROM h.o_custkey OR b.o_orderstatus IS DISTINCT FROM h.o_orderstatus THEN 'changed' ELSE 'same' END AS status,
        CASE WHEN b.o_orderkey IS NULL OR h.o_orderkey IS NULL THEN '' ELSE concat_ws(',', CASE WHEN b.o_custkey IS DISTINCT FROM h.o_custkey THEN 'o_custkey' END,
            CASE WHEN b.o_orderstatus IS DISTINCT FROM h.o_orderstatus THEN 'o_orderstatus' END, CASE WHEN b.o_orderpriority IS DISTINCT FROM h.o_orderpriority THEN 'o_orderpriority' END) END AS aspects
    FROM base b FULL JOIN head h ON b.o_orderkey = h.o_orderkey)"""


def _diff(spark, sf_dir):
    return relational.snapshot_diff(orders_base(spark, sf_dir), orders_head(spark, sf_dir), ["o_orderkey"], COLUMNS)


@query(f"{DIFF_SQL} SELECT o_orderkey, status FROM diff WHERE status <> 'same'")
def orders_diff_status(spark, sf_dir):
    return _diff(spark, sf_dir).where("status <> 'same'").select("o_orderkey", "status")


@query(f"{DIFF_SQL} SELECT count(*) FILTER (WHERE status = 'added') AS added, count(*) FILTER (WHERE status = 'removed') AS removed, count(*) FILTER (WHERE status = 'changed') AS changed, count(*) FILTER (WHERE status = 'same') AS same FROM diff")
def orders_diff_counts(spark, sf_dir):
    return relational.diff_counts(_diff(spark, sf_dir))


@query(f"{DIFF_SQL} SELECT o_orderkey, aspects FROM diff WHERE status = 'changed'")
def orders_diff_aspects(spark, sf_dir):
    return _diff(spark, sf_dir).where("status = 'changed'").select("o_orderkey", F.array_join("aspects", ",").alias("aspects"))


@query("""
WITH b AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_orderkey % 10 <> 0 AND l_linenumber <> 2),
h AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_orderkey % 7 <> 0 AND l_linenumber <> 3),
n AS (SELECT src AS id FROM h UNION SELECT dst FROM h)
SELECT src, dst, 'added' AS change FROM (SELECT * FROM h EXCEPT SELECT * FROM b)
UNION ALL SELECT src, dst, 'removed' FROM (SELECT * FROM b EXCEPT SELECT * FROM h) WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)
""")
def edge_added_removed(spark, sf_dir):
    b, h, nodes = _two_sides(spark, sf_dir)
    return relational.edge_changes(b, h, nodes)


def _two_sides(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), "l_linenumber")
    b = lines.where("src % 10 <> 0 AND l_linenumber <> 2").select("src", "dst")
    h = lines.where("src % 7 <> 0 AND l_linenumber <> 3").select("src", "dst")
    return b, h, h.select(F.col("src").alias("id")).union(h.select("dst"))


@query("""
WITH b AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_linenumber = 1), h AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_linenumber = 5),
n AS (SELECT src AS id FROM h UNION SELECT p_partkey FROM part)
SELECT DISTINCT dst AS id FROM (SELECT * FROM b EXCEPT SELECT * FROM h) WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n) AND dst NOT IN (SELECT dst FROM h)
""")
def orphans(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    side = lambda n: lines.where(f"l_linenumber = {n}").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    nodes = side(5).select(F.col("src").alias("id")).union(table(spark, sf_dir, "part").select("p_partkey")).distinct()
    return relational.orphans(side(1), side(5), nodes)


@query("""
WITH b AS (SELECT DISTINCT source AS place, text AS what FROM documents WHERE doc_id % 2 = 0), h AS (SELECT DISTINCT source AS place, text AS what FROM documents WHERE doc_id % 2 = 1),
gone AS (SELECT * FROM b EXCEPT SELECT * FROM h), fresh AS (SELECT what, min(place) AS moved_to FROM (SELECT * FROM h EXCEPT SELECT * FROM b) GROUP BY what HAVING count(DISTINCT place) = 1)
SELECT g.what, g.place AS moved_from, f.moved_to FROM gone g JOIN fresh f ON g.what = f.what WHERE g.place <> f.moved_to
""")
def moved_unique(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    side = lambda n: docs.where(F.col("doc_id") % 2 == n).select(F.col("source").alias("place"), F.col("text").alias("what")).distinct()
    return relational.moved_unique(side(0), side(1), "place", ["what"])


@query("""
SELECT l_partkey AS id, l_orderkey AS file, CAST(l_linenumber AS BIGINT) AS line FROM (SELECT DISTINCT l_partkey, l_orderkey, l_linenumber FROM lineitem) l
WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 45) AND NOT EXISTS (SELECT 1 FROM lineitem w WHERE w.l_orderkey = l.l_orderkey AND w.l_linenumber = l.l_linenumber AND w.l_returnflag = 'R')
""")
def contract_usages(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("file"), F.col("l_linenumber").cast("long").alias("line"), "l_returnflag")
    changed = table(spark, sf_dir, "part").where("p_size > 45").select(F.col("p_partkey").alias("id"))
    return relational.uses_left_behind(lines.drop("l_returnflag").distinct(), changed, lines.where("l_returnflag = 'R'").select("file", "line").distinct()).select("id", "file", "line")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi_exists(spark, sf_dir):
    late = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return table(spark, sf_dir, "customer").join(late, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_missing(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query(f"""
WITH {BASE_SQL}, {HEAD_SQL}
SELECT coalesce(h.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN h.o_orderkey IS NULL THEN b.o_orderpriority ELSE h.o_orderpriority END AS o_orderpriority FROM base b FULL JOIN head h ON b.o_orderkey = h.o_orderkey
""")
def upsert_latest(spark, sf_dir):
    b, h = (f(spark, sf_dir).withColumn("version", F.lit(v)) for f, v in ((orders_base, 1), (orders_head, 2)))
    return relational.upsert(b, h, ["o_orderkey"], "version").select("o_orderkey", "o_orderpriority")


@query(f"WITH {BASE_SQL}, {HEAD_SQL} SELECT o_orderkey, o_orderpriority FROM base UNION ALL SELECT o_orderkey, o_orderpriority FROM head WHERE o_orderkey NOT IN (SELECT o_orderkey FROM base)")
def insert_or_ignore(spark, sf_dir):
    return relational.insert_or_ignore(orders_base(spark, sf_dir), orders_head(spark, sf_dir), ["o_orderkey"]).select("o_orderkey", "o_orderpriority")


@query("""
WITH h AS (SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT)) AS q, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT)) AS q, count(*) AS n FROM lineitem WHERE l_linenumber <> 4 GROUP BY 1)
SELECT h.l_orderkey FROM h JOIN b ON h.l_orderkey = b.l_orderkey AND h.q = b.q AND h.n = b.n
""")
def patch_hash_unchanged(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    sums = lambda df: df.groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("q"), F.count("*").alias("n"))
    return sums(lines).join(sums(lines.where("l_linenumber <> 4")), ["l_orderkey", "q", "n"], "left_semi").select("l_orderkey")
