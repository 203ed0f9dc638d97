"""Positions, retention, islands, budgets and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeloom.functions.text import token_estimate
from changeloom.operators import relational, windows
from changeloom.plans.registry import query, table
from changeloom.plans.standins import longs


@query("""
SELECT user_id, event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1
""")
def latest_per_entry(spark, sf_dir):
    return relational.latest_by(table(spark, sf_dir, "events"), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id", "ts")


@query("SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS position FROM events")
def queue_positions(spark, sf_dir):
    return windows.queue_positions(table(spark, sf_dir, "events"), ["event_type"], F.col("ts"), F.col("event_id")).select("event_id", "event_type", "position")


@query("""
SELECT event_type, event_id, nth FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth <= 5
""")
def retention_keep_newest(spark, sf_dir):
    return longs(relational.keep_newest(table(spark, sf_dir, "events"), ["event_type"], 5, F.desc("ts"), F.desc("event_id")).select("event_type", "event_id", "nth"), "nth")


@query("""
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events
) WHERE rn <= 3
""")
def last_n_ascending(spark, sf_dir):
    last = relational.keep_newest(table(spark, sf_dir, "events"), ["user_id"], 3, F.desc("ts"), F.desc("event_id"))
    return windows.queue_positions(last, ["user_id"], F.col("ts"), F.col("event_id")).select("user_id", "event_id", F.col("position").alias("line"))


@query("""
WITH d AS (SELECT DISTINCT user_id, datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS x FROM events),
g AS (SELECT user_id, x, x - row_number() OVER (PARTITION BY user_id ORDER BY x) AS k FROM d)
SELECT user_id, min(x) AS "first", max(x) AS "last", count(*) AS n FROM g GROUP BY user_id, k
""")
def islands_active_days(spark, sf_dir):
    return windows.islands(table(spark, sf_dir, "events"), ["user_id"], F.unix_date(F.to_date("ts")))


@query("""
WITH d AS (SELECT DISTINCT user_id, event_id AS x FROM events), g AS (SELECT user_id, x, x - row_number() OVER (PARTITION BY user_id ORDER BY x) AS k FROM d)
SELECT user_id, min(x) AS "first", max(x) AS "last", count(*) AS n FROM g GROUP BY user_id, k
""")
def blame_ranges(spark, sf_dir):
    return windows.islands(table(spark, sf_dir, "events"), ["user_id"], F.col("event_id"))


@query("""
WITH r AS (SELECT user_id, event_id - 20 AS a, event_id + 20 AS b FROM events),
m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM r),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, min(a) AS "first", max(b) AS "last", count(*) AS n FROM g GROUP BY user_id, k
""")
def context_windows_merge(spark, sf_dir):
    return windows.merged_windows(table(spark, sf_dir, "events"), ["user_id"], F.col("event_id") - 20, F.col("event_id") + 20)


@query("""
SELECT event_id, user_id, CAST(sum(CASE WHEN event_type = 'login' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM events
""")
def block_numbers(spark, sf_dir):
    return windows.block_numbers(table(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("event_type") == "login").select("event_id", "user_id", "block")


@query("""
SELECT p_partkey, CASE WHEN rn = 1 THEN p_name ELSE p_name || ' (' || CAST(rn AS VARCHAR) || ')' END AS unique_name
FROM (SELECT *, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS rn FROM part)
""")
def unique_names(spark, sf_dir):
    return windows.unique_names(table(spark, sf_dir, "part"), "p_name", F.col("p_partkey")).select("p_partkey", "unique_name")


@query("""
WITH a AS (SELECT p_partkey, p_name, p_brand, p_type, count(*) OVER (PARTITION BY p_name) > 1 AS c1 FROM part),
b AS (SELECT *, CASE WHEN c1 THEN p_name || ' ' || p_brand ELSE p_name END AS l1 FROM a),
c AS (SELECT *, count(*) OVER (PARTITION BY l1) > 1 AS c2 FROM b)
SELECT p_partkey, CASE WHEN c2 THEN p_name || ' ' || p_brand || ' ' || p_type ELSE l1 END AS label, CAST(CASE WHEN c2 THEN 2 WHEN c1 THEN 1 ELSE 0 END AS BIGINT) AS level FROM c
""")
def name_collisions(spark, sf_dir):
    levels = [F.col("p_name"), F.concat_ws(" ", "p_name", "p_brand"), F.concat_ws(" ", "p_name", "p_brand", "p_type")]
    return longs(windows.colliding_labels(table(spark, sf_dir, "part"), levels).select("p_partkey", "label", "level"), "level")


@query("""
WITH c AS (SELECT conv_id, turn, role, CAST(ceil(length(text) / 4) AS BIGINT) AS cost FROM conversations),
l AS (SELECT *, 600 - coalesce(sum(cost) FILTER (WHERE role = 'system') OVER (PARTITION BY conv_id), 0) AS room,
    sum(CASE WHEN role = 'system' THEN 0 ELSE cost END) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS spent FROM c)
SELECT conv_id, turn, cost FROM l WHERE role = 'system' OR spent <= room
""")
def truncate_to_budget(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", token_estimate(F.col("text")).alias("cost"))
    return windows.within_budget(turns, ["conv_id"], "turn", "cost", 600, F.col("role") == "system").select("conv_id", "turn", "cost")


@query("""
SELECT p_brand, p_partkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 6
""")
def top_by_kind(spark, sf_dir):
    return longs(windows.top_by_kind(table(spark, sf_dir, "part"), "p_brand", 6, F.desc("p_retailprice"), F.col("p_partkey")).select("p_brand", "p_partkey", "rank"), "rank")


@query("""
WITH v AS (SELECT o_orderkey, o_custkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ord,
    lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = o_orderdate AS same FROM orders)
SELECT o_orderkey, ord, coalesce(same, false) AS same_version FROM v
""")
def replay_positions(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders")
    return rows.select("o_orderkey", F.row_number().over(w).cast("long").alias("ord"), F.coalesce(F.lag("o_orderdate").over(w) == F.col("o_orderdate"), F.lit(False)).alias("same_version"))


@query("""
SELECT n, CAST(n AS VARCHAR) || CASE WHEN n % 100 BETWEEN 11 AND 13 THEN 'th' WHEN n % 10 = 1 THEN 'st' WHEN n % 10 = 2 THEN 'nd' WHEN n % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal, count(*) AS uses
FROM (SELECT CAST(l_quantity AS BIGINT) + l_linenumber * 100 AS n FROM lineitem) GROUP BY n
""")
def ordinals(spark, sf_dir):
    from changeloom.functions.text import ordinal

    rows = table(spark, sf_dir, "lineitem").select((F.col("l_quantity").cast("long") + F.col("l_linenumber") * 100).alias("n"))
    return rows.groupBy("n").agg(F.count("*").alias("uses")).select("n", ordinal(F.col("n")).alias("ordinal"), "uses")
