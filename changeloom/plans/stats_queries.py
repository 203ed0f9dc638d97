"""Statistics of files, commits and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeloom.operators import stats, windows
from changeloom.plans.registry import query, table
from changeloom.plans.standins import longs

LINES_SQL = "CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END"


def _day():
    return F.to_date("ts")


@query(f"""
SELECT lang, count(*) AS files, CAST(sum({LINES_SQL}) AS BIGINT) AS lines,
    CAST(sum(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S')))) AS BIGINT) AS non_blank
FROM documents GROUP BY lang
""")
def stats_languages(spark, sf_dir):
    return stats.language_stats(table(spark, sf_dir, "documents"), "lang")


@query(f"""
SELECT lang, source, CAST(grouping(lang, source) AS BIGINT) AS grouping_level, count(*) AS files, CAST(sum({LINES_SQL}) AS BIGINT) AS lines
FROM documents GROUP BY ROLLUP (lang, source)
""")
def stats_totals_rollup(spark, sf_dir):
    return stats.totals_rollup(table(spark, sf_dir, "documents"), "lang", "source")


@query("""
WITH commits AS (
    SELECT CASE WHEN user_id % 3 = 0 THEN 'Person ' || CAST(user_id % 40 AS VARCHAR) ELSE 'person ' || CAST(user_id % 40 AS VARCHAR) END AS name,
        'U' || CAST(user_id AS VARCHAR) || '@x.org' AS email, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS authored_at, event_id % 50 AS added, event_id % 7 AS removed
    FROM events
), parts AS (
    SELECT lower(email) AS k, name, count(*) AS n, sum(added) AS added, sum(removed) AS removed, min(authored_at) AS f, max(authored_at) AS l FROM commits GROUP BY 1, 2
), people AS (
    SELECT k, sum(n) AS commits, sum(added) AS added, sum(removed) AS removed, min(f) AS f, max(l) AS l,
        (SELECT name FROM parts q WHERE q.k = p.k ORDER BY n DESC, name LIMIT 1) AS name
    FROM parts p GROUP BY k
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lower(trim(name)) ORDER BY commits DESC, name DESC) AS rn FROM people
)
SELECT CAST(sum(commits) AS BIGINT) AS commits, CAST(sum(added) AS BIGINT) AS added, CAST(sum(removed) AS BIGINT) AS removed, min(f) AS "first", max(l) AS "last", max(CASE WHEN rn = 1 THEN name END) AS name
FROM ranked GROUP BY lower(trim(name))
""")
def stats_contributors(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    person = F.when(F.col("user_id") % 3 == 0, "Person ").otherwise("person ")
    commits = events.select(
        F.concat(person, (F.col("user_id") % 40).cast("string")).alias("name"),
        F.concat(F.lit("U"), F.col("user_id").cast("string"), F.lit("@x.org")).alias("email"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("authored_at"),
        (F.col("event_id") % 50).alias("added"),
        (F.col("event_id") % 7).alias("removed"),
    )
    return stats.contributors(commits)


NET_SQL = "CAST(sum(CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) AS BIGINT)"
LATER_SQL = "greatest(0, 100 - coalesce(sum(net) OVER (PARTITION BY user_id ORDER BY d ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0))"


def _by_user_day(spark, sf_dir):
    net = F.sum(F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0))
    return table(spark, sf_dir, "events").groupBy("user_id", _day().alias("day")).agg(F.count("*").alias("n"), net.alias("net"))


@query(f"""
WITH days AS (SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS n, {NET_SQL} AS net FROM events GROUP BY 1, 2)
SELECT user_id, d AS "day", n, CAST({LATER_SQL} AS BIGINT) AS lines FROM days
""")
def stats_timeline(spark, sf_dir):
    return longs(windows.running_back(_by_user_day(spark, sf_dir), ["user_id"], "day", "net", F.lit(100)).drop("net"), "lines")


@query(f"""
WITH days AS (SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS n, {NET_SQL} AS net FROM events GROUP BY 1, 2),
walked AS (SELECT user_id, d, n, {LATER_SQL} AS lines FROM days),
calendar AS (SELECT user_id, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM days GROUP BY user_id)
SELECT c.user_id, c.d AS "day", coalesce(n, 0) AS n, CAST(last_value(lines IGNORE NULLS) OVER (PARTITION BY c.user_id ORDER BY c.d) AS BIGINT) AS lines
FROM calendar c LEFT JOIN walked w ON c.user_id = w.user_id AND c.d = w.d
""")
def stats_timeline_dense(spark, sf_dir):
    walked = windows.running_back(_by_user_day(spark, sf_dir), ["user_id"], "day", "net", F.lit(100)).drop("net")
    return longs(windows.dense_calendar(walked, ["user_id"], "day", ["n"], ["lines"]), "lines")


@query("""
SELECT CAST(ts AS DATE) AS "day", count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type = 'purchase') AS passed FROM events GROUP BY 1
""")
def stats_ci_daily(spark, sf_dir):
    return stats.daily(table(spark, sf_dir, "events"), _day(), failed=F.col("event_type") == "error", passed=F.col("event_type") == "purchase")


@query("""
SELECT p_brand, count(*) AS files, CAST(sum(p_size) AS BIGINT) AS total_size, count(DISTINCT p_type) AS kinds FROM part GROUP BY p_brand
""")
def component_file_counts(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("files"), F.sum("p_size").cast("long").alias("total_size"), F.count_distinct("p_type").alias("kinds"))


@query("""
SELECT user_id, event_type, n FROM (
    SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn FROM events GROUP BY 1, 2
) WHERE rn = 1
""")
def majority_vote(spark, sf_dir):
    return stats.majority(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("""
SELECT o_custkey, o_orderstatus, n FROM (
    SELECT o_custkey, o_orderstatus, count(*) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 WHEN 'F' THEN 3 ELSE 4 END, o_orderstatus) AS rn
    FROM orders GROUP BY 1, 2
) WHERE rn = 1
""")
def dominant_role(spark, sf_dir):
    return stats.dominant(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", ["P", "O", "F"])


@query("""
SELECT count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS queued, count(*) FILTER (WHERE value > 50 AND event_type = 'error') AS unseen FROM events
""")
def queue_state_counts(spark, sf_dir):
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").agg(F.count_if(kind == "error").alias("failed"), F.count_if(kind.isin("view", "click")).alias("queued"), F.count_if((F.col("value") > 50) & (kind == "error")).alias("unseen"))


@query("""
SELECT event_type, CAST(ts AS DATE) AS "day", count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY CAST(ts AS DATE)), 1) AS share FROM events GROUP BY 1, 2
""")
def daily_shares(spark, sf_dir):
    from changeloom.functions.numbers import share

    counted = table(spark, sf_dir, "events").groupBy("event_type", _day().alias("day")).agg(F.count("*").alias("n"))
    return counted.withColumn("share", share(F.col("n"), "day"))


@query("""
SELECT l_partkey, l_suppkey, count(*) AS n_lines, count(*) FILTER (WHERE q > 0) AS n_hit, count(*) FILTER (WHERE q = 0) AS n_missed
FROM (SELECT l_partkey, l_suppkey, l_linenumber, max(CAST(l_quantity AS BIGINT) % 5) AS q FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1, 2
""")
def coverage_merge(spark, sf_dir):
    from changeloom.operators.scans import merged_coverage

    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.col("l_linenumber").alias("line"), (F.col("l_quantity").cast("long") % 5).alias("hits"))
    return merged_coverage(lines, ["l_partkey", "l_suppkey"])


@query("""
SELECT l_orderkey, sha256(string_agg(CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey)) AS patch_hash, count(*) AS n FROM lineitem GROUP BY l_orderkey
""")
def patch_hashes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("rows"), F.count("*").alias("n"))
    text = F.array_join(F.transform("rows", lambda r: F.concat_ws(":", r["l_linenumber"].cast("string"), r["l_partkey"].cast("string"))), ",")
    return rows.select("l_orderkey", F.sha2(text, 256).alias("patch_hash"), "n")
