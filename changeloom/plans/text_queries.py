"""Scalars over texts, names and URLs, and searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeloom.functions import numbers, paths, text
from changeloom.operators import relational, scans, search
from changeloom.plans.registry import query, table
from changeloom.plans.standins import longs
from changeloom.plans.stats_queries import LINES_SQL

URL_PATH_SQL = "regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)"
#: Ids in URL paths as parameters, as a route of the pages would name them.
ROUTE_SQL = f"regexp_replace(regexp_replace({URL_PATH_SQL}, '/[0-9]+', '/:id', 'g'), '/:id', '/{{id}}', 'g')"
STOP_SQL = ", ".join(f"'{w}'" for w in text.STOPWORDS)
SUMMARY_SQL = f"""array_to_string(list_filter(list_transform(string_split(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9_.$]+', ' ', 'g'), ' '), lambda w: regexp_replace(regexp_replace(w, '^\\.+', ''), '\\.+$', '')),
    lambda w: w <> '' AND w NOT IN ({STOP_SQL}) AND NOT regexp_matches(w, '^[0-9]+$')), ' ')"""


def _routes(spark, sf_dir):
    raw = F.regexp_replace(paths.url_path(F.col("url")), "/[0-9]+", "/:id")
    return table(spark, sf_dir, "pages").select("page_id", "url", paths.route_path(raw).alias("route"))


NORMAL_SQL = f"(CASE WHEN starts_with(r, '/') THEN r ELSE '/' || r END) AS r2 FROM (SELECT page_id, regexp_replace({ROUTE_SQL}, '/+', '/', 'g') AS r FROM pages)"
ROUTES_SQL = f"routes AS (SELECT page_id, CASE WHEN length(r2) > 1 AND ends_with(r2, '/') THEN left(r2, length(r2) - 1) ELSE r2 END AS route FROM (SELECT page_id, {NORMAL_SQL}))"


@query(f"WITH {ROUTES_SQL} SELECT page_id, route, lower(regexp_replace(route, '\\{{[^}}]*\\}}', '{{}}', 'g')) AS route_key FROM routes")
def url_normalise(spark, sf_dir):
    return _routes(spark, sf_dir).select("page_id", "route", paths.route_key(F.col("route")).alias("route_key"))


@query(f"WITH {ROUTES_SQL} SELECT page_id, len(regexp_extract_all(route, '\\{{(\\w+)\\*?\\??\\}}')) AS n_params FROM routes")
def url_params(spark, sf_dir):
    return longs(_routes(spark, sf_dir).select("page_id", F.size(paths.route_params(F.col("route"))).alias("n_params")), "n_params")


@query(f"""
WITH {ROUTES_SQL}, s AS (SELECT page_id, list_filter(string_split(route, '/'), lambda x: x <> '') AS p FROM routes),
k AS (SELECT page_id, p, list_position(list_transform(p, lambda x: regexp_matches(x, '(?i)^(api|rest|v[0-9]+|public|internal|\\{{.*\\}}|…)$')), false) AS f FROM s),
m AS (SELECT *, list_position(list_transform(p, lambda x, i: i > f AND regexp_matches(x, '^\\{{.*\\}}$')), true) AS q FROM k)
SELECT page_id, CASE WHEN f IS NULL OR f = 0 THEN '/' WHEN q > 0 AND p[q + 1] IS NOT NULL AND NOT regexp_matches(p[q + 1], '^\\{{.*\\}}$') THEN p[f] || ' › ' || p[q + 1] ELSE p[f] END AS route_group FROM m
""")
def url_group(spark, sf_dir):
    return _routes(spark, sf_dir).select("page_id", paths.route_group(F.col("route")).alias("route_group"))


@query(f"""
SELECT page_id, pattern FROM (SELECT page_id, ltrim({URL_PATH_SQL}, '/') AS path FROM pages), (SELECT unnest(['a/**', '*.html', 'p*', 'index']) AS pattern)
WHERE CASE WHEN ends_with(pattern, '/**') THEN starts_with(path, left(pattern, length(pattern) - 2)) WHEN starts_with(pattern, '*.') THEN ends_with(path, substr(pattern, 2)) WHEN ends_with(pattern, '*') THEN starts_with(path, left(pattern, length(pattern) - 1)) ELSE path = pattern END
""")
def path_globs(spark, sf_dir):
    globs = F.explode(F.array(*map(F.lit, ["a/**", "*.html", "p*", "index"]))).alias("pattern")  # a fixed list
    rows = table(spark, sf_dir, "pages").select("page_id", F.ltrim(paths.url_path(F.col("url")), F.lit("/")).alias("path"), globs)
    return rows.where(paths.matches_glob(F.col("path"), F.col("pattern"))).select("page_id", "pattern")


@query("SELECT p_partkey, lower(regexp_replace(replace(p_name, ' ', 'X'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS snake FROM part")
def snake_case(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.snake_case(F.replace("p_name", F.lit(" "), F.lit("X"))).alias("snake"))


@query("""
WITH w AS (SELECT p_partkey, list_filter(string_split(lower(p_name), ' '), lambda x: regexp_matches(x, '[a-z]')) AS ws FROM part)
SELECT p_partkey, array_to_string(list_transform(CASE WHEN length(ws[1]) <= 3 THEN ws[1:2] ELSE ws[1:1] END, lambda x: CASE WHEN length(x) > 3 AND ends_with(x, 's') AND NOT regexp_matches(x, '(ss|is|us|as)$') THEN left(x, length(x) - 1) ELSE x END), ' ') AS stem FROM w
""")
def name_stem(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.name_stem(F.concat(F.lit("src/"), F.col("p_name"), F.lit(".py"))).alias("stem"))


@query(f"SELECT doc_id, CAST({LINES_SQL} AS BIGINT) AS lines, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM documents")
def line_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.line_count(F.col("text")).alias("lines"), text.token_estimate(F.col("text")).alias("tokens"))


def _summaries(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", text.normal_summary(F.coalesce("text", F.lit(""))).alias("summary"))


@query(f"SELECT doc_id, {SUMMARY_SQL} AS summary FROM documents")
def summary_normalise(spark, sf_dir):
    return _summaries(spark, sf_dir).select("doc_id", "summary")


@query(f"""
WITH s AS (SELECT doc_id, source, list_distinct(list_filter(string_split({SUMMARY_SQL}, ' '), lambda x: x <> '')) AS ws FROM documents), f AS (SELECT doc_id, source, len(ws) AS n, unnest(ws) AS w FROM s),
c AS (SELECT a.source, a.doc_id AS left_id, b.doc_id AS right_id, a.n AS x, b.n AS y, count(*) AS n FROM f a JOIN f b ON a.source = b.source AND a.w = b.w AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT source, left_id, right_id, round(CAST(n AS DOUBLE) / (x + y - n), 6) AS score FROM c WHERE n >= 0.5 * (x + y - n) - 1e-9
""")
def summary_jaccard_pairs(spark, sf_dir):
    rows = _summaries(spark, sf_dir).withColumn("ws", F.filter(F.split("summary", " "), lambda w: w != ""))
    found = relational.similar_pairs(rows, "source", "doc_id", "ws", 0.5)
    return found.withColumn("score", F.round("score", 6))


@query(f"""
WITH s AS (SELECT doc_id, source, list_distinct(list_filter(string_split({SUMMARY_SQL}, ' '), lambda x: x <> '')) AS ws FROM documents), f AS (SELECT doc_id, source, len(ws) AS n, unnest(ws) AS w FROM s),
c AS (SELECT a.source, a.doc_id, b.doc_id AS other, a.n AS x, b.n AS y, count(*) AS n FROM f a JOIN f b ON a.source = b.source AND a.w = b.w AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT doc_id, count(*) AS n_links, round(max(CAST(n AS DOUBLE) / (x + y - n)), 6) AS best FROM c WHERE n >= 0.5 * (x + y - n) - 1e-9 GROUP BY doc_id)
SELECT source, doc_id, coalesce(n_links, 0) AS n_links, best FROM s LEFT JOIN l USING (doc_id) WHERE len(ws) > 0
""")
def summary_links(spark, sf_dir):
    rows = _summaries(spark, sf_dir).withColumn("ws", F.filter(F.split("summary", " "), lambda w: w != ""))
    return relational.similar_links(rows, "source", "doc_id", "ws", 0.5).withColumn("best", F.round("best", 6))


@query("SELECT doc_id, substr(sha256(source || chr(0) || lang || chr(0) || text), 1, 32) AS content_id, length(text) AS n FROM documents")
def content_id(spark, sf_dir):
    return longs(table(spark, sf_dir, "documents").select("doc_id", text.content_id(F.col("source"), F.col("lang"), F.col("text")).alias("content_id"), F.length("text").alias("n")), "n")


#: The same shapes for an engine without back references: repeats are told character by character.
REPEATED = "|".join(f"{c}{{8,}}" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_=/-")
SHAPES = " UNION ALL ".join("SELECT doc_id, line, '{}' AS kind, regexp_extract(content, '{}', 0) AS v FROM l".format(k, p.replace("'", "''")) for k, p in scans.TOKENS)


@query(f"""
WITH l AS (SELECT * FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line FROM documents) WHERE length(content) <= 2000),
f AS ({SHAPES} UNION ALL SELECT doc_id, line, 'random', regexp_extract(content, '{scans.RANDOM.replace("'", "''")}', 1) FROM l)
SELECT doc_id, line, kind, substr(sha256(v), 1, 12) AS fingerprint FROM f WHERE v <> '' AND NOT regexp_matches(v, '(?i)x{{4,}}|example|changeme|<[a-z_]+>|\\$\\{{|your[-_]') AND NOT regexp_matches(v, '{REPEATED}')
    AND NOT (kind = 'url_password' AND regexp_matches(v, '@(localhost|127\\.0\\.0\\.1|0\\.0\\.0\\.0|\\[?::1|host\\.docker\\.internal)')) AND (kind <> 'random' OR list_entropy(string_split(v, '')) >= 4.2)
""")
def secret_scan_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(scans.may_hold_secret(F.col("text")))
    return longs(scans.secret_lines(scans.lines_of(docs, "text", "doc_id"), "doc_id", "line"), "line").select("doc_id", "line", "kind", "fingerprint")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50")
def json_path_filter(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").where(k > 50).select("event_id", k.alias("k"))


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%a%e%r%'")
def like_subsequence(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.lower("p_name").like(search.like_subsequence("aer"))).select("p_partkey", "p_name")


@query("""
SELECT doc_id, CAST(line AS BIGINT) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line FROM documents) WHERE regexp_matches(content, '\\b(License|Licensed)\\b')
""")
def grep_lines(spark, sf_dir):
    return longs(scans.grep(table(spark, sf_dir, "documents"), "License|Licensed", "doc_id", whole_word=True).select("doc_id", "line"), "line")


@query("""
SELECT o_orderkey, CASE WHEN d < 60 THEN CAST(d AS VARCHAR) || ' days' WHEN d < 730 THEN CAST(CAST(round(d / 30.4) AS INTEGER) AS VARCHAR) || ' months' ELSE printf('%.1f', d / 365.25) || ' years' END AS age
FROM (SELECT o_orderkey, datediff('day', CAST(o_orderdate AS DATE), DATE '1998-09-01') AS d FROM orders)
""")
def age_texts(spark, sf_dir):
    days = F.datediff(F.lit("1998-09-01").cast("date"), F.to_date("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.age_text(days).alias("age"))


@query("SELECT event_id, CAST(1000 * pow(2, greatest(0, event_id % 6 - 1)) AS BIGINT) AS delay_ms FROM events")
def backoff_delays(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", numbers.backoff(F.lit(1000), F.col("event_id") % 6).cast("long").alias("delay_ms"))


@query("SELECT doc_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS criterion FROM documents")
def criterion_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.criterion_key(F.col("text")).alias("criterion"))
