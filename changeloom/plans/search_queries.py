"""Rankings of files, names, references, findings, endpoints and catalogs for a query, with the score told anew in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeloom.operators import search
from changeloom.plans.registry import query, table
from changeloom.plans.standins import FILES, longs, sql, told

STARTS = "(i = 0 OR regexp_matches(substr(text, i, 1), '[/._\\-#\\s:]') OR substr(text, i, 1) = lower(substr(text, i, 1)) AND substr(text, i + 1, 1) <> lower(substr(text, i + 1, 1)))"


def scores(name: str, texts: str, wanted: str) -> str:
    """CTEs that give `name` (id, score) for texts (id, text), recursive ones among them; characters are walked one a step."""
    n = len(wanted)
    return f"""{name}_t AS (SELECT DISTINCT id, text FROM ({texts}) WHERE length(text) > 0),
{name}_b AS (SELECT id, text, list_filter(range(length(text)), lambda i: {STARTS}) AS starts, list_filter(range(length(text)), lambda i: substr(lower(text), i + 1, {n}) = '{wanted}') AS hits FROM {name}_t),
{name}_c AS (SELECT id, text, starts, coalesce(list_filter(hits, lambda i: list_contains(starts, i))[1], hits[1]) AS place FROM {name}_b),
{name}_w AS (SELECT id, text, starts, jump, 0 AS k, CAST([] AS BIGINT[]) AS places FROM {name}_c, (VALUES (true), (false)) j(jump) WHERE place IS NULL
    UNION ALL SELECT id, text, starts, jump, k + 1, list_append(places, CASE WHEN jump AND NOT (len(places) > 0 AND after[1] = places[-1] + 1) THEN coalesce(list_filter(after, lambda i: list_contains(starts, i))[1], after[1]) ELSE after[1] END)
    FROM (SELECT *, list_filter(range(coalesce(places[-1] + 1, 0), length(text)), lambda i: substr(lower(text), i + 1, 1) = substr('{wanted}', k + 1, 1)) AS after FROM {name}_w WHERE k < {n}) x WHERE len(after) > 0),
{name}_p AS (SELECT id, text, arg_min(places, NOT jump) AS p, any_value(starts) AS starts FROM {name}_w WHERE k = {n} GROUP BY id, text),
{name}_r AS (SELECT *, list_filter(range(1, {n} + 1), lambda k: k = 1 OR p[k] <> p[k - 1] + 1) AS begins FROM {name}_p),
{name} AS (SELECT id, text, 100.0 + {4 * n} - 0.5 * least(place, 40) + CASE WHEN list_contains(starts, place) THEN 30 ELSE 0 END + CASE WHEN place = 0 THEN 15 ELSE 0 END + CASE WHEN length(text) = {n} THEN 40 ELSE 0 END AS score FROM {name}_c WHERE place IS NOT NULL
    UNION ALL SELECT id, text, 20.0 + 8 * len(list_filter(p, lambda i: list_contains(starts, i))) + 5 * ({n} - len(begins)) - 0.3 * least(p[1], 40) - 0.2 * least(p[-1] - p[1] - {n}, 60) FROM {name}_r
    WHERE len(list_filter(begins, lambda k: NOT list_contains(starts, p[k]))) <= {1 + n // 2})"""


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns or ("score",)})


@query(f"""
WITH RECURSIVE {scores("s", "SELECT p_partkey AS id, p_name AS text FROM part", "rwi")}
SELECT p_brand, p_partkey, p_name, CAST(round(score, 6) AS DOUBLE) AS score, CAST(rank AS BIGINT) AS rank FROM (SELECT p_brand, p_partkey, p_name, score, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_name, p_partkey) AS rank FROM part JOIN s ON id = p_partkey) WHERE rank <= 6
""")
def fuzzy_topk(spark, sf_dir):
    rows = search.scored(table(spark, sf_dir, "part"), search.fuzzy("r wi", F.col("p_name")))
    return rounded(longs(search.top_by_kind(rows, "p_brand", 6, F.desc("score"), F.col("p_name"), F.col("p_partkey")).select("p_brand", "p_partkey", "p_name", "score", "rank"), "rank"))


BASES = f"SELECT id, regexp_extract(path, '([^/]*)$', 1) AS text FROM ({told(FILES)})"


@query(f"""
WITH RECURSIVE {scores("w", f"SELECT id, path AS text FROM ({told(FILES)})", "libts")}, {scores("b", BASES, "libts")}
SELECT w.id, w.text AS path, CAST(round(CASE WHEN b.score + 20 >= w.score THEN b.score + 20 WHEN contains(w.text, '/') THEN w.score ELSE w.score + 20 END, 6) AS DOUBLE) AS score FROM w LEFT JOIN b ON b.id = w.id
""")
def path_scores(spark, sf_dir):
    found = search.scored(sql(spark, sf_dir, FILES, "part"), search.fuzzy_path("lib ts", F.col("path")))
    return rounded(found)


@query(f"""
WITH RECURSIVE {scores("n", "SELECT p_partkey AS id, p_name AS text FROM part", "ob")}, {scores("q", "SELECT p_partkey AS id, p_brand || '.' || p_name AS text FROM part", "ob")}
SELECT p_partkey AS id, CAST(round(greatest(n.score + 10, q.score) + CASE WHEN p_size % 2 = 0 THEN 5 ELSE 0 END, 6) AS DOUBLE) AS score FROM part LEFT JOIN n ON n.id = p_partkey LEFT JOIN q ON q.id = p_partkey WHERE n.score IS NOT NULL OR q.score IS NOT NULL
""")
def symbol_scores(spark, sf_dir):
    score = search.fuzzy_symbol("ob", F.col("p_name"), F.concat_ws(".", "p_brand", "p_name"), F.col("p_size") % 2 == 0)
    return rounded(search.scored(table(spark, sf_dir, "part"), score).select(F.col("p_partkey").alias("id"), "score"))


@query(f"""
WITH RECURSIVE {scores("n", "SELECT p_partkey AS id, p_brand AS text FROM part", "d1")}
SELECT p_partkey AS id, CAST(round(coalesce(n.score, CASE WHEN contains(lower(p_name), 'd1') THEN 30.0 END), 6) AS DOUBLE) AS score FROM part JOIN n ON n.id = p_partkey
UNION ALL SELECT p_partkey, 30::DOUBLE FROM part WHERE p_partkey NOT IN (SELECT id FROM n) AND contains(lower(p_type || ' d1 ' || p_name), 'd1')
""")
def component_scores(spark, sf_dir):
    score = search.fuzzy_component("d1", F.col("p_brand"), F.concat_ws(" ", "p_type", F.lit("d1"), "p_name"))
    return rounded(search.scored(table(spark, sf_dir, "part"), score).select(F.col("p_partkey").alias("id"), "score"))


@query("""
SELECT o_orderkey AS id, CASE WHEN o_orderkey = 12 THEN 200::DOUBLE ELSE 120 END + CASE WHEN o_orderstatus = 'O' THEN 10 ELSE 0 END AS score FROM orders WHERE starts_with(CAST(o_orderkey AS VARCHAR), '12')
""")
def number_scores(spark, sf_dir):
    score = search.fuzzy_number("#12", F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus") == "O")
    return search.scored(table(spark, sf_dir, "orders"), score).select(F.col("o_orderkey").alias("id"), "score")


@query(f"""
WITH RECURSIVE c AS (SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'dc1e' ELSE '' END || substr(sha256(CAST(event_id AS VARCHAR)), 1, 36) AS sha, event_type AS subject FROM events), {scores("s", "SELECT id, substr(sha, 1, 7) || ' ' || subject AS text FROM c", "dc1e")}
SELECT c.id, CAST(round(CASE WHEN starts_with(sha, 'dc1e') THEN 150.0 ELSE s.score END, 6) AS DOUBLE) AS score FROM c LEFT JOIN s ON s.id = c.id WHERE starts_with(sha, 'dc1e') OR s.score IS NOT NULL
""")
def commit_scores(spark, sf_dir):
    sha = F.concat(F.when(F.col("event_type") == "error", "dc1e").otherwise(""), F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 36))
    return rounded(search.scored(table(spark, sf_dir, "events"), search.fuzzy_commit("dc1e", sha, F.col("event_type"))).select(F.col("event_id").alias("id"), "score"))


@query(f"""
WITH RECURSIVE {scores("s", "SELECT p_partkey AS id, p_name AS text FROM part", "bolt")}, {scores("e", "SELECT p_partkey AS id, p_type || ' ' || p_brand AS text FROM part", "bolt")}
SELECT p_partkey AS id, CAST(round(coalesce(s.score, 0.6 * e.score) + CASE p_size % 4 WHEN 0 THEN 30 WHEN 1 THEN 20 WHEN 2 THEN 5 ELSE -10 END - CASE WHEN p_size > 40 THEN 40 ELSE 0 END - CASE WHEN p_size < 5 THEN 10 ELSE 0 END, 6) AS DOUBLE) AS score
FROM part LEFT JOIN s ON s.id = p_partkey LEFT JOIN e ON e.id = p_partkey WHERE s.score IS NOT NULL OR e.score IS NOT NULL
""")
def finding_scores(spark, sf_dir):
    assessment = F.element_at(F.array(*map(F.lit, ("defect", "concern", "unknown", "ok"))), F.col("p_size") % 4 + 1)
    score = search.fuzzy_finding("bolt", F.col("p_name"), F.concat_ws(" ", "p_type", "p_brand"), assessment, F.col("p_size") > 40, F.col("p_size") < 5)
    return rounded(search.scored(table(spark, sf_dir, "part"), score).select(F.col("p_partkey").alias("id"), "score"))


@query(f"""
WITH RECURSIVE {scores("s", "SELECT p_partkey AS id, p_type || ' /' || p_name AS text FROM part", "sbo")}, {scores("h", "SELECT p_partkey AS id, p_brand || p_name AS text FROM part", "sbo")}
SELECT p_partkey AS id, CAST(round(coalesce(s.score, CASE WHEN h.score IS NOT NULL THEN 40.0 END), 6) AS DOUBLE) AS score FROM part LEFT JOIN s ON s.id = p_partkey LEFT JOIN h ON h.id = p_partkey WHERE s.score IS NOT NULL OR h.score IS NOT NULL
""")
def endpoint_scores(spark, sf_dir):
    score = search.fuzzy_endpoint("sbo", F.concat_ws(" /", "p_type", "p_name"), F.concat("p_brand", "p_name"))
    return rounded(search.scored(table(spark, sf_dir, "part"), score).select(F.col("p_partkey").alias("id"), "score"))


ALL_SQL = """things AS (SELECT 'table' AS kind, 't' || p_partkey AS key, p_name AS title, p_brand AS path FROM part UNION ALL SELECT 'env', 'e' || s_suppkey, s_name, 'Brand#' || s_nationkey FROM supplier UNION ALL SELECT 'infra', 'i' || n_nationkey, n_name, 'none' FROM nation)"""


@query(f"""
WITH RECURSIVE {ALL_SQL}, {scores("s", "SELECT key AS id, title AS text FROM things", "er")}, history AS (SELECT 't' || l_partkey AS key, count(*) AS uses, max(l_shipdate) > TIMESTAMP '2001-01-01' AS recent FROM lineitem WHERE l_quantity > 40 GROUP BY 1),
touched AS (SELECT DISTINCT p_brand AS path FROM part WHERE p_size = 1),
scored AS (SELECT kind, t.key, title, s.score + CASE WHEN h.key IS NULL THEN 0 ELSE 3 * least(uses, 10) + CASE WHEN recent THEN 10 ELSE 0 END END + CASE WHEN t.path IN (SELECT path FROM touched) THEN 40 ELSE 0 END + CASE kind WHEN 'table' THEN 5 ELSE 4 END AS score FROM things t JOIN s ON s.id = t.key LEFT JOIN history h ON h.key = t.key)
SELECT kind, key, title, CAST(round(score, 6) AS DOUBLE) AS score, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, title, key) AS rank FROM scored) WHERE rank <= 6
""")
def search_all_kinds(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    thing = lambda df, kind, key, title, path: search.scored(df, search.fuzzy("er", title)).select(F.lit(kind).alias("kind"), key.alias("key"), title.alias("title"), path.alias("path"), "score")
    sources = [
        thing(parts, "table", F.concat(F.lit("t"), "p_partkey"), F.col("p_name"), F.col("p_brand")),
        thing(table(spark, sf_dir, "supplier"), "env", F.concat(F.lit("e"), "s_suppkey"), F.col("s_name"), F.concat(F.lit("Brand#"), "s_nationkey")),
        thing(table(spark, sf_dir, "nation"), "infra", F.concat(F.lit("i"), "n_nationkey"), F.col("n_name"), F.lit("none")),
    ]
    picked = table(spark, sf_dir, "lineitem").where("l_quantity > 40").groupBy(F.concat(F.lit("t"), "l_partkey").alias("key")).agg(F.count("*").alias("uses"), (F.max("l_shipdate") > F.expr("timestamp_ntz'2001-01-01'")).alias("recent"))
    return rounded(longs(search.search_all(sources, picked, parts.where("p_size = 1").select(F.col("p_brand").alias("path"))), "rank"))


@query("""
SELECT p_brand, p_partkey, CAST(tier AS BIGINT) AS tier FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY tier, p_name, p_type, p_partkey) AS n FROM (SELECT *, CASE WHEN p_name = 'Red' THEN 0 WHEN p_type = 'Red' THEN 1 WHEN lower(p_name) = 'red' THEN 2 WHEN lower(p_type) = 'red' THEN 3
    WHEN contains(lower(p_name), 'red') THEN 4 WHEN contains(lower(p_type), 'red') THEN 5 END AS tier FROM part) WHERE tier IS NOT NULL) WHERE n = 1
""")
def best_matches(spark, sf_dir):
    found = search.best_match(table(spark, sf_dir, "part"), "Red", ["p_name", "p_type"], ["p_brand"], F.col("p_partkey"))
    return longs(found.select("p_brand", "p_partkey", "tier"), "tier")


@query("SELECT p_partkey FROM part WHERE lower(p_name) = 'red bolt'")
def declaration_lookup(spark, sf_dir):
    return search.declarations_named(table(spark, sf_dir, "part").withColumnRenamed("p_name", "qualified"), "Red Bolt").select("p_partkey")


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%a%e%' ORDER BY p_name, p_partkey LIMIT 40")
def search_candidates(spark, sf_dir):
    return search.candidates(table(spark, sf_dir, "part"), "ae", "p_name", 40, F.col("p_partkey")).select("p_partkey", "p_name")
