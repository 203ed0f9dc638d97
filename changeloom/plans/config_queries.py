"""Settings and stored results: nested values, overlays, image stages, exports, users of changed symbols, a stored analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeloom.checkpoints import new_path
from changeloom.operators import exports, images, nested, stored, symbols
from changeloom.plans.registry import query, table
from changeloom.plans.standins import sql, told


@query("SELECT event_id, 'k' AS name, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def event_attributes(spark, sf_dir):
    return nested.attributes(table(spark, sf_dir, "events"), "props", ["event_id"])


#: Manifests: an object with a list of named objects, a list of values, a null, and every ninth a bare value.
MANIFESTS = """SELECT p_partkey AS id, (CASE WHEN p_partkey % 9 = 0 THEN CAST(p_size AS varchar(9)) ELSE '{"spec":{"replicas":' || CAST(p_size AS varchar(9)) || ',"containers":[{"name":"' || p_type || '","port":' || CAST(p_partkey AS varchar(12)) || '},{"name":"side"},' ||
    '{"image":"' || p_name || '","env":[{"name":"A","value":"x  y"}]}]},"tags":["a",null,"' || p_brand || '"],"gone":null}' END) AS json, p_size, p_type, p_partkey, p_name, p_brand FROM {part}"""
M = f"m AS (SELECT * FROM ({told(MANIFESTS)}) WHERE id % 9 <> 0)"


@query(f"""
WITH {M}
SELECT id, 'value' AS name, json AS value FROM ({told(MANIFESTS)}) WHERE id % 9 = 0
UNION ALL SELECT id, 'spec.replicas', CAST(p_size AS VARCHAR) FROM m UNION ALL SELECT id, 'spec.containers[' || p_type || '].port', CAST(p_partkey AS VARCHAR) FROM m UNION ALL SELECT id, 'spec.containers[side]', 'side' FROM m
UNION ALL SELECT id, 'spec.containers[2].image', p_name FROM m UNION ALL SELECT id, 'spec.containers[2].env[A].value', 'x y' FROM m UNION ALL SELECT id, 'tags', '["a",null,"' || p_brand || '"]' FROM m
""")
def manifest_attributes(spark, sf_dir):
    return nested.attributes(sql(spark, sf_dir, MANIFESTS, "part"), "json", ["id"])


#: Edits of records by brand in six layers, dev on qa on base, prod on eu on base and on shared.
EDITS = """SELECT (CASE p_partkey % 6 WHEN 0 THEN 'base' WHEN 1 THEN 'qa' WHEN 2 THEN 'dev' WHEN 3 THEN 'eu' WHEN 4 THEN 'prod' ELSE 'shared' END) AS layer, p_brand AS record, (CASE p_size % 6 WHEN 0 THEN 'spec' WHEN 1 THEN 'spec.' || lower(p_type) WHEN 2 THEN 'spec.list[a].x'
    WHEN 3 THEN 'spec.list[b].x' WHEN 4 THEN 'spec.list' ELSE 'meta.' || lower(p_type) || '.y' END) AS name, (CASE WHEN p_size % 6 = 0 THEN (CASE WHEN p_partkey % 3 = 0 THEN 'remove' ELSE 'set' END) WHEN p_size % 6 = 4 THEN 'replace' ELSE 'set' END) AS action,
    (CASE WHEN p_size % 6 IN (0, 4) OR p_size = 11 THEN NULL ELSE CAST(p_size AS varchar(9)) END) AS value FROM {part} WHERE p_size % 7 <> 3"""
BASES = [("dev", "qa"), ("qa", "base"), ("prod", "eu"), ("eu", "base"), ("eu", "shared")]
CHAIN = {"base": "base", "shared": "shared", "qa": "base qa", "dev": "base qa dev", "eu": "base shared eu", "prod": "base shared eu prod"}
CHAIN_SQL = ", ".join(f"('{env}', '{layer}', {n})" for env, layers in CHAIN.items() for n, layer in enumerate(layers.split(), 1))


@query(f"""
WITH edits AS ({told(EDITS)}), chain(env, layer, nth) AS (VALUES {CHAIN_SQL}), placed AS (
    SELECT env, record, name, action, value, nth FROM edits JOIN chain USING (layer)
), sets AS (
    SELECT env, record, name, nth, max(value) AS value FROM placed WHERE action <> 'remove' AND value IS NOT NULL GROUP BY ALL
)
SELECT env, record, name, arg_max(value, nth) AS value FROM sets s WHERE NOT EXISTS (
    SELECT 1 FROM placed p WHERE p.env = s.env AND p.record = s.record AND p.nth > s.nth AND (p.action <> 'set' OR p.value IS NULL) AND (s.name = p.name OR starts_with(s.name, p.name || '.') OR starts_with(s.name, p.name || '['))
) AND NOT EXISTS (
    SELECT 1 FROM sets p WHERE p.env = s.env AND p.record = s.record AND p.nth > s.nth AND (starts_with(s.name, p.name || '.') OR starts_with(s.name, p.name || '[') OR starts_with(p.name, s.name || '.') OR starts_with(p.name, s.name || '['))
) GROUP BY env, record, name
""")
def overlay_values(spark, sf_dir):
    bases = spark.createDataFrame(BASES, "layer string, base string")
    return nested.overlaid(sql(spark, sf_dir, EDITS, "part"), nested.chain_of(bases))


#: Stages of a file by brand, in the order of the parts; few names, so that they are used again; bases are names or images.
STAGES = """SELECT p_brand AS file, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS int) AS stage, (CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 2 = 0 THEN lower(p_type) ELSE p_type END) AS name,
    (CASE WHEN p_size % 3 = 0 THEN p_name ELSE upper(p_type) END) AS base, (CASE p_size % 4 WHEN 0 THEN 'medium' WHEN 1 THEN '2' WHEN 2 THEN 'nowhere' END) AS source FROM {part} WHERE p_partkey < 1000"""


@query(f"""
WITH RECURSIVE s AS ({told(STAGES)}), uses AS (
    SELECT file, stage, base AS name, 'from' AS via FROM s UNION ALL SELECT file, stage, source, 'copy' FROM s WHERE source IS NOT NULL
), edges AS (
    SELECT u.file, u.stage, u.via, max(p.stage) AS parent FROM uses u JOIN s p ON p.file = u.file AND p.stage < u.stage AND (lower(p.name) = lower(u.name) OR CAST(p.stage AS VARCHAR) = u.name) GROUP BY ALL
), walk AS (
    SELECT file, max(stage) AS stage, 0 AS hops, 'from' AS via FROM s GROUP BY file
    UNION SELECT w.file, e.parent, w.hops + 1, CASE WHEN w.via = 'copy' OR e.via = 'copy' THEN 'copy' ELSE 'from' END FROM walk w JOIN edges e ON w.file = e.file AND w.stage = e.stage
)
SELECT file, stage, min(hops) AS hops, max(via) AS via FROM walk GROUP BY file, stage
""")
def image_stages(spark, sf_dir):
    s = sql(spark, sf_dir, STAGES, "part")
    return images.final_image(s.select("file", "stage", "name", "base"), s.where("source IS NOT NULL").select("file", "stage", "source"))


#: Patterns, requests and files of a package by brand.
PATTERNS = """SELECT p_brand AS package, (CASE p_size % 6 WHEN 0 THEN '.' WHEN 1 THEN './' || lower(p_type) WHEN 2 THEN './*' WHEN 3 THEN './' || left(lower(p_type), 2) || '*' WHEN 4 THEN './' || left(lower(p_type), 2) || '*.js' ELSE './*.js' END) AS pattern,
    (CASE p_size % 6 WHEN 0 THEN './index.js' WHEN 1 THEN './src/' || lower(p_type) || '.js' WHEN 2 THEN './lib/*' WHEN 3 THEN './src/' || left(lower(p_type), 2) || '*' WHEN 4 THEN './js/*.ts' ELSE 'src/*.js' END) AS target FROM {part}"""
REQUESTS = "SELECT DISTINCT p_brand AS package, (CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN lower(p_type) WHEN 2 THEN lower(p_type) || '.js' ELSE 'x/' || lower(p_type) END) AS subpath FROM {part}"
PATHS = "SELECT DISTINCT p_brand AS package, (CASE p_partkey % 5 WHEN 0 THEN 'index.js' WHEN 1 THEN 'src/' || lower(p_type) || '.js' WHEN 2 THEN 'lib/x/' || lower(p_type) WHEN 3 THEN 'js/' || substr(lower(p_type), 3) || '.ts' ELSE 'lib/' || lower(p_type) END) AS path FROM {part} WHERE p_partkey % 3 = 0"


@query(f"""
WITH x AS (SELECT DISTINCT * FROM ({told(PATTERNS)})), r AS (
    SELECT *, CASE WHEN subpath IS NULL THEN '.' ELSE './' || subpath END AS key FROM ({told(REQUESTS)})
), met AS (
    SELECT r.package, r.subpath, pattern, target, '' AS star, 0 AS a, 0 AS b FROM r JOIN x ON x.package = r.package AND x.pattern = r.key
    UNION ALL SELECT r.package, r.subpath, pattern, target, substr(key, instr(pattern, '*'), length(key) - length(pattern) + 1), instr(pattern, '*'), length(pattern) - instr(pattern, '*') FROM r JOIN x ON x.package = r.package AND instr(pattern, '*') > 0
        AND starts_with(key, split_part(pattern, '*', 1)) AND ends_with(key, split_part(pattern, '*', 2)) AND length(key) >= length(pattern) - 1 WHERE NOT EXISTS (SELECT 1 FROM x e WHERE e.package = r.package AND e.pattern = r.key)
), there AS (
    SELECT m.*, f.path FROM met m JOIN ({told(PATHS)}) f ON f.package = m.package AND f.path = regexp_replace(replace(target, '*', star), '^\\./', '')
), best AS (
    SELECT * FROM there QUALIFY row_number() OVER (PARTITION BY package, subpath ORDER BY a DESC, b DESC, pattern, path) = 1
)
SELECT r.package, r.subpath, pattern, path AS file FROM r LEFT JOIN best b ON b.package = r.package AND b.subpath IS NOT DISTINCT FROM r.subpath
""")
def export_targets(spark, sf_dir):
    return exports.resolved(*[sql(spark, sf_dir, s, "part") for s in (REQUESTS, PATTERNS, PATHS)])


#: Declarations of a brand's file at two times; bodies name other declarations.
DECLARED = """SELECT p_brand AS file, 'fn' || CAST(p_partkey AS varchar(12)) AS name, 'body of  ' || p_name || ' calls fn' || CAST(p_partkey - {step} AS varchar(12)) || '(x) and $fn' || CAST(p_partkey AS varchar(12)) || {edit} AS text, p_partkey % 3 > 0 AS callable, p_size % 4 > 0 AS exported FROM {part} WHERE {which}"""
OLD = DECLARED.replace("{step}", "25").replace("{edit}", "''").replace("{which}", "p_partkey % 11 > 0")
NEW = DECLARED.replace("{step}", "(CASE WHEN p_partkey % 13 = 0 THEN 50 ELSE 25 END)").replace("{edit}", "(CASE WHEN p_partkey % 17 = 0 THEN ' ' ELSE '' END)").replace("{which}", "p_partkey % 10 > 0")


@query(f"""
WITH b AS ({told(OLD)}), h AS ({told(NEW)}), plain AS (
    SELECT coalesce(h.file, b.file) AS file, coalesce(h.name, b.name) AS name, h.text, h.callable AND h.exported AS offered,
        CASE WHEN b.name IS NULL THEN 'added' WHEN h.name IS NULL THEN 'removed' WHEN trim(regexp_replace(b.text, '\\s+', ' ', 'g')) <> trim(regexp_replace(h.text, '\\s+', ' ', 'g')) THEN 'modified' END AS change
    FROM b FULL JOIN h ON b.file = h.file AND b.name = h.name
)
SELECT file, name, change, NULL AS via FROM plain WHERE change IS NOT NULL
UNION ALL SELECT u.file, u.name, 'via', min(c.name) FROM plain u JOIN plain c ON u.file = c.file AND c.change IS NOT NULL AND u.change IS NULL AND u.offered AND c.name <> u.name AND regexp_matches(u.text, '\\b' || c.name || '\\b') GROUP BY ALL
""")
def changed_callers(spark, sf_dir):
    return symbols.changed_symbols(sql(spark, sf_dir, OLD, "part"), sql(spark, sf_dir, NEW, "part"))


@query("SELECT p_brand AS module, count(*) AS files, count(DISTINCT p_type) AS kinds FROM part GROUP BY p_brand")
def stored_analysis(spark, sf_dir):
    """Saved twice, the second time right: what is read is the second."""
    root, part = new_path(spark, "analysis"), table(spark, sf_dir, "part")
    files = part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("module"), F.col("p_type").alias("kind"))
    stored.save(root, "shop", "c1", {"files": files.where("id % 2 = 0")})
    stored.save(root, "shop", "c2", {"files": files})
    return stored.load(spark, root, "shop", "files").groupBy("module").agg(F.count("*").alias("files"), F.count_distinct("kind").alias("kinds"))
