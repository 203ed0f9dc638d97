"""Schema histories and catalogs: renames, trial pairs, merged sources and drift, over parts as tables and columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeloom.operators import migrations
from changeloom.plans.registry import query
from changeloom.plans.standins import sql, told

#: Operations by brand: a migration for each size; chains of renames of tables by type and of columns.
HISTORY = """SELECT p_brand AS database, p_size AS ord, p_partkey AS seq,
    CASE p_partkey % 5 WHEN 0 THEN 'create_table' WHEN 1 THEN 'rename_table' WHEN 2 THEN 'rename_column' WHEN 3 THEN 'rename_column' ELSE 'rename_table' END AS op,
    't' || CAST(p_partkey % 11 AS varchar(9)) AS "table", 'c' || CAST(p_size % 4 AS varchar(9)) AS "column", (CASE WHEN p_partkey % 5 IN (2, 3) THEN 'c' || CAST((p_size + 1) % 4 AS varchar(9)) ELSE 't' || CAST(p_partkey % 7 AS varchar(9)) END) AS "to" FROM {part}"""

RENAMES_SQL = f"""
WITH RECURSIVE ops AS (
    SELECT *, row_number() OVER (PARTITION BY database ORDER BY ord, seq) AS pos FROM ({told(HISTORY)})
), moves AS (
    SELECT * FROM ops m WHERE op = 'rename_table' AND "table" <> "to" AND NOT EXISTS (SELECT 1 FROM ops c WHERE c.op = 'create_table' AND c.database = m.database AND c.ord = m.ord AND c."table" = m."table" AND c.pos < m.pos)
), marks AS (
    SELECT database, "table" AS name, pos, 'left' AS what FROM moves UNION ALL SELECT database, "to", pos, 'came' FROM moves UNION ALL SELECT database, "table", pos, 'made' FROM ops WHERE op = 'create_table'
), linked AS (
    SELECT m.*, (SELECT arg_max(CASE WHEN k.what = 'came' THEN k.pos END, k.pos) FROM marks k WHERE k.database = m.database AND k.name = m."table" AND k.pos < m.pos AND k.what = 'came'
        AND k.pos = (SELECT max(l.pos) FROM marks l WHERE l.database = m.database AND l.name = m."table" AND l.pos < m.pos)) AS back FROM moves m
), walked AS (
    SELECT database, pos, pos AS root, "table" AS first, "to" AS now FROM linked WHERE back IS NULL
    UNION ALL SELECT l.database, l.pos, w.root, w.first, l."to" FROM linked l JOIN walked w ON l.database = w.database AND l.back = w.pos
), ends AS (
    SELECT database, root, first, arg_max(now, pos) AS last FROM walked GROUP BY ALL
), renamed AS (
    SELECT c.*, (SELECT arg_max(CASE k.what WHEN 'came' THEN 'chain' ELSE k.what END || ':' || CAST(k.pos AS VARCHAR), k.pos) FROM marks k WHERE k.database = c.database AND k.name = c."table" AND k.pos < c.pos) AS means
    FROM ops c WHERE op = 'rename_column' AND "column" <> "to"
), placed AS (
    SELECT r.database, r.pos, r."column" AS old, r."to" AS new, coalesce(w.first, r."table") AS tbl, CASE WHEN means LIKE 'made:%' THEN means END AS made
    FROM renamed r LEFT JOIN walked w ON means = 'chain:' || CAST(w.pos AS VARCHAR) AND w.database = r.database
), steps AS (
    SELECT p.*, (SELECT max(q.pos) FROM placed q WHERE q.database = p.database AND q.tbl = p.tbl AND q.made IS NOT DISTINCT FROM p.made AND q.new = p.old AND q.pos < p.pos
        AND NOT EXISTS (SELECT 1 FROM placed z WHERE z.database = p.database AND z.tbl = p.tbl AND z.made IS NOT DISTINCT FROM p.made AND z.old = p.old AND z.pos > q.pos AND z.pos < p.pos)) AS back FROM placed p
), follow AS (
    SELECT database, tbl, made, pos, pos AS root, old AS first, new AS now FROM steps WHERE back IS NULL
    UNION ALL SELECT s.database, s.tbl, s.made, s.pos, f.root, f.first, s.new FROM steps s JOIN follow f ON s.database = f.database AND s.back = f.pos
), done AS (
    SELECT database, tbl, made, root, first, arg_max(now, pos) AS last FROM follow GROUP BY ALL
)
SELECT database, 'table' AS kind, last AS "table", first AS "from", last AS "to" FROM ends WHERE first <> last
UNION ALL SELECT d.database, 'column', coalesce(e.last, d.tbl), d.first, d.last FROM done d LEFT JOIN ends e ON d.database = e.database AND d.tbl = e.first AND d.made IS NULL WHERE d.first <> d.last
"""


@query(RENAMES_SQL)
def schema_renames(spark, sf_dir):
    return migrations.renames(sql(spark, sf_dir, HISTORY.replace('"', "`"), "part"))


#: Files of a folder by brand: schemas that make tables and columns, logs that add and drop columns.
FILES = """SELECT p_brand AS folder, 'f' || CAST(p_partkey % 3 AS varchar(9)) AS file, 0 AS ord, p_partkey AS seq,
    CASE p_size % 4 WHEN 0 THEN 'drop_column' WHEN 1 THEN 'rename_column' ELSE 'add_column' END AS op, 't' || CAST(CAST(floor(p_partkey / 3) AS int) % 4 AS varchar(9)) AS "table", 'c' || CAST(p_size % 9 AS varchar(9)) AS "column", 'd' || CAST(p_size % 9 AS varchar(9)) AS "to", p_type AS type, true AS nullable FROM {part}"""


def folders(spark, sf_dir):
    """(schemas, logs): of each brand three of each; a schema makes its tables and what some of its operations add."""
    logs = sql(spark, sf_dir, FILES.replace('"', "`"), "part")
    adds = logs.where("op = 'add_column' AND seq % 2 = 0")
    made = adds.select("folder", "file", "table").distinct().select("folder", "file", F.lit(-1).alias("ord"), F.lit(0).cast("long").alias("seq"), F.lit("create_table").alias("op"), "table", F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("to"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("boolean").alias("nullable"))
    return made.unionByName(adds), logs


@query()
def schema_log_trials(spark, sf_dir):
    return migrations.tried(*folders(spark, sf_dir))


@query()
def schema_log_pairs(spark, sf_dir):
    return migrations.matched(migrations.tried(*folders(spark, sf_dir)))


#: Three sources of one schema, by which parts each of them knows.
SOURCE = """SELECT p_brand AS database, p_type AS "table", (CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE 'c' || CAST(p_size % 12 AS varchar(9)) END) AS "column", {kind} AS type, {null} AS nullable FROM {part} WHERE {which}"""
PARTS = (("'int'", "p_size % 2 = 0", "p_partkey % 3 <> 0 AND p_brand <> 'Brand#11' AND p_brand <> 'Brand#12'"), ("CASE WHEN p_size % 5 = 0 THEN 'text' END", "p_size % 3 = 0", "p_partkey % 5 < 3 AND p_brand <> 'Brand#12'"), ("'num'", "CASE WHEN p_size % 7 > 0 THEN true END", "p_partkey % 7 < 5 AND p_brand <> 'Brand#13'"))
SOURCES = [SOURCE.replace("{kind}", k).replace("{null}", n).replace("{which}", w) for k, n, w in PARTS]
ROWS = " UNION ALL ".join(f"SELECT *, {n} AS nth FROM ({told(s)})" for n, s in enumerate(SOURCES))


def sources(spark, sf_dir):
    return [sql(spark, sf_dir, s.replace('"', "`"), "part") for s in SOURCES]


@query(f"""
WITH rows AS ({ROWS})
SELECT database, "table", "column", ['migration', 'schema', 'model'][min(nth) + 1] AS source, arg_min(type, nth) FILTER (WHERE type IS NOT NULL) AS type, ['migration', 'schema', 'model'][min(nth) FILTER (WHERE type IS NOT NULL) + 1] AS type_source,
    min(CAST(nullable AS INT)) FILTER (WHERE nth = least_null) = 1 AS nullable, ['migration', 'schema', 'model'][any_value(least_null) + 1] AS nullable_source
FROM (SELECT *, min(CASE WHEN nullable IS NOT NULL THEN nth END) OVER (PARTITION BY database, "table", "column") AS least_null FROM rows WHERE "column" IS NOT NULL) GROUP BY ALL
""")
def schema_catalog(spark, sf_dir):
    return migrations.catalog(*sources(spark, sf_dir))


@query(f"""
WITH rows AS ({ROWS}), exact AS (
    SELECT database, CASE WHEN min(nth) < 2 THEN min(nth) END AS exact FROM rows GROUP BY database HAVING min(nth) < 2
), t AS (
    SELECT DISTINCT database, "table", nth FROM rows
), c AS (
    SELECT DISTINCT database, "table", "column", nth FROM rows WHERE "column" IS NOT NULL
), lower AS (
    SELECT database, exact, nth FROM exact, range(1, 3) r(nth) WHERE nth > exact
)
SELECT l.database, t."table", NULL AS "column", ['migration', 'schema', 'model'][l.nth + 1] AS source, 'model-no-table' AS kind FROM lower l JOIN t ON t.database = l.database AND t.nth = l.nth AND NOT EXISTS (SELECT 1 FROM t e WHERE e.database = l.database AND e.nth = exact AND e."table" = t."table")
UNION ALL
SELECT l.database, t."table", NULL, 'model', 'table-no-model' FROM lower l JOIN t ON t.database = l.database AND t.nth = exact WHERE l.nth = 2 AND EXISTS (SELECT 1 FROM t m WHERE m.database = l.database AND m.nth = 2) AND NOT EXISTS (SELECT 1 FROM t e WHERE e.database = l.database AND e.nth = 2 AND e."table" = t."table")
UNION ALL
SELECT l.database, c."table", c."column", ['migration', 'schema', 'model'][l.nth + 1], 'field-no-column' FROM lower l JOIN c ON c.database = l.database AND c.nth = l.nth JOIN t ON t.database = l.database AND t.nth = exact AND t."table" = c."table"
WHERE NOT EXISTS (SELECT 1 FROM c e WHERE e.database = l.database AND e.nth = exact AND e."table" = c."table" AND e."column" = c."column")
UNION ALL
SELECT l.database, c."table", c."column", ['migration', 'schema', 'model'][l.nth + 1], 'column-no-field' FROM lower l JOIN c ON c.database = l.database AND c.nth = exact JOIN t ON t.database = l.database AND t.nth = l.nth AND t."table" = c."table"
WHERE NOT EXISTS (SELECT 1 FROM c e WHERE e.database = l.database AND e.nth = l.nth AND e."table" = c."table" AND e."column" = c."column")
""")
def schema_drift(spark, sf_dir):
    return migrations.drift(*sources(spark, sf_dir))
