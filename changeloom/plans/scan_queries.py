"""Facts read back from texts that are put together from the given tables; the SQL takes them from the tables themselves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from changeloom.operators import relational, scans
from changeloom.plans.registry import query, table
from changeloom.plans.standins import longs


def joined(rows, key: Column, order: list[str], part: Column, before: str = "", after: str = "", between: str = "\n"):
    """One text of each key: its rows' parts in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(*order, part.alias("part")))), lambda x: x["part"])
    return relational.dealt(rows, key).groupBy(key.alias("report")).agg(F.concat(F.lit(before), F.array_join(parts, between), F.lit(after)).alias("text"))


LINES = "SELECT l_suppkey AS report, 'src/f' || (l_partkey % 40) AS file, l_linenumber AS line, CAST(max(l_quantity) AS BIGINT) - 10 AS hits FROM lineitem GROUP BY 1, 2, 3"
FOUND = f"SELECT report, file, CAST(line AS BIGINT) AS line, CASE WHEN hits < 0 THEN 0 ELSE hits END AS hits FROM ({LINES})"


def _hits(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("report"), F.concat(F.lit("src/f"), F.col("l_partkey") % 40).alias("file"), F.col("l_linenumber").alias("line")).agg((F.max("l_quantity").cast("long") - 10).alias("hits"))
    return rows.withColumn("hits", F.greatest("hits", F.lit(0)))


def _lcov(rows):
    return joined(rows, F.col("report"), ["file", "line"], F.concat(F.lit("SF:"), "file", F.lit("\nDA:"), "line", F.lit(","), "hits", F.lit("\nend_of_record")))


def _files(rows, part: Column, before: str, after: str, between: str = "\n"):
    """One text of each report and file, then one of each report."""
    return rows.groupBy("report", "file").agg(F.concat(F.lit(before), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", part.alias("part")))), lambda x: x["part"]), between), F.lit(after)).alias("body"))


def _cobertura(rows):
    files = _files(rows, F.concat(F.lit('<line number="'), "line", F.lit('" hits="'), "hits", F.lit('"/>')), "<lines>", "</lines>")
    return joined(files, F.col("report"), ["file"], F.concat(F.lit('<class name="x" filename="'), "file", F.lit('">'), "body", F.lit("</class>")), "<coverage><packages>", "</packages></coverage>")


def _jacoco(rows):
    files = _files(rows, F.concat(F.lit('<line nr="'), "line", F.lit('" mi="1" ci="'), "hits", F.lit('"/>')), "", '<line nr="99" mi="0" ci="0"/>')
    return joined(files, F.col("report"), ["file"], F.concat(F.lit('<package name="src"><sourcefile name="'), F.substr("file", F.lit(5)), F.lit('">'), "body", F.lit("</sourcefile></package>")), "<report>", "</report>")


def _istanbul(rows):
    at = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "hits"))), lambda x: F.concat(F.lit('"'), x["line"], F.lit('":{"start":{"line":'), x["line"], F.lit("}}"))), ",")
    n = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "hits"))), lambda x: F.concat(F.lit('"'), x["line"], F.lit('":'), x["hits"])), ",")
    files = rows.groupBy("report", "file").agg(F.concat(F.lit('"'), F.col("file"), F.lit('":{"path":"'), F.col("file"), F.lit('","statementMap":{'), at, F.lit('},"s":{'), n, F.lit("}}")).alias("body"))
    return joined(files, F.col("report"), ["file"], F.col("body"), "{", "}", ",")


@query(FOUND)
def coverage_formats(spark, sf_dir):
    """A quarter of the suppliers each report in one of the four formats."""
    rows = _hits(spark, sf_dir)
    made = [make(rows.where(f"report % 4 = {i}")) for i, make in enumerate((_lcov, _cobertura, _jacoco, _istanbul))]
    return longs(scans.coverage_lines(made[0].union(made[1]).union(made[2]).union(made[3])), "line")


def _diffs(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    n, name = F.col("o_orderkey") % 4, F.concat(F.lit("f"), "o_orderkey", F.lit(".py"))
    gone = F.col("o_orderstatus") == "P"
    hunk = F.concat(F.lit("@@ -"), F.col("o_orderkey") % 50 + 1, F.lit(","), n + 1, F.when(gone, " +0,0 @@\n").otherwise(F.concat(F.lit(" +"), F.col("o_orderkey") % 70 + 2, F.lit(" @@ def x\n+new\n"))), F.repeat(F.lit("-old\n"), (n + 1).cast("int")))
    text = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\n--- a/"), name, F.when(gone, "\n+++ /dev/null\n").otherwise(F.concat(F.lit("\n+++ b/"), name, F.lit("\n"))), hunk)
    return joined(rows, F.col("o_custkey"), ["o_orderkey"], text, between="").withColumnRenamed("report", "diff_id")


@query("""
SELECT o_custkey AS diff_id, 'f' || o_orderkey || '.py' AS file, 'old' AS side, unnest(range(o_orderkey % 50 + 1, o_orderkey % 50 + o_orderkey % 4 + 2)) AS line FROM orders
UNION ALL SELECT o_custkey, 'f' || o_orderkey || '.py', 'new', o_orderkey % 70 + 2 FROM orders WHERE o_orderstatus <> 'P'
""")
def diff_line_sets(spark, sf_dir):
    return longs(scans.diff_lines(_diffs(spark, sf_dir)), "line")


@query("SELECT o_custkey AS diff_id, 'f' || o_orderkey || '.py' AS path, CAST(o_orderkey % 4 + 1 AS BIGINT) AS removed FROM orders")
def split_diffs(spark, sf_dir):
    return longs(scans.split_diffs(_diffs(spark, sf_dir)).select("diff_id", "path", F.regexp_count("patch", F.lit("(?m)^-old$")).alias("removed")), "removed")


@query("SELECT p_partkey AS id, CAST(2 AS BIGINT) AS line, 'acme/' || replace(p_name, ' ', '-') || ':1' AS image, CASE WHEN p_size % 2 = 0 THEN 'docker/Dockerfile.' || p_size END AS dockerfile FROM part WHERE p_size % 3 > 0")
def image_builds(spark, sf_dir):
    command = F.concat(F.when(F.col("p_size") % 3 == 1, "docker build ").when(F.col("p_size") % 3 == 2, "  docker buildx build --push ").otherwise("docker run "), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("-f docker/Dockerfile."), "p_size")).otherwise(""), F.lit(' --tag "acme/'), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(':1" .'))
    return longs(scans.image_builds(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("set -e\n"), command, F.lit("\ntrue")).alias("text")), "id"), "line")


@query("""
WITH l AS (SELECT o_custkey AS block, o_orderkey AS pos, CASE WHEN o_orderkey % 2 = 0 THEN 'old' ELSE 'new' END AS side, o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN '  x' ELSE ' x' END AS content FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY block, side ORDER BY pos) AS n FROM l)
SELECT block, pos, side FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE b.block = a.block AND b.n = a.n AND b.side <> a.side AND replace(b.content, ' ', '') = replace(a.content, ' ', ''))
""")
def without_space_changes(spark, sf_dir):
    lines = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("block"), F.col("o_orderkey").alias("pos"), F.when(F.col("o_orderkey") % 2 == 0, "old").otherwise("new").alias("side"), F.concat("o_orderpriority", F.when(F.col("o_orderkey") % 3 == 0, "  x").otherwise(" x")).alias("content"))
    return scans.without_space_changes(lines).select("block", "pos", "side")


@query("""
WITH h AS (SELECT l_shipdate AS d, l_returnflag AS name, l_suppkey AS file, l_partkey AS line FROM lineitem), b AS (SELECT * FROM h WHERE line % 4 > 0), m AS (SELECT h.name, h.file FROM (SELECT name, file, count(*) AS n FROM h GROUP BY 1, 2) h LEFT JOIN (SELECT name, file, count(*) AS n FROM b GROUP BY 1, 2) b ON b.name = h.name AND b.file = h.file WHERE h.n > coalesce(b.n, 0))
SELECT name, file, line FROM h WHERE (name, file) IN (SELECT name, file FROM m) AND line % 8 = 0
""")
def added_reads(spark, sf_dir):
    reads = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("name"), F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("line"))
    return scans.added_reads(reads.where("line % 4 > 0"), reads, reads.where("line % 8 = 0").select("file", "line")).select("name", "file", "line")


@query("""
SELECT p_partkey AS id, 'main.t' || p_size AS "table", p_size % 3 = 0 AS write FROM part UNION ALL SELECT p_partkey, replace(p_name, ' ', '_'), p_size % 3 = 0 FROM part
""")
def query_tables(spark, sf_dir):
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    statement = F.concat(F.lit("-- from nowhere\nWITH own AS (SELECT 'x from y' FROM main.T"), "p_size", F.lit(") "), F.when(F.col("p_size") % 3 == 0, "INSERT INTO ").otherwise("SELECT * FROM own JOIN "), name, F.when(F.col("p_size") % 3 == 0, " SELECT * FROM own").otherwise(" USING (id)"))
    return scans.query_tables(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), statement.alias("statement")), "id")


@query("""
SELECT o_orderkey AS id, CAST(1 AS BIGINT) AS line, 'box ' || o_orderstatus AS text FROM orders UNION ALL SELECT o_orderkey, 4, 'Given ' || o_orderpriority || ' When sent Then ' || o_custkey FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 4, 'item ' || o_custkey FROM orders WHERE o_orderkey % 2 = 1
""")
def acceptance_criteria(spark, sf_dir):
    body = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Given "), "o_orderpriority", F.lit("\n- When sent\n  Then "), "o_custkey")).otherwise(F.concat(F.lit("1. item "), "o_custkey", F.lit("\n\n")))
    text = F.concat(F.lit("- [x] box "), "o_orderstatus", F.lit("\n- no item\n## Acceptance criteria\n"), body, F.lit("\n## Notes\n- none"))
    lines = scans.lines_of(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.alias("text")), "text", "id")
    return longs(scans.acceptance_criteria(lines, "id"), "line")


@query("""
WITH l AS (SELECT l_orderkey AS file, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS line, 2 * (l_linenumber % 3) AS d FROM lineitem)
SELECT file, line, coalesce((SELECT min(b.line) - 1 FROM l b WHERE b.file = a.file AND b.line > a.line AND b.d <= a.d), (SELECT max(line) FROM l b WHERE b.file = a.file)) AS last FROM l a WHERE d <= 2
""")
def indented_blocks(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.row_number().over(order).cast("long").alias("line"), F.concat(F.repeat(F.lit("  "), F.col("l_linenumber") % 3), F.lit("x")).alias("content"))
    return scans.indented_blocks(lines, lines.where("content IN ('x', '  x')"), "file")


@query("SELECT p_partkey AS id, 'NAME_' || p_size AS name, p_name AS value, CAST(2 AS BIGINT) AS line FROM part UNION ALL SELECT p_partkey, 'B', '1', 3 FROM part")
def dotenv_sets(spark, sf_dir):
    text = F.concat(F.lit("# comment = no\nexport NAME_"), "p_size", F.lit(' = "'), "p_name", F.lit('"\nB=1\nnot a line'))
    return longs(scans.dotenv_sets(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("text")), "id"), "line")


@query("SELECT p_partkey AS id, CAST(1 AS BIGINT) AS line, 'VAR_' || p_size AS name FROM part UNION ALL SELECT p_partkey, 2, 'DB_URL' FROM part WHERE p_size % 2 = 0")
def env_reads(spark, sf_dir):
    text = F.concat(F.when(F.col("p_size") % 3 == 0, "x = os.getenv('VAR_").when(F.col("p_size") % 3 == 1, "const x = process.env.VAR_").otherwise('let x = env::var("VAR_'), "p_size", F.when(F.col("p_size") % 3 == 0, "')\n").when(F.col("p_size") % 3 == 1, ";\n").otherwise('")\n'), F.when(F.col("p_size") % 2 == 0, 'os.Getenv("DB_URL")').otherwise("getenv(DB_URL)"))
    return longs(scans.env_reads(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("text")), "id"), "line")


@query("SELECT p_partkey AS id, CAST(1 AS BIGINT) AS line, 'A.B' || p_size AS name, NULL AS fallback FROM part UNION ALL SELECT p_partkey, 2, 'C', p_name FROM part")
def config_placeholders(spark, sf_dir):
    text = F.concat(F.lit("url: http://${A.B"), "p_size", F.lit("}/x\nname: ${C:"), "p_name", F.lit("} $D"))
    return longs(scans.placeholders(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("text")), "id"), "line")


@query("""
SELECT p_partkey AS id, CAST(0 AS BIGINT) AS stage, CAST(1 AS BIGINT) AS nth, 'FROM' AS instruction, 'node:' || p_size || ' AS build' AS value FROM part UNION ALL SELECT p_partkey, 0, 2, 'RUN', 'npm ci &&  npm run ' || p_name FROM part
UNION ALL SELECT p_partkey, 1, 3, 'FROM', 'scratch' FROM part UNION ALL SELECT p_partkey, 1, 4, 'COPY', '--from=build /app /app' FROM part
""")
def dockerfile_stages(spark, sf_dir):
    text = F.concat(F.lit("# base\nFROM node:"), "p_size", F.lit(" AS build\nRUN npm ci && \\\n  npm run "), "p_name", F.lit("\n\nFROM scratch\n  copy --from=build /app /app\n"))
    return longs(scans.dockerfile_instructions(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("text")), "id"), "stage", "nth")


@query("SELECT p_partkey AS id, 'build' AS name, 'tsc -p ' || p_name AS command FROM part UNION ALL SELECT p_partkey, 'test', 'node --test' FROM part WHERE p_size > 20")
def manifest_scripts(spark, sf_dir):
    scripts = F.create_map(F.lit("build"), F.concat(F.lit("tsc -p "), "p_name"))
    both = F.when(F.col("p_size") > 20, F.map_concat(scripts, F.create_map(F.lit("test"), F.lit("node --test")))).otherwise(scripts)
    return scans.manifest_scripts(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.to_json(F.struct(F.col("p_name").alias("name"), both.alias("scripts"))).alias("text")), "id")


@query("""
SELECT c_name AS name, lower(c_name) || '@x.org' AS email, min(o_orderdate)::VARCHAR AS authored_at, CAST(sum(o_orderkey % 90) FILTER (WHERE o_orderkey % 9 > 0) AS BIGINT) AS added, CAST(sum(o_orderkey % 40) FILTER (WHERE o_orderkey % 9 > 0) AS BIGINT) AS removed, count(*) AS files
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2 HAVING count(*) FILTER (WHERE o_orderkey % 9 > 0) > 0
""")
def commit_log_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    stat = F.when(F.col("o_orderkey") % 9 == 0, F.concat(F.lit("-\t-\tb"), "o_orderkey")).otherwise(F.concat_ws("\t", (F.col("o_orderkey") % 90).cast("string"), (F.col("o_orderkey") % 40).cast("string"), F.concat(F.lit("f"), "o_orderkey")))
    texts = rows.groupBy("c_name").agg(F.date_format(F.min("o_orderdate"), "yyyy-MM-dd HH:mm:ss").alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", stat.alias("s")))), lambda x: x["s"]), "\n").alias("stats"), F.count_if(F.col("o_orderkey") % 9 > 0).alias("n")).where("n > 0")
    value = F.concat_ws("\n", F.concat_ws("\x1f", "c_name", F.concat(F.lower("c_name"), F.lit("@x.org")), "at"), "stats")
    return longs(scans.commit_log(texts.select(value.alias("value"))), "files")


@query("SELECT p_partkey AS id, CAST(2 AS BIGINT) AS line, CASE p_size % 4 WHEN 0 THEN 'focus' ELSE 'skip' END AS kind FROM part WHERE p_size % 4 < 3")
def test_marker_lines(spark, sf_dir):
    line = F.when(F.col("p_size") % 4 == 0, "it.only('x')").when(F.col("p_size") % 4 == 1, "describe.skip('x')").when(F.col("p_size") % 4 == 2, "@pytest.mark.skip").otherwise("it('x only skip')")
    return longs(scans.test_markers(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("import x\n"), line).alias("text")), "id"), "line")
