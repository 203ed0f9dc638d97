"""Changes read from patches and graphs of files: contracts, splits of large modules, groups of features."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeloom.operators import contracts, groups, relational, review
from changeloom.plans.registry import query, table
from changeloom.plans.standins import edges, sql, told

#: A patch for each part: one hunk with a function over two lines whose parameters depend on the size; some functions go, and some come again in another part's file.
PATCHES = """SELECT 'src/' || p_brand || '/' || CAST(p_partkey AS varchar(12)) || '.ts' AS path, (CASE WHEN p_partkey % 10 = 9 THEN 'added' ELSE 'modified' END) AS status,
    '@@ -1,5 +1,5 @@' || chr(10) || ' import x' || chr(10) ||
    (CASE WHEN p_partkey % 10 = 9 THEN '+export function job' || CAST(p_partkey - 1 AS varchar(12)) || '(a, ' || p_type || ') {' || chr(10) || '+}'
     ELSE '-export function job' || CAST(p_partkey AS varchar(12)) || '(' || chr(10) || '-  a, ' || p_type || ') {' || chr(10) ||
        (CASE WHEN p_partkey % 10 = 8 THEN '' WHEN p_size % 3 = 0 THEN '+export function job' || CAST(p_partkey AS varchar(12)) || '( a,' || p_type || ' ) {' || chr(10) ELSE '+export function job' || CAST(p_partkey AS varchar(12)) || '(a) {' || chr(10) END) || '   body' || chr(10) || ' }' END) AS patch, p_partkey, p_type, p_size FROM {part}"""


@query(f"""
WITH parts AS (SELECT *, lead(p_type) OVER (ORDER BY p_partkey) AS next_type, lead(path) OVER (ORDER BY p_partkey) AS next_path FROM ({told(PATCHES)})), lost AS (
    SELECT path, p_partkey, 'export function job' || p_partkey || '(' || chr(10) || '  a, ' || p_type || ')' AS before, 'job' || p_partkey AS name, p_type, p_size, next_type, next_path FROM parts WHERE status = 'modified'
)
SELECT path, name, 'callable' AS kind, 'changed' AS change, before, 'export function ' || name || '(a)' AS after, NULL AS moved_from FROM lost WHERE p_partkey % 10 <> 8 AND p_size % 3 <> 0
UNION ALL SELECT path, name, 'callable', 'removed', before, NULL, NULL FROM lost WHERE p_partkey % 10 = 8
UNION ALL SELECT next_path, name, 'callable', 'changed', before, 'export function ' || name || '(a, ' || next_type || ')', path FROM lost WHERE p_partkey % 10 = 8 AND next_path IS NOT NULL AND next_type <> p_type
""")
def patch_contracts(spark, sf_dir):
    return contracts.changed_contracts(sql(spark, sf_dir, PATCHES, "part"), whole=True)


#: Lines of other files that call the functions of parts, some of them edited.
CALLS = "SELECT 'lib/' || CAST(l_suppkey AS varchar(12)) || '.ts' AS path, l_orderkey AS line, 'return job' || CAST(l_partkey AS varchar(12)) || '(job' || CAST(l_partkey + 1 AS varchar(12)) || ')' AS content, l_quantity > 45 AS edited FROM {lineitem}"


@query(f"""
WITH parts AS (SELECT *, lead(p_type) OVER (ORDER BY p_partkey) AS next_type, lead(path) OVER (ORDER BY p_partkey) AS next_path FROM ({told(PATCHES)})), c AS (
    SELECT 'job' || p_partkey AS name, path AS contract_path, CASE WHEN p_partkey % 10 = 8 THEN 'removed' ELSE 'changed' END AS change FROM parts WHERE status = 'modified' AND (p_partkey % 10 = 8 OR p_size % 3 <> 0)
    UNION ALL SELECT 'job' || p_partkey, next_path, 'changed' FROM parts WHERE p_partkey % 10 = 8 AND next_path IS NOT NULL AND next_type <> p_type
), calls AS ({told(CALLS)}), w AS (
    SELECT DISTINCT path, line, unnest(regexp_extract_all(content, '[A-Za-z0-9_$]+')) AS name FROM calls
)
SELECT DISTINCT w.name, contract_path, change, path, line FROM w JOIN c USING (name) WHERE (path, line) NOT IN (SELECT (path, line) FROM calls WHERE edited)
""")
def contract_usages(spark, sf_dir):
    lines = sql(spark, sf_dir, CALLS, "lineitem")
    return contracts.left_behind(patch_contracts(spark, sf_dir), lines, lines.where("edited"))


def named_parts(spark, sf_dir):
    """(module, path): parts as files of their brand, named after their name and number."""
    p = table(spark, sf_dir, "part")
    words = F.transform(F.split("p_name", " "), F.initcap)
    path = F.concat(F.lit("src/"), F.col("p_brand"), F.lit("/"), F.array_join(words, ""), F.col("p_partkey").cast("string"), F.lit(".ts"))
    return p.select(F.concat(F.lit("src/"), F.col("p_brand")).alias("module"), path.alias("path"), F.col("p_partkey").alias("id"))


def part_imports(spark, sf_dir):
    files = named_parts(spark, sf_dir)
    of = lambda end: files.select(F.col("id").alias(end), F.col("path").alias(f"{end}_path"))
    return edges(spark, sf_dir).select("src", "dst").join(of("src").hint("merge"), "src").join(of("dst").hint("merge"), "dst").select(F.col("src_path").alias("src"), F.col("dst_path").alias("dst"))


@query()
def split_modules(spark, sf_dir):
    return groups.split_large(named_parts(spark, sf_dir), part_imports(spark, sf_dir))


@query()
def feature_groups(spark, sf_dir):
    """The part names of each brand as groups, linked by the orders that hold both, contracted to 16."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("scope"), F.concat_ws(" ", "p_name", "p_type").alias("name"))
    end = lambda e: p.select(F.col("id").alias(e), F.col("scope"), F.col("name").alias("a" if e == "src" else "b"))
    links = edges(spark, sf_dir).join(end("src"), "src").join(end("dst"), ["dst", "scope"]).select("scope", "a", "b", F.col("weight").alias("w"))
    return groups.contract(p.select("scope", F.col("name").alias("id"), F.lit(1).cast("long").alias("n")), links, 16)


#: Blocks of lines before and after: a line of each word of a part's name and type, some indented anew, left out or added.
BLOCKS = """SELECT p_partkey AS id, replace(p_name, ' ', chr(10)) || chr(10) || p_type || chr(10) || p_brand || chr(10) || CAST(p_size AS varchar(9)) AS before,
    (CASE WHEN p_size % 3 = 0 THEN 'new' || chr(10) ELSE '' END) || replace(p_name, ' ', (CASE WHEN p_size % 4 = 0 THEN chr(10) || 'between' || chr(10) ELSE chr(10) || '  ' END)) || chr(10) || (CASE WHEN p_size % 5 > 0 THEN p_type || chr(10) ELSE '' END) || '  ' || p_brand AS after FROM {part}"""


@query()
def block_diffs(spark, sf_dir):
    return review.block_diff(sql(spark, sf_dir, BLOCKS, "part"), "before", "after", "id")


@query()
def changed_words(spark, sf_dir):
    """The ranges that differ between a part's description and that of the next number's size."""
    p = table(spark, sf_dir, "part")
    old = F.concat_ws(" ", "p_name", F.concat(F.lit("("), "p_type", F.lit("),")), "p_brand", F.col("p_size").cast("string"))
    new = F.concat_ws(" ", "p_name", F.when(F.col("p_size") % 3 == 0, "new"), F.concat(F.lit("("), "p_type", F.lit(");")), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), (F.col("p_size") + 1).cast("string"))
    marks = relational.spread(p).select("p_partkey", review.word_ranges(old, new).alias("m"))
    told = lambda side: F.array_join(F.transform(f"m.{side}", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), " ")
    return marks.select("p_partkey", told("old").alias("old_ranges"), told("new").alias("new_ranges"))
