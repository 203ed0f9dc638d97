"""What a package exports under a subpath: exact names, patterns with one star, and conditions in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Conditions in the order in which they are tried (fixed values).
CONDITIONS = "import module default require types node".split()


def picked(value: str, depth: int = 2) -> Column:
    """The target of a VARIANT of conditions: a text itself, of a list the first that has one, of an object the first condition that has one; to `depth` levels."""
    steps = ["[0]", "[1]", *[f".{c}" for c in CONDITIONS]]
    leaf = lambda path: F.expr(f"CASE WHEN schema_of_variant(try_variant_get({value}, '{path}', 'variant')) = 'STRING' THEN try_variant_get({value}, '{path}', 'string') END")

    def ordered(path: str, left: int) -> list[Column]:
        return [leaf(path)] + [x for step in (steps if left else ()) for x in ordered(path + step, left - 1)]

    return F.coalesce(*ordered("$", depth))


def resolved(requests: DataFrame, exports: DataFrame, files: DataFrame) -> DataFrame:
    """requests (package, subpath) with pattern and file: the export that names the subpath, and the file it leads to.

    exports: package, pattern (`.`, `./x` or with one star), target (with the star's place, if any). files: package, path. A request's exports are tried in order: the exact one alone if
    there is one; else patterns by the longest part before the star, then the longest behind it, then by name; the first whose target is there counts. Patterns are
    met by equality: on the package and on the request's start of each length that the package's patterns have. Null packages, patterns and targets lead nowhere;
    a null subpath is the package itself. Repeated rows count once.
    """
    asked = requests.select("package", "subpath").distinct().withColumn("key", F.when(F.coalesce("subpath", F.lit("")) == "", ".").otherwise(F.concat(F.lit("./"), "subpath")))
    known = exports.where("package IS NOT NULL AND pattern IS NOT NULL").select("package", "pattern", "target").distinct()
    exact = asked.join(known.where("NOT contains(pattern, '*')").withColumnRenamed("pattern", "key"), ["package", "key"]).withColumns({"pattern": F.col("key"), "star": F.lit("")})
    starred = known.where("contains(pattern, '*')").withColumn("before", F.substring_index("pattern", "*", 1)).withColumn("behind", F.substr("pattern", F.length("before") + 2))
    lengths = starred.select("package", F.length("before").alias("_n")).distinct()
    opened = asked.join(exact.select("package", "subpath", "key"), ["package", "key"], "left_anti").join(lengths, "package").where(F.length("key") >= F.col("_n")).withColumn("before", F.left("key", F.col("_n")))
    met = opened.join(starred, ["package", "before"]).where(F.col("key").endswith(F.col("behind")) & (F.length("key") >= F.length("before") + F.length("behind")))
    met = met.withColumn("star", F.substr("key", F.length("before") + 1, F.length("key") - F.length("before") - F.length("behind")))
    columns = ["package", "subpath", "pattern", "target", "star"]
    both = exact.select(*columns, F.lit(0).alias("_before"), F.lit(0).alias("_behind")).unionByName(met.select(*columns, F.length("before").alias("_before"), F.length("behind").alias("_behind")))
    target = F.regexp_replace(F.concat(F.substring_index("target", "*", 1), F.when(F.col("target").contains("*"), F.concat("star", F.expr("substr(target, length(substring_index(target, '*', 1)) + 2)"))).otherwise("")), r"^\./", "")
    there = both.withColumn("file", target).join(files.select("package", F.col("path").alias("file")).distinct(), ["package", "file"])
    order = Window.partitionBy("package", "subpath").orderBy(F.desc("_before"), F.desc("_behind"), "pattern", "file")
    best = there.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("package", F.col("subpath").alias("_sub"), "pattern", "file")
    joined = asked.join(best.withColumnRenamed("package", "_package"), (F.col("package") == F.col("_package")) & F.col("subpath").eqNullSafe(F.col("_sub")), "left")
    return joined.select("package", "subpath", "pattern", "file")
