"""Source trees as tables: files of a folder with size caps, binary sniff and ignore rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of other people's or of built code (fixed values).
IGNORED = r"(^|/)(node_modules|vendor|third_party|dist|build|out|coverage|__pycache__|venv|\.[^/]+)(/|$)"
#: What lies beside a `target` folder that is a build folder (fixed values).
MANIFESTS = ["pom.xml", "Cargo.toml", "build.sbt"]


def is_ignored(path: Column) -> Column:
    return path.rlike(IGNORED)


def is_binary(content: Column, head: int = 8192) -> Column:
    """A zero byte among the first ones."""
    return F.hex(F.substring(content, 1, head)).rlike("^(?:..)*?00")


def read_tree(spark: SparkSession, root: str, *, cap: int = 1_000_000, glob: str | None = None) -> DataFrame:
    """path (below root), size and text of the files of a folder; large, binary and ignored ones are left out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    bare = root.rstrip("/").removeprefix("file://")
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^{bare}/", "")
    kept = files.where(F.col("length") <= cap).select(path.alias("path"), F.col("length").alias("size"), "content").where(~is_ignored(F.col("path")))
    text = kept.where(~is_binary(F.col("content"))).select("path", "size", F.decode("content", "utf-8").alias("text"))
    return without_build_targets(text)


def without_build_targets(files: DataFrame) -> DataFrame:
    """Without what lies in a `target` folder beside a build manifest."""
    roots = files.where(F.substring_index("path", "/", -1).isin(MANIFESTS)).select(F.regexp_extract("path", "^(.*/)?[^/]*$", 1).alias("_root")).distinct()
    inside = F.regexp_extract("path", "^((?:.*/)?)target/", 1)
    marked = files.withColumn("_root", F.when(F.col("path").rlike("(^|/)target/"), inside))
    return marked.join(roots, "_root", "left_anti").drop("_root")


def read_commit_log(spark: SparkSession, path: str) -> DataFrame:
    """Commit records of a log whose records end with the record separator."""
    from changeloom.operators.scans import commit_log

    return commit_log(spark.read.option("lineSep", "\x1e").text(path))


def changed_files(base: DataFrame, head: DataFrame) -> DataFrame:
    """path, status and line counts of the files that differ between two trees (path, text)."""
    from changeloom.functions.text import line_count

    j = base.select("path", F.col("text").alias("b")).join(head.select("path", F.col("text").alias("h")), "path", "full_outer")
    status = F.when(F.col("b").isNull(), "added").when(F.col("h").isNull(), "removed").when(F.col("b") != F.col("h"), "changed")
    blind = F.regexp_replace("b", r"\s+", "") == F.regexp_replace("h", r"\s+", "")
    return j.withColumn("status", status).where("status IS NOT NULL").select("path", "status", line_count(F.col("b")).alias("lines_before"), line_count(F.col("h")).alias("lines_after"), F.coalesce(blind, F.lit(False)).alias("only_white_space"))
