"""Stages of image files: which earlier stage a name means, what the final image is made of, and what its copies reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bound(uses: DataFrame, stages: DataFrame) -> DataFrame:
    """uses (file, stage, name) with parent: the latest earlier stage of the file that has the name, or whose number it is; null for none."""
    named = stages.select("file", F.col("stage").alias("_stage"), F.lower("name").alias("_name")).where("_name IS NOT NULL")
    numbered = stages.select("file", F.col("stage").alias("_stage"), F.col("stage").cast("string").alias("_name"))
    known = named.unionByName(numbered)
    u = uses.select("file", "stage", "name").distinct()
    found = u.join(known.withColumnRenamed("file", "_file"), (F.col("file") == F.col("_file")) & (F.lower("name") == F.col("_name")) & (F.col("_stage") < F.col("stage")))
    best = found.groupBy("file", "stage", "name").agg(F.max("_stage").alias("parent"))
    return u.join(best, ["file", "stage", "name"], "left")


def final_image(stages: DataFrame, copies: DataFrame, most: int = 200) -> DataFrame:
    """file, stage, hops, via: the stages that a file's last stage is made of (via from), or whose files it takes (via copy).

    stages: file, stage (number from 0), name (after AS, or null), base (after FROM). copies: file, stage, source (after --from=).
    Names mean the latest earlier stage that has them, so they may be used again and a stage that names itself means an outer one or an image. Chains of FROM alone
    are `from`; a stage that is only reached through a copy is `copy`. One recursive query over both kinds of edges; as each goes to an earlier stage it ends, after
    `most` steps at the latest (longer chains are refused by Spark). Names of images and null names lead nowhere. Repeated rows count once.
    """
    spark = stages.sparkSession
    stages = stages.where("file IS NOT NULL AND stage IS NOT NULL").distinct()
    base = bound(stages.select("file", "stage", F.col("base").alias("name")), stages).withColumn("via", F.lit("from"))
    taken = bound(copies.select("file", "stage", F.col("source").alias("name")), stages).withColumn("via", F.lit("copy"))
    edges = base.unionByName(taken).where("parent IS NOT NULL").select("file", "stage", "parent", "via").distinct()
    edges.createOrReplaceTempView("_stage_edges")
    stages.groupBy("file").agg(F.max("stage").alias("stage")).createOrReplaceTempView("_last_stages")
    walked = spark.sql(f"""
        WITH RECURSIVE walk(file, stage, hops, via) MAX RECURSION LEVEL {most} AS (
            SELECT file, stage, 0, 'from' FROM _last_stages
            UNION ALL SELECT w.file, e.parent, w.hops + 1, IF(w.via = 'copy' OR e.via = 'copy', 'copy', 'from') FROM walk w JOIN _stage_edges e ON w.file = e.file AND w.stage = e.stage
        ) SELECT * FROM walk LIMIT ALL""")
    return walked.groupBy("file", "stage").agg(F.min("hops").alias("hops"), F.max("via").alias("via"))
