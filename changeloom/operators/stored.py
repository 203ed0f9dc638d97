"""A stored analysis: tables by repository and commit, written whole, and made visible by one pointer."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _pointer(root: str, repo: str) -> str:
    return f"{root.rstrip('/')}/_current/{repo.encode().hex()}.json"


def save(root: str, repo: str, sha: str, tables: dict[str, DataFrame], run: str | None = None) -> dict:
    """Writes the tables under (repo, sha, run) and then, all being there, points to them; returns what the pointer says.

    Each table is partitioned by repo, sha and run, and a write replaces only its own partition, so one that failed and is tried again under the same
    run starts anew, and what is visible stays until the pointer moves. The pointer is a small file that is renamed over the old one, which the file system does at once.
    """
    run = run or uuid.uuid4().hex
    told = {"repo": repo, "sha": sha, "run": run, "tables": sorted(tables)}
    for name, df in sorted(tables.items()):
        keyed = df.withColumns({"repo": F.lit(repo), "sha": F.lit(sha), "run": F.lit(run)})
        keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo", "sha", "run").parquet(f"{root.rstrip('/')}/{name}")
    spark = next(iter(tables.values())).sparkSession
    target = _pointer(root, repo)
    fs, fresh = _fs(spark, f"{target}.{run}")
    out = fs.create(fresh, True)
    out.write(bytearray(json.dumps(told).encode()))
    out.close()
    jvm = spark._jvm
    overwrite = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fresh, jvm.org.apache.hadoop.fs.Path(target), overwrite)
    return told


def current(spark: SparkSession, root: str, repo: str) -> dict | None:
    """What the repository's pointer says; None if nothing has been saved."""
    fs, path = _fs(spark, _pointer(root, repo))
    if not fs.exists(path):
        return None
    return json.loads("".join(r[0] for r in spark.read.text(_pointer(root, repo)).collect()))  # one line


def load(spark: SparkSession, root: str, repo: str, name: str) -> DataFrame:
    """The visible rows of a table of the repository; only their partition is read. Without a saved analysis there is an error."""
    told = current(spark, root, repo)
    if told is None or name not in told["tables"]:
        raise LookupError(f"no {name} of {repo} is stored")
    here = (F.col("repo") == repo) & (F.col("sha") == told["sha"]) & (F.col("run") == told["run"])
    path = f"{root.rstrip('/')}/{name}"
    schema = spark.read.parquet(f"{path}/repo={_escaped(spark, repo)}/sha={_escaped(spark, told['sha'])}/run={_escaped(spark, told['run'])}").schema
    return spark.read.schema(schema.add("repo", "string").add("sha", "string").add("run", "string")).parquet(path).where(here).drop("repo", "sha", "run")


def _escaped(spark: SparkSession, value: str) -> str:
    """As Spark writes the value into the name of a partition's folder."""
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)
