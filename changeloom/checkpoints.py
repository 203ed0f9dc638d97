"""Cutting lineage: tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What a local master uses where spark.checkpoint.dir is unset; it goes when the process ends.
OWN = f"/tmp/checkpoints/{os.getpid()}"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local master gets a folder of its own and others are refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # local-cluster has executors of its own
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not os.path.isdir(OWN):
        os.makedirs(OWN)
        atexit.register(shutil.rmtree, OWN, ignore_errors=True)
    return f"file://{OWN}"


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/changeloom/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """df as a table of the shared folder, which survives lost executors; what reads it starts there."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Delete all of this application's tables that cut lineage; to be called when the results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
