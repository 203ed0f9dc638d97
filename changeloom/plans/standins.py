"""The given tables in the roles of the analysis: edges between parts, two snapshots of orders, files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changeloom.operators.relational import keep_newest
from changeloom.plans.registry import table

#: The edges in SQL: each part's heaviest edge to the part on the next line of an order, and of every other part the second too.
EDGES_SQL = """nexts AS (
    SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS dst FROM lineitem
), counted AS (
    SELECT src, dst, count(*) AS weight FROM nexts WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst
), edges AS (
    SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rn FROM counted) WHERE rn = 1 OR rn = 2 AND src % 2 = 0
)"""

BASE_SQL = "base AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 10 <> 0)"
HEAD_SQL = "head AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 11 = 0 THEN 'moved' ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 7 <> 0)"


def all_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, weight): how often one part follows another in an order."""
    lines = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    nexts = lines.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"))
    return nexts.where("dst IS NOT NULL AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = keep_newest(all_edges(spark, sf_dir), ["src"], 2, F.desc("weight"), F.col("dst"))
    return ranked.where("nth = 1 OR src % 2 = 0").drop("nth")


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("owner"))


def orders_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderkey % 10 <> 0").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


def orders_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where("o_orderkey % 7 <> 0")
    return rows.select("o_orderkey", "o_custkey", "o_orderstatus", F.when(F.col("o_orderkey") % 11 == 0, "moved").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def sql(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    """A stand-in table told in the SQL that both engines read: {part} and the like stand for the given tables."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(f"given_{name}")
        text = text.replace(f"{{{name}}}", f"given_{name}")
    return spark.sql(text)


def told(text: str) -> str:
    """The same SQL for the engine that knows the tables by their names."""
    return re.sub(r"\{([a-z]+)\}", r"\1", text)


#: Paths of files by part, in SQL that both engines read.
FILES = """SELECT p_partkey AS id, CASE WHEN p_partkey % 37 = 0 THEN (CASE p_size % 16 WHEN 0 THEN 'package.json' WHEN 1 THEN 'api/go.work' WHEN 2 THEN 'uv.lock' WHEN 3 THEN 'Dockerfile' WHEN 4 THEN 'docker-compose.prod.yml' WHEN 5 THEN '.github/workflows/ci.yml'
    WHEN 6 THEN 'LICENSE' WHEN 7 THEN 'docs/site/index.ts' WHEN 8 THEN 'tests/conftest.py' WHEN 9 THEN 'Makefile' WHEN 10 THEN 'app.csproj' WHEN 11 THEN '.env.production.local' WHEN 12 THEN 'infra/prod.auto.tfvars' WHEN 13 THEN 'Jenkinsfile' WHEN 14 THEN 'tsconfig.base.json' ELSE 'next.config.mjs' END)
    ELSE (CASE p_partkey % 19 WHEN 0 THEN 'src/api/' WHEN 1 THEN 'src/components/' WHEN 2 THEN 'lib/db/' WHEN 3 THEN 'tests/e2e/' WHEN 4 THEN 'infra/' WHEN 5 THEN 'docs/' WHEN 6 THEN 'packages/core/src/' WHEN 7 THEN 'src/__mocks__/' WHEN 8 THEN 'vendor/lib/' WHEN 9 THEN 'src/integrations/' WHEN 10 THEN 'app/pages/api/'
        WHEN 11 THEN 'src/hooks/' WHEN 12 THEN 'test/helpers/' WHEN 13 THEN 'it/' WHEN 14 THEN 'worker/' WHEN 15 THEN 'src/stripe/' WHEN 16 THEN '' ELSE 'lib/' || lower(p_type) || '/' END)
    || replace(p_name, ' ', (CASE p_size % 3 WHEN 0 THEN '-' WHEN 1 THEN '_' ELSE 'X' END))
    || (CASE p_size % 22 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' WHEN 2 THEN '.test.ts' WHEN 3 THEN '.spec.js' WHEN 4 THEN '.py' WHEN 5 THEN '_test.go' WHEN 6 THEN '.go' WHEN 7 THEN 'IT.java' WHEN 8 THEN '.md' WHEN 9 THEN '.yaml' WHEN 10 THEN '.sql' WHEN 11 THEN '.tf' WHEN 12 THEN '.css' WHEN 13 THEN '.rs'
        WHEN 14 THEN '.d.ts' WHEN 15 THEN '.min.js' WHEN 16 THEN '.vue' WHEN 17 THEN '.kt' WHEN 18 THEN 'Spec.scala' WHEN 19 THEN '.cy.ts' WHEN 20 THEN '.json' ELSE '.bin' END) END AS path FROM {part}"""
