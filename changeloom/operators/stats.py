"""Statistics of a repository. All of them are native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.functions.text import line_count, non_blank_lines
from changeloom.operators.relational import latest_by


def language_stats(files: DataFrame, *by: str, text: str = "text") -> DataFrame:
    t = F.col(text)
    return files.groupBy(*by).agg(F.count("*").alias("files"), F.sum(line_count(t)).alias("lines"), F.sum(non_blank_lines(t)).alias("non_blank"))


def totals_rollup(files: DataFrame, a: str, b: str, text: str = "text") -> DataFrame:
    return files.rollup(a, b).agg(F.grouping_id().cast("long").alias("grouping_level"), F.count("*").alias("files"), F.sum(line_count(F.col(text))).alias("lines"))


def contributors(commits: DataFrame) -> DataFrame:
    """commits (name, email, authored_at, added, removed) by person.

    A person is an e-mail in lower case, or a name where there is none; the name used most stands for each
    (ties: the first by code point), and people with the same name, whatever the case, become one.
    """
    key = F.coalesce(F.nullif(F.lower("email"), F.lit("")), F.lower("name"))
    named = commits.withColumn("_key", key)
    sums = lambda n: [F.sum(n).alias("commits"), F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.min("first").alias("first"), F.max("last").alias("last")]
    parts = named.groupBy("_key", "name").agg(F.count("*").alias("n"), F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.min("authored_at").alias("first"), F.max("authored_at").alias("last"))
    people = parts.groupBy("_key").agg(*sums("n")).join(latest_by(parts.select("_key", "name", "n"), ["_key"], F.desc("n"), F.col("name")).drop("n"), "_key")
    merged = people.withColumn("_name", F.lower(F.trim("name"))).groupBy("_name").agg(*sums("commits"), F.max_by("name", F.struct("commits", "name")).alias("name"))
    return merged.drop("_name")


def daily(events: DataFrame, day: Column, **counts: Column) -> DataFrame:
    return events.groupBy(day.alias("day")).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in counts.items()])


def majority(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key; ties go to the smallest."""
    counted = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    return latest_by(counted, [key], F.desc("n"), F.col(value))


def dominant(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """The most frequent value of each key; ties go by the given order of values."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(value))
    counted = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    return latest_by(counted, [key], F.desc("n"), F.when(place > 0, place).otherwise(len(order) + 1), F.col(value))
