"""Keeping stored tables: replacing parts of them, carrying fields over, retention. DataFrames in, the new table out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeloom.operators.relational import keep_newest


def replace_slots(base: DataFrame, slots: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """base with everything under the slots (keys) taken out and rows put in; as a partitioned table this is a dynamic overwrite."""
    return base.join(slots.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


def sync_by_id(old: DataFrame, new: DataFrame, keys: list[str], kept: list[str]) -> DataFrame:
    """The new rows with the fields `kept` of the old row of the same id, if there is one; old rows that are not in new go."""
    carried = old.select(*keys, *[F.col(c).alias(f"_{c}") for c in kept])
    return new.join(carried, keys, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in kept else F.col(c) for c in new.columns])


def relinked(rows: DataFrame, owners: DataFrame, parents: DataFrame) -> DataFrame:
    """rows (component, file) under the component that owns their file now (file, owner), else under the one that took theirs in (component, parent)."""
    found = rows.join(owners.select("file", "owner"), "file", "left").join(parents.select("component", "parent"), "component", "left")
    return found.withColumn("component", F.coalesce("owner", "parent", "component")).select(*rows.columns)


def without_children(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Parents that have children left; the others are pruned."""
    return parents.join(children.select(key).distinct(), key, "left_semi")


def next_sequence(rows: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The number that comes next for each key."""
    return rows.groupBy(*keys).agg((F.max(sequence) + 1).alias("next"))


def appended(log: DataFrame, lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """log (keys, seq, ...) with lines added behind, numbered on within each key."""
    last = log.groupBy(*keys).agg(F.max("seq").alias("_last"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    numbered = lines.withColumn("_n", nth).join(last, keys, "left").withColumn("seq", F.coalesce("_last", F.lit(0)) + F.col("_n"))
    return log.unionByName(numbered.select(*log.columns))


def log_slice(log: DataFrame, keys: list[str], start: int, end: int) -> DataFrame:
    """Lines from start to end of each log, both inclusive and from 0; negative ones count from the end."""
    whole = Window.partitionBy(*keys)
    place = F.row_number().over(whole.orderBy("seq")) - 1
    n = F.count("*").over(whole)
    at = lambda i: F.lit(i) if i >= 0 else n + i
    return log.withColumn("_at", place).withColumn("_a", at(start)).withColumn("_b", at(end)).where("_at BETWEEN _a AND _b").drop("_at", "_a", "_b")


def picks_recorded(history: DataFrame, picks: DataFrame, group: list[str], key: str, most: int = 200) -> DataFrame:
    """history (group, key, uses, last_used) with picks (group, key, at) counted in; of each group the `most` picked last stay."""
    both = history.select(*group, key, "uses", "last_used").unionByName(picks.select(*group, key, F.lit(1).cast("long").alias("uses"), F.col("at").alias("last_used")))
    summed = both.groupBy(*group, key).agg(F.sum("uses").alias("uses"), F.max("last_used").alias("last_used"))
    return keep_newest(summed, group, most, F.desc("last_used"), F.col(key)).drop("nth")


def unexpired(kv: DataFrame, now: Column, value: str = "value", path: str = "$.expiresAt") -> DataFrame:
    """JSON records whose time, if they have one, is still to come."""
    until = F.get_json_object(value, path)
    return kv.where(until.isNull() | (until.cast("double") > now))


def to_parse(blobs: DataFrame, cache: DataFrame, key: str = "blob") -> tuple[DataFrame, DataFrame]:
    """(what the cache knows of the blobs, the blobs it does not know)."""
    return cache.join(blobs.select(key).distinct(), key, "left_semi"), blobs.join(cache.select(key), key, "left_anti").dropDuplicates([key])


def retained(jobs: DataFrame, keys: list[str], newest: int, finished: str, since: Column) -> DataFrame:
    """Jobs that are among the newest of their key and not older than allowed; jobs that have not finished stay."""
    nth = F.row_number().over(Window.partitionBy(*keys, F.col(finished).isNull()).orderBy(F.desc(finished), "id"))
    return jobs.withColumn("_n", nth).where(F.col(finished).isNull() | ((F.col("_n") <= newest) & (F.col(finished) >= since))).drop("_n")


def in_asked_order(asked: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """asked (pos, key) with what is known of each, misses too, in the order asked."""
    return asked.join(known, key, "left").orderBy("pos")


def packed(*columns: str) -> Column:
    """A row as JSON without its nulls."""
    return F.to_json(F.struct(*columns))
