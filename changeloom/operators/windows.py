"""Running totals, calendars, islands and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_back(df: DataFrame, keys: list[str], day: str, net: str, total: Column) -> DataFrame:
    """lines: the total as it was at each day, walked back from the newest and never below 0."""
    later = Window.partitionBy(*keys).orderBy(day).rowsBetween(1, Window.unboundedFollowing)
    return df.withColumn("lines", F.greatest(F.lit(0), total - F.coalesce(F.sum(net).over(later), F.lit(0))))


def dense_calendar(df: DataFrame, keys: list[str], day: str, counts: list[str], carried: list[str]) -> DataFrame:
    """A row for every day from first to last: missing counts are 0, carried values keep the last one."""
    days = df.groupBy(*keys).agg(F.min(day).alias("_a"), F.max(day).alias("_b")).select(*keys, F.explode(F.sequence("_a", "_b")).alias(day))
    so_far = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    full = days.join(df, [*keys, day], "left")
    return full.select(*keys, day, *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], *[F.last(c, ignorenulls=True).over(so_far).alias(c) for c in carried])


def islands(df: DataFrame, keys: list[str], number: Column) -> DataFrame:
    """Runs of consecutive numbers of each key: first, last, n. Repeated numbers count once."""
    rows = df.select(*keys, number.cast("long").alias("_x")).distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_x"))
    return rows.withColumn("_g", F.col("_x") - rank).groupBy(*keys, "_g").agg(F.min("_x").alias("first"), F.max("_x").alias("last"), F.count("*").alias("n")).drop("_g")


def merged_windows(df: DataFrame, keys: list[str], first: Column, last: Column) -> DataFrame:
    """Overlapping or touching ranges of each key joined: first, last, n."""
    order = Window.partitionBy(*keys).orderBy("_a", "_b")
    rows = df.select(*keys, first.alias("_a"), last.alias("_b"))
    reached = F.max("_b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = rows.withColumn("_new", F.when(F.coalesce(F.col("_a") > reached + 1, F.lit(True)), 1).otherwise(0))
    numbered = fresh.withColumn("_g", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_g").agg(F.min("_a").alias("first"), F.max("_b").alias("last"), F.count("*").alias("n")).drop("_g")


def queue_positions(df: DataFrame, queue: list[str], *order: Column) -> DataFrame:
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*queue).orderBy(*order)).cast("long"))


def block_numbers(df: DataFrame, keys: list[str], line: str, starts: Column) -> DataFrame:
    """block: how many block starts lie at or before each line."""
    return df.withColumn("block", F.sum(F.when(starts, 1).otherwise(0)).over(Window.partitionBy(*keys).orderBy(line).rowsBetween(Window.unboundedPreceding, 0)))


def unique_names(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """unique_name: the first of equal names (whatever the case) keeps it, the others get ` (2)`, ` (3)`."""
    nth = F.row_number().over(Window.partitionBy(F.lower(name)).orderBy(*order))
    return df.withColumn("_nth", nth).withColumn("unique_name", F.when(F.col("_nth") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(" ("), F.col("_nth").cast("string"), F.lit(")")))).drop("_nth")


def colliding_labels(df: DataFrame, levels: list[Column]) -> DataFrame:
    """label: the shortest of the given labels that no other row has, else the longest; level says which."""
    out = df.withColumn("level", F.lit(0)).withColumn("label", levels[0])
    for n, longer in enumerate(levels[1:], 1):
        clash = F.count("*").over(Window.partitionBy("label")) > 1
        out = out.withColumn("_clash", clash).withColumn("label", F.when(F.col("_clash"), longer).otherwise(F.col("label"))).withColumn("level", F.when(F.col("_clash"), n).otherwise(F.col("level"))).drop("_clash")
    return out


def within_budget(df: DataFrame, keys: list[str], order: str, cost: str, budget: int, always: Column | None = None) -> DataFrame:
    """The newest rows of each key whose costs add up to the budget at most, after those that always stay."""
    always = F.lit(False) if always is None else always
    whole = Window.partitionBy(*keys)
    back = whole.orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_always", always).withColumn("_left", F.lit(budget) - F.coalesce(F.sum(F.when(F.col("_always"), F.col(cost))).over(whole), F.lit(0)))
    spent = rows.withColumn("_spent", F.sum(F.when(F.col("_always"), 0).otherwise(F.col(cost))).over(back))
    return spent.where(F.col("_always") | (F.col("_spent") <= F.col("_left"))).drop("_always", "_left", "_spent")


def top_by_kind(df: DataFrame, kind: str, n: int, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(kind).orderBy(*order))).where(F.col("rank") <= n)
