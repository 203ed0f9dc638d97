"""Dates, shares, versions and delays as columns. All of them are native expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def author_day(iso: Column) -> Column:
    """The author's own day: the first ten characters, whatever the offset."""
    return F.substring(iso, 1, 10)


def local_day(ts: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def age_text(days: Column) -> Column:
    """Days, months of 30.4 days, or years of 365.25 days."""
    return F.when(days < 60, F.concat(days.cast("string"), F.lit(" days"))).when(days < 730, F.concat(F.round(days / 30.4).cast("int").cast("string"), F.lit(" months"))).otherwise(F.concat(F.format_number(days / 365.25, 1), F.lit(" years")))


def share(value: Column, *by: str) -> Column:
    """Per cent of the total with one decimal; null where the total is 0."""
    return F.round(100.0 * value / F.nullif(F.sum(value).over(Window.partitionBy(*by)), F.lit(0)), 1)


def backoff(delay: Column, attempt: Column) -> Column:
    """Doubled for each attempt after the first."""
    return delay * F.pow(F.lit(2), F.greatest(F.lit(0), attempt - 1))


def version_key(version: Column, parts: int = 4) -> Column:
    """array<bigint> to order versions by; missing parts count as 0."""
    numbers = F.transform(F.regexp_extract_all(version, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("bigint"))
    return F.slice(F.concat(numbers, F.array_repeat(F.lit(0).cast("bigint"), parts)), 1, parts)


def range_list(first: Column, last: Column) -> Column:
    return F.when(first <= last, F.sequence(first, last))


def merged_ranges(ranges: Column) -> Column:
    """Sorted array<struct<first, last>> with overlapping and touching ranges joined."""
    empty = F.slice(ranges, 1, 0)

    def step(kept: Column, r: Column) -> Column:
        tail = F.get(kept, F.size(kept) - 1)
        joined = F.struct(tail["first"].alias("first"), F.greatest(tail["last"], r["last"]).alias("last"))
        touches = (F.size(kept) > 0) & (r["first"] <= tail["last"] + 1)
        return F.when(touches, F.concat(F.slice(kept, 1, F.greatest(F.lit(0), F.size(kept) - 1)), F.array(joined))).otherwise(F.concat(kept, F.array(r)))

    return F.aggregate(F.array_sort(ranges), empty, step)
