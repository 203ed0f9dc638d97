"""Declarations that differ between two versions, and those that stay as they are but use one that changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.checkpoints import cut
from changeloom.operators.relational import latest_by

#: Changed names up to this many are broadcast (under 200 bytes each), more are joined by a shuffle.
BROADCAST_NAMES = 100_000


def mentioned(text: Column) -> Column:
    """The words of a text, and its names with dollar signs, each once."""
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(r"(\w+)"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"([\w$]*\$[\w$]*)"), F.lit(1))))


def changed_symbols(base: DataFrame, head: DataFrame, scope: str = "file") -> DataFrame:
    """file, name, change (added, modified, removed, or via), via: declarations (file, name, text, callable, exported) that differ, and exported callables that use one.

    Texts are compared without regard to blanks. An unchanged exported callable that mentions a changed name of its scope (its file, or another column that
    both sides have) is told with change `via` and the least such name. Bodies are not searched by patterns: each is opened to its distinct words,
    which meet the changed names by equality; names are one row each on their side, so a frequent word costs its bodies one row each.

    Edge cases. Null files and names: left out. Of repeated declarations of a file the greatest text counts. Null text: as empty; null flags: false. No rows: no rows.
    """
    keys = ["file", "name"]

    def side(df: DataFrame) -> DataFrame:
        plain = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
        rows = df.where("file IS NOT NULL AND name IS NOT NULL").select(F.col(scope).alias("_scope"), *keys, plain.alias("plain"), F.coalesce(F.col("callable") & F.col("exported"), F.lit(False)).alias("offered"))
        return latest_by(rows, keys, F.desc("plain"), F.desc("offered"))

    b, h = side(base), side(head)
    both = b.select(*keys, F.col("_scope").alias("b_scope"), F.col("plain").alias("b_plain")).join(h, keys, "full")
    change = F.when(F.col("b_plain").isNull(), "added").when(F.col("plain").isNull(), "removed").when(F.col("plain") != F.col("b_plain"), "modified")
    seen = cut(both.select(F.coalesce("_scope", "b_scope").alias("_scope"), *keys, change.alias("change"), "plain", "offered"), "symbols")
    changed = seen.where("change IS NOT NULL")
    names = changed.select("_scope", F.col("name").alias("word")).distinct()
    near = seen.where("change IS NULL AND offered").join(names.select("_scope").distinct(), "_scope", "left_semi")
    words = near.select("_scope", *keys, F.explode(mentioned(F.col("plain"))).alias("word")).where("word <> name")
    few = names.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES
    via = words.join(F.broadcast(names) if few else names, ["_scope", "word"]).groupBy(*keys).agg(F.min("word").alias("via"))
    out = changed.select(*keys, "change", F.lit(None).cast("string").alias("via"))
    return out.unionByName(via.select(*keys, F.lit("via").alias("change"), "via"))
