"""Grouping files by what connects them: small groups join their strongest neighbours, all at once, in rounds.

In a round each moving group names its heaviest link, ties by the names of both ends; as links are so in one order,
choices end in a group that stays or in two that name each other, of which the smaller name stays. Chains of choices are followed
by pointer jumping, then sizes and links are summed anew. Scopes (modules, repositories) do not meet, and no
scope is held by one task. What grows with files is joined by shuffles: its tables are far smaller than it, and Spark would go by
their size and broadcast them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changeloom.checkpoints import cut
from changeloom.functions.text import name_stem, singular
from changeloom.operators.graph import chased

#: Files of no part of their own, as barrels (fixed values).
BARREL = r"(?i)^(index\.[cm]?[jt]sx?|mod\.rs|__init__\.py|package-info\.java)$"


def joined(groups: DataFrame, links: DataFrame, moving: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """One round: scope, id, root of groups (scope, id, n). links: scope, a, b, w, either way round once; moving: scope, id.

    fallback (scope, id): where movers of the scope without links go.
    """
    ways = links.select("scope", F.col("a").alias("id"), F.col("b").alias("other"), "w").unionByName(links.select("scope", F.col("b").alias("id"), F.col("a").alias("other"), "w"))
    order = F.min(F.struct((-F.col("w")).alias("w"), F.least("id", "other").alias("x"), F.greatest("id", "other").alias("y"), "other"))
    best = ways.join(moving.hint("merge"), ["scope", "id"], "left_semi").groupBy("scope", "id").agg(order["other"].alias("to"))
    if fallback is not None:
        alone = moving.join(best.hint("merge"), ["scope", "id"], "left_anti").join(fallback.select("scope", F.col("id").alias("to")), "scope").where("id <> to")
        best = best.unionByName(alone.select("scope", "id", "to"))
    best = cut(best, "choices")
    back = best.select("scope", F.col("id").alias("to"), F.col("to").alias("id"), F.lit(True).alias("_mutual"))
    steps = best.join(back.hint("merge"), ["scope", "id", "to"], "left").where("_mutual IS NULL OR id > to")
    node = lambda c: F.struct(F.col("scope"), F.col(c).alias("id"))
    known = groups.join(steps.select("scope", "id", "to").hint("merge"), ["scope", "id"], "left").withColumn("to", F.coalesce("to", "id"))
    return chased(known.select(node("id").alias("start"), node("to").alias("root"))).select("start.scope", "start.id", F.col("root.id").alias("root"))


def summed(groups: DataFrame, links: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups and links under their roots; links within a group go."""
    merged = groups.join(roots.hint("merge"), ["scope", "id"]).groupBy("scope", F.col("root").alias("id")).agg(F.sum("n").alias("n"))
    of = lambda end: roots.select("scope", F.col("id").alias(end), F.col("root").alias(f"{end}_root"))
    moved = links.join(of("a").hint("merge"), ["scope", "a"]).join(of("b").hint("merge"), ["scope", "b"]).where("a_root <> b_root")
    one = moved.groupBy("scope", F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).agg(F.sum("w").alias("w"))
    return cut(merged, "groups"), cut(one, "links")


def started(groups: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    groups = cut(groups.where("id IS NOT NULL AND scope IS NOT NULL").groupBy("scope", "id").agg(F.sum("n").alias("n")), "groups")
    known = groups.select("scope", "id")
    both = links.where("a <> b").join(known.withColumnRenamed("id", "a").hint("merge"), ["scope", "a"], "left_semi").join(known.withColumnRenamed("id", "b").hint("merge"), ["scope", "b"], "left_semi")
    return groups, cut(both.groupBy("scope", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w")), "links")


def agglomerate(groups: DataFrame, links: DataFrame, least: int) -> DataFrame:
    """scope, id, root: groups (scope, id, n) under `least` join their strongest neighbours until none that has one is left.

    links: scope, a, b, w; those of groups that are not there are left out. Repeated rows add up. Ties: the smallest pair
    of names. Null ids and scopes are left out. No rows: no rows.
    """
    groups, links = started(groups, links)
    told = groups.select("scope", "id", F.col("id").alias("root"))
    while True:
        touched = links.select("scope", F.col("a").alias("id")).unionByName(links.select("scope", F.col("b").alias("id"))).distinct()
        moving = cut(groups.where(F.col("n") < least).select("scope", "id").join(touched.hint("merge"), ["scope", "id"], "left_semi"), "moving")
        if not moving.limit(1).count():
            return told
        roots = joined(groups, links, moving)
        told = renamed(told, roots)
        groups, links = summed(groups, links, roots)


def renamed(told: DataFrame, roots: DataFrame) -> DataFrame:
    return cut(told.join(roots.select("scope", F.col("id").alias("root"), F.col("root").alias("_root")).hint("merge"), ["scope", "root"]).select("scope", "id", F.col("_root").alias("root")), "roots")


def contract(groups: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """scope, id, root: the groups of each scope contracted to `most` at most, the lightest first.

    Of a scope with more, each round moves the lightest, as many as are too many but half of all at most, to their
    strongest neighbours, and those without one to the largest group. So a scope never falls below `most` that had more, and
    the number of rounds is about the logarithm of the number of groups. Ties go by name, of the largest to the smallest name.
    Edge cases as in agglomerate.
    """
    groups, links = started(groups, links)
    told = groups.select("scope", "id", F.col("id").alias("root"))
    while True:
        # The lightest are found by rank within the scopes that have too many; groups are few beside files.
        of = groups.groupBy("scope").agg(F.count("*").alias("k"), F.min(F.struct((-F.col("n")).alias("n"), "id"))["id"].alias("largest")).where(F.col("k") > most)
        order = Window.partitionBy("scope").orderBy("n", "id")
        near = groups.join(of, "scope").withColumn("nth", F.row_number().over(order))
        moving = cut(near.where((F.col("nth") <= F.col("k") - most) & (F.col("nth") <= F.ceil(F.col("k") / 2))).select("scope", "id"), "moving")
        if not moving.limit(1).count():
            return told
        roots = joined(groups, links, moving, of.select("scope", F.col("largest").alias("id")))
        told = renamed(told, roots)
        groups, links = summed(groups, links, roots)


def split_large(files: DataFrame, imports: DataFrame, *, largest: int = 30, least: int = 3, hub_share: float = 0.25, hub_least: int = 6) -> DataFrame:
    """module, path, part of files (module, path): modules of more than `largest` files fall into parts by their files' names.

    part is null for the core, which keeps the module's name: hubs (barrels, and files that many of the module's import or
    that import many), names without letters, and parts under `least` files that nothing connects. Smaller parts join those
    that imports (src, dst) connect them to most (agglomerate). Modules up to `largest` files are all core. Repeated files and
    imports count once; imports between modules and of a file by itself are left out.
    """
    files = cut(files.where("path IS NOT NULL AND module IS NOT NULL").select("module", "path").distinct(), "files")
    sizes = files.groupBy("module").agg(F.count("*").alias("k")).where(F.col("k") > largest)
    inside = files.join(sizes, "module")
    place = lambda end: inside.select("module", F.col("path").alias(end)).hint("merge")
    links = cut(imports.select("src", "dst").where("src <> dst").distinct().join(place("src"), "src").join(place("dst"), ["module", "dst"]), "imports")
    bound = F.greatest(F.lit(hub_least), F.ceil(F.col("k") * hub_share))
    busy = links.groupBy("module", F.col("src").alias("path")).count().unionByName(links.groupBy("module", F.col("dst").alias("path")).count())
    hubs = busy.join(sizes, "module").where(F.col("count") >= bound).select("module", "path").distinct()
    folder = singular(F.lower(F.regexp_extract("module", r"([A-Za-z0-9]+)[^A-Za-z0-9]*$", 1)))
    stem = F.when(~F.substring_index("path", "/", -1).rlike(BARREL), F.nullif(name_stem(F.col("path"), folder), F.lit("")))
    named = cut(inside.join(hubs.hint("merge"), ["module", "path"], "left_anti").select("module", "path", stem.alias("stem")).where("stem IS NOT NULL"), "stems")
    end = lambda e, as_: named.select("module", F.col("path").alias(e), F.col("stem").alias(as_)).hint("merge")
    between = links.join(end("src", "a"), ["module", "src"]).join(end("dst", "b"), ["module", "dst"]).groupBy("module", "a", "b").agg(F.count("*").alias("w"))
    groups = named.groupBy("module", F.col("stem").alias("id")).agg(F.count("*").alias("n"))
    scoped = lambda df: df.withColumnRenamed("module", "scope")
    roots = agglomerate(scoped(groups), scoped(between), least)
    parts = named.join(roots.select(F.col("scope").alias("module"), F.col("id").alias("stem"), "root").hint("merge"), ["module", "stem"]).select("module", "path", F.col("root").alias("part"))
    fit = parts.groupBy("module", "part").count().where(F.col("count") >= least).select("module", "part")
    return files.join(parts.join(fit, ["module", "part"]).hint("merge"), ["module", "path"], "left").select("module", "path", "part")
