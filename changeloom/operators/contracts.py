"""Contracts that a change breaks, read from its patches: signatures, types and constants that others name.

A patch is cut into hunks and a hunk into its old and its new side, as arrays of lines; declarations are found
on each side, with their signatures to the line on which brackets close, or their blocks to the line that is not indented
deeper. All of that is one native expression a hunk, without a shuffle; a hunk is a row. What follows are joins by path and name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeloom.checkpoints import cut
from changeloom.functions.declarations import declared, indent, plain_form
from changeloom.operators.relational import latest_by, spread

#: Lines that a signature and a block have at most unless they are read whole, columns that a declaration is indented at most, and the length of names that are too short to be looked for (fixed values).
SIGNATURE_LINES, BLOCK_LINES, INDENT, SHORT = 10, 40, 8, 2
LINE = "struct<body:string,changed:boolean>"


def hunks(patches: DataFrame) -> DataFrame:
    """path, status, hunk (its number), old, new of patches (path, status, patch): the sides as arrays of (body, changed)."""
    text = F.concat(F.lit("\n"), F.regexp_replace("patch", "\r\n", "\n"))
    bodies = F.slice(F.split(text, r"\n@@ [^\n]*@@[^\n]*"), 2, 1 << 30)
    rows = spread(patches.select("path", "status", "patch")).where("path IS NOT NULL AND patch IS NOT NULL").select("path", F.coalesce("status", F.lit("modified")).alias("status"), F.posexplode(bodies).alias("hunk", "_h"))
    lines = F.filter(F.slice(F.split("_h", "\n"), 2, 1 << 30), lambda x: (x != "") & ~x.startswith("\\"))
    side = lambda mark: F.transform(F.filter(lines, lambda x: ~x.startswith(mark)), lambda x: F.struct(F.substr(x, F.lit(2)).alias("body"), (~x.startswith(" ")).alias("changed")))
    return rows.select("path", "status", "hunk", side("+").alias("old"), side("-").alias("new"))


def reached(lines: Column, at: Column, start: Column, step: Callable[[Column, Column], Column], most: int, whole: bool) -> Column:
    """n of a fold over the lines from `at` on, until it is done: over `most` of them, or, if whole, over 16 times as many as before until it is done or they end."""

    def fold(size: int) -> Column:
        return F.aggregate(F.slice(lines, at, size), start, step)

    def widened(size: int) -> Column:
        if size > 1 << 20:
            return fold(1 << 30)["n"]
        return F.get(F.transform(F.array(fold(size)), lambda a: F.when(a["done"] | (F.size(lines) < at + size), a["n"]).otherwise(widened(size * 16))), 0)

    return widened(most) if whole else fold(most)["n"]


def signature_lines(lines: Column, at: Column, whole: bool = False) -> Column:
    """Lines of the callable declared at `at` (from 1): to the one on which the brackets that it opens are closed, or the last."""
    count = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(a: Column, x: Column) -> Column:
        depth = a["depth"] + count(x["body"], "(") - count(x["body"], ")")
        return F.when(a["done"], a).otherwise(F.struct(depth.alias("depth"), (a["n"] + 1).alias("n"), (depth <= 0).alias("done")))

    return reached(lines, at, start, step, SIGNATURE_LINES, whole)


def block_lines(lines: Column, at: Column, whole: bool = False) -> Column:
    """Lines of the type or value declared at `at`: all that is blank or indented deeper, and a line that closes it."""
    own = indent(F.element_at(lines, at)["body"])
    start = F.struct(F.lit(1).alias("n"), F.lit(False).alias("done"))

    def step(a: Column, x: Column) -> Column:
        inside = (F.trim(x["body"]) == "") | (indent(x["body"]) > own)
        closing = x["body"].rlike(r"^\s*(?:[}\])]|end\b)")
        return F.when(a["done"], a).otherwise(F.struct((a["n"] + (inside | closing).cast("int")).alias("n"), (~inside).alias("done")))

    return reached(lines, at + 1, start, step, BLOCK_LINES - 1, whole)


def declarations(lines: Column, whole: bool = False) -> Column:
    """Of an array of (body, changed) the declarations: nth (line, from 1), name, kind, text, touched, own (whether its first line is changed)."""

    def one(x: Column, i: Column) -> Column:
        at = i + 1
        what = F.when(indent(x["body"]) <= INDENT, declared(x["body"]))
        n = F.when(what["kind"] == "callable", signature_lines(lines, at, whole)).otherwise(block_lines(lines, at, whole))
        span = F.slice(lines, at, n)
        text = F.rtrim(F.array_join(F.transform(span, lambda y: y["body"]), "\n"))
        text = F.when(what["kind"] == "callable", F.regexp_replace(text, r"\s*\{\s*$", "")).otherwise(text)
        return F.when(what.isNotNull(), F.struct(at.alias("nth"), what["name"].alias("name"), what["kind"].alias("kind"), text.alias("text"), F.exists(span, lambda y: y["changed"]).alias("touched"), x["changed"].alias("own")))

    return F.filter(F.transform(lines, one), lambda d: d.isNotNull() & (F.length(d["name"]) > SHORT))


def changed_contracts(patches: DataFrame, whole: bool = False) -> DataFrame:
    """path, name, kind, change (changed or removed), before, after, moved_from of patches (path, status, patch).

    status: added, removed or modified. Of the declarations of a hunk, old and new ones of a name belong together: equal ones
    first, then the nearest signature by edit distance, then the first. A contract changes if its plain form does; one that no hunk of its file has on
    its new side, and whose own line was removed, is removed. A removed one that the patches write into just one other file, by its name
    and kind, moved there: if its form changed on the way, that file has it as changed, with moved_from. Each path and name is told once, by
    its first hunk. whole: signatures and blocks are read to their ends, not to SIGNATURE_LINES and BLOCK_LINES.

    Edge cases. Null paths and patches: left out; null status: modified. Added files are read for moves only. Repeated rows tell
    the same once. Names of one or two letters are left out. No rows: no rows. Extra columns are ignored.
    """
    sides = cut(hunks(patches).select("path", "status", "hunk", declarations(F.col("old"), whole).alias("old"), declarations(F.col("new"), whole).alias("new")).where("size(old) + size(new) > 0"), "sides")
    of = lambda c: sides.select("path", "status", "hunk", F.explode(c).alias("d")).select("path", "status", "hunk", "d.*").distinct()
    old, new = of("old").where("status <> 'added'"), of("new")
    here = new.where("status <> 'removed'").select("path", "hunk", "name", F.col("nth").alias("n_nth"), F.col("text").alias("n_text"), F.col("touched").alias("n_touched"))
    both = old.join(here, ["path", "hunk", "name"], "left")
    far = F.when(plain_form(F.col("text")) == plain_form(F.col("n_text")), -1).otherwise(F.levenshtein(plain_form(F.col("text")), plain_form(F.col("n_text"))))
    both = both.withColumn("_far", far).withColumn("_taken", F.min("_far").over(Window.partitionBy("path", "hunk", "name", "n_nth")) == -1)
    free = ~F.coalesce("_taken", F.lit(False)) | (F.col("_far") == -1)  # what equals one old declaration is no other's new form
    both = both.withColumns({c: F.when(free, F.col(c)) for c in ("n_nth", "n_text", "n_touched", "_far")})
    nearest = latest_by(both, ["path", "hunk", "name", "nth", "text"], F.col("_far").asc_nulls_last(), F.col("n_nth"))
    found = cut(nearest.where("touched OR n_touched"), "near-declarations")

    changed = found.where("n_text IS NOT NULL AND _far >= 0").select("path", "name", "kind", "hunk", "nth", F.lit("changed").alias("change"), F.col("text").alias("before"), F.col("n_text").alias("after"))
    still = here.select("path", "name").distinct()
    gone = found.where("n_text IS NULL AND (own OR status = 'removed')").join(still, ["path", "name"], "left_anti")
    removed = gone.select("path", "name", "kind", "hunk", "nth", F.lit("removed").alias("change"), F.col("text").alias("before"), F.lit(None).cast("string").alias("after"))
    told = cut(latest_by(changed.unionByName(removed), ["path", "name"], F.col("hunk"), F.col("nth")), "contracts")

    written = new.where("status = 'added' OR own").select(F.col("path").alias("to"), "name", "kind", "hunk", "nth", F.col("text").alias("after"))
    lost = told.where("change = 'removed'").select(F.col("path").alias("moved_from"), "name", "kind", "before")
    homes = lost.join(written, ["name", "kind"]).where("`to` <> moved_from")
    apart = homes.groupBy("moved_from", "name").agg(F.count_distinct("to").alias("_homes")).where("_homes = 1")
    same = plain_form(F.col("before")) == plain_form(F.col("after"))
    order = Window.partitionBy("moved_from", "name").orderBy((~same).cast("int"), "hunk", "nth")
    moved = homes.join(apart, ["moved_from", "name"]).withColumn("_n", F.row_number().over(order)).where((F.col("_n") == 1) & ~same)
    # Two files may have lost what one has gained: the first by name is told.
    moved = latest_by(moved, ["to", "name"], F.col("moved_from")).join(told.select(F.col("path").alias("to"), "name"), ["to", "name"], "left_anti")
    out = told.select("path", "name", "kind", "change", "before", "after", F.lit(None).cast("string").alias("moved_from"))
    return out.unionByName(moved.select(F.col("to").alias("path"), "name", "kind", F.lit("changed").alias("change"), "before", "after", "moved_from"))


#: Contracts up to this many are broadcast (some 100 bytes each), more are joined by a shuffle.
BROADCAST_NAMES = 100_000
#: Words are counted by so many buckets; one with more than this part of all words is hot: fewer than HOT_PART of all can be.
WORD_BUCKETS, HOT_PART = 65_536, 256


def left_behind(contracts: DataFrame, lines: DataFrame, edited: DataFrame) -> DataFrame:
    """name, contract_path, change, path, line: lines (path, line, content) that mention a changed contract and were not edited along (edited: path, line).

    A name that several files' contracts have is told for each; its own file is left out, as its declaration stands there. A line is opened to its distinct words, which meet the names
    by equality. Words of hot buckets do not travel: their bucket's contracts, some 256 in 65 536 of all, are broadcast to them. Null paths, lines and names: left out.
    """
    names = contracts.where("name IS NOT NULL").select("name", F.col("path").alias("contract_path"), "change").distinct()
    names = cut(names, "names")
    words = F.array_distinct(F.regexp_extract_all("content", F.lit(r"([\w$]+)"), F.lit(1)))
    opened = lines.where("path IS NOT NULL AND line IS NOT NULL").select("path", "line", F.explode(words).alias("name"))
    if names.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES:
        met = opened.join(F.broadcast(names), "name")
    else:
        bucket = F.pmod(F.xxhash64("name"), F.lit(WORD_BUCKETS))
        counted = opened.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
        hot = [r["bucket"] for r in counted.withColumn("all", F.sum("n").over(Window.partitionBy())).where(F.col("n") * HOT_PART > F.col("all")).collect()]
        met = opened.where(~bucket.isin(hot)).join(names.where(~bucket.isin(hot)).hint("merge"), "name")
        if hot:
            met = met.unionByName(opened.where(bucket.isin(hot)).join(F.broadcast(names.where(bucket.isin(hot))), "name"))
    kept = met.where("path <> contract_path").join(edited.select("path", "line").hint("merge"), ["path", "line"], "left_anti")
    return kept.select("name", "contract_path", "change", "path", "line").distinct()
