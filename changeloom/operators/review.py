"""What a review is put together from: usages, contracts, contexts, groupings, verdicts. Native unless it says so."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeloom.functions.paths import ancestors, base_name, dir_name
from changeloom.functions.text import criterion_key, words
from changeloom.operators.graph import reach, rolled_up
from changeloom.operators.relational import keep_newest, latest_by, spread

# --- resolution ------------------------------------------------------------------------------------------------


def alias_match(specifiers: DataFrame, aliases: DataFrame) -> DataFrame:
    """Specifiers (specifier) with the alias (pattern with one `*` or none, target) that fits, longest prefix first.

    Specifiers are opened to their prefixes, so patterns are joined by equality.
    """
    star = F.col("pattern").contains("*")
    a = aliases.select("pattern", "target", F.substring_index("pattern", "*", 1).alias("_p"), F.when(star, F.substring_index("pattern", "*", -1)).alias("_s"))
    opened = specifiers.select("specifier").distinct().select("specifier", F.explode(F.sequence(F.lit(0), F.length("specifier"))).alias("_n")).withColumn("_p", F.left("specifier", F.col("_n")))
    rest = F.substr("specifier", F.col("_n") + 1)
    fits = F.when(F.col("_s").isNull(), rest == "").otherwise(F.endswith(rest, F.col("_s")) & (F.length(rest) >= F.length("_s")))
    found = opened.join(a, "_p").where(fits)
    middle = F.left(rest, F.length(rest) - F.coalesce(F.length("_s"), F.lit(0)))
    return latest_by(found.withColumn("resolved", F.replace("target", F.lit("*"), middle)), ["specifier"], F.col("_s").isNotNull(), F.desc("_n"), F.col("pattern")).select("specifier", "pattern", "resolved")


def inherited_settings(configs: DataFrame, settings: DataFrame, max_depth: int = 12) -> DataFrame:
    """settings (id, key, value) of each config (id, parent) with those of its ancestors; the nearest wins."""
    edges = configs.where("parent IS NOT NULL").select(F.col("id").alias("src"), F.col("parent").alias("dst"))
    above = reach(edges, configs.select(F.col("id").alias("origin"), "id"), max_hops=max_depth, keyed=True)
    found = above.join(settings, "id").groupBy("origin", "key").agg(F.min_by("value", "hops").alias("value"))
    return found.withColumnRenamed("origin", "id")


# --- usages and contracts --------------------------------------------------------------------------------------


def usage_index(*uses: DataFrame) -> DataFrame:
    """Uses (id, file, line, name) of all kinds: the lines and names by declaration and file, and their weight."""
    rows = uses[0]
    for more in uses[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("id", "file").agg(F.array_sort(F.collect_set("line")).alias("lines"), F.array_sort(F.collect_set("name")).alias("names"), F.greatest(F.lit(1), F.count_distinct("line")).alias("weight"))


def link_index(links: DataFrame) -> DataFrame:
    """links (kind, text, target, line, ord): of each kind and text the first target, and the lines that lead to it."""
    first = links.groupBy("kind", "text").agg(F.min_by("target", "ord").alias("target"))
    return links.join(first, ["kind", "text", "target"]).groupBy("kind", "text", "target").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def contract_changes(changes: DataFrame, exported: DataFrame, still_provided: DataFrame) -> DataFrame:
    """Changes (id, status) of exported declarations (id, file, name) that callers feel; a name that its file still provides is none."""
    felt = changes.where("status IN ('signature', 'removed', 'moved')").join(exported, "id")
    return felt.join(still_provided.select("file", "name").withColumn("_still", F.lit(True)), ["file", "name"], "left").where("status = 'signature' OR _still IS NULL").drop("_still")


def new_dead_imports(base: DataFrame, head: DataFrame) -> DataFrame:
    """Imports (file, source, name) that resolve to nothing at head and did not at base."""
    return head.join(base, ["file", "source", "name"], "left_anti")


def component_edge_changes(base: DataFrame, head: DataFrame, owners: DataFrame) -> DataFrame:
    """Pairs of owners that only one side's edges connect."""
    b, h = rolled_up(base, owners), rolled_up(head, owners)
    pair = ["src_owner", "dst_owner"]
    return h.join(b, pair, "left_anti").select(*pair, F.lit("added").alias("change")).unionByName(b.join(h, pair, "left_anti").select(*pair, F.lit("removed").alias("change")))


def env_changes(base: DataFrame, head: DataFrame) -> DataFrame:
    """Variables (name, part, key, value) of two sides by name: new, gone or changed, and how many of each part differ."""
    j = base.withColumnRenamed("value", "_b").join(head.withColumnRenamed("value", "_h"), ["name", "part", "key"], "full_outer")
    seen = j.groupBy("name").agg(F.count("_b").alias("n_b"), F.count("_h").alias("n_h"), *[F.count_if((F.col("part") == p) & ~F.col("_b").eqNullSafe(F.col("_h"))).alias(p) for p in ("read", "decl", "set")])
    status = F.when(F.col("n_b") == 0, "new").when(F.col("n_h") == 0, "gone").when(F.col("read") + F.col("decl") + F.col("set") > 0, "changed")
    return seen.withColumn("status", status).where("status IS NOT NULL").drop("n_b", "n_h")


def endpoint_tables(reached: DataFrame, uses: DataFrame) -> DataFrame:
    """reached (origin, id) and table uses (id, table, write): tables of each endpoint, whether read or written, and through what."""
    return reached.join(uses, "id").groupBy("origin", "table").agg(F.bool_or("write").alias("writes"), F.bool_or(~F.col("write")).alias("reads"), F.array_sort(F.collect_set("id")).alias("via"))


def access(reads: Column, writes: Column) -> Column:
    return F.when(reads & writes, "both").when(writes, "write").when(reads, "read")


# --- lines -----------------------------------------------------------------------------------------------------


#: Cells of a table of common lengths (4 bytes each) that are held at once, and the strips that a larger one is cut in; results don't depend on them.
TABLE_CELLS, STRIPS = 1 << 24, 16
#: Tokens of a line up to which words of two lines are compared, and the least part of them that is alike.
LONGEST_LINE, LEAST_ALIKE = 400, 0.4
TOKEN = re.compile(r"\w+|\s+|[^\w\s]", re.ASCII)


def longest_common(a: list, b: list, old_first: bool = True) -> list[tuple[int, int]]:
    """The positions that a longest common subsequence pairs. Where either side can be passed over, it is the old one, or else the new one.

    The table of common lengths is worked out from its end, and walked from its start. Of a large one only rows at the borders of strips are kept; a strip's
    rows are worked out anew when the walk gets there, so memory grows with the lines of the new side (some STRIPS rows a level), and time with the table.
    """
    same = {x: k for k, x in enumerate({*a, *b})}
    x, y = np.array([same[v] for v in a], np.int32), np.array([same[v] for v in b], np.int32)
    pairs = []

    def above(row: np.ndarray, i: int, j: int) -> np.ndarray:
        """The longest of a[i:] and b[j:], b[j + 1:], ...; row: those of a[i + 1:]."""
        best = np.where(y[j:] == x[i], row[1:] + 1, row[:-1])
        return np.append(np.maximum.accumulate(best[::-1])[::-1], np.int32(0))

    def walked(i: int, end: int, j: int, below: np.ndarray) -> int:
        """Pairs of a[i:end], from j on; where on the new side that ends. below: the row of end, from j on."""
        start, first = i, j
        if j == len(b):
            return j
        if end - i > 1 and (end - i) * len(below) > TABLE_CELLS:
            borders = [*range(i, end, -(-(end - i) // STRIPS)), end]
            rows, row = {end: below}, below
            for k in range(end - 1, borders[1] - 1, -1):
                row = above(row, k, first)
                if k in borders:
                    rows[k] = row
            for upper, lower in zip(borders, borders[1:], strict=False):
                j = walked(upper, lower, j, rows.pop(lower)[j - first :])
            return j
        left = [below]
        for k in range(end - 1, start - 1, -1):
            left.append(above(left[-1], k, first))
        left.reverse()
        while i < end and j < len(b):
            past_old, past_new = left[i + 1 - start][j - first], left[i - start][j + 1 - first]
            if x[i] == y[j]:
                pairs.append((i, j))
                i, j = i + 1, j + 1
            elif past_old >= past_new if old_first else past_old > past_new:
                i += 1
            else:
                j += 1
        return j

    walked(0, len(a), 0, np.zeros(len(b) + 1, np.int32))
    return pairs


def lcs_pairs(old: Column, new: Column, old_first: bool = True) -> Column:
    """The pairs of positions of two arrays of lines that a longest common subsequence keeps, of sides of any length; null if one is null.

    What both sides start with is paired without a table, as any longest one can start so.
    """

    @F.pandas_udf("array<struct<old: int, new: int>>")
    def inner(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else [{"old": i, "new": j} for i, j in longest_common(list(x), list(y), old_first)] for x, y in zip(a, b, strict=True)])

    same = F.zip_with(old, new, lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    ahead = F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(same)).cast("int")
    rest = lambda x: F.slice(x, ahead + 1, F.greatest(F.lit(0), F.size(x) - ahead))
    begun = F.transform(F.filter(F.sequence(F.lit(0), ahead), lambda i: i < ahead), lambda i: F.struct(i.alias("old"), i.alias("new")))
    return F.concat(begun, F.transform(inner(rest(old), rest(new)), lambda p: F.struct((p["old"] + ahead).alias("old"), (p["new"] + ahead).alias("new"))))


def block_diff(blocks: DataFrame, before: str, after: str, *keys: str) -> DataFrame:
    """keys, nth, sign, line of blocks (keys, before, after): what stays (a blank, the new side's line), goes (-) and comes (+), blanks around lines apart; nth from 1.

    What goes and comes between two lines that stay is told in the order of a walk that takes the new side first where both do. Null sides are empty texts' lines: none.
    """
    lines = lambda c: F.when(F.col(c).isNull(), F.array().cast("array<string>")).otherwise(F.split(c, "\n", -1))
    rows = spread(blocks).select(*keys, lines(before).alias("_a"), lines(after).alias("_b"))
    trimmed = lambda c: F.transform(c, lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    paired = rows.withColumn("_p", lcs_pairs(trimmed("_a"), trimmed("_b"), old_first=False))
    kept = F.transform("_p", lambda p: F.struct(p["old"].alias("i"), p["new"].alias("j")))
    # Gaps between pairs, the last one behind them: new lines come before old ones there.
    ends = F.concat(F.array(F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j"))), kept, F.array(F.struct(F.size("_a").alias("i"), F.size("_b").alias("j"))))
    item = lambda sign, x: F.struct(F.lit(sign).alias("sign"), x.alias("line"))

    def gap(e: Column, k: Column) -> Column:
        nxt = F.get(ends, k + 1)
        come = F.transform(F.slice("_b", e["j"] + 2, F.greatest(F.lit(0), nxt["j"] - e["j"] - 1)), lambda x: item("+", x))
        go = F.transform(F.slice("_a", e["i"] + 2, F.greatest(F.lit(0), nxt["i"] - e["i"] - 1)), lambda x: item("-", x))
        stay = F.when(nxt["j"] < F.size("_b"), F.array(item(" ", F.get("_b", nxt["j"])))).otherwise(F.slice(F.array(item(" ", F.lit(""))), 1, 0))
        return F.concat(come, go, stay)

    told = F.flatten(F.transform(F.slice(ends, 1, F.size(ends) - 1), gap))
    return paired.select(*keys, F.posexplode(told).alias("_n", "d")).select(*keys, (F.col("_n") + 1).alias("nth"), "d.sign", "d.line")


def _marks(a: str | None, b: str | None) -> tuple[list[str], list[str], list[tuple[int, int]]] | None:
    """Tokens of both lines and the pairs that are kept; None where marks would not help."""
    if a is None or b is None or a == b:
        return None
    x, y = TOKEN.findall(a), TOKEN.findall(b)
    if len(x) > LONGEST_LINE or len(y) > LONGEST_LINE:
        return None
    pairs = longest_common(x, y)
    return (x, y, pairs) if 2 * sum(len(x[i]) for i, _ in pairs) >= LEAST_ALIKE * max(1, len(a) + len(b)) else None


def _spans(tokens: list[str], kept: set[int]) -> list[dict]:
    out, at = [], 0
    for k, t in enumerate(tokens):
        if k not in kept:
            if out and out[-1]["end"] == at:
                out[-1]["end"] += len(t)
            else:
                out.append({"start": at, "end": at + len(t)})
        at += len(t)
    return out


def word_ranges(old: Column, new: Column) -> Column:
    """Of a changed line the ranges of characters that differ on either side: struct<old, new> of arrays of (start, end); null for equal lines, more than LONGEST_LINE tokens or too little alike."""

    @F.pandas_udf("struct<old: array<struct<start: int, end: int>>, new: array<struct<start: int, end: int>>>")
    def ranges(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        found = [_marks(x, y) for x, y in zip(a, b, strict=True)]
        return pd.DataFrame({"old": [None if m is None else _spans(m[0], {i for i, _ in m[2]}) for m in found], "new": [None if m is None else _spans(m[1], {j for _, j in m[2]}) for m in found]})

    found = ranges(old, new)
    return F.when(found["old"].isNotNull(), found)


def word_diff(old: Column, new: Column) -> Column:
    """Of a changed line its same, old and new runs of words; null as in word_ranges."""

    @F.pandas_udf("array<struct<kind: string, text: string>>")
    def runs(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            if (m := _marks(x, y)) is None:
                out.append(None)
                continue
            told, i, j = [], 0, 0
            for p, q in (*m[2], (len(m[0]), len(m[1]))):
                for kind, text in (("old", "".join(m[0][i:p])), ("new", "".join(m[1][j:q])), ("same", m[0][p] if p < len(m[0]) else "")):
                    if text and told and told[-1]["kind"] == kind:
                        told[-1]["text"] += text
                    elif text:
                        told.append({"kind": kind, "text": text})
                i, j = p + 1, q + 1
            out.append(told)
        return pd.Series(out)

    return runs(old, new)


def placed_comments(findings: DataFrame, shown: DataFrame, files: DataFrame) -> DataFrame:
    """Findings (id, file, line) on a diff whose new side shows lines (file, line): where they go, or why they don't."""
    at = shown.select("file", "line").distinct().withColumn("_shown", F.lit(True))
    in_diff = files.select("file").distinct().withColumn("_file", F.lit(True))
    j = findings.join(at, ["file", "line"], "left").join(in_diff, "file", "left")
    where = F.when(F.col("_shown"), "inline").when(F.col("line").isNull(), "no-line").when(F.col("_file"), "line-not-in-diff").otherwise("file-not-in-diff")
    return j.select("id", "file", "line", where.alias("placement"))


def diff_identifiers(lines: DataFrame, *keep: str) -> DataFrame:
    """The distinct identifiers of three characters or more on changed lines (content)."""
    return lines.select(*keep, F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"([A-Za-z_$][A-Za-z0-9_$]{2,})"), F.lit(1)))).alias("identifier")).distinct()


def code_search(lines: DataFrame, text: str, shown: int = 60) -> DataFrame:
    """The first lines (path, line, content) that hold a text, and how many there are."""
    found = lines.where(F.col("content").contains(text))
    total = found.count()
    return found.orderBy("path", "line").limit(shown).withColumn("total", F.lit(total))


# --- groupings -------------------------------------------------------------------------------------------------


def folder_cut(files: DataFrame, least: int = 3, largest: float = 0.75) -> DataFrame:
    """files (cluster, path) by the folder below the cluster's own: null where a cut would not help.

    A part needs `least` files, and a cluster is cut only if its largest part has at most that share.
    """
    below = F.regexp_extract("path", "^(?:.*/)?([^/]+)/[^/]+$", 1)
    rows = files.withColumn("_f", below).withColumn("_n", F.count("*").over(Window.partitionBy("cluster", "_f")))
    rows = rows.withColumn("_f", F.when(F.col("_n") >= least, F.col("_f")).otherwise("")).withColumn("_n", F.count("*").over(Window.partitionBy("cluster", "_f")))
    whole = Window.partitionBy("cluster")
    share = F.max("_n").over(whole) / F.count("*").over(whole)
    return rows.withColumn("part", F.when(share <= largest, F.col("_f"))).drop("_f", "_n")


def card_split(files: DataFrame, card: str, key: str, cards: int = 8) -> DataFrame:
    """The largest keys of each card as cards of their own, the rest together as Other."""
    counted = files.groupBy(card, key).agg(F.count("*").alias("_n"))
    ranked = counted.withColumn("_r", F.row_number().over(Window.partitionBy(card).orderBy(F.desc("_n"), key)))
    return files.join(ranked.select(card, key, "_r"), [card, key]).withColumn("part", F.when(F.col("_r") < cards, F.col(key)).otherwise("Other")).drop("_r")


def compact_placements(files: DataFrame) -> DataFrame:
    """files (path, key): the shortest folders (or files) all of whose files have one key, so that each file is in one."""
    opened = files.select("path", "key", F.explode(ancestors(F.col("path"))).alias("prefix"))
    uniform = opened.groupBy("prefix").agg(F.count_distinct("key").alias("_k"), F.min("key").alias("key")).where("_k = 1").drop("_k")
    best = opened.select("path", "prefix").join(uniform, "prefix").groupBy("path").agg(F.min_by(F.struct("prefix", "key"), F.length("prefix")).alias("b"))
    return best.select("b.prefix", "b.key").distinct()


def prefix_groups(rows: DataFrame, name: str, pattern: str = r"^([A-Za-z]+)[-_.]") -> DataFrame:
    """group: the prefix of the name, if two rows or more share it."""
    p = rows.withColumn("_p", F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")))
    return p.withColumn("group", F.when(F.count("*").over(Window.partitionBy("_p")) >= 2, F.col("_p"))).drop("_p")


def feature_keys(files: DataFrame) -> DataFrame:
    """Words of file names: files, distinct names and distinct folders of each."""
    rows = files.select("path", F.explode(F.array_distinct(words(F.substring_index(base_name(F.col("path")), ".", 1)))).alias("key"))
    return rows.groupBy("key").agg(F.count("*").alias("files"), F.count_distinct(base_name(F.col("path"))).alias("names"), F.count_distinct(dir_name(F.col("path"))).alias("folders"))


def capped_neighbourhood(nodes: DataFrame, edges: DataFrame, n: int = 400) -> tuple[DataFrame, DataFrame]:
    """The n nodes (id, changed, degree) that matter most, changed ones first, and the edges among them."""
    kept = nodes.orderBy(F.desc("changed"), F.desc("degree"), "id").limit(n)
    ids = kept.select("id")
    return kept, edges.join(ids, F.col("src") == F.col("id"), "left_semi").join(ids, F.col("dst") == F.col("id"), "left_semi")


# --- verdicts --------------------------------------------------------------------------------------------------


def ci_state(checks: DataFrame, key: str = "sha") -> DataFrame:
    """The state of each commit's checks (key, state): any failure, else any pending, else success."""
    has = lambda s: F.bool_or(F.col("state") == s)
    return checks.groupBy(key).agg(F.when(has("failure"), "failure").when(has("pending"), "pending").otherwise("success").alias("state"))


def outcome(before: Column, after: Column) -> Column:
    """before and after: null (absent), 'failed', or what came out."""
    failed_b, failed_a = before == "failed", after == "failed"
    return F.when(before.isNull() & after.isNull(), None).when(failed_b & failed_a, "failed").when(before.isNull(), F.when(failed_a, "failed").otherwise("new")).when(after.isNull(), "removed").when(failed_a, "breaks").when(failed_b, "recovers").when(before == after, "same").otherwise("different")


def numbered_criteria(criteria: DataFrame, target: str = "target", most: int = 40) -> DataFrame:
    """criteria (target, ord, text): each once by its letters and digits, the first stays, numbered c1, c2, ... in order."""
    once = latest_by(criteria.withColumn("_k", criterion_key(F.col("text"))).where("_k <> ''"), [target, "_k"], F.col("ord"))
    numbered = keep_newest(once, [target], most, F.col("ord"))
    return numbered.select(target, F.concat(F.lit("c"), F.col("nth").cast("string")).alias("id"), "text")


def posted_record(findings: DataFrame, log: DataFrame) -> DataFrame:
    """Findings (id, fingerprint) that the log (finding_id, fingerprint, posted_at) knows by id, else by fingerprint."""
    by_id = findings.join(log.select(F.col("finding_id").alias("id"), "posted_at"), "id")
    rest = findings.join(by_id.select("id"), "id", "left_anti").join(log.select("fingerprint", "posted_at"), "fingerprint")
    return by_id.select("id", "posted_at").unionByName(rest.select("id", "posted_at")).groupBy("id").agg(F.min("posted_at").alias("posted_at"))


def swept(findings: DataFrame, targets: DataFrame, keep: DataFrame) -> DataFrame:
    """Findings without those of the given targets whose component (target, component) is not to be kept."""
    mine = findings.join(targets.select("target"), "target", "left_semi").join(keep, ["target", "component"], "left_semi")
    return findings.join(targets.select("target"), "target", "left_anti").unionByName(mine)
