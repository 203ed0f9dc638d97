"""Joins, upserts and snapshot differences over typed tables."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeloom.checkpoints import cut
from changeloom.functions.paths import ancestors


def latest_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row of each key: the first in the given order. A row is combined in each task before it is shuffled."""
    rank = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(rank)).where("_nth = 1").drop("_nth")


def keep_newest(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each key; Spark cuts groups off at n before it shuffles them."""
    rank = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("nth", F.row_number().over(rank)).where(F.col("nth") <= n)


def spread(rows: DataFrame) -> DataFrame:
    """rows, dealt over as many tasks as shuffles have: for work that costs far more a row than its move, as a small file is one task's."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: Rows that a task holds of what is grouped, some tens of MB.
TASK_ROWS = 250_000


def dealt(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """rows by keys, in as many tasks as their number asks for: groups of these keys, or of more, then need no other shuffle, and what a task holds does not grow with the input."""
    return rows.repartition(max(1, math.ceil(rows.count() / TASK_ROWS)), *keys)


def upsert(base: DataFrame, incoming: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest version of each key; of equal versions the incoming one."""
    both = base.withColumn("_in", F.lit(0)).unionByName(incoming.withColumn("_in", F.lit(1)), allowMissingColumns=True)
    return latest_by(both, keys, F.desc(version), F.desc("_in")).drop("_in")


def insert_or_ignore(base: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    return base.unionByName(incoming.dropDuplicates(keys).join(base, keys, "left_anti"))


def insert_if_ends_exist(edges: DataFrame, nodes: DataFrame, src: str = "src", dst: str = "dst", node: str = "id") -> DataFrame:
    """Edges whose two ends are nodes."""
    ids = nodes.select(F.col(node).alias("_id"))
    return edges.join(ids, F.col(src) == F.col("_id"), "left_semi").join(ids, F.col(dst) == F.col("_id"), "left_semi")


def prune_orphans(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    return children.join(parents, keys, "left_semi")


def patch_merge(base: DataFrame, patch: DataFrame, keys: list[str], cleared: str = "cleared") -> DataFrame:
    """Fields of the patch over those of the base; fields that its array `cleared` names become null."""
    fields = [c for c in base.columns if c not in keys]
    given = patch.select(*keys, F.col(cleared).alias("_cleared"), *[F.col(c).alias(f"_{c}") if c in patch.columns else F.lit(None).alias(f"_{c}") for c in fields])
    value = lambda c: F.when(F.array_contains("_cleared", c), F.lit(None)).otherwise(F.coalesce(f"_{c}", c)).alias(c)
    return base.join(given, keys, "left").select(*keys, *map(value, fields))


def keep_alive(df: DataFrame, expires: str, now: Column) -> DataFrame:
    return df.where(F.col(expires).isNull() | (F.col(expires) > now))


def snapshot_diff(base: DataFrame, head: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, status (added, removed, changed, same) and the names of the columns that differ, in their order."""
    b = base.select(*keys, *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(True).alias("_b"))
    h = head.select(*keys, *[F.col(c).alias(f"h_{c}") for c in columns], F.lit(True).alias("_h"))
    aspects = F.array_compact(F.array(*[F.when(~F.col(f"b_{c}").eqNullSafe(F.col(f"h_{c}")), F.lit(c)) for c in columns]))
    joined = b.join(h, keys, "full_outer").withColumn("aspects", F.when(F.col("_b") & F.col("_h"), aspects).otherwise(F.array().cast("array<string>")))
    status = F.when(F.col("_b").isNull(), "added").when(F.col("_h").isNull(), "removed").when(F.size("aspects") > 0, "changed").otherwise("same")
    return joined.withColumn("status", status).drop("_b", "_h")


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("added", "removed", "changed", "same")])


def edge_changes(base: DataFrame, head: DataFrame, head_nodes: DataFrame) -> DataFrame:
    """(src, dst, change): edges that are new, and edges that went although both ends are still there; repeated edges count once.

    The edges of both sides are grouped once, so nothing is joined to tell which side has them.
    """
    pair = ["src", "dst"]
    of = lambda edges, side: edges.select(*pair, F.lit(side).alias("_head"))
    told = dealt(of(base, False).unionByName(of(head, True)), *pair).groupBy(*pair).agg(F.bool_and("_head").alias("_new"), F.bool_or("_head").alias("_there"))
    removed = insert_if_ends_exist(told.where("NOT _there").select(pair), dealt(head_nodes.select("id"), "id"))
    return told.where("_new").select(*pair, F.lit("added").alias("change")).unionByName(removed.withColumn("change", F.lit("removed")))


def orphans(base_edges: DataFrame, head_edges: DataFrame, head_nodes: DataFrame) -> DataFrame:
    """Nodes that lost the last edge into them."""
    lost = edge_changes(base_edges, head_edges, head_nodes).where("change = 'removed'").select(F.col("dst").alias("id")).distinct()
    return lost.join(head_edges.select(F.col("dst").alias("id")), "id", "left_anti")


def moved_unique(base: DataFrame, head: DataFrame, place: str, what: list[str]) -> DataFrame:
    """What went from one place and is new in exactly one other: what, from, to."""
    key = [place, *what]
    gone = base.join(head, key, "left_anti").select(*what, F.col(place).alias("moved_from"))
    new = head.join(base, key, "left_anti").groupBy(*what).agg(F.min(place).alias("moved_to"), F.count_distinct(place).alias("n")).where("n = 1").drop("n")
    return gone.join(new, what).where("moved_from <> moved_to")


def uses_left_behind(uses: DataFrame, changed: DataFrame, written: DataFrame) -> DataFrame:
    """Uses (id, file, line) of changed ids on lines that the change did not write."""
    return uses.join(changed.select("id").distinct(), "id", "left_semi").join(written, ["file", "line"], "left_anti")


def longest_prefix(paths: DataFrame, owners: DataFrame, path: str = "path", prefix: str = "prefix") -> DataFrame:
    """Each path with its most specific owner: an equal one first, else the longest folder above it.

    Paths are opened to their ancestors, so this is an equality join and no comparison of all with all.
    """
    opened = paths.select(path).distinct().select(path, F.posexplode(ancestors(F.col(path))).alias("_up", prefix))
    found = opened.join(owners, prefix).groupBy(path).agg(F.min_by(F.struct(*[F.col(c) for c in owners.columns]), "_up").alias("_owner"))
    return paths.join(found, path, "left").select(*paths.columns, "_owner.*")


def nearest_ancestor(paths: DataFrame, configs: DataFrame, path: str = "path", folder: str = "folder") -> DataFrame:
    return longest_prefix(paths, configs.withColumnRenamed(folder, "prefix"), path).withColumnRenamed("prefix", folder)


def suffix_match(reported: DataFrame, files: DataFrame) -> DataFrame:
    """Each reported path with the one file that shares the longest suffix with it; a tie is no match.

    A suffix of one segment counts only if no other file has that name. Longer ones are found by their last two
    segments, so files of a name that every folder has do not all meet.
    """
    r, f = (x.select(F.col("path").alias(n), F.reverse(F.split("path", "/")).alias(f"{n}_parts"), F.substring_index("path", "/", -1).alias("_name"), F.substring_index("path", "/", -2).alias("_tail")) for x, n in ((reported, "reported"), (files, "file")))
    same = F.zip_with("reported_parts", "file_parts", lambda a, b: a.eqNullSafe(b) & a.isNotNull())
    depth = F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(same)).cast("int")
    order = Window.partitionBy("reported").orderBy(F.desc("depth"))
    deep = r.join(f.drop("_name"), "_tail").withColumn("depth", depth).where("depth >= 2").withColumn("_rank", F.rank().over(order)).where("_rank = 1")
    best = deep.groupBy("reported").agg(F.count("*").alias("_n"), F.min("file").alias("file"), F.min("depth").alias("depth"))
    alone = f.groupBy("_name").agg(F.count("*").alias("_n"), F.min("file").alias("file")).where("_n = 1").select("_name", "file")
    single = r.join(best.select("reported"), "reported", "left_anti").join(alone, "_name").select("reported", "file", F.lit(1).alias("depth"))
    return best.where("_n = 1").select("reported", "file", "depth").unionByName(single)


def innermost_interval(points: DataFrame, spans: DataFrame, key: str, point: str, first: str, last: str, span_id: str, width: int = 64) -> DataFrame:
    """Each point with the shortest span of its key that holds it; spans are laid into bins, so the join is by equality."""
    binned = spans.select(key, first, last, span_id, F.explode(F.sequence(F.floor(F.col(first) / width), F.floor(F.col(last) / width))).alias("_bin"))
    found = points.withColumn("_bin", F.floor(F.col(point) / width)).join(binned, [key, "_bin"]).where(F.col(point).between(F.col(first), F.col(last)))
    cols = [c for c in points.columns]
    return found.groupBy(*cols).agg(F.min_by(span_id, F.struct(F.col(last) - F.col(first), F.col(span_id))).alias(span_id))


def first_existing(candidates: DataFrame, files: DataFrame, key: str = "specifier") -> DataFrame:
    """Of each key's ordered candidates (nth, path) the first that is a file."""
    return candidates.join(files.select("path"), "path", "left_semi").groupBy(key).agg(F.min_by("path", "nth").alias("path"))


#: Rows and tokens of a group that one block holds at most; larger groups are cut in blocks, and pairs of blocks meet in a task each.
TOKEN_BLOCK = 65_536
SET_TOKENS = 8_000_000


#: Postings and pairs of a cell that are counted at once, 8 bytes each.
NEAR_BATCH = 4_000_000


def near_sets(cell: pa.Table, threshold: float, sided: bool) -> pa.Table:
    """left, right, score of one cell (group, side, words, own, i, j): row numbers of sets of one group whose similarity reaches the threshold, once each.

    Sets are ordered from rare to frequent tokens. Of two similar ones the first |x| - ceil(t |x|) + 1 tokens meet; what the first tokens share, with all that stands behind them
    in the set whose first tokens end earlier, is the most that two can share. Only pairs for which that is enough are counted out. Sets stand in order of their sizes, so
    a set's first tokens are looked up among those of near sizes only.
    """
    words = pc.split_pattern(cell["words"].combine_chunks(), "\0")
    at = np.argsort(pc.list_value_length(words).to_numpy(zero_copy_only=False), kind="stable")
    words = words.take(pa.array(at))
    lengths = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = pc.list_flatten(words).dictionary_encode().indices.to_numpy().astype(np.int64)
    group, side = (pc.dictionary_encode(cell[c].combine_chunks()).indices.to_numpy()[at] for c in ("group", "side"))
    own, i, j = cell["own"].to_numpy()[at], cell["i"][0].as_py(), cell["j"][0].as_py()
    n, doc = len(lengths), np.repeat(np.arange(len(lengths)), lengths)
    if group.max() > 0:  # a token of two groups is two
        codes = np.unique(group[doc].astype(np.int64) * (codes.max() + 1) + codes, return_inverse=True)[1]
    n_tokens = int(codes.max()) + 1
    seen = np.bincount(codes)
    rank = np.empty(n_tokens, np.int64)
    rank[np.argsort(seen, kind="stable")] = np.arange(n_tokens)
    ordered = np.sort(doc * n_tokens + rank[codes]) % n_tokens
    starts = np.concatenate([[0], np.cumsum(lengths)])
    heads = np.maximum(1, lengths - np.ceil(threshold * lengths - 1e-6).astype(np.int64) + 1)
    last, behind = ordered[starts[:-1] + heads - 1], lengths - heads
    of = np.arange(len(ordered)) - starts[doc] < heads[doc]
    lists, asked = of & (own[doc] == j), of & (own[doc] == i)
    keys = np.sort(ordered[lists] * n + doc[lists])
    posted = keys % n
    # The sets that each is compared with: of near sizes, and within a block those behind it.
    first = np.arange(n) + 1 if i == j else np.searchsorted(lengths, threshold * lengths - 1e-6)
    behind_last = np.searchsorted(lengths, lengths / max(threshold, 1e-9) + 1e-6, side="right")
    x, token = doc[asked], ordered[asked]
    begin, end = np.searchsorted(keys, token * n + first[x]), np.searchsorted(keys, token * n + behind_last[x])
    met = begin < end
    x, begin, count = x[met], begin[met], (end - begin)[met]
    marked, out, done = np.zeros(n_tokens, bool), [], 0
    # In runs of whole sets, of so many postings and compared pairs at once.
    width = np.maximum(0, behind_last - first)
    xs, of_x = np.unique(x, return_index=True)
    of_x = np.append(of_x, len(x))
    work = np.cumsum(np.add.reduceat(count, of_x[:-1]) + width[xs]) if len(xs) else np.zeros(0, np.int64)
    while done < len(xs):
        to = max(done + 1, int(np.searchsorted(work, (work[done - 1] if done else 0) + NEAR_BATCH, side="right")))
        part, now = slice(of_x[done], of_x[to]), xs[done:to]
        steps = count[part]
        y = posted[np.repeat(begin[part] - np.cumsum(steps) + steps, steps) + np.arange(steps.sum())]
        base = np.concatenate([[0], np.cumsum(width[now])])
        place = base[:-1] - first[now]
        shared = np.bincount(np.repeat(place[np.searchsorted(now, x[part])], steps) + y, minlength=base[-1])
        hit = np.flatnonzero(shared)
        a = np.searchsorted(base, hit, side="right") - 1
        b, a, n_shared = hit - place[a], now[a], shared[hit]
        most = n_shared + np.where(last[a] <= last[b], behind[a], behind[b])
        fits = (most >= threshold / (1 + threshold) * (lengths[a] + lengths[b]) - 1e-6) & (np.minimum(lengths[a], lengths[b]) >= threshold * np.maximum(lengths[a], lengths[b]) - 1e-6)
        if sided:
            fits &= side[a] != side[b]
        a, b = a[fits], b[fits]
        both, before = np.empty(len(a), np.int64), -1
        for k, (p, q) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            if p != before:
                if before >= 0:
                    marked[ordered[starts[before] : starts[before + 1]]] = False
                marked[ordered[starts[p] : starts[p + 1]]] = True
                before = p
            both[k] = np.count_nonzero(marked[ordered[starts[q] : starts[q + 1]]])
        if before >= 0:
            marked[ordered[starts[before] : starts[before + 1]]] = False
        score = both / (lengths[a] + lengths[b] - both)
        near = score >= threshold - 1e-9
        out.append((at[a[near]], at[b[near]], score[near]))
        done = to
    left, right, score = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pa.table({"left": left, "right": right, "score": score})


def similar_sets(rows: DataFrame, group: str, key: str, tokens: str, threshold: float, side: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(members: group, side, key, rep; pairs: group, left_rep, right_rep, score): rows of equal token sets by one of them, and which of those are similar.

    Sets are written once and travel once for each block that theirs meets (TOKEN_BLOCK, SET_TOKENS); blocks of far sizes don't meet, and small groups share a block. What two sets share is counted where their blocks
    meet (near_sets), so no candidate pair is shuffled. side: only rows of different sides are compared.
    """
    s = F.col(side) if side else F.lit(0)
    # Sets as one text, with what parts the tokens escaped in them. They are bound to a name and written before anything else is worked out from them, a filter too, so the tokens are
    # worked out once.
    escape = lambda w: F.replace(F.replace(w, F.lit("\1"), F.lit("\1\2")), F.lit("\0"), F.lit("\1\3"))

    def one_text(plain: Column) -> Column:
        rare = F.array_join(plain, "").contains("\0") | F.array_join(plain, "").contains("\1")
        return F.struct(F.size(plain).alias("n"), F.array_join(F.when(rare, F.transform(plain, escape)).otherwise(plain), "\0").alias("words"))

    bound = F.get(F.transform(F.array(F.array_sort(F.array_distinct(tokens))), one_text), 0)
    written = cut(rows.where(F.col(group).isNotNull()).select(group, s.alias("_side"), key, bound.alias("_set")), "token-sets")
    listed = written.where("_set.n > 0").select(group, "_side", key, F.col("_set.n").alias("_n"), F.col("_set.words").alias("_words"))
    told = listed.withColumn("_digest", F.sha2("_words", 256))
    same = [group, "_side", "_digest"]
    sets = cut(told.groupBy(*same).agg(F.min(key).alias("rep"), F.first("_n").alias("_n"), F.first("_words").alias("_words")), "token-heads")
    members = cut(told.select(*same, key).join(sets.select(*same, "rep").hint("merge"), same).select(group, "_side", key, "rep"), "set-members")

    sizes = cut(sets.groupBy(group).agg(F.count("*").alias("k"), F.sum("_n").alias("n")), "set-groups")
    k, n = sizes.agg(F.coalesce(F.sum("k"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    cells = max(1, math.ceil(k / TOKEN_BLOCK), math.ceil(n / SET_TOKENS))
    # Groups of half a block or more have cells of their own: twice as many as blocks at most. Their blocks follow the sizes of sets, and a size of more than a block has several:
    # of each block its number and its least and largest size.
    own_cells = sizes.where((F.col("k") * 2 > TOKEN_BLOCK) | (F.col("n") * 2 > SET_TOKENS)).select(group)
    by_size = sets.join(F.broadcast(own_cells), group, "left_semi").groupBy(group, "_n").agg(F.count("*").alias("k"))
    upto = Window.partitionBy(group).orderBy("_n")
    part = F.greatest(F.col("k") / TOKEN_BLOCK, F.col("k") * F.col("_n") / SET_TOKENS)
    placed = by_size.withColumn("_part", part).withColumn("_from", F.floor(F.sum("_part").over(upto) - F.col("_part") + 1e-9))
    opened = placed.select(group, "_n", F.explode(F.sequence(F.col("_from"), F.col("_from") + F.greatest(F.lit(0), F.ceil("_part") - 1))).alias("b"))
    each = opened.groupBy(group, F.col("b").cast("int").alias("b")).agg(F.min("_n").alias("lo"), F.max("_n").alias("hi"))
    large = cut(each.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("b", "lo", "hi"))).alias("_blocks")), "set-blocks")
    name = F.xxhash64(group)
    dealt = sets.join(F.broadcast(large), group, "left").withColumn("_cell", F.when(F.col("_blocks").isNull(), F.pmod(name, F.lit(cells))).otherwise(name))
    # A set is in one of the blocks of its size, and travels to those that hold sets of near sizes.
    among = F.filter("_blocks", lambda x: (x["lo"] <= F.col("_n")) & (F.col("_n") <= x["hi"]))
    own = F.get(F.transform(among, lambda x: x["b"]), F.pmod(F.xxhash64("_digest", "_side"), F.size(among)).cast("int"))
    near = F.filter("_blocks", lambda x: (x["b"] == F.col("_own")) | ((threshold * x["lo"] <= F.col("_n") + 1e-6) & (threshold * F.col("_n") <= x["hi"] + 1e-6)))
    dealt = dealt.withColumn("_own", F.when(F.col("_blocks").isNull(), 0).otherwise(own)).withColumn("_o", F.explode(F.coalesce(F.transform(near, lambda x: x["b"]), F.array(F.lit(0)))))
    met = dealt.where("_side IS NOT NULL").select("_cell", F.least("_own", "_o").alias("i"), F.greatest("_own", "_o").alias("j"), F.col("_own").alias("own"), F.col(group).alias("group"), F.col("_side").alias("side"), "rep", F.col("_words").alias("words"))

    def compare(cell: pa.Table) -> pa.Table:
        found = near_sets(cell, threshold, side is not None)
        left, right = cell.take(found["left"]), cell.take(found["right"])
        return pa.table({"g": left["group"], "left_side": left["side"], "left_rep": left["rep"], "right_side": right["side"], "right_rep": right["rep"], "score": found["score"]})

    of = {f.name: f.dataType.simpleString() for f in met.schema}
    schema = f"g {of['group']}, left_side {of['side']}, left_rep {of['rep']}, right_side {of['side']}, right_rep {of['rep']}, score double"
    # Dealt by hand, as cells cost far more than their bytes tell.
    found = met.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_cell", "i", "j").groupBy("_cell", "i", "j").applyInArrow(compare, schema)
    ahead = (F.col("left_side") < F.col("right_side")) if side else (F.col("left_rep") < F.col("right_rep"))
    of = lambda c: F.when(ahead, F.col(f"left_{c}")).otherwise(F.col(f"right_{c}"))
    other = lambda c: F.when(ahead, F.col(f"right_{c}")).otherwise(F.col(f"left_{c}"))
    told = found.where("left_rep <> right_rep").select(F.col("g").alias(group), of("side").alias("_left_side"), of("rep").alias("left_rep"), other("side").alias("_right_side"), other("rep").alias("right_rep"), "score")
    return members, cut(told, "similar-sets")


def similar_pairs(rows: DataFrame, group: str, key: str, tokens: str, threshold: float, side: str | None = None) -> DataFrame:
    """group, left_id, right_id, score: pairs of a group whose token sets have a Jaccard similarity of at least the threshold, exactly; left_id is the lesser.

    side: a column; only rows that differ in it are paired. Rows without tokens or group are in no pair. A group of n copies has n (n - 1) / 2 pairs:
    similar_links tells the same without writing them.
    """
    members, pairs = similar_sets(rows, group, key, tokens, threshold, side)
    of = lambda which: members.select(group, F.col("_side").alias(f"_{which}_side"), F.col("rep").alias(f"{which}_rep"), F.col(key).alias(f"_{which}"))
    found = pairs.join(of("left"), [group, "_left_side", "left_rep"]).join(of("right"), [group, "_right_side", "right_rep"])
    if side is None:
        equal = of("left").join(of("right").withColumnRenamed("right_rep", "left_rep"), [group, "left_rep"]).where("_left < _right").withColumn("score", F.lit(1.0))
        found = found.select(group, "_left", "_right", "score").unionByName(equal.select(group, "_left", "_right", "score"))
    return found.select(group, F.least("_left", "_right").alias("left_id"), F.greatest("_left", "_right").alias("right_id"), "score")


def similar_links(rows: DataFrame, group: str, key: str, tokens: str, threshold: float) -> DataFrame:
    """group, key, n_links, best: of each row the number of its partners in similar_pairs and the highest score; rows of equal sets are counted, not paired."""
    members, pairs = similar_sets(rows, group, key, tokens, threshold)
    sizes = members.groupBy(group, "rep").agg(F.count("*").alias("_size"))
    ways = pairs.select(group, F.col("left_rep").alias("rep"), F.col("right_rep").alias("_other"), "score").unionByName(pairs.select(group, F.col("right_rep").alias("rep"), F.col("left_rep").alias("_other"), "score"))
    near = ways.join(sizes.withColumnRenamed("rep", "_other"), [group, "_other"]).groupBy(group, "rep").agg(F.sum("_size").alias("_n"), F.max("score").alias("_best"))
    each = sizes.join(near, [group, "rep"], "left").select(group, "rep", (F.coalesce("_n", F.lit(0)) + F.col("_size") - 1).alias("n_links"), F.when(F.col("_size") > 1, 1.0).otherwise(F.col("_best")).alias("best"))
    return members.join(each, [group, "rep"]).select(group, key, "n_links", "best")


def carry_over(old: DataFrame, new: DataFrame, file: str, summary: str, kept: list[str], threshold: float = 0.6) -> DataFrame:
    """New findings (id) with the fields `kept` of the old one on the same file whose words are nearest.

    Each new finding takes its nearest old one, and an old one goes to the nearest new one that wants it.
    """
    both = old.select(F.concat(F.lit("old "), F.col("id").cast("string")).alias("k"), file, summary).unionByName(new.select(F.concat(F.lit("new "), F.col("id").cast("string")).alias("k"), file, summary))
    pairs = similar_pairs(both.withColumn("_t", F.split(summary, " ")).withColumn("_old", F.col("k").startswith("old ")), file, "k", "_t", threshold, side="_old")
    wanted = latest_by(pairs, ["left_id"], F.desc("score"), F.col("right_id"))
    given = latest_by(wanted, ["right_id"], F.desc("score"), F.col("left_id"))
    ids = given.select(F.substring("left_id", 5, 100).alias("_new"), F.substring("right_id", 5, 100).alias("_old"))
    fields = old.select(F.col("id").cast("string").alias("_old"), *kept)
    return new.drop(*kept).join(ids.join(fields, "_old"), F.col("id").cast("string") == F.col("_new"), "left").drop("_new", "_old")
