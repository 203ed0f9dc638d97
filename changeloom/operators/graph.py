"""Graph operators on edge tables (src, dst): loops of joins, one frontier a round.

Edges are written once before a loop; each round joins the frontier with them and drops what has been seen. What
is kept between rounds is a table of the shared folder, so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from changeloom.checkpoints import cut


def counted_cut(df: DataFrame, condition: Column) -> tuple[DataFrame, int]:
    """df as a table, and how many of its rows met the condition, counted while it was written."""
    seen = Observation()
    out = cut(df.observe(seen, F.count_if(condition).alias("n")), "round")
    return out, seen.get["n"]


#: Rows of a frontier, counted, up to which it is broadcast (some 100 bytes each).
FEW = 100_000


def shuffled(df: DataFrame) -> DataFrame:
    """df, not to be broadcast whatever the size of its files: they can be far smaller than its rows, and the driver builds what is broadcast."""
    return df.hint("merge")


def near_rows(frontier: DataFrame, n: int | None) -> DataFrame:
    """A frontier of n rows (None: not counted) as it is joined with all edges."""
    return shuffled(frontier) if n is None or n > FEW else F.broadcast(frontier)


def chased(known: DataFrame, child: str = "start", parent: str = "root") -> DataFrame:
    """child, parent with the last parent of each chain; each round doubles the step. A last one is its own parent or has no row.

    Links are shuffled: their files can be far smaller than they are, and Spark would go by the files and broadcast them.
    """
    known = cut(known.select(child, parent), "links")
    while True:
        onward = known.select(F.col(child).alias(parent), F.col(parent).alias("_onward"))
        step = cut(known.join(shuffled(onward), parent, "left").select(child, F.coalesce("_onward", parent).alias("_new"), parent), "links")
        if not step.where(f"NOT (_new <=> {parent})").limit(1).count():
            return step.select(child, parent)
        known = step.select(child, F.col("_new").alias(parent))


def reach(edges: DataFrame, seeds: DataFrame, *, max_hops: int | None = None, reverse: bool = False, barrier: DataFrame | None = None, keyed: bool = False, via: bool = False) -> DataFrame:
    """Nodes reached from seeds (id, or origin and id if keyed) with the fewest hops; seeds have 0.

    barrier (id): nodes that are reached but not passed. reverse: against the edges. via: the node before each on
    a shortest path, of several the smallest; null for seeds.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    key = ["origin", "id"] if keyed else ["id"]
    steps = edges.select(F.col(a).alias("id"), F.col(b).alias("next")).distinct()
    if barrier is not None:
        steps = steps.join(shuffled(barrier.select("id")), "id", "left_anti")
    steps = cut(steps, "steps")
    start = seeds.select(*key).distinct().withColumn("hops", F.lit(0))
    seen = frontier = cut(start.withColumn("via", F.lit(None).cast(steps.schema["id"].dataType)) if via else start, "reach")
    hops, n = 0, None
    while max_hops is None or hops < max_hops:
        hops += 1
        near = near_rows(frontier.drop("hops", "via"), n).join(steps, "id").withColumnRenamed("id", "via").withColumnRenamed("next", "id")
        near = near.groupBy(*key).agg(F.min("via").alias("via")) if via else near.select(*key).distinct()
        frontier, n = counted_cut(near.join(shuffled(seen.select(*key)), key, "left_anti").withColumn("hops", F.lit(hops)), F.lit(True))
        if not n:
            break
        seen = seen.unionByName(frontier)
        if hops % 8 == 0:
            seen = cut(seen, "reach")
    return seen


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_hops: int | None = 12) -> DataFrame:
    """pairs (src, dst) with the least number of hops between them; pairs without a path of max_hops (None: any) are left out."""
    seeds = pairs.select(F.col("src").alias("origin"), F.col("src").alias("id")).distinct()
    found = reach(edges, seeds, max_hops=max_hops, keyed=True)
    return pairs.distinct().join(shuffled(found.select(F.col("origin").alias("src"), F.col("id").alias("dst"), "hops")), ["src", "dst"])


def mutual(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of edges (src, dst) that lie on cycles with the smallest node of their group, by one walk in depth."""
    ahead: dict = {}
    for a, b in zip(rows["src"].tolist(), rows["dst"].tolist(), strict=True):
        ahead.setdefault(a, []).append(b)
    number, low, open_nodes, on, out = {}, {}, [], set(), []
    for start in ahead:
        path = [] if start in number else [(start, iter(ahead[start]))]
        while path:
            node, rest = path[-1]
            if node not in number:
                number[node] = low[node] = len(number)
                open_nodes.append(node)
                on.add(node)
            for b in rest:
                if b not in number:
                    path.append((b, iter(ahead.get(b, ()))))
                    break
                if b in on:
                    low[node] = min(low[node], number[b])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[node])
                if low[node] == number[node]:
                    group = []
                    while True:
                        group.append(x := open_nodes.pop())
                        on.discard(x)
                        if x == node:
                            break
                    if len(group) > 1:
                        out += [(x, min(group)) for x in group]
    return pd.DataFrame(out, columns=["id", "group"])


#: Graphs of up to this many edges that cycles can use (16 bytes each) are walked by one task, larger ones in rounds.
SMALL_GRAPH = 200_000


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the nodes of edges with the smallest node that they hang together with, whatever the edges' directions.

    Each round a node takes the least of its neighbours' names, and then the name that its namesake has.
    """
    ends = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = cut(ends.distinct(), "ends")
    known, moved = cut(both.groupBy(F.col("src").alias("id")).agg(F.least(F.col("id"), F.min("dst")).alias("component")), "components"), 1
    while moved:
        near = both.join(shuffled(known.withColumnRenamed("id", "src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("component").alias("near"))
        least = cut(known.join(shuffled(near), "id").select("id", "component", F.least("component", "near").alias("least")), "components")
        onward = least.select(F.col("id").alias("least"), F.col("least").alias("onward"))
        known, moved = counted_cut(least.join(shuffled(onward), "least").select("id", F.col("onward").alias("now"), "component"), F.col("now") != F.col("component"))
        known = known.select("id", F.col("now").alias("component"))
    return known


def within(edges: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """Edges between nodes (id) that have the same name."""
    a, b = (nodes.select(F.col("id").alias(end), F.col(name).alias(f"_{end}")) for end in ("src", "dst"))
    return edges.join(shuffled(a), "src").join(shuffled(b), "dst").where("_src = _dst").select("src", "dst")


def cycle_groups(edges: DataFrame) -> DataFrame:
    """(id, group): nodes that lie on cycles, and the smallest node of those that reach each other; cycles of any length.

    Edges that no cycle can use go first, as long as a round finds a twentieth of them. If few are left, one task walks them. Else those that
    hang together are walked, some SMALL_GRAPH a task. Of larger parts each node takes the largest node that reaches it as its colour; the nodes
    of a colour that reach its namesake are one group. What is left starts anew.
    """

    def usable(left: DataFrame, n: int, part: float) -> tuple[DataFrame, int]:
        while n > SMALL_GRAPH:  # an edge of a cycle starts where another ends, and ends where another starts
            ends, starts = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
            before = n
            left, n = counted_cut(left.join(shuffled(ends), "src", "left_semi").join(shuffled(starts), "dst", "left_semi"), F.lit(True))
            if before - n <= part * before:
                break
        return left, n

    left, groups = cut(edges.select("src", "dst").where("src <> dst").distinct(), "cycles"), None
    kind = left.schema["src"].dataType.simpleString()
    left, n = usable(left, left.count(), 0.05)
    if n > SMALL_GRAPH:
        placed = cut(left.join(shuffled(components(left).withColumnRenamed("id", "src")), "src"), "placed")
        large = placed.groupBy("component").agg(F.count("*").alias("_n")).where(F.col("_n") > SMALL_GRAPH)  # one for each SMALL_GRAPH edges at most
        sized = placed.join(F.broadcast(large), "component", "left")
        task = F.pmod(F.xxhash64("component"), F.lit(math.ceil(n / max(1, SMALL_GRAPH))))
        groups = cut(sized.where("_n IS NULL").select(task.alias("_task"), "src", "dst").groupBy("_task").applyInPandas(mutual, f"id {kind}, group {kind}"), "cycles")
        left = cut(sized.where("_n IS NOT NULL").select("src", "dst"), "cycles")
    while True:
        left, n = usable(left, left.count(), 0)
        if not n:
            return groups if groups is not None else left.select(F.col("src").alias("id"), F.col("src").alias("group"))
        if n <= SMALL_GRAPH:
            rows = left.repartition(1).mapInPandas(lambda parts: [mutual(pd.concat(list(parts)))], f"id {kind}, group {kind}")
            return rows if groups is None else groups.unionByName(rows)
        colours, moved = cut(left.select(F.col("src").alias("id")).distinct().withColumn("colour", F.col("id")), "colours"), 1
        while moved:
            near = left.join(shuffled(colours.withColumnRenamed("id", "src")), "src").groupBy(F.col("dst").alias("id")).agg(F.max("colour").alias("near"))
            new = colours.join(shuffled(near), "id", "left").select("id", F.greatest("colour", "near").alias("colour"), (F.col("near") > F.col("colour")).alias("moved"))
            new, moved = counted_cut(new, F.col("moved"))
            colours = new.select("id", "colour")
        members = reach(within(left, colours, "colour"), colours.where("id = colour").select("id"), reverse=True).select("id").join(shuffled(colours), "id")
        smallest = F.min("id").over(Window.partitionBy("colour"))
        found = cut(members.select("id", smallest.alias("group"), F.count("*").over(Window.partitionBy("colour")).alias("n")), "cycles")
        rows = found.where("n > 1").select("id", "group")
        groups = rows if groups is None else groups.unionByName(rows)
        left = left.join(shuffled(found.select(F.col("id").alias("src"))), "src", "left_anti").join(shuffled(found.select(F.col("id").alias("dst"))), "dst", "left_anti")
        left = cut(left, "cycles")


def topo_levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, level: peeled from the sources; nodes of cycles, and what lies behind them, have no level."""
    deps, out, level = cut(edges.select("src", "dst").where("src <> dst").distinct(), "deps"), None, 0
    left = cut(nodes.select("id").distinct(), "topo")
    while True:
        blocked = deps.join(left.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"), F.lit(True).alias("blocked")).distinct()
        marked, n_free = counted_cut(left.join(blocked, "id", "left"), F.col("blocked").isNull())
        free = marked.where("blocked IS NULL").select("id", F.lit(level).alias("level"))
        left = marked.where("blocked").select("id")
        if not n_free:
            rest = left.withColumn("level", F.lit(None).cast("int"))
            return rest if out is None else out.unionByName(rest)
        out, level = free if out is None else out.unionByName(free), level + 1


def _kahn(rows: pd.DataFrame) -> pd.DataFrame:
    behind, waits = {}, {}
    for node, dep in zip(rows["id"], rows["dep"], strict=True):
        waits.setdefault(node, 0)
        if isinstance(dep, str):
            behind.setdefault(dep, []).append(node)
            waits[node] += 1
    ready = [n for n, w in waits.items() if not w]
    heapq.heapify(ready)
    order = []
    while ready:
        order.append(node := heapq.heappop(ready))
        for n in behind.get(node, []):
            waits[n] -= 1
            if not waits[n]:
                heapq.heappush(ready, n)
    place = {n: i + 1 for i, n in enumerate(order)}
    return pd.DataFrame({"chain": rows["chain"].iloc[0], "id": list(waits), "position": pd.array([place.get(n) for n in waits], dtype="Int64")})


#: Nodes and dependencies of a chain (some 100 bytes each) that one task puts in order at most.
LARGEST_CHAIN = 500_000


def chain_order(nodes: DataFrame, deps: DataFrame) -> DataFrame:
    """chain, id, position: each chain's nodes (chain, id: strings) after what they depend on (chain, id, dep), the smallest free one first.

    Nodes on cycles and behind them have no position. Which node is the smallest free one depends on all before it, so a chain (the migrations of one
    database) is one task's; chains of more than LARGEST_CHAIN nodes and dependencies are refused. topo_levels has no such bound.
    """
    known = deps.join(nodes.select("chain", F.col("id").alias("dep")), ["chain", "dep"], "left_semi").select("chain", "id", "dep").distinct()
    rows = cut(nodes.select("chain", "id").distinct().join(known, ["chain", "id"], "left"), "chains")
    if large := rows.groupBy("chain").count().where(F.col("count") > LARGEST_CHAIN).first():
        raise ValueError(f"chain {large['chain']} has {large['count']} nodes and dependencies; {LARGEST_CHAIN} are the most that are put in order")
    return rows.groupBy("chain").applyInPandas(_kahn, "chain string, id string, position long")


def chain_problems(nodes: DataFrame, deps: DataFrame) -> DataFrame:
    """chain, problem, id: missing parents, and, where there are several, the heads and the roots of each chain."""
    ids = nodes.select("chain", "id").distinct()
    missing = deps.join(ids.withColumnRenamed("id", "dep"), ["chain", "dep"], "left_anti").select("chain", F.lit("missing-parent").alias("problem"), "id").distinct()

    def several(rows: DataFrame, problem: str) -> DataFrame:
        counted = rows.withColumn("_n", F.count("*").over(Window.partitionBy("chain")))
        return counted.where("_n > 1").select("chain", F.lit(problem).alias("problem"), "id")

    heads = several(ids.join(deps.select("chain", F.col("dep").alias("id")), ["chain", "id"], "left_anti"), "several-heads")
    roots = several(ids.join(deps.select("chain", "id"), ["chain", "id"], "left_anti"), "several-roots")
    return missing.unionByName(heads).unionByName(roots)


def chain_roots(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes (id) that no edge leads to; all of them where there is none such."""
    free = cut(nodes.select("id").join(edges.select(F.col("dst").alias("id")), "id", "left_anti"), "roots")
    return nodes.select("id") if free.isEmpty() else free


def degrees(edges: DataFrame) -> DataFrame:
    """id, fan_in, fan_out; nodes without edges are not there."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    return ends.groupBy("id").agg(F.sum("in").alias("fan_in"), F.sum("out").alias("fan_out"))


def hubs(edges: DataFrame, least: int = 6, share: float = 0.25) -> DataFrame:
    """Nodes whose fan-in or fan-out is the larger of `least` and that share of all nodes, or more."""
    found = cut(degrees(edges), "degrees")
    threshold = max(least, math.ceil(found.count() * share))
    return found.withColumn("threshold", F.lit(threshold)).where("fan_in >= threshold OR fan_out >= threshold")


def rolled_up(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """Edges (src, dst, weight) between the owners (id, owner) of their ends, without loops."""
    a, b = (owners.select(F.col("id").alias(end), F.col("owner").alias(f"{end}_owner")) for end in ("src", "dst"))
    return edges.join(a, "src").join(b, "dst").where("src_owner <> dst_owner").groupBy("src_owner", "dst_owner").agg(F.sum("weight").alias("weight"), F.count("*").alias("n_edges"))


def edge_weights(uses: DataFrame) -> DataFrame:
    """uses (src, dst, lines: an array of a use's lines) to src, dst, weight: the lines of all uses, one at least for each."""
    return uses.groupBy("src", "dst").agg(F.sum(F.greatest(F.lit(1), F.coalesce(F.size("lines"), F.lit(0)))).alias("weight"))


def neighbours(edges: DataFrame) -> DataFrame:
    """(id, neighbour) in both directions, each once."""
    return edges.select(F.col("src").alias("id"), F.col("dst").alias("neighbour")).union(edges.select("dst", "src")).distinct()


def key_nodes(edges: DataFrame, owners: DataFrame, n: int = 3) -> DataFrame:
    """The n nodes of each owner that most edges lead to."""
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in"))
    rank = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("fan_in"), "id"))
    return into.join(owners, "id").withColumn("rank", rank).where(F.col("rank") <= n)


def card_edges(edges: DataFrame, owners: DataFrame, samples: int = 3) -> DataFrame:
    """Edges (src, dst, weight) between cards (id, owner): weight, and the first few pairs of members as samples."""
    a, b = (owners.select(F.col("id").alias(end), F.col("owner").alias(f"{end}_owner")) for end in ("src", "dst"))
    between, pair = edges.join(a, "src").join(b, "dst").where("src_owner <> dst_owner"), ["src_owner", "dst_owner"]
    ranked = between.withColumn("_n", F.row_number().over(Window.partitionBy(*pair).orderBy(F.desc("weight"), "src", "dst"))).where(F.col("_n") <= samples)
    shown = ranked.groupBy(*pair).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.concat_ws(">", "src", "dst").alias("pair")))), lambda x: x["pair"]).alias("samples"))
    return between.groupBy(*pair).agg(F.sum("weight").alias("weight")).join(shown, pair)


def nearest_origins(edges: DataFrame, seeds: DataFrame, n: int) -> DataFrame:
    """origin, id, hops: of each node the first n seeds (origin, id) that reach it, by hops and origin; seeds have themselves at 0.

    A node hands on only what it keeps: what n others come before there, they come before behind it as well.
    """
    steps = cut(edges.select(F.col("src").alias("id"), F.col("dst").alias("next")).distinct(), "steps")
    seen = frontier = cut(seeds.select("origin", "id").distinct().withColumn("hops", F.lit(0)), "nearest")
    hops, found = 0, None
    while True:
        hops += 1
        near = near_rows(frontier, found).join(steps, "id").select("origin", F.col("next").alias("id")).distinct().join(shuffled(seen.select("origin", "id")), ["origin", "id"], "left_anti")
        ranked = near.withColumn("_nth", F.row_number().over(Window.partitionBy("id").orderBy("origin"))).where(F.col("_nth") <= n)
        full = seen.groupBy("id").agg(F.count("*").alias("_n"))
        fits = ranked.join(shuffled(full), "id", "left").where(F.col("_nth") + F.coalesce("_n", F.lit(0)) <= n)
        frontier, found = counted_cut(fits.select("origin", "id", F.lit(hops).alias("hops")), F.lit(True))
        if not found:
            return seen
        seen = seen.unionByName(frontier)
        if hops % 8 == 0:
            seen = cut(seen, "nearest")


#: Groups of nodes on cycles from this size on are taken for hubs: who reaches one reaches all behind it.
HUB = 64


def origin_counts(edges: DataFrame, origins: DataFrame) -> DataFrame:
    """id, n: how many origins (id), to which no edge leads, reach each node by an edge or more.

    Pairs of origin and node are not listed where a hub stands between. Each node behind hubs takes the largest of them; its count is that of the
    hub's origins, and of those walked to it which the hub has not. Where an edge leads to a node of another hub, the origins of
    the first that the second lacks walk on from there.
    """
    edges = cut(edges.select("src", "dst").where("src <> dst").distinct(), "edges")
    groups = cycle_groups(edges)
    large = groups.withColumn("_n", F.count("*").over(Window.partitionBy("group"))).where(F.col("_n") >= HUB)
    labels = cut(large.select("id", F.struct(F.col("_n").alias("size"), "group").alias("hub")), "hubs")
    # Who reaches a hub, by hub.
    back = reach(edges, labels.select(F.col("hub").alias("origin"), "id"), reverse=True, keyed=True)
    covers = cut(back.join(shuffled(origins.select("id")), "id", "left_semi").select(F.col("origin").alias("hub"), F.col("id").alias("origin")), "covers")
    frontier, moved = labels, None
    while moved != 0:  # a node takes the largest hub before it
        near = near_rows(frontier, moved).join(edges.withColumnRenamed("src", "id"), "id").groupBy(F.col("dst").alias("id")).agg(F.max("hub").alias("near"))
        frontier, moved = counted_cut(near.join(shuffled(labels), "id", "left").where("hub IS NULL OR near > hub").select("id", F.col("near").alias("hub")), F.lit(True))
        if moved:
            labels = cut(labels.join(near_rows(frontier.select("id"), moved), "id", "left_anti").unionByName(frontier), "hubs")
    at = cut(edges.join(shuffled(labels.withColumnRenamed("id", "dst")), "dst", "left"), "steps")
    steps = at.select(F.col("src").alias("id"), F.col("dst").alias("next"), "hub")
    leaps = at.join(shuffled(labels.select(F.col("id").alias("src"), F.col("hub").alias("_before"))), "src").where("_before <> hub").select(F.col("_before").alias("hub"), "dst", F.col("hub").alias("_after")).distinct()
    handed = leaps.join(shuffled(covers), "hub").select("origin", F.col("dst").alias("id"), F.col("_after").alias("hub")).distinct().join(shuffled(covers), ["hub", "origin"], "left_anti").select("origin", "id")
    seen = frontier = cut(origins.select(F.col("id").alias("origin"), "id").distinct().unionByName(handed), "walked")
    rounds, found = 0, None
    while True:
        near = near_rows(frontier, found).join(steps, "id").select("origin", F.col("next").alias("id"), "hub").distinct().join(shuffled(covers), ["hub", "origin"], "left_anti").drop("hub")
        frontier, found = counted_cut(near.join(shuffled(seen), ["origin", "id"], "left_anti"), F.lit(True))
        if not found:
            break
        seen, rounds = seen.unionByName(frontier), rounds + 1
        if rounds % 8 == 0:
            seen = cut(seen, "walked")
    walked = seen.where("origin <> id").groupBy("id").agg(F.count("*").alias("_w"))
    covered = labels.join(shuffled(covers.groupBy("hub").agg(F.count("*").alias("_c"))), "hub").select("id", "_c")
    return walked.join(shuffled(covered), "id", "full_outer").select("id", (F.coalesce("_w", F.lit(0)) + F.coalesce("_c", F.lit(0))).alias("n"))


def reach_of_tests(edges: DataFrame, tests: DataFrame, support: DataFrame, sources: DataFrame, first: int = 20) -> DataFrame:
    """Of each source (id): how many tests (id) reach it along the edges, the fewest hops, and the first tests by hops and name.

    A test's paths run through support files and sources, but never on through another test.
    """
    free = cut(edges.select("src", "dst").join(shuffled(tests.select(F.col("id").alias("dst"))), "dst", "left_anti").distinct(), "edges")
    wanted = sources.select("id").join(shuffled(support.select("id")), "id", "left_anti").distinct()
    near = nearest_origins(free, tests.select(F.col("id").alias("origin"), "id"), max(1, first)).where("hops > 0").join(shuffled(wanted), "id")
    shown = F.slice(F.array_sort(F.collect_list(F.struct("hops", "origin"))), 1, first)
    told = near.groupBy("id").agg(F.min("hops").alias("min_hops"), F.transform(shown, lambda x: x["origin"]).alias("tests"))
    return told.join(shuffled(origin_counts(free, tests)), "id").select("id", F.col("n").alias("n_tests"), "min_hops", "tests")


def new_cycles(base: DataFrame, head: DataFrame, max_hops: int | None = 12) -> DataFrame:
    """Cycles of head through an edge that base has not, unless base already led from its ends to each other.

    Which edges close a cycle is seen from the groups of nodes that reach each other, whatever their lengths;
    length is that of the shortest cycle through the edge, null if it is longer than max_hops.
    """
    base, head = (cut(edges.select("src", "dst").distinct(), "edges") for edges in (base, head))
    added = head.join(shuffled(base), ["src", "dst"], "left_anti")
    groups = cut(cycle_groups(head), "groups")
    inside = cut(within(head, groups, "group"), "inside")
    closing = cut(within(added, groups, "group"), "closing")
    fresh = cut(closing.join(shuffled(within(closing, cycle_groups(base), "group")), ["src", "dst"], "left_anti"), "fresh")
    # A shortest cycle through an edge stays in the edge's group.
    back = shortest_paths(inside, fresh.select(F.col("dst").alias("src"), F.col("src").alias("dst")), max_hops)
    return fresh.join(shuffled(back.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "hops")), ["src", "dst"], "left").withColumn("length", F.col("hops") + 1).drop("hops")
