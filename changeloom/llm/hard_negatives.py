"""Hard negatives by a multiway hyperplane tree whose split points store distance ranges to their siblings.

Scores are integer inner products. With one more component, sqrt(M^2 - |x|^2) for rows and 0 for anchors, a
score s is the distance sqrt(|a|^2 + M^2 - 2 s), so a window of scores is an annulus around the anchor. The
tree is fitted on at most `max_sample` rows: at each node `arity` far-apart rows split the space, each point going to the
nearest; a pass over all rows gives each its leaf, and another the least and the greatest distance from every
split point to every sibling's subtree. A subtree can be left out if, for some split point, these distances and the
anchor's own cannot meet within the annulus. Leaves are searched exactly, so the tree never changes a result.

A search has two steps: each query sees its own room first; its k-th best there narrows its windows, and what
is left of the tree then says which other rooms it has to see. Positives are the first search (same label, no
window), negatives the second (other labels, a window a positive).

Edge cases. Rows with a null vec_id or label, a null vector or any null or non-finite component take no part. Rows that
share a vec_id are one row, the least by label and vector. Shorter vectors count as padded with zeros, and an empty one
scores 0. Ties go to the smaller vec_id. Labels are any integers. An anchor without positives, and a positive
with a negative score (whose window is empty), give no rows. No rows: no rows. Extra columns are ignored. Inner products
that could pass a long are refused with an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changeloom.llm import vectors as V
from changeloom.llm.common import stage

#: Scores below and above all others.
LOW, HIGH = -(1 << 62), 1 << 62
FOUND = "query_id long, slot int, vec_id long, score long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
#: Queries and rows of one matrix of scores.
QUERIES_AT_ONCE, ROWS_AT_ONCE = 512, 8192


@dataclass
class Node:
    splits: np.ndarray  #: arity rows
    children: list[int]  #: a node, or -1 - leaf
    low: np.ndarray = field(default=None)  #: [split, child]: least distance from the split point to the child's rows
    high: np.ndarray = field(default=None)


class Tree:
    """Nodes in an array; a tree of one leaf has none."""

    def __init__(self, points: np.ndarray, arity: int, leaf_points: int, seed: int = 7):
        self.nodes: list[Node] = []
        self.leaves = 0
        self.root = self._grow(points, arity, leaf_points, np.random.default_rng(seed))

    def _grow(self, points: np.ndarray, arity: int, leaf_points: int, rng: np.random.Generator) -> int:
        if len(points) > leaf_points:
            # Far-apart points among three times as many drawn ones.
            drawn = points[np.sort(rng.choice(len(points), min(len(points), 3 * arity), replace=False))]
            chosen, gap = [0], distances(drawn, drawn[:1])[:, 0]
            while len(chosen) < arity and gap.max() > 1e-6:
                chosen.append(int(gap.argmax()))
                gap = np.minimum(gap, distances(drawn, drawn[chosen[-1:]])[:, 0])
            if len(chosen) > 1:
                at = len(self.nodes)
                self.nodes.append(Node(drawn[chosen], []))
                nearest = distances(points, drawn[chosen]).argmin(axis=1)
                self.nodes[at].children = [self._grow(points[nearest == j], arity, leaf_points, rng) for j in range(len(chosen))]
                m = len(chosen)
                self.nodes[at].low, self.nodes[at].high = np.full((m, m), np.inf), np.full((m, m), -np.inf)
                return at
        self.leaves += 1
        return -self.leaves

    def walk(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(child or node, rows, distances to the splits, nearest split) of all nodes that points pass; leaves come with no distances."""
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            at, rows = todo.pop()
            if at < 0 or not len(rows):
                yield at, rows, np.zeros((0, 0)), np.zeros(0, int)
                continue
            d = distances(points[rows], self.nodes[at].splits)
            nearest = d.argmin(axis=1)
            yield at, rows, d, nearest
            todo += [(child, rows[nearest == j]) for j, child in enumerate(self.nodes[at].children)]

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int32)
        for at, rows, _, _ in self.walk(points):
            if at < 0:
                out[rows] = -1 - at
        return out

    def alive(self, anchors: np.ndarray, inner: np.ndarray, outer: np.ndarray, slack: np.ndarray) -> np.ndarray:
        """[anchor, leaf]: whether the leaf can hold rows within one of the anchor's annuli [inner, outer] (nan: none)."""
        out = np.zeros((len(anchors), self.leaves), bool)
        todo = [(self.root, np.arange(len(anchors)))]
        while todo:
            at, rows = todo.pop()
            if at < 0:
                out[rows, -1 - at] = True
            elif len(rows):
                node = self.nodes[at]
                d, e = distances(anchors[rows], node.splits), slack[rows, None]
                for j, child in enumerate(node.children):
                    least = np.maximum(d - node.high[:, j], node.low[:, j] - d).max(axis=1, keepdims=True)
                    most = (d + node.high[:, j]).min(axis=1, keepdims=True)
                    meets = (inner[rows] <= most + e) & (outer[rows] >= least - e)
                    todo.append((child, rows[meets.any(axis=1)]))
        return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T)))


@dataclass
class Space:
    """What the tasks need: the tree, the norm that all rows are lifted to, and the number type of exact scores."""

    tree: Tree
    top: float
    dtype: type
    packed: dict[int, tuple[int, int]] = field(default_factory=dict)

    def lifted(self, x: np.ndarray, anchors: bool = False) -> np.ndarray:
        x = x.astype(np.float64)
        more = np.zeros(len(x)) if anchors else np.sqrt(np.maximum(0, self.top - (x * x).sum(axis=1)))
        return np.column_stack([x, more])

    def alive(self, vectors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        a = self.lifted(vectors, anchors=True)
        both = (a * a).sum(axis=1)[:, None] + self.top
        outer = np.sqrt(np.maximum(0, both - 2.0 * lo))
        inner = np.sqrt(np.maximum(0, both - 2.0 * hi))
        outer[lo > hi], inner[lo > hi] = np.nan, np.nan
        return self.tree.alive(a, inner, outer, 1e-6 * (np.sqrt(both[:, 0]) + 1))


def windows_of(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """lo and hi, as matrices; missing windows are empty."""
    lo, hi = table.column("lo").to_pylist(), table.column("hi").to_pylist()
    width = max((len(x) for x in lo), default=1)
    fill = lambda rows, by: np.array([x + [by] * (width - len(x)) for x in rows], np.int64).reshape(len(rows), width)
    return fill(lo, HIGH), fill(hi, LOW)


def prepare(df: DataFrame, scale: int = 256, moved: int | None = 7, classes: int = 10) -> DataFrame:
    """vec_id, label, vec (array<long>): the rows that take part, one for each vec_id."""
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % moved == 0, (label + 1) % classes).otherwise(label) if moved else label
    vec = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    fit = df.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & V.usable(F.col("embedding")))
    rows = fit.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), vec.alias("vec"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("r")).select("vec_id", "r.label", "r.vec")


def build(rows: DataFrame, arity: int, leaf_rows: int, max_sample: int) -> tuple[DataFrame, Space | None]:
    """rows with code (its leaf) and room, and the tree with its ranges; no tree if there are no rows."""
    most = F.coalesce(F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double")))), F.lit(0.0))
    n, dim, peak = rows.agg(F.count("*"), F.max(F.size("vec")), F.max(most)).first()
    if not n:
        return rows, None
    dim, peak = max(dim, 1), int(peak)
    if dim * peak * peak >= 1 << 62:
        raise ValueError("inner products of these vectors can pass a long")
    even = rows.withColumn("vec", V.padded(F.col("vec"), dim, F.lit(0).cast("long")))
    top = float(even.agg(F.max(F.aggregate("vec", F.lit(0).cast("long"), lambda a, x: a + x * x))).first()[0])
    sample = V.matrix(even.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max_sample).select("vec").toArrow().column("vec"))
    space = Space(None, top, np.float64 if dim * peak * peak < 1 << 53 else np.int64)
    space.tree = Tree(space.lifted(sample), arity, max(2 * arity, len(sample) * leaf_rows // n))

    def with_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = space.tree.leaf_of(space.lifted(V.matrix(b.column("vec")))) if b.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int32())], [*b.schema.names, "code"])

    placed = stage(even.mapInArrow(with_leaf, "vec_id long, label long, vec array<long>, code int"), "leaves")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each node, child and split the least and the greatest distance in this task."""
        seen: dict[tuple[int, int, int], tuple[float, float]] = {}
        for b in batches:
            for at, _, d, nearest in space.tree.walk(space.lifted(V.matrix(b.column("vec")))) if b.num_rows else ():
                for j in np.unique(nearest):
                    part = d[nearest == j]
                    for i, (lo, hi) in enumerate(zip(part.min(axis=0), part.max(axis=0))):
                        was = seen.get((at, int(j), i), (np.inf, -np.inf))
                        seen[at, int(j), i] = (min(was[0], lo), max(was[1], hi))
        rows = [(*k, *v) for k, v in seen.items()]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[c]) for c in range(5)], ["node", "child", "split", "low", "high"])

    # As many rows as the tree has pairs of siblings: the model's size.
    ranges = placed.select("vec").mapInArrow(spread, "node int, child int, split int, low double, high double").groupBy("node", "child", "split").agg(F.min("low"), F.max("high"))
    for at, j, i, low, high in ranges.collect():
        space.tree.nodes[at].low[i, j], space.tree.nodes[at].high[i, j] = low, high
    counts = {r[0]: r[1] for r in placed.groupBy("code").count().collect()}
    space.packed = V.pack(counts, V.rooms_for(n))
    return stage(V.in_rooms(placed, space.packed), "rooms"), space


def search(queries: DataFrame, rows: DataFrame, space: Space, k: int, same: bool) -> DataFrame:
    """query_id, slot, vec_id, score: for each window (slot) of each query its k best rows of the same or of other labels.

    queries: query_id, label, vec, room (its own), lo, hi (arrays of window bounds, inclusive).
    """
    n = queries.count()
    chunks = V.chunks_for(n, V.rooms_for(rows.count()), rows.sparkSession.sparkContext.defaultParallelism)
    rows = rows.select("room", "vec_id", "label", "vec", "code")

    def kernel(asked: pa.Table, given: pa.Table) -> pa.Table:
        return best_in_room(asked, given, space, k, same)

    columns = ["query_id", "label", "vec", "lo", "hi"]
    own = stage(V.meet(queries.select(*columns, "room"), rows, chunks, kernel, FOUND), "own-room")
    cut = own.groupBy("query_id", "slot").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
    cuts = cut.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "least"))).alias("cuts"))
    narrowed = F.transform("lo", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("cuts", i), F.lit(LOW))))
    left = queries.join(cuts, "query_id", "left").withColumn("lo", narrowed).select(*columns, F.col("room").alias("own"))

    def other_rooms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lo, hi = windows_of(b)
            alive = space.alive(V.matrix(b.column("vec")), lo, hi)
            own_room, at, room = V.values(b.column("own")), [], []
            for code, (first, pieces) in space.packed.items():
                for r in range(first, first + pieces):
                    who = np.flatnonzero(alive[:, code] & (own_room != r))
                    at.append(who), room.append(np.full(len(who), r, np.int64))
            pairs = np.unique(np.column_stack([np.concatenate(at), np.concatenate(room)]), axis=0)
            out = b.select(columns).take(pa.array(pairs[:, 0]))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(pairs[:, 1].astype(np.int32))], [*columns, "room"])

    routed = left.mapInArrow(other_rooms, "query_id long, label long, vec array<long>, lo array<long>, hi array<long>, room int")
    both = own.unionByName(V.meet(routed, rows, chunks, kernel, FOUND))
    order = Window.partitionBy("query_id", "slot").orderBy(F.desc("score"), "vec_id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_in_room(asked: pa.Table, given: pa.Table, space: Space, k: int, same: bool) -> pa.Table:
    """The k best of the room for each query and window, leaf by leaf, those left out that the tree excludes."""
    out: list[tuple[np.ndarray, ...]] = []
    if asked.num_rows and given.num_rows:
        x, ids, labels, leaf = V.matrix(given.column("vec"), space.dtype), V.values(given.column("vec_id")), V.values(given.column("label")), V.values(given.column("code"))
        order = np.lexsort((ids, leaf))
        x, ids, labels, leaf = x[order], ids[order], labels[order], leaf[order]
        starts = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
        spans = [(s, min(s + ROWS_AT_ONCE, e)) for a, e in zip(starts, [*starts[1:], len(leaf)]) for s in range(a, e, ROWS_AT_ONCE)]
        for begin in range(0, asked.num_rows, QUERIES_AT_ONCE):
            part = asked.slice(begin, QUERIES_AT_ONCE)
            q, who, own = V.matrix(part.column("vec"), space.dtype), V.values(part.column("query_id")), V.values(part.column("label"))
            lo, hi = windows_of(part)
            alive = space.alive(q, lo, hi)
            for s, e in spans:
                sel = np.flatnonzero(alive[:, leaf[s]])
                if not len(sel):
                    continue
                scores = q[sel] @ x[s:e].T
                fit = own[sel, None] == labels[None, s:e] if same else own[sel, None] != labels[None, s:e]
                fit &= who[sel, None] != ids[None, s:e]
                for w in range(lo.shape[1]):
                    which, least = V.keep_best(scores, fit & (scores >= lo[sel, w, None]) & (scores <= hi[sel, w, None]), k)
                    lo[sel, w] = np.maximum(lo[sel, w], np.maximum(least, LOW).astype(np.int64))
                    a, b = np.nonzero(which)
                    out.append((who[sel][a], np.full(len(a), w), ids[s:e][b], scores[a, b].astype(np.int64)))
    query, slot, ids, scores = (np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out) if out else [()] * 4))
    first = V.first_of_each(k, query, slot, by=(-scores, ids))
    return pa.table({"query_id": pa.array(query[first], pa.int64()), "slot": pa.array(slot[first].astype(np.int32)), "vec_id": pa.array(ids[first], pa.int64()), "score": pa.array(scores[first], pa.int64())})


def mine(df: DataFrame, every: int = 100, n_positives: int = 5, n_negatives: int = 10, bounds: tuple[int, int] = (30, 90), arity: int = 16, leaf_rows: int = 1024, max_sample: int = 8192, **prepared) -> DataFrame:
    """The hard negatives of each anchor (vec_id divisible by `every`) and positive: score within bounds, in hundredths of the positive's.

    anchor_id, positive_id, rank, negative_id, positive_score, negative_score. df: vec_id, label, embedding.
    """
    rows, space = build(stage(prepare(df, **prepared), "vectors"), arity, leaf_rows, max_sample)
    if space is None:
        return df.sparkSession.createDataFrame([], RESULT)
    least, most = bounds
    anchors = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "label", "vec", "room")
    everything = anchors.withColumn("lo", F.array(F.lit(LOW))).withColumn("hi", F.array(F.lit(HIGH)))
    positives = stage(search(everything, rows, space, n_positives, True).select("query_id", F.col("rank").alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # least * p <= 100 * s <= most * p has solutions only where p is not negative.
    window = F.expr(f"struct(nth, positive_id, positive_score, ({least} * positive_score + 99) div 100 AS lo, ({most} * positive_score) div 100 AS hi)")
    of_anchor = positives.where("positive_score >= 0").groupBy("query_id").agg(F.array_sort(F.collect_list(window)).alias("ps"))
    asked = stage(anchors.join(of_anchor, "query_id").select("query_id", "label", "vec", "room", F.col("ps.lo").alias("lo"), F.col("ps.hi").alias("hi"), F.col("ps").alias("ps")), "windows")
    found = search(asked.drop("ps"), rows, space, n_negatives, False).select("query_id", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    chosen = asked.select("query_id", F.posexplode("ps").alias("slot", "p"))
    return found.join(chosen, ["query_id", "slot"]).select(F.col("query_id").alias("anchor_id"), "p.positive_id", "rank", "negative_id", "p.positive_score", "negative_score")
