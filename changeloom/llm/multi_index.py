"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves, each with a codebook of its own (k-means on at most `max_sample` rows); a row's
cell is the pair of its nearest centroids. A query's distance to a centroid is how much its half's inner product with
it lies below the best of that codebook, and cells are visited in the order of summed distances: a heap walks the pairs of
the two sorted lists until the cells passed hold a given part of all rows. That part is what `n_probes` queries
need for the share `recall` of their true neighbours, which one pass over all rows finds. The distance at which a query
stops says all about its visit, so that is what travels to the rooms of cells, whose tasks compute the inner products
of visited cells only and rank the best by scores added up component by component in 64-bit floats.

Edge cases. Rows with a null vec_id, a null, empty or zero vector, or any null or non-finite component take no part. Rows
that share a vec_id are one row, the least vector. Shorter vectors count as padded with zeros. Equal vectors have
equal scores; ties go to the smaller vec_id. Fewer than k candidates: all that the visited cells hold, and all there
are if the whole is visited. No rows: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeloom.llm import vectors as V
from changeloom.llm.common import stage

FOUND = "query_id long, vec_id long, score double"
RESULT = "query_id long, rank int, vec_id long, score double"
#: Centroids of a half: five quarters of the square root of the number of rows, within these. Small cells follow a query better, and a walk has as many steps as cells.
CENTROIDS = (2, 128)
QUERIES_AT_ONCE = 512
#: Scores by matrix product and by component differ by less than this part of the norms' product.
NOISE = 1e-12


@dataclass
class Index:
    books: tuple[np.ndarray, np.ndarray]  #: the centroids of each half
    counts: np.ndarray  #: rows of each cell
    part: float  #: of all rows, what a query visits
    packed: dict[int, tuple[int, int]]  #: the rooms of each cell
    rows: DataFrame  #: vec_id, vec, code (its cell), room

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The queries' distances to the centroids of each half."""
        m = self.books[0].shape[1]
        inner = x[:, :m] @ self.books[0].T, x[:, m:] @ self.books[1].T
        return tuple(i.max(axis=1, keepdims=True) - i for i in inner)


def lloyd(points: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """At most k centroids; empty ones are dropped."""
    rng = np.random.default_rng(seed)
    unique = np.unique(points, axis=0)
    centres = unique[np.sort(rng.choice(len(unique), min(k, len(unique)), replace=False))]
    for _ in range(rounds):
        near = nearest(points, centres)
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, points)
        centres = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1)[None] - 2 * (points @ centres.T)).argmin(axis=1)


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: float) -> float:
    """The summed distance at which the cells, visited in its order, hold `wanted` rows."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y, n = first[a].tolist(), second[b].tolist(), counts[np.ix_(a, b)].tolist()
    heap, reached, held, at = [(x[0] + y[0], 0, 0)], [0] * len(x), 0, 0.0
    while heap and held < wanted:
        at, i, j = heapq.heappop(heap)
        held += n[i][j]
        reached[i] = j + 1
        # A pair is due once the pairs before it in its row and in its column are passed.
        if j + 1 < len(y) and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if i + 1 < len(x) and reached[i + 1] == j:
            heapq.heappush(heap, (x[i + 1] + y[j], i + 1, j))
    return at


def added_up(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products row by row, added up from the first component to the last."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * x[:, d]
    return out


def best_of(asked: pa.Table | pa.RecordBatch, given: pa.Table | pa.RecordBatch, k: int, index: Index | None = None) -> pa.Table:
    """query_id, vec_id, score: the k best of given for each query; with an index, among the cells that it visits.

    asked: query_id, vec, stop; given: vec_id, vec, code.
    """
    out: list[tuple[np.ndarray, ...]] = []
    if asked.num_rows and given.num_rows:
        x, ids, code = V.matrix(given.column("vec")), V.values(given.column("vec_id")), V.values(given.column("code"))
        # Copies of a vector are one column of scores; as many of them follow as can be wanted.
        order = np.lexsort((ids, *x.T[::-1], code))
        x, ids, code = x[order], ids[order], code[order]
        new = np.r_[True, (x[1:] != x[:-1]).any(axis=1) | (code[1:] != code[:-1])]
        at = np.flatnonzero(new)
        size = np.diff(np.r_[at, len(x)])
        distinct, cell, norms = x[at], code[at], np.sqrt((x[at] ** 2).sum(axis=1)).max()
        n_second = len(index.books[1]) if index else 1
        strips = np.flatnonzero(np.r_[True, cell[1:] // n_second != cell[:-1] // n_second])
        for begin in range(0, asked.num_rows, QUERIES_AT_ONCE):
            part = asked.slice(begin, QUERIES_AT_ONCE)
            q, who = V.matrix(part.column("vec")), V.values(part.column("query_id"))
            scores, seen = np.full((len(q), len(distinct)), -np.inf), np.ones((len(q), len(distinct)), bool)
            if index:
                first, second = index.halves(q)
                stop = V.values(part.column("stop"))
                for s, e in zip(strips, [*strips[1:], len(cell)]):
                    total = first[:, cell[s] // n_second, None] + second[:, cell[s:e] % n_second]
                    seen[:, s:e] = total <= stop[:, None]
                    sel = np.flatnonzero(seen[:, s:e].any(axis=1))
                    scores[sel, s:e] = q[sel] @ distinct[s:e].T
            else:
                scores = q @ distinct.T
            _, least = V.keep_best(scores, seen, k + 1)  # one more, for the query's own row
            noise = NOISE * norms * np.sqrt((q * q).sum(axis=1))
            a, b = np.nonzero(seen & (scores >= (least - 2 * noise)[:, None]))
            copies = np.minimum(size[b], k + 1)
            a, b, nth = np.repeat(a, copies), np.repeat(b, copies), np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
            row = at[b] + nth
            other = ids[row] != who[a]
            a, row = a[other], row[other]
            exact = added_up(q[a], x[row])
            first_ones = V.first_of_each(k, a, by=(-exact, ids[row]))
            out.append((who[a[first_ones]], ids[row[first_ones]], exact[first_ones]))
    query, ids, scores = (np.concatenate(c) if out else np.zeros(0) for c in (zip(*out) if out else [()] * 3))
    return pa.table({"query_id": pa.array(query.astype(np.int64)), "vec_id": pa.array(ids.astype(np.int64)), "score": pa.array(scores.astype(np.float64))})


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_neighbours(rows: DataFrame, queries: pa.Table, k: int) -> DataFrame:
    """query_id, rank, vec_id, score by brute force, for a bounded number of queries (query_id, vec) that travel with the task."""
    asked = queries.append_column("stop", pa.nulls(queries.num_rows, pa.float64()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table] = []
        for b in batches:
            kept.append(best_of(asked, b, k))
            if len(kept) >= 32:
                kept = [shrunk(kept)]
        for b in shrunk(kept).to_batches() if kept else ():
            yield b

    def shrunk(tables: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(tables)
        return t.take(pa.array(V.first_of_each(k, V.values(t.column("query_id")), by=(-V.values(t.column("score")), V.values(t.column("vec_id"))))))

    return ranked(rows.select("vec_id", "vec", "code").mapInArrow(scan, FOUND), k)


def prepare(df: DataFrame) -> DataFrame:
    """vec_id, vec: the rows that take part, one for each vec_id."""
    vec = F.transform("embedding", lambda x: x.cast("double"))
    fit = df.where(F.col("vec_id").isNotNull() & V.usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0))
    return fit.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(vec).alias("vec"))


def build(df: DataFrame, probes: Column, k: int = 20, recall: float = 0.95, n_probes: int = 128, max_sample: int = 16384) -> Index | None:
    """The index over all rows of df (vec_id, embedding). probes: which rows are like queries; None if no rows take part."""
    rows = stage(prepare(df), "vectors")
    n, dim = rows.agg(F.count("*"), F.max(F.size("vec"))).first()
    if not n:
        return None
    dim = max(2, dim)
    even = rows.withColumn("vec", V.padded(F.col("vec"), dim, F.lit(0.0)))
    drawn = even.orderBy(F.xxhash64("vec_id"), "vec_id")
    sample = V.matrix(drawn.limit(max_sample).select("vec").toArrow().column("vec"))
    centroids = int(min(CENTROIDS[1], max(CENTROIDS[0], round(1.25 * n**0.5))))
    books = tuple(lloyd(half, centroids) for half in np.hsplit(sample, [dim // 2]))

    def with_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = V.matrix(b.column("vec"))
                code = nearest(x[:, : dim // 2], books[0]) * len(books[1]) + nearest(x[:, dim // 2 :], books[1])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code.astype(np.int32))], [*b.schema.names, "code"])

    placed = stage(even.mapInArrow(with_cell, "vec_id long, vec array<double>, code int"), "cells")
    # At most as many numbers as there are cells, which the codebooks bound.
    by_cell = {r[0]: r[1] for r in placed.groupBy("code").count().collect()}
    counts = np.zeros(len(books[0]) * len(books[1]), np.int64)
    counts[list(by_cell)] = list(by_cell.values())
    packed = V.pack(by_cell, V.rooms_for(n))
    index = Index(books, counts.reshape(len(books[0]), -1), 1.0, packed, stage(V.in_rooms(placed, packed), "rooms"))
    asked = placed.where(probes).orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_probes).select(F.col("vec_id").alias("query_id"), "vec").toArrow()
    if asked.num_rows:
        index.part = part_needed(index, asked, k, recall)
    return index


def part_needed(index: Index, asked: pa.Table, k: int, recall: float) -> float:
    """The part of all rows that the probes have to visit for the given share of their true neighbours."""
    near = exact_neighbours(index.rows, asked, k)
    true = near.join(index.rows.select("vec_id", "code"), "vec_id").select("query_id", "code").toArrow()
    cells: dict[int, list[int]] = {}
    for query, code in zip(*(c.to_pylist() for c in true.columns)):
        cells.setdefault(query, []).append(code)
    first, second = index.halves(V.matrix(asked.column("vec")))
    need: list[float] = []
    for p, query in enumerate(asked.column("query_id").to_pylist()):
        total = (first[p][:, None] + second[p][None]).ravel()
        order = np.argsort(total, kind="stable")
        upto = np.cumsum(index.counts.ravel()[order])
        for code in cells.get(query, []):
            need.append(upto[np.searchsorted(total[order], total[code], "right") - 1])
    return float(np.quantile(need, recall, method="higher") / index.counts.sum()) if need else 1.0


def neighbours(index: Index, queries: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest that the visited cells hold, for the rows of the index that `queries` says."""
    wanted = index.part * int(index.counts.sum())
    light = Index(index.books, index.counts, index.part, index.packed, None)
    by_room: dict[int, list[int]] = {}
    for code, (room, pieces) in index.packed.items():
        for r in range(room, room + pieces):
            by_room.setdefault(r, []).append(code)
    columns = ["query_id", "vec", "stop"]

    def to_rooms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(light.books[1])
        for b in batches:
            if not b.num_rows:
                continue
            first, second = light.halves(V.matrix(b.column("vec")))
            stop = np.array([walk(f, s, light.counts, wanted) for f, s in zip(first, second)])
            b = b.append_column("stop", pa.array(stop))
            for room, codes in by_room.items():
                c = np.array(codes)
                strips = np.unique(c // width)
                who = np.zeros(len(stop), bool)
                for i in strips:
                    who |= first[:, i] + second[:, c[c // width == i] % width].min(axis=1) <= stop
                part = b.filter(pa.array(who))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(part.num_rows, room, np.int32))], [*columns, "room"])

    asked = index.rows.where(queries).select(F.col("vec_id").alias("query_id"), "vec")
    # The walks are the work here, so queries are dealt out evenly.
    cores = index.rows.sparkSession.sparkContext.defaultParallelism
    routed = asked.repartition(max(1, 4 * cores), "query_id").mapInArrow(to_rooms, "query_id long, vec array<double>, stop double, room int")
    chunks = V.chunks_for(asked.count(), V.rooms_for(int(light.counts.sum())), cores)

    def kernel(q: pa.Table, given: pa.Table) -> pa.Table:
        return best_of(q, given, k, light)

    return ranked(V.meet(routed, index.rows.select("room", "vec_id", "vec", "code"), chunks, kernel, FOUND), k)


def nearest_neighbours(df: DataFrame, every: int = 20, k: int = 20, **options) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by `every`, against all other rows."""
    queries = F.col("vec_id") % every == 0
    index = build(df, queries, k, **options)
    return df.sparkSession.createDataFrame([], RESULT) if index is None else neighbours(index, queries, k)
