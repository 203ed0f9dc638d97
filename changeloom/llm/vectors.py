"""What the searches over vectors share: rows in rooms of bounded size, queries sent to rooms, the best of each kept.

An index gives every row a code (a leaf, a cell). Codes are packed in order into rooms of about the same number of
rows; a code with more rows than a room holds gets several rooms, which its rows are dealt to by hash. Queries go to
the rooms that their search has to see, and a task holds one room and one chunk of queries.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A room has at most about this many rows, and there are so many rooms at least, whatever the number of cores.
ROOM_ROWS, LEAST_ROOMS = 1 << 16, 16
#: Queries of a task at most; fewer, down to the second figure, where cores would be idle.
CHUNK_MOST, CHUNK_LEAST = 1 << 14, 1 << 11


def usable(vector: Column) -> Column:
    """Whether the vector is there and all its components are finite numbers."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def padded(vector: Column, dim: int, zero: Column) -> Column:
    """Components that shorter vectors lack count as zeros."""
    return F.concat(vector, F.array_repeat(zero, F.lit(dim) - F.size(vector)))


def matrix(column: pa.Array | pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    """A column of lists of one length as rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat.reshape(len(column), -1), dtype)


def values(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def rooms_for(n: int) -> int:
    return max(LEAST_ROOMS, -(-n // ROOM_ROWS))


def pack(counts: dict[int, int], rooms: int) -> dict[int, tuple[int, int]]:
    """Of each code its first room and its number of rooms."""
    size = max(1, -(-sum(counts.values()) // rooms))
    out, room, filled = {}, 0, 0
    for code in sorted(counts):
        n = counts[code]
        if filled and filled + n > size:
            room, filled = room + 1, 0
        pieces = max(1, -(-n // size))
        out[code] = (room, pieces)
        room, filled = (room + pieces, 0) if pieces > 1 else (room, filled + n)
    return out


def in_rooms(rows: DataFrame, packed: dict[int, tuple[int, int]]) -> DataFrame:
    """rows (code, vec_id) with room. The map is as large as the index's set of codes, which no input enlarges."""
    known = rows.sparkSession.createDataFrame([(c, *v) for c, v in packed.items()] or [(0, 0, 1)], "code int, _first int, _pieces int")
    room = F.col("_first") + F.pmod(F.xxhash64("vec_id"), F.col("_pieces")).cast("int")
    return rows.join(F.broadcast(known), "code").withColumn("room", room).drop("_first", "_pieces")


def chunks_for(n_queries: int, rooms: int, cores: int) -> int:
    return max(1, -(-n_queries // CHUNK_MOST), min(-(-2 * cores // rooms), n_queries // CHUNK_LEAST))


def meet(queries: DataFrame, rows: DataFrame, chunks: int, kernel: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """kernel(queries, rows) for each room and chunk of queries. queries: query_id, room, ...; rows: room, ..."""
    asked = queries.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int"))
    given = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    return asked.groupBy("room", "chunk").cogroup(given.groupBy("room", "chunk")).applyInArrow(kernel, schema)


def keep_best(scores: np.ndarray, among: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(which, least): of each row the k highest scores among the marked, ties to the left, and the k-th of them.

    Ties at the k-th are kept k times at most; where fewer than k are marked, least is the lowest value there is.
    """
    low = -np.inf if scores.dtype.kind == "f" else np.iinfo(scores.dtype).min
    least = np.full(len(scores), low, scores.dtype)
    full = np.flatnonzero(among.sum(axis=1) >= k)
    which = among.copy()
    if len(full):
        v = np.where(among[full], scores[full], low)
        t = np.partition(v, v.shape[1] - k, axis=1)[:, v.shape[1] - k]
        least[full] = t
        tie = among[full] & (v == t[:, None])
        which[full] = among[full] & (v > t[:, None]) | tie & (np.cumsum(tie, axis=1) <= k)
    return which, least


def first_of_each(k: int, *keys: np.ndarray, by: tuple[np.ndarray, ...]) -> np.ndarray:
    """Positions of the first k rows of each group of equal keys in the order of `by`."""
    order = np.lexsort((*reversed(by), *reversed(keys)))
    if not len(order):
        return order
    new = np.zeros(len(order), bool)
    new[0] = True
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - start < k]
