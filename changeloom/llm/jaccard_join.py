"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles (lower case, letters and digits only; a shorter text is one shingle
of all its words). Documents with the same set are one class of copies and take part once. Pairs that share
a MinHash band are candidates. Of a candidate pair MinHash values are compared 32 at a time; after each step
the pair is dropped if the posterior probability that its similarity reaches the threshold, given the
matches so far and a uniform prior, lies below the tolerance. The rest is verified exactly on the sets.

Where pairs meet. Each set joins the smallest set that it shares a band with; those that joined the same one
are a cell. A cell is cut into blocks of bounded numbers of sets and shingles, and each pair of blocks of a
cell, or of two cells that share a band, is one group of work. So every candidate pair meets once, a group of
any size is spread over many small tasks, and no pairs are written: a task returns for each set the number
of its links and the smallest set that it is connected with, from which components are found. The groups of
work of a cell go to partitions one after the other, so no partition gets many of them by chance. Blocks grow
with their cell up to eight times, so a text of a cell of n sets is sent to n / 8192 groups at most, or to 64.

With 24 bands of 4 values, a pair at 0.8 shares no band with probability 3e-6.

Edge cases. Null, empty and wordless texts: no links, a class of their own. Repeated rows are copies. Null
doc_id: takes part, but names a class only if no other id is there. No rows: no rows. Extra columns are
ignored by jaccard_join and kept by drop_near_copies. Texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm.common import ROW_KEY, by_chunk, one_of_each, row_key, shielded, stage

WORD = re.compile(r"\w+")
STEP = 32
REMEMBERED = 400_000


class Sketcher:
    """Shingle sets and MinHash values of texts; the same everywhere."""

    def __init__(self, shingle: int = 5, bands: int = 24, rows: int = 4, seed: int = 11):
        self.shingle, self.bands, self.rows = shingle, bands, rows
        random = np.random.default_rng(seed)
        self.a = random.integers(1, 1 << 32, bands * rows, np.uint64).astype(np.uint32)[:, None] | np.uint32(1)
        self.b = random.integers(0, 1 << 32, bands * rows, np.uint64).astype(np.uint32)[:, None]
        self.mix = random.integers(1, 1 << 63, max(shingle, rows) + 2, np.uint64) | np.uint64(1)
        self.known: dict[str, int] = {}

    def shingles(self, text: str | None) -> np.ndarray:
        """The sorted distinct 64-bit hashes of the shingles."""
        words = WORD.findall(text.lower()) if text else []
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.array([known[w] for w in words], np.uint64)
        k = min(self.shingle, len(h))
        mixed = np.full(len(h) - k + 1, np.uint64(k))
        for i in range(k):
            mixed = (mixed ^ h[i : len(h) - k + 1 + i]) * self.mix[i]
            mixed ^= mixed >> np.uint64(29)
        mixed *= self.mix[-1]
        return np.unique(mixed ^ (mixed >> np.uint64(32)))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        low = shingles.astype(np.uint32)
        for at in range(0, len(low), 8192):
            np.minimum(out, (self.a * low[None, at : at + 8192] + self.b).min(axis=1), out=out)
        return out

    def band_keys(self, signatures: np.ndarray) -> np.ndarray:
        """int64 keys of the bands of (n, bands * rows) signatures, different for each band."""
        parts = signatures.reshape(len(signatures), self.bands, self.rows).astype(np.uint64)
        keys = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
        for i in range(self.rows):
            keys = (keys ^ parts[:, :, i]) * self.mix[i]
            keys ^= keys >> np.uint64(31)
        return keys.view(np.int64)


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """The fewest matches among n values with which P(similarity >= threshold) is at least the tolerance.

    After m matches of n and a uniform prior the similarity is Beta(m + 1, n - m + 1), and it reaches t with
    the probability that of n + 1 draws at chance t at most m succeed.
    """
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def _sketch(settings: dict):
    def make():
        sketcher = Sketcher(**settings)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [sketcher.shingles(t) for t in batch.column("text").to_pylist()]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            signatures = np.stack([sketcher.signature(s) for s in sets]) if sets else np.zeros((0, len(sketcher.a)), np.uint32)
            flat = pa.array(sketcher.band_keys(signatures).reshape(-1))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, sketcher.bands, np.int32)), flat)
            return pa.record_batch(
                [batch.column("doc_id"), batch.column("row_key"), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int32()), bands], names=["doc_id", "row_key", "set_key", "n_shingles", "bands"]
            )

        return each

    return by_chunk(make)


LINK_SCHEMA = "set_key binary, links long, link_docs long, root binary"


class Verifier:
    """Links among the sets of one group of work."""

    def __init__(self, settings: dict, threshold: float, tolerance: float):
        self.sketcher, self.threshold = Sketcher(**settings), threshold
        n = len(self.sketcher.a)
        self.steps = [(at, min(n, at + STEP), least_matches(min(n, at + STEP), threshold, tolerance)) for at in range(0, n, STEP)]

    def links(self, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j) at the threshold or above: within left if right is None, else between the two."""
        signatures = np.stack([self.sketcher.signature(s) for s in sets])
        bands, sizes = self.sketcher.band_keys(signatures), np.array([len(s) for s in sets])
        bits = self._bits(sets)
        other = left if right is None else right
        out = []
        for at in range(0, len(left), 256):
            rows = left[at : at + 256]
            hit = np.zeros((len(rows), len(other)), bool)
            for band in range(self.sketcher.bands):
                hit |= bands[rows, band][:, None] == bands[other, band][None, :]
            if right is None:
                hit &= np.arange(len(other))[None, :] > np.arange(at, at + len(rows))[:, None]
            small, large = np.minimum(sizes[rows][:, None], sizes[other]), np.maximum(sizes[rows][:, None], sizes[other])
            hit &= small >= self.threshold * large - 1e-9
            if hit.mean() > 0.1:  # many candidates: the first step on the whole matrix
                first, end, least = self.steps[0]
                same = np.zeros(hit.shape, np.uint8)
                for v in range(first, end):
                    same += signatures[rows, v][:, None] == signatures[other, v][None, :]
                hit &= same >= least
            i, j = np.nonzero(hit)
            for part in range(0, len(i), 65_536):
                out.append(self._verified(rows[i[part : part + 65_536]], other[j[part : part + 65_536]], signatures, sets, sizes, bits))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _verified(self, i, j, signatures, sets, sizes, bits):
        matches = np.zeros(len(i), np.int64)
        for at, end, least in self.steps:
            matches += (signatures[i, at:end] == signatures[j, at:end]).sum(axis=1)
            keep = matches >= least
            i, j, matches = i[keep], j[keep], matches[keep]
        if bits is not None:
            both = np.zeros(len(i), np.int64)
            for word in range(bits.shape[0]):
                both += np.bitwise_count(bits[word][i] & bits[word][j])
        else:
            both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
        keep = both >= self.threshold * (sizes[i] + sizes[j] - both) - 1e-9
        return i[keep], j[keep]

    @staticmethod
    def _bits(sets: list[np.ndarray]) -> np.ndarray | None:
        """(words, n): of each set a bit for every shingle that more than one has; None if that is too large."""
        flat = np.concatenate(sets)
        _, where, counts = np.unique(flat, return_inverse=True, return_counts=True)
        number = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)[where]
        width = (int((counts > 1).sum()) + 63) // 64
        if width * len(sets) * 8 > 64 << 20:
            return None
        bits = np.zeros((width, len(sets)), np.uint64)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        shared = number >= 0
        np.bitwise_or.at(bits, (number[shared] // 64, owner[shared]), np.uint64(1) << (number[shared] % 64).astype(np.uint64))
        return bits


def components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes is connected with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _group_links(settings: dict, threshold: float, tolerance: float):
    """A mapInArrow function over rows (task, within, side, set_key, n_docs, text) in the order of their task, a pair of numbers.

    within: the task is one block with itself. Of two blocks one may be without sets; then nothing meets.
    """

    def solve(verifier: Verifier, within: bool, group: list[tuple]) -> pa.RecordBatch | None:
        rows = list({(side, key): (side, key, n, text) for side, key, n, text in group}.values())
        rows.sort(key=lambda r: r[1])
        sides, docs = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
        sets = [verifier.sketcher.shingles(r[3]) for r in rows]
        left, right = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
        if len(left) < 1 + within or not within and not len(right):
            return None
        i, j = verifier.links(sets, left, None if within else right)
        if not len(i):
            return None
        n = len(rows)
        links = np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
        weight = np.bincount(i, docs[j], n) + np.bincount(j, docs[i], n)
        root, has = components(n, i, j), np.flatnonzero(links)
        return pa.record_batch(
            [pa.array([rows[x][1] for x in has], pa.binary()), pa.array(links[has], pa.int64()), pa.array(weight[has].astype(np.int64)), pa.array([rows[root[x]][1] for x in has], pa.binary())],
            names=["set_key", "links", "link_docs", "root"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verifier, group, current, within = Verifier(settings, threshold, tolerance), [], None, False
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("task", "within", "side", "set_key", "n_docs", "text")]
            for task, inside, *row in zip(*columns, strict=True):
                if task != current:
                    if group and (found := solve(verifier, within, group)) is not None:
                        yield found
                    group, current, within = [], task, inside
                group.append(tuple(row))
        if group and (found := solve(verifier, within, group)) is not None:
            yield found

    return run


def connected(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges (set_key, root) to (set_key, label): the smallest key of each component, by rounds of smallest labels.

    In each round a node takes the smallest label around it and then its label's label; rounds are tables of
    the shared folder. Groups come as stars from the tasks, so a few rounds are enough.
    """
    both = edges.select("set_key", "root").where("set_key <> root")
    both = stage(both.unionByName(both.select(F.col("root").alias("set_key"), F.col("set_key").alias("root"))).distinct(), name)
    labels = stage(both.groupBy("set_key").agg(F.min("root").alias("m")).select("set_key", F.least("set_key", "m").alias("label")), name)
    while True:
        around = both.join(labels.withColumnRenamed("set_key", "root"), "root").groupBy("set_key").agg(F.min("label").alias("near"))
        new = labels.join(around, "set_key", "left").select("set_key", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        of_label = labels.select(F.col("set_key").alias("label"), F.col("label").alias("next"))
        jumped = stage(new.join(of_label, "label", "left").select("set_key", "old", F.least("label", F.coalesce("next", "label")).alias("label")), name)
        labels = jumped.select("set_key", "label")
        if jumped.where("label <> old").limit(1).count() == 0:
            return labels


def jaccard_join(
    docs: DataFrame,
    *,
    shingle: int = 5,
    threshold: float = 0.8,
    bands: int = 24,
    rows: int = 4,
    tolerance: float = 1e-5,
    block_sets: int = 1024,
    block_shingles: int = 400_000,
) -> DataFrame:
    """docs (doc_id, text) to one row each: doc_id, class_id, class_size, n_links, n_text_links, kept, row_key.

    class_id is the smallest doc_id of the component of links, class_size its documents. n_links counts the
    other documents at the threshold or above, copies among them; n_text_links the different sets among those.
    kept marks one row of each class.
    """
    settings = {"shingle": shingle, "bands": bands, "rows": rows}
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), "text")
    sketched = texts.mapInArrow(_sketch(settings), f"doc_id long, row_key {ROW_KEY}, set_key binary, n_shingles int, bands array<long>")
    sketch = stage(sketched.select(F.monotonically_increasing_id().alias("tag"), "*"), "sketch")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag", "row_key")).alias("first")
    sets = stage(sketch.where("set_key IS NOT NULL").groupBy("set_key").agg(first, F.count("*").alias("n_docs"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")), "sets")

    # Bands that more than one set has, and the cell of each such set: the smallest set it shares a band with.
    buckets = sets.select("set_key", F.explode("bands").alias("band"))
    shared = buckets.groupBy("band").agg(F.count("*").alias("n"), F.min("set_key").alias("lead")).where("n > 1").drop("n")
    members = stage(buckets.join(shared, "band"), "band-members")
    cell_of = stage(members.groupBy("set_key").agg(F.min("lead").alias("cell")).join(sets.select("set_key", "n_docs", "n_shingles", F.col("first.row_key").alias("row_key")), "set_key"), "cells")
    grown = F.least(F.lit(8.0), F.greatest(F.lit(1.0), F.count("*") / (64 * block_sets)))
    parts = F.greatest(F.ceil(F.count("*") / (grown * block_sets)), F.ceil(F.sum("n_shingles") / (grown * block_shingles)))
    cells = stage(cell_of.groupBy("cell").agg(parts.alias("parts"), F.count("*").alias("n_sets")), "cell-sizes")
    in_cells = members.join(cell_of.select("set_key", "cell"), "set_key").select("band", "cell").distinct()
    pairs = in_cells.join(in_cells.withColumnRenamed("cell", "other"), "band").where("cell < other").select("cell", "other").distinct()
    sized = pairs.join(cells.select("cell", "parts"), "cell").join(cells.select(F.col("cell").alias("other"), F.col("parts").alias("other_parts")), "other")
    sized = stage(sized, "cell-pairs")

    # Which block of work each set goes to: a group of work is that of two cells (or one) and the number of two blocks.
    placed = cell_of.join(cells, "cell").withColumn("block", F.pmod(F.xxhash64("set_key"), F.col("parts")))
    group = lambda left, right, number: F.struct((F.xxhash64(left, right) + number).alias("a"), (F.xxhash64(F.lit(1), left, right) + number).alias("b")).alias("task")
    low, high = F.least("block", "b"), F.greatest("block", "b")
    own = placed.where("n_sets > 1").select("set_key", "n_docs", "row_key", "cell", "block", F.explode(F.expr("sequence(0L, parts - 1)")).alias("b"))
    own = own.select("set_key", "n_docs", "row_key", group("cell", "cell", F.expr("greatest(block, b) * (greatest(block, b) + 1) div 2") + low), (low == high).alias("within"), F.when(F.col("block") <= F.col("b"), 0).otherwise(1).alias("side"))
    over = F.explode(F.expr("sequence(0L, other_parts - 1)")).alias("b")
    here = placed.select("set_key", "n_docs", "row_key", "cell", "block", "parts")
    to_right = here.join(sized.drop("parts"), "cell").select("set_key", "n_docs", "row_key", "cell", "other", "block", "other_parts", over)
    to_right = to_right.select("set_key", "n_docs", "row_key", group("cell", "other", F.col("block") * F.col("other_parts") + F.col("b")), F.lit(False).alias("within"), F.lit(0).alias("side"))
    turned = sized.select(F.col("other").alias("cell"), F.col("cell").alias("left"), F.col("parts").alias("other_parts"))
    to_left = here.join(turned, "cell").select("set_key", "n_docs", "row_key", "left", "cell", "block", "parts", over)
    to_left = to_left.select("set_key", "n_docs", "row_key", group("left", "cell", F.col("b") * F.col("parts") + F.col("block")), F.lit(False).alias("within"), F.lit(1).alias("side"))
    work = own.unionByName(to_right).unionByName(to_left)

    # A partition for about 4096 sets that are sent, and as many as other shuffles have at least.
    sizes = cells.select("cell", "n_sets")
    across = sized.join(sizes, "cell").join(sizes.select(F.col("cell").alias("other"), F.col("n_sets").alias("other_sets")), "other")
    sent = cells.agg(F.sum(F.col("n_sets") * F.col("parts"))).first()[0] or 0
    sent += across.agg(F.sum(F.col("n_sets") * F.col("other_parts") + F.col("other_sets") * F.col("parts"))).first()[0] or 0
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(100_000, sent // 4096))

    grouped = texts.select("row_key", "text").join(work, "row_key").select("task", "within", "side", "set_key", "n_docs", "text")
    dealt = grouped.repartitionById(partitions, F.pmod("task.a", F.lit(partitions)).cast("int")).sortWithinPartitions("task")
    links = stage(dealt.mapInArrow(_group_links(settings, threshold, tolerance), LINK_SCHEMA), "links")
    degrees = links.groupBy("set_key").agg(F.sum("links").alias("links"), F.sum("link_docs").alias("link_docs"))
    labels = connected(links)
    known = stage(
        sets.select("set_key", "first", "n_docs").join(labels, "set_key", "left").join(degrees, "set_key", "left").withColumn("label", F.coalesce("label", "set_key")), "set-labels"
    )
    classes = known.groupBy("label").agg(F.min("first").alias("class_first"), F.sum("n_docs").alias("class_size"))
    named = stage(
        known.join(classes, "label").select(
            "set_key", "n_docs", F.col("class_first.doc_id").alias("class_id"), F.col("class_first.tag").alias("class_tag"), "class_size",
            (F.col("n_docs") - 1 + F.coalesce("link_docs", F.lit(0))).alias("n_links"), F.coalesce("links", F.lit(0)).alias("n_text_links"),
        ),
        "set-classes",
    )
    # Sets with a thousandth of all documents or more are a thousand at most, and are broadcast.
    slim = sketch.select("doc_id", "tag", "row_key", "set_key")
    hot_from = max(1000, slim.count() // 1000)
    hot, cold = F.broadcast(named.where(F.col("n_docs") >= hot_from)), named.where(F.col("n_docs") < hot_from)
    out = slim.join(hot, "set_key").unionByName(slim.join(hot, "set_key", "left_anti").join(cold, "set_key", "left"))
    return out.select(
        "doc_id",
        F.when(F.col("class_tag").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_text_links", F.lit(0)).cast("long").alias("n_text_links"),
        F.coalesce(F.col("tag") == F.col("class_tag"), F.lit(True)).alias("kept"),
        "row_key",
    )


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each class of near copies; all columns stay."""
    docs, restore = shielded(docs, ("doc_id", "text"))
    # Rows without words are classes of their own, so all of them stay.
    return restore(one_of_each(docs, jaccard_join(docs, **options).where("class_size > 1").select("row_key", "kept")))
