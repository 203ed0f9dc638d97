"""Exact deduplication on a log-structured merge index of text digests.

Documents are first logged: (tag, doc_id, digest, sha256), one row each, the index's write-ahead log. The log
is inserted in a few batches. Of a batch, tasks gather digests in memtables of bounded size, which are flushed
with the smallest identifier and the count of each digest and merged into one run sorted by digest, with a
Bloom filter cut into buckets. Before a run is added, its digests are probed against the filters of the runs
that are there; those that pass are looked up exactly. A level of `fan_in` runs is compacted into one run of
the next, which keeps smallest identifiers.

What a later run found in an earlier one, and what a run counts more than once, are hits. Only the entries of
hits are merged over all runs, and only rows with such digests are compared: the texts behind them are
compared byte for byte (they are the grouping keys of an aggregation), so texts that only share a digest stay
apart. All other rows stand alone.

Two texts are equal when they are identical after lower-casing A-Z; null counts as empty. The row that
stays has the largest doc_id (keep="last": identifiers are complements, so the smallest wins) or the
smallest (keep="first"); null ids lose to all others, and of rows with the same id the first logged stays.

Edge cases. Empty and null texts are equal texts. Repeated rows are copies of each other. No rows: no rows.
Extra columns are ignored. Digests are taken in Python: folding A-Z as a column costs three times as much.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.llm.common import ROW_KEY, by_chunk, discard, one_of_each, row_key, shielded, stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN_SCHEMA = "digest binary, ident long, tag long, n long"
#: Bits of a filter's bucket, digests that it is meant for, and bits that each digest sets: one in 90 others passes.
FILTER_BITS, FILTER_DIGESTS, FILTER_HASHES = 1 << 17, 13_000, 5
#: Filters of up to this many buckets (16 KB each) are broadcast, larger ones are joined by a shuffle.
BROADCAST_BUCKETS = 2048
#: Likewise entries of hits and rows behind hits, of about 60 bytes.
BROADCAST_ROWS = 200_000


def folded(text: Column) -> Column:
    """The text that is compared: A-Z in lower case, null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def digests(digest_bytes: int):
    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            found = [hashlib.sha256((t or b"").lower()) for t in texts]  # bytes.lower() touches A-Z only
            return pa.record_batch(
                [batch.column("doc_id"), batch.column("row_key"), pa.array([h.digest()[:digest_bytes] for h in found], pa.binary()), pa.array([h.hexdigest() for h in found], pa.string())],
                names=["doc_id", "row_key", "digest", "text_sha256"],
            )

        return each

    return by_chunk(make)


def memtables(memtable_rows: int):
    """A mapInArrow function: digests to the entries of sorted memtables of at most memtable_rows digests."""

    def flush(table: dict) -> pa.RecordBatch:
        keys = sorted(table)
        entries = [table[k] for k in keys]
        columns = [keys, *([e[i] for e in entries] for i in range(3))]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["digest", "ident", "tag", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[bytes, list] = {}
        for batch in batches:
            for digest, ident, tag in zip(*(batch.column(c).to_pylist() for c in ("digest", "ident", "tag")), strict=True):
                entry = table.get(digest)
                if entry is None:
                    if len(table) >= memtable_rows:
                        yield flush(table)
                        table = {}
                    table[digest] = [ident, tag, 1]
                else:
                    entry[2] += 1
                    if ident is not None and (entry[0] is None or (ident, tag) < (entry[0], entry[1])):
                        entry[0], entry[1] = ident, tag
                    elif ident is None and entry[0] is None and tag < entry[1]:
                        entry[1] = tag
        if table:
            yield flush(table)

    return run


def bucket_of(digest: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), digest), F.lit(buckets))


def filter_bits(digest: Column) -> list[Column]:
    """The bits of a bucket that a digest sets."""
    return [F.pmod(F.xxhash64(F.lit(i + 1), digest), F.lit(FILTER_BITS)) for i in range(FILTER_HASHES)]


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, places), sorted by bucket, to (bucket, bits); a bucket that two tasks read gives two rows."""
    current, bits = None, np.zeros(FILTER_BITS, np.uint8)

    def done() -> pa.RecordBatch:
        words = np.packbits(bits, bitorder="little").view(np.int64)
        return pa.record_batch([pa.array([current], pa.int64()), pa.array([words], pa.list_(pa.int64()))], names=["bucket", "bits"])

    for batch in batches:
        buckets, places = batch.column("bucket").to_numpy(), np.stack([batch.column(f"p{i}").to_numpy() for i in range(FILTER_HASHES)])
        cuts = np.flatnonzero(np.diff(buckets)) + 1
        for start, end in zip([0, *cuts], [*cuts, len(buckets)], strict=True):
            if start == end:
                continue
            if buckets[start] != current:
                if current is not None:
                    yield done()
                current = int(buckets[start])
                bits[:] = 0
            bits[places[:, start:end].ravel()] = 1
    if current is not None:
        yield done()


@dataclass
class Run:
    """A table of entries (bucket, digest, ident, tag, n), sorted, a digest each, and its filter (bucket, bits)."""

    entries: DataFrame
    filters: DataFrame
    buckets: int

    def may_hold(self, digest_rows: DataFrame) -> DataFrame:
        """The rows (with digest) whose digest passes the filter."""
        side = self.filters.select(F.col("bucket").alias("_bucket"), "bits")
        side = F.broadcast(side) if self.buckets <= BROADCAST_BUCKETS else side
        hit = bucket_of(F.col("digest"), self.buckets) == F.col("_bucket")
        for place in filter_bits(F.col("digest")):
            hit &= F.getbit(F.get("bits", F.shiftright(place, 6).cast("int")), (place % 64).cast("int")) == 1
        return digest_rows.join(side, hit, "left_semi")


class MergeIndex:
    """Digest runs by level, tables of the shared folder; level 0 holds what batches flush."""

    def __init__(self, memtable_rows: int = 200_000, fan_in: int = 3):
        self.memtable_rows, self.fan_in = memtable_rows, fan_in
        self.levels: list[list[Run]] = [[]]

    @property
    def runs(self) -> list[Run]:
        return [run for level in self.levels for run in level]

    def _written(self, entries: DataFrame, most: int) -> Run:
        """The entries, several of a digest merged, as a run; most: how many digests there can be."""
        buckets = -(-max(1, most) // FILTER_DIGESTS)
        cut = entries.withColumn("bucket", bucket_of(F.col("digest"), buckets)).repartition("bucket")
        table = stage(merged(cut, "bucket").sortWithinPartitions("bucket", "digest"), "digest-run")
        places = table.sortWithinPartitions("bucket").select("bucket", *[p.alias(f"p{i}") for i, p in enumerate(filter_bits(F.col("digest")))])
        return Run(table, stage(places.mapInArrow(_filters, "bucket long, bits array<long>"), "digest-filter"), buckets)

    def insert(self, log: DataFrame) -> DataFrame:
        """Flush a log (tag, ident, digest) as a run. Its digests that earlier runs hold already (digest)."""
        flushed = stage(log.select("digest", "ident", "tag").mapInArrow(memtables(self.memtable_rows), RUN_SCHEMA), "memtables")
        run = self._written(flushed, flushed.count())
        discard(flushed)
        known = stage(self.lookup(run.entries.select("digest")).select("digest"), "digest-hits")
        self.levels[0].append(run)
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fan_in:
                self.compact(level)
        return known

    def compact(self, level: int | None = None) -> None:
        """Merge the runs of a level, or of all levels, into one of the next; smallest identifiers stay."""
        from_levels = range(len(self.levels)) if level is None else [level]
        old = [run for i in from_levels for run in self.levels[i]]
        if not old:
            return
        to = len(self.levels) if level is None else level + 1
        every = union([run.entries.drop("bucket") for run in old])
        new = self._written(every, every.count())
        for i in from_levels:
            self.levels[i] = []
        self.levels += [[] for _ in range(to + 1 - len(self.levels))]
        self.levels[to].append(new)
        for run in old:
            discard(run.entries)
            discard(run.filters)

    def entries(self) -> DataFrame:
        """(digest, ident, tag, n) of all levels, merged on the fly where more than one run is left."""
        return merged(union([run.entries for run in self.runs]))

    def lookup(self, digest_rows: DataFrame) -> DataFrame:
        """digest_rows (with digest) that the index holds; the runs' filters go first, so the exact join gets few others."""
        found = [run.may_hold(digest_rows).join(run.entries.select("digest"), "digest", "left_semi") for run in self.runs]
        return union(found).distinct() if found else digest_rows.limit(0)

    def repeated(self, known: DataFrame) -> DataFrame:
        """(digest, ident, tag, n), merged over all runs, of the digests that are known or that a run counts more than once."""
        every = union([run.entries.select("digest", "ident", "tag", "n") for run in self.runs])
        wanted = stage(known.select("digest").unionByName(every.where("n > 1").select("digest")).distinct(), "digest-wanted")
        few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        return merged(every.join(F.broadcast(wanted) if few else wanted, "digest", "left_semi"))


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def merged(entries: DataFrame, *more_keys: str) -> DataFrame:
    best = F.min(F.struct(F.col("ident").isNull().alias("none"), "ident", "tag"))
    return entries.groupBy(*more_keys, "digest").agg(best.alias("best"), F.sum("n").alias("n")).select(*more_keys, "digest", "best.ident", "best.tag", "n")


def verified_splits(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """Digests under which more than one text lies: (digest, variants, hashes). marked: rows with the count of their digest.

    Only texts behind hits are compared. Equal texts are combined before they are shuffled, so a group of
    any size sends one text from each task.
    """
    hits = stage(marked.where("n > 1").select("row_key", "digest").distinct(), "digest-rows")
    few = hits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = docs.select(row_key().alias("row_key"), "text").join(F.broadcast(hits) if few else hits, "row_key").groupBy("digest", "text").agg(F.count("*").alias("n"))
    variants = texts.groupBy("digest", folded(F.col("text")).alias("text")).agg(F.sum("n").alias("n"))
    return variants.groupBy("digest").agg(F.count("*").alias("variants"), F.count_distinct(F.sha2("text", 256)).alias("hashes")).where("variants > 1")


def with_entries(log: DataFrame, entries: DataFrame) -> DataFrame:
    """The log with best, best_tag and n of each digest; rows whose digest has no entry stand alone.

    Few entries are broadcast. Of many, those of a thousandth of all rows or more are a thousand at most and
    are broadcast, so that no task gets all rows of one.
    """
    named = stage(entries.select("digest", F.col("ident").alias("best"), F.col("tag").alias("best_tag"), "n"), "digest-copies")
    if named.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        joined = log.join(F.broadcast(named), "digest", "left")
    else:
        least = max(1000, log.count() // 1000)
        hot, cold = F.broadcast(named.where(F.col("n") >= least)), named.where(F.col("n") < least)
        joined = log.join(hot, "digest").unionByName(log.join(hot, "digest", "left_anti").join(cold, "digest", "left"))
    alone = F.col("n").isNull()
    return joined.withColumns({"best": F.when(alone, F.col("ident")).otherwise(F.col("best")), "best_tag": F.when(alone, F.col("tag")).otherwise(F.col("best_tag")), "n": F.coalesce("n", F.lit(1))})


def find_copies(docs: DataFrame, *, keep: str = "last", digest_bytes: int = 16, memtable_rows: int = 200_000, batches: int = 4) -> DataFrame:
    """docs (doc_id, text) to doc_id, row_key, tag, keep_id, group_size, kept, text_sha256; one row each."""
    ident = F.bitwise_not("doc_id") if keep == "last" else F.col("doc_id")
    logged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("row_key"))
    hashed = logged.mapInArrow(digests(digest_bytes), f"doc_id long, row_key {ROW_KEY}, digest binary, text_sha256 string")
    numbered = hashed.select(F.monotonically_increasing_id().alias("tag"), "*", ident.alias("ident"))
    # A task's rows are one batch; a batch is a folder, so that inserting it reads no others.
    log = stage(numbered.withColumn("batch", F.pmod(F.shiftright("tag", 33), F.lit(batches)).cast("int")), "digest-log", "batch")
    index = MergeIndex(memtable_rows)
    known = union([index.insert(log.where(F.col("batch") == b)) for b in range(batches)])
    log = log.drop("batch")
    marked = stage(with_entries(log, index.repeated(known)), "digest-marked")
    apart = stage(verified_splits(docs, marked), "digest-splits")
    wrong = apart.agg(F.count("*").alias("n"), F.count_if(F.col("hashes") < F.col("variants")).alias("same")).first()
    if wrong["same"]:
        raise ValueError("different texts share their whole SHA-256; they can't be told apart by it")
    all_rows = marked
    if wrong["n"]:
        split = log.join(apart.select("digest"), "digest")
        best = F.min(F.struct(F.col("ident").isNull().alias("none"), "ident", "tag")).alias("best")
        by_text = split.groupBy("digest", "text_sha256").agg(best, F.count("*").alias("n")).select("digest", "text_sha256", F.col("best.ident").alias("best"), F.col("best.tag").alias("best_tag"), "n")
        all_rows = marked.join(apart, "digest", "left_anti").unionByName(split.join(by_text, ["digest", "text_sha256"]))
    keep_id = F.bitwise_not("best") if keep == "last" else F.col("best")
    return all_rows.select("doc_id", "row_key", "tag", keep_id.alias("keep_id"), F.col("n").alias("group_size"), (F.col("tag") == F.col("best_tag")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """docs without the rows that find_copies does not keep; all columns stay."""
    mine, restore = shielded(docs, ("doc_id", "text"))
    return restore(one_of_each(mine, find_copies(mine, **options).where("group_size > 1").select("row_key", "kept")))
