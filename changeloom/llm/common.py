"""What the operators share: tables that cut lineage, and Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.checkpoints import new_path

#: Rows handed to Python at once are regrouped into chunks of about this many characters.
CHUNK_CHARS = 4_000_000


def stage(df: DataFrame, name: str, partitioned_by: str | None = None) -> DataFrame:
    """df written to the shared folder and read again: the lineage ends here, on files that outlive executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(partitioned_by) if partitioned_by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a stage that nothing reads any more."""
    spark = df.sparkSession
    for folder in {x.rpartition("/")[0] for x in df.inputFiles()}:
        if "/changeloom/" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: The type of row_key().
ROW_KEY = "struct<a: long, b: long>"


def half_key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def row_key() -> Column:
    """A 128-bit hash of doc_id and text, by which a row is found again; only equal rows are expected to share one."""
    return F.struct(half_key(1).alias("a"), half_key(2).alias("b"))


#: Keys of rows up to this many (about 40 bytes each) are broadcast to find the rows, more are joined by a shuffle.
BROADCAST_KEYS = 200_000


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """docs without the rows of groups that do not stay. groups: row_key, kept, for rows that share their group with others.

    Rows of no group stay where they are; of a group's rows only those that stay are shuffled, repeated ones once. Which of the rows of one
    doc_id and text that differ in other columns stays is not fixed.
    """
    keys = stage(groups.groupBy(F.col("row_key").alias("_key")).agg(F.bool_or("kept").alias("_kept")), "row-keys")
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    side = lambda df: F.broadcast(df) if few else df
    keyed = docs.withColumn("_key", row_key())
    alone = keyed.join(side(keys.select("_key")), "_key", "left_anti")
    chosen = keyed.join(side(keys.where("_kept").select("_key")), "_key", "left_semi").dropDuplicates(["_key"])
    return alone.unionByName(chosen)


def shielded(docs: DataFrame, needed: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all other columns under names that clash with nothing, and what gives them back their own."""
    names = {c: c if c in needed else f"__other{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(names[c]) for c in docs.columns])
    return renamed, lambda out: out.select(*[F.col(names[c]).alias(c) for c in docs.columns])


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts hold about `limit` bytes; one longer text is a slice of its own."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def by_chunk(make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], column: str = "text"):
    """A mapInArrow function: `make()` is called once a task and gives the function for each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for part in slices(batch, column):
                yield each(part)

    return run
