"""Mixing sources to target weights, with DataFrame operations only.

The words of each source form one stream (documents in a fixed pseudorandom order) that is cut into
blocks of `block_words`. A source's target is a number of slots. How many of them each output shard gets is a
multinomial draw: the shards are halved again and again, and of the slots of a range a binomial draw falls to
its left half. So every shard has its count of each source, the counts of a source add up to its target, and
no slot is touched for that. The count of a shard and source names a run of slots; slot k of a source takes
the block that the source's pseudorandom permutation of epoch k div n gives for k mod n, so no block is taken
more than once an epoch and no document more than `cap` times. Slots and documents meet by (source, block).

Edge cases. Null text: size 0, nothing taken. Null source: a source of its own, last in order. A source
of size 0 gets target 0. Repeated rows are documents of their own. No rows: no rows. Extra columns are
ignored. Ties in the order of a stream go by doc_id, size and text hash, so reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeloom.llm.common import shielded, stage

WORD = r"[^\x20\x09-\x0D]+"
#: Sources up to this many are joined by broadcast (about 100 bytes each), more by a shuffle.
BROADCAST_SOURCES = 10_000

@dataclass(frozen=True)
class Mix:
    sources: DataFrame  #: rank, source, weight, source_size, n_docs, target, blocks, epochs, rest
    placed: DataFrame  #: tag, doc_id, text_hash, rank, size, offset: where each document lies in its stream
    counts: DataFrame  #: rank, shard, first_slot, n: the draw, where n > 0
    slots: DataFrame  #: shard, rank, epoch, block, fill
    taken: DataFrame  #: tag, block, word, first, last, times, fill, shard: the parts of blocks that documents fill
    documents: DataFrame  #: doc_id, source, text_hash, size, source_size, target, taken, first_shard
    broadcast: bool  #: whether the sources are few enough to be broadcast


def targets(per_source: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """per_source (source, source_size, n_docs) with rank, weight and target.

    A source is at its cap if, with all sources of a lower cap-to-weight ratio at theirs, its share of
    the rest would lie above it; this is where resharing the excess again and again ends.
    """
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "rank")
    before, onward = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(whole)
    return (
        per_source.withColumn("rank", F.row_number().over(by_source) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights)) + 1))
        .withColumn("cap", F.col("source_size") * float(cap))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
        .withColumn("capped", F.col("ratio") < F.col("level"))
        .withColumn("share", F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(whole))
        .withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", F.col("share") * F.col("weight"))))
        .select("rank", "source", "weight", "source_size", "n_docs", "target", "capped")
    )


def permuted(df: DataFrame, index: str, size: str, key: list[Column], rounds: int) -> DataFrame:
    """df with `index` sent through a keyed permutation of [0, size): swap-or-not rounds, each its own inverse."""
    def one(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, r), F.col(size)) - x, F.col(size))
        coin = F.xxhash64(*key, r, F.greatest(x, other)).bitwiseAND(F.lit(1))
        return F.when(coin == 1, other).otherwise(x)

    # A lambda and not a column for each round: the optimizer would merge those into one huge expression.
    return df.withColumn(index, F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), F.col(index), one))


def coins(n: str, seed: int) -> str:
    """SQL of how many of n fair coins show heads: the ones among so many bits of hashes, in runs so that no array grows with n."""
    mask = f"IF(w < {n} div 64, -1L, IF({n} % 64 = 0, 0L, shiftrightunsigned(-1L, cast(64 - {n} % 64 AS int))))"
    one = f"bit_count(xxhash64({seed}, rank, v.lo, v.hi, t, w) & {mask})"
    run = f"aggregate(sequence(i * 65536, least(i * 65536 + 65535, {n} div 64)), 0L, (b, w) -> b + {one})"
    return f"aggregate(sequence(0L, {n} div 64 div 65536), 0L, (a, i) -> a + {run})"


def binomial(chance: tuple[str, str], seed: int) -> str:
    """SQL of a binomial draw of v.n at the chance of a ratio of longs, by the same law at any size.

    Each trial is a uniform number in binary, compared with the chance bit by bit: of those that agree so far, half
    agree in the next bit, and the others are decided. So a draw takes about 2 v.n coins, 64 from a hash; what still
    agrees after 64 bits, one trial in 2**64, counts as a failure.
    """
    part, whole = chance
    hit = f"named_struct('k', m.k + c, 'rest', m.rest - c, 'r', 2 * m.r - ({whole}))"
    step = f"IF(m.rest = 0 OR m.r = 0, m, element_at(transform(array({coins('m.rest', seed)}), c -> IF(2 * m.r >= ({whole}), {hit}, named_struct('k', m.k, 'rest', c, 'r', 2 * m.r))), 1))"
    return f"aggregate(sequence(1, 64), named_struct('k', 0L, 'rest', v.n, 'r', {part}), (m, t) -> {step}, m -> m.k)"


def halved(levels: int, seed: int) -> str:
    """SQL that splits `nodes`, an array of (lo, hi, at, n), that many times.

    Of the n slots of the shards from lo to hi, a binomial draw falls to those below the middle; `at` is the
    first of the slots. Shards without slots are left out, and ranges of one shard are left alone.
    """
    drawn = binomial(("(v.lo + v.hi) div 2 - v.lo", "v.hi - v.lo"), seed)
    pair = "array(named_struct('lo', v.lo, 'hi', (v.lo + v.hi) div 2, 'at', v.at, 'n', k), named_struct('lo', (v.lo + v.hi) div 2, 'hi', v.hi, 'at', v.at + k, 'n', v.n - k))"
    split = f"IF(v.hi - v.lo <= 1, array(v), flatten(transform(array({drawn}), k -> filter({pair}, x -> x.n > 0))))"
    return f"aggregate(sequence(1, {levels}), nodes, (a, i) -> flatten(transform(a, v -> {split})))" if levels else "nodes"


def shard_counts(quotas: DataFrame, shards: int, tasks: int, seed: int) -> DataFrame:
    """quotas (rank, n_slots, and others that stay) to (..., shard, first_slot, n): each source's slots by shard.

    Half of the levels come before the rows are dealt over `tasks`, so no row holds more than about the square
    root of the number of shards.
    """
    levels = max(0, shards - 1).bit_length()
    root = F.expr(f"array(named_struct('lo', 0L, 'hi', {shards}L, 'at', 0L, 'n', n_slots))")
    begun = quotas.where("n_slots > 0").withColumn("nodes", root).withColumn("node", F.explode(F.expr(halved(levels // 2, seed)))).drop("nodes")
    dealt = begun.repartition(tasks, "rank", "node.lo")
    done = dealt.withColumn("nodes", F.array("node")).withColumn("node", F.explode(F.expr(halved(levels - levels // 2, seed)))).drop("nodes")
    return done.select(*quotas.columns, F.col("node.lo").alias("shard"), F.col("node.at").alias("first_slot"), F.col("node.n").alias("n"))


def mix_sources(
    docs: DataFrame,
    *,
    weights: tuple[float, ...] = (5, 2, 1),
    cap: int = 3,
    block_words: int = 128,
    slots_per_shard: int = 1024,
    rounds: int = 12,
    seed: int = 20_24,
) -> Mix:
    """Mix docs (doc_id, source, text) so that each source's words come to its target."""
    sized = stage(
        docs.select(
            "doc_id",
            "source",
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64("text").alias("text_hash"),
        ),
        "mix-sized",
    )
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rest_words = F.col("target") - F.col("epochs") * F.col("source_size")
    sources = stage(
        targets(per_source, weights, cap)
        .withColumn("blocks", F.ceil(F.col("source_size") / block_words))
        .withColumn("epochs", F.when(F.col("capped"), F.lit(cap)).otherwise(F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0))).cast("long"))
        .withColumn("rest", F.when(F.col("capped"), F.lit(0)).otherwise(F.greatest(F.lit(0), F.least("source_size", F.round(rest_words)))).cast("long"))
        .withColumn("n_slots", F.col("epochs") * F.col("blocks") + F.ceil(F.col("rest") / block_words)),
        "mix-sources",
    )
    few = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    side = F.broadcast(sources) if few else sources

    # Streams: a source's documents are dealt into chunks of about the square root of their number, so
    # that neither the running sum within a chunk nor the one over chunks is a task that holds a source.
    chunk_docs = F.greatest(F.lit(500), F.ceil(F.sqrt("n_docs")))
    dealt = (
        sized.alias("d")
        .join(side.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
        .select("doc_id", "text_hash", "size", "rank", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_hash"), F.ceil(F.col("n_docs") / chunk_docs)).alias("chunk"))
    )
    in_chunk = Window.partitionBy("rank", "chunk").orderBy("doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    over_chunks = Window.partitionBy("rank").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("rank", "chunk").agg(F.sum("size").alias("words")).select("rank", "chunk", F.coalesce(F.sum("words").over(over_chunks), F.lit(0)).alias("base"))
    placed = stage(
        dealt.withColumn("before", F.coalesce(F.sum("size").over(in_chunk), F.lit(0)))
        .join(bases, ["rank", "chunk"])
        .select(F.monotonically_increasing_id().alias("tag"), "doc_id", "text_hash", "rank", "size", (F.col("base") + F.col("before")).alias("offset")),
        "mix-placed",
    )

    total_slots = sources.agg(F.coalesce(F.sum("n_slots"), F.lit(0))).first()[0]
    shards = max(1, -(-total_slots // slots_per_shard))
    counts = shard_counts(sources.select("rank", "blocks", "epochs", "rest", "n_slots"), shards, max(1, min(4096, total_slots // 65_536 + 1)), seed)
    k = (
        counts.withColumn("k", F.explode(F.sequence("first_slot", F.col("first_slot") + F.col("n") - 1)))
        .withColumn("epoch", F.expr("k div blocks"))
        .withColumn("block", F.col("k") % F.col("blocks"))
        .withColumn("fill", F.when(F.col("epoch") < F.col("epochs"), F.lit(block_words)).otherwise(F.least(F.lit(block_words), F.col("rest") - F.col("block") * block_words)).cast("long"))
    )
    slots = permuted(k, "block", "blocks", [F.lit(seed), F.col("rank"), F.col("epoch")], rounds).select("shard", "rank", "epoch", "block", "fill")

    # One row for each block: how often it is taken whole, the words of it that the last epoch takes, and the first shard that has it.
    chosen = slots.groupBy("rank", "block").agg(
        F.count_if(F.col("fill") == block_words).alias("times"), F.coalesce(F.max(F.when(F.col("fill") < block_words, F.col("fill"))), F.lit(0)).alias("fill"), F.min("shard").alias("shard")
    )
    pieces = (
        placed.where("size > 0")
        .select("tag", "rank", "offset", "size", F.explode(F.expr(f"sequence(offset div {block_words}, (offset + size - 1) div {block_words})")).alias("block"))
        .select(
            "tag",
            "rank",
            "block",
            F.greatest(F.lit(0), F.col("offset") - F.col("block") * block_words).alias("first"),
            F.least(F.lit(block_words), F.col("offset") + F.col("size") - F.col("block") * block_words).alias("last"),
            (F.greatest(F.col("offset"), F.col("block") * block_words) - F.col("offset")).alias("word"),
        )
    )
    # The hint: rows that sequences expand to are not in Spark's estimates, which would broadcast all slots.
    taken = pieces.join(chosen.hint("merge"), ["rank", "block"]).select("tag", "block", "word", "first", "last", "times", "fill", "shard")
    words = F.col("times") * (F.col("last") - F.col("first")) + F.greatest(F.lit(0), F.least("last", "fill") - F.col("first"))
    sums = taken.groupBy("tag").agg(F.sum(words).alias("taken"), F.min(F.when(words > 0, F.col("shard"))).alias("first_shard"))
    documents = (
        placed.join(sums, "tag", "left")
        .join(side, "rank")
        .select("doc_id", "source", "text_hash", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard", "tag")
    )
    return Mix(sources, placed, counts, slots, taken, documents, few)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself, with the columns of docs: each document once for each whole time it is taken, and
    once with the words of its blocks that were taken one time more. n_chars, if there, follows the text.

    Of a document taken t times a part and t + 1 times another, t rows hold the whole text and one row the
    other part's words with the white space before each, as they stand in the text. Documents that no block
    takes are left out.
    """
    docs, restore = shielded(docs, ("doc_id", "text", "source", "n_chars"))
    mix = mix_sources(docs, **options)
    # Of each document: the blocks' words that are taken one time more than the whole epochs take them.
    whole, last_part = F.col("last") - F.col("first"), F.greatest(F.lit(0), F.least("last", "fill") - F.col("first"))
    more = F.when(F.col("times") > F.col("epochs"), whole).otherwise(last_part)
    per_doc = (
        mix.taken.join(mix.placed.select("tag", "rank"), "tag")
        .join(F.broadcast(mix.sources.select("rank", "epochs")) if mix.broadcast else mix.sources.select("rank", "epochs"), "rank")
        .groupBy("tag")
        .agg(F.first("epochs").alias("_copies"), F.array_sort(F.collect_list(F.when(more > 0, F.struct("word", more.alias("n"))))).alias("_parts"))
    )
    # Rows of the same source, id and text are told apart by number; it does not matter which of them is which.
    nth = Window.partitionBy("rank", "doc_id", "text_hash").orderBy("tag")
    ranks = mix.sources.select("rank", F.col("source").alias("_source"))
    taken = mix.placed.join(per_doc, "tag").join(F.broadcast(ranks) if mix.broadcast else ranks, "rank")
    known = taken.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h"), "_source", F.row_number().over(nth).alias("_n"), "size", "_copies", "_parts")
    known = known.withColumn("_all", F.expr("aggregate(_parts, 0L, (a, p) -> a + p.n) = size")).drop("size")
    mine = docs.withColumn("_hash", F.xxhash64("text")).withColumn("_nth", F.row_number().over(Window.partitionBy("source", "doc_id", "_hash").orderBy(F.lit(0))))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_hash") == F.col("_h")) & (F.col("_nth") == F.col("_n"))
    joined = mine.join(known, same)
    words = F.when(~F.col("_all") & (F.size("_parts") > 0), F.regexp_extract_all("text", F.lit(rf"([\x20\x09-\x0D]*{WORD})"), F.lit(1)))
    rest = F.regexp_replace(F.expr("array_join(flatten(transform(_parts, m -> slice(_words, cast(m.word + 1 as int), cast(m.n as int)))), '')"), r"^[\x20\x09-\x0D]+", "")
    copies = F.expr("array_repeat(text, cast(_copies + IF(_all, 1, 0) as int))")
    parts = F.when(F.col("_words").isNotNull(), F.array(rest)).otherwise(F.array().cast("array<string>"))
    out = joined.withColumn("_words", words).withColumn("_out", F.explode(F.concat(copies, parts)))
    return restore(out.select(*[F.col("_out").alias(c) if c == "text" else F.length("_out").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]))
