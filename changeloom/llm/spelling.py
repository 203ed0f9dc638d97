"""Spelling variants: words that differ by one inserted, deleted or replaced code point, by dense tiling.

Two words whose longer one has L code points are one edit apart just if their common prefix and their common
suffix together reach L - 1. One of the two then holds at least (L - 1) / 2 code points, rounded up, so words
meet by L and that half: each word is an entry under its own length and the next, by its start and by its end.
Entries go to their half by one shuffle and are read in its order; runs of groups are laid as padded matrices
of code points, from the left and from the right, and compared tile by tile: the prefix lengths of all pairs of
a tile are one running `and` over the columns, the suffix lengths another. Groups of more than `block` words are
dealt to blocks by hash, and each pair of blocks is a group of its own, so no task holds more than two blocks.

A word's form is its most frequent neighbour if that is `ratio` times as frequent or more; its root is where
the forms end. Frequencies grow by `ratio` with every step, so chains are short and pointer jumping ends
after a number of rounds known beforehand.

Edge cases. Null and empty texts have no words; a null doc_id counts as an empty string in the hash. Repeated
rows count again. Ties between forms go to the smallest word in code-point order. No rows: no rows. Words without a
neighbour have n_near 0, no form and themselves as root. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm.common import stage

#: Letters of a run, after A-Z are lower-cased.
LETTERS = "[a-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Groups over this many words are compared as pairs of blocks of about this size.
BLOCK = 2048
#: Rows of a tile, and code points of its matrix, at most.
TILE, TILE_CELLS = 256, 1 << 20
#: Groups over BLOCK words up to this many are found by a broadcast (under 100 bytes each), more by a shuffle.
BROADCAST_GROUPS = 100_000
PAIRS = "word string, near string, near_n long"


def corpus_words(docs: DataFrame, min_chars: int = 7, min_count: int = 2, damage: int | None = 31) -> DataFrame:
    """word, n: the runs of letters of all texts with at least min_chars code points and min_count occurrences.

    damage: where it divides the crc32 of "<doc_id>:<run>", the run loses the code point crc32 mod length. Runs
    only get shorter by that, so shorter ones are never looked at.
    """
    run, h = F.col("run"), F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"{LETTERS}{{{min_chars},}}"), F.lit(0))
    out = docs.select("doc_id", F.explode(runs).alias("run"))
    if damage:
        at = (F.col("h") % F.length(run)).cast("int")
        hit = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
        out = out.withColumn("h", h).select(F.when(F.col("h") % damage == 0, hit).otherwise(run).alias("word")).where(F.length("word") >= min_chars)
    else:
        out = out.select(run.alias("word"))
    return out.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


#: The first and the last longer div 2 code points: all that a shared half surely has.
SIDES = {
    "prefix": lambda n: F.substring("word", F.lit(1), n),
    "suffix": lambda n: F.substring("word", F.length("word") - n + 1, n),
}


def entries(words: DataFrame, block: int) -> DataFrame:
    """longer, side, half, i, j, blk, word, n: each word under the four halves it can share; (i, j) is a pair of blocks."""
    size = F.length("word")
    options = [F.struct((size + more).cast("int").alias("longer"), F.lit(side).alias("side"), half(F.floor((size + more) / 2).cast("int")).alias("half")) for side, half in SIDES.items() for more in (0, 1)]
    flat = words.select("word", "n", F.explode(F.array(*options)).alias("k")).select("k.longer", "k.side", "k.half", "word", "n")
    key = ["longer", "side", "half"]
    large = stage(flat.groupBy(*key).count().where(F.col("count") > block).select(*key, F.ceil(F.col("count") / block).cast("int").alias("blocks")), "large-groups")
    few = large.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    dealt = flat.join(F.broadcast(large) if few else large, key, "left").withColumn("blk", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("word"), F.col("blocks"))).cast("int"))
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("o", other).select(*key, F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "blk", "word", "n")


def matrix(words: list[str], width: int, right: bool) -> np.ndarray:
    """Code points, padded with zeros before or after the word."""
    padded = "".join(w.rjust(width, "\0") if right else w.ljust(width, "\0") for w in words)
    out = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), width)
    return out.astype(np.uint8) if out.size and out.max() < 256 else out


def common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The length of the common start of each row of a with each row of b, at most `most`."""
    alive = np.ones((len(a), len(b)), bool)
    out = np.zeros((len(a), len(b)), np.int32)
    for t in range(a.shape[1]):
        alive &= a[:, t, None] == b[None, :, t]
        if not alive.any():
            break
        out += alive
    return np.minimum(out, most)


def tile_pairs(words: list[str], group: np.ndarray, blk: np.ndarray, cross: np.ndarray, longer: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (x, y), x < y, of the pairs one edit apart within each group; of crossing groups only pairs of different blocks.

    What shares both halves is reported under its prefix.
    """
    sizes = np.array([len(w) for w in words])
    width = int(sizes.max())
    left, right = matrix(words, width, False), matrix(words, width, True)[:, ::-1]
    step = max(2, min(TILE, TILE_CELLS // width))
    xs, ys = [], []
    ends = np.searchsorted(group, group, "right")  # groups are in order
    for a in range(0, len(words), step):
        ra = slice(a, min(a + step, len(words)))
        for b in range(a, int(ends[ra.stop - 1]), step):
            rb = slice(b, min(b + step, len(words)))
            la, lb = sizes[ra, None], sizes[None, rb]
            ok = (group[ra, None] == group[None, rb]) & (np.maximum(la, lb) == longer[ra, None]) & (~cross[ra, None] | (blk[ra, None] != blk[None, rb]))
            if a == b:
                ok &= np.tri(ok.shape[0], dtype=bool).T & ~np.eye(ok.shape[0], dtype=bool)
            if not ok.any():
                continue
            least = np.minimum(la, lb)
            prefix = common(left[ra], left[rb], least)
            ok &= ~(suffix[ra, None] & (prefix >= longer[ra, None] // 2))
            ok &= prefix + common(right[ra], right[rb], least) >= longer[ra, None] - 1
            x, y = np.nonzero(ok)
            xs.append(x + a), ys.append(y + b)
    return (np.concatenate(xs), np.concatenate(ys)) if xs else (np.zeros(0, int), np.zeros(0, int))


def near_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The near pairs of entries that come in the order of their groups, both ways."""
    held: list[tuple] = []

    def found(rows: list[tuple]) -> pa.RecordBatch:
        keys, group = [r[:5] for r in rows], np.zeros(len(rows), int)
        group[1:] = np.cumsum([x != y for x, y in zip(keys, keys[1:])])
        column = lambda f, kind: np.array([f(r) for r in rows], kind)
        x, y = tile_pairs([r[6] for r in rows], group, column(lambda r: r[5], int), column(lambda r: r[3] != r[4], bool), column(lambda r: r[0], int), column(lambda r: r[1] == "suffix", bool))
        one, two = np.concatenate([x, y]), np.concatenate([y, x])
        return pa.RecordBatch.from_arrays([pa.array([rows[i][6] for i in one], pa.string()), pa.array([rows[i][6] for i in two], pa.string()), pa.array([rows[i][7] for i in two], pa.int64())], ["word", "near", "near_n"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            # A group is never split; groups of much longer words start anew, so that little of a matrix is padding.
            if held and row[:5] != held[-1][:5] and (len(held) >= 4 * TILE or row[0] > 2 * held[0][0]):
                yield found(held)
                held = []
            held.append(row)
    if held:
        yield found(held)


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, near, near_n: all pairs of words (distinct; word, n) that are one edit apart, both ways."""
    key = ["longer", "side", "half", "i", "j"]
    dealt = entries(words, block).repartition(*key).sortWithinPartitions(*key).select(*key, "blk", "word", "n")
    return dealt.mapInArrow(near_in_order, PAIRS)


def roots(forms: DataFrame, ratio: int) -> DataFrame:
    """word, root of forms (word, form, form_n): where the forms end; after r rounds 2**r steps are taken at once."""
    known = stage(forms.select("word", F.col("form").alias("root")), "forms")
    top = forms.agg(F.max("form_n")).first()[0] or 0
    steps = next(k for k in range(64) if ratio**k > top)  # a chain of k forms ends in a frequency of ratio**k or more
    for _ in range(max(0, steps - 2).bit_length()):
        onward = known.select(F.col("word").alias("root"), F.col("root").alias("_onward"))
        known = stage(known.join(onward, "root", "left").select("word", F.coalesce("_onward", "root").alias("root")), "roots")
    return known


def group_variants(words: DataFrame, ratio: int = 10, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n)."""
    words = stage(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near")))
    near = near_words(words, block).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left").withColumn("m", -F.col("best.m"))
    sure = F.col("m") >= ratio * F.col("n")
    found = stage(joined.select("word", F.when(sure, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(sure, F.col("m")).alias("form_n")), "variants")
    ends = roots(found.where(F.col("form").isNotNull()), ratio)
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
