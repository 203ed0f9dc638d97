import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from changeloom.llm import mixing

WORD = re.compile(mixing.WORD)


def reshared(sizes, weights=(5, 2, 1), cap=3):
    """Targets by resharing the excess until none is above: {source: target}."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, full = sum(sizes.values()), {}, set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        share = sum(weight[s] for s in order if s not in full)
        target = {s: cap * sizes[s] if s in full else rest * weight[s] / share for s in order}
        more = {s for s in order if s not in full and target[s] > cap * sizes[s]}
        if not more:
            return target
        full |= more


def check(docs, mix, tolerance):
    rows = docs.collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    want = reshared(sizes)
    found = mix.documents.collect()
    assert len(found) == len(rows) and Counter(r.doc_id for r in found) == Counter(r.doc_id for r in rows)
    taken = Counter()
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= tolerance, (s, taken[s], t)
    return found


def test_targets_and_taken_words(small):
    mix = mixing.mix_sources(small, block_words=32)
    check(small, mix, 34)


def test_blocks_and_shards(small):
    mix = mixing.mix_sources(small, block_words=16, slots_per_shard=64)
    sources = {r["rank"]: r for r in mix.sources.collect()}
    slots = mix.slots.collect()
    used = Counter((r["rank"], r.epoch, r.block) for r in slots)
    assert max(used.values()) == 1  # a permutation: no block twice in an epoch
    for rank, s in sources.items():
        for epoch in range(s.epochs):
            assert {b for r, e, b in used if (r, e) == (rank, epoch)} == set(range(s.blocks))
    shards = Counter(r.shard for r in slots)
    assert len(shards) == -(-len(slots) // 64) and min(shards.values()) > 25
    spread = Counter((r.shard, r["rank"]) for r in slots)
    assert spread == {(r.shard, r["rank"]): r.n for r in mix.counts.collect()}  # the slots are those that the draw names
    for rank, s in sources.items():
        assert sum(n for (_, r), n in spread.items() if r == rank) == s.n_slots


@pytest.mark.parametrize(("shards", "n"), [(7, 3000), (64, 200), (5, 200_000)])
def test_counts_by_shard_are_multinomial(spark, shards, n):
    """400 sources drawn alike: mean, variance and sum of the counts of each shard, for few slots and for many."""
    quotas = spark.range(400).select(F.col("id").alias("rank"), F.lit(n).cast("long").alias("n_slots"))
    table = defaultdict(dict)
    for r in mixing.shard_counts(quotas, shards, 2, 7).collect():
        table[r["rank"]][r.shard] = (r.first_slot, r.n)
    assert len(table) == 400
    for row in table.values():
        runs = [row[s] for s in sorted(row)]
        assert sum(c for _, c in runs) == n and [a for a, _ in runs] == [sum(c for _, c in runs[:i]) for i in range(len(runs))]
    p = 1 / shards
    for s in range(shards):
        counts = [row.get(s, (0, 0))[1] for row in table.values()]
        mean = sum(counts) / 400
        variance = sum((c - mean) ** 2 for c in counts) / 399
        assert abs(mean - n * p) < 5 * (n * p * (1 - p) / 400) ** 0.5 and 0.6 < variance / (n * p * (1 - p)) < 1.5


def test_the_draw_is_the_count_of_the_bits_of_its_hashes(spark):
    """Beyond one run of hashes as well: the left half's count, from the hashes one by one."""
    for n in (1, 63, 64, 65, 1000, 64 * 65536 + 77):
        quota = spark.createDataFrame([(5, n)], "rank long, n_slots long")
        left = {r.shard: r.n for r in mixing.shard_counts(quota, 2, 1, 9).collect()}.get(0, 0)
        w = spark.range(n // 64 + 1).select(F.xxhash64(F.lit(9), F.lit(5).cast("long"), F.lit(0).cast("long"), F.lit(2).cast("long"), F.lit(1), "id").alias("h"), "id")
        assert left == sum((r.h & ((1 << (64 if r.id < n // 64 else n % 64)) - 1)).bit_count() for r in w.collect())


def test_repeats_over_sources_stay_in_their_source(make_docs):
    """Rows that share id and text over a capped and an uncapped source: each source's words are those taken of it."""
    rng = random.Random(4)
    text = lambda k: " ".join(rng.choice("abcdefgh") * 3 for _ in range(k))
    shared = [(i, text(400)) for i in range(8)]
    rows = [(i, t, "en", s, len(t)) for s in ("a", "b", None) for i, t in shared] + [(100 + i, text(400), "en", "b", 1) for i in range(44)]
    rows += [(0, shared[0][1], "en", "a", 1)] * 2
    docs = make_docs(rows)
    taken, got = Counter(), Counter()
    for r in mixing.mix_sources(docs, block_words=64).documents.collect():
        taken[r.source] += r.taken
    for r in mixing.mixed_documents(docs, block_words=64).collect():
        got[r.source] += len(r.text.split())
    assert got == taken and len(taken) == 3


def test_taken_against_plain_python(small):
    """Streams, blocks and slots in plain Python, from the sources' quotas, the draw and where documents lie."""
    size = 16
    mix = mixing.mix_sources(small, block_words=size, slots_per_shard=64)
    sources, placed = {r["rank"]: r for r in mix.sources.collect()}, mix.placed.collect()
    streams = defaultdict(dict)
    for r in placed:
        for w in range(r.size):
            assert streams[r["rank"]].setdefault(r.offset + w, r.tag) == r.tag  # documents do not overlap
    assert {k: len(v) for k, v in streams.items()} == {k: s.source_size for k, s in sources.items() if s.source_size}
    taken, first = Counter(), {}
    for slot in mix.slots.collect():
        words = [streams[slot["rank"]][x] for x in range(slot.block * size, slot.block * size + slot.fill) if x in streams[slot["rank"]]]
        taken.update(words)
        for tag in words:
            first[tag] = min(slot.shard, first.get(tag, slot.shard))
    found = {r.tag: r for r in mix.documents.collect()}
    assert {t: r.taken for t, r in found.items() if r.taken} == taken and {t: r.first_shard for t, r in found.items() if r.taken} == first
    assert len(set(first.values())) > 5 and "shard" in mix.documents._jdf.queryExecution().optimizedPlan().toString()


def test_permutation_is_one(spark):
    df = spark.range(1000).select(F.col("id").alias("i"), F.lit(1000).cast("long").alias("n"))
    out = [r.i for r in mixing.permuted(df, "i", "n", [F.lit(1)], 12).orderBy("i").collect()]
    assert out == list(range(1000))
    moved = [r.i for r in mixing.permuted(df, "i", "n", [F.lit(2)], 12).collect()]
    assert sum(a == b for a, b in enumerate(moved)) < 20


def test_reruns_agree(small):
    key = lambda m: sorted((r.doc_id, r.taken) for r in m.documents.collect())
    assert key(mixing.mix_sources(small)) == key(mixing.mix_sources(small.repartition(7)))


ODD = [
    (1, "a b c d e f g h", "en", "b", 1), (2, None, "en", "b", None), (3, "", "en", None, 0), (4, "x y", "en", None, 3), (4, "x y", "en", None, 3), (None, "n u l l", "en", "é", 7),
    (5, "\u00a0 \x1f word\x0bword\x0cword", "en", "Z", 9), (6, "w " * 50_000, "en", "big", 100_000), (7, "  \n ", "en", "blank", 4),
]


def test_odd_rows(make_docs):
    docs = make_docs(ODD, ("size", "rank", "taken"))
    found = check(docs, mixing.mix_sources(docs), 128)
    assert {r.doc_id: r.size for r in found if r.doc_id in (1, 2, 3, 5, 6, 7)} == {1: 8, 2: 0, 3: 0, 5: 5, 6: 50_000, 7: 0}
    assert mixing.mix_sources(make_docs([])).documents.count() == 0
    only_empty = mixing.mix_sources(make_docs([(1, None), (2, "")])).documents.collect()
    assert [(r.size, r.target, r.taken) for r in only_empty] == [(0, 0.0, 0)] * 2


def test_mixture_is_what_was_taken(small):
    docs = small.withColumn("_words", F.lit("mine"))
    taken = {r.doc_id: r.taken for r in mixing.mix_sources(docs, block_words=32).documents.collect()}
    out = mixing.mixed_documents(docs, block_words=32)
    assert out.columns == docs.columns
    texts, words, broken = {r.doc_id: r.text for r in docs.collect()}, Counter(), 0
    for r in out.collect():
        assert r.n_chars == len(r.text) and r._words == "mine"
        got = WORD.findall(r.text)
        words[r.doc_id] += len(got)
        assert r.text == texts[r.doc_id] or set(got) <= set(WORD.findall(texts[r.doc_id]))
        broken += r.text != texts[r.doc_id] and "\n" in r.text
    assert words == Counter({i: n for i, n in taken.items() if n})
    assert broken > 0  # partly taken texts keep their lines
    odd = mixing.mixed_documents(mixing_docs := docs.limit(0))
    assert odd.count() == 0 and odd.columns == mixing_docs.columns


def test_plans_are_native(make_docs):
    mix = mixing.mix_sources(make_docs(ODD))
    for df in (mix.documents, mix.slots, mix.counts, mix.sources, mixing.mixed_documents(make_docs(ODD))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
