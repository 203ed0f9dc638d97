import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from changeloom.llm import common, exact_dedup

FOLD = str.maketrans(exact_dedup.UPPER, exact_dedup.LOWER)


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(FOLD)].append(doc_id)
    return {(i, hashlib.sha256(t.encode()).hexdigest()): (max((x for x in ids if x is not None), default=None), len(ids)) for t, ids in groups.items() for i in ids}


ROWS = [(1, "Abc"), (2, "aBC"), (3, "abc "), (4, None), (5, ""), (6, "É"), (7, "é"), (8, "x" * 200_000), (9, "X" * 200_000), (9, "X" * 200_000), (None, "abc"), (None, "only"), (-3, "neg"), (-2, "NEG")]


@pytest.mark.parametrize("options", [{}, {"digest_bytes": 1, "memtable_rows": 2}])
def test_against_brute_force(make_docs, options):
    found = exact_dedup.find_copies(make_docs(ROWS, ("digest", "tag", "row_key", "n")), **options).collect()
    assert len(found) == len(ROWS)
    want = brute(ROWS)
    for r in found:
        assert want[r.doc_id, r.text_sha256] == (r.keep_id, r.group_size)
    kept = [r for r in found if r.kept]
    assert len(kept) == len({r.text_sha256 for r in found}) and all(r.doc_id == r.keep_id for r in kept)


def test_first_can_stay(make_docs):
    found = exact_dedup.find_copies(make_docs(ROWS), keep="first").where("kept").collect()
    assert {1, 4, 8, -3} <= {r.doc_id for r in found}


def test_short_digests_keep_texts_apart(small):
    rows = [(r.doc_id, r.text) for r in small.collect()]
    want = brute(rows)
    found = exact_dedup.find_copies(small, digest_bytes=1, memtable_rows=20).collect()
    assert len(found) == len(rows) and all(want[r.doc_id, r.text_sha256] == (r.keep_id, r.group_size) for r in found)


def test_drop_keeps_columns_and_one_row_of_each_text(make_docs):
    docs = make_docs(ROWS, ("_key", "kept"))
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns and out.where("_key = 'x' AND kept = 'x'").count() == len(brute(ROWS).keys() and {(t or "").translate(FOLD) for _, t in ROWS})
    assert exact_dedup.drop_copies(make_docs([])).count() == 0
    assert exact_dedup.find_copies(make_docs([])).count() == 0


def test_levels_compact(spark, make_docs):
    index, known = exact_dedup.MergeIndex(memtable_rows=3, fan_in=2), []
    for part in range(5):
        rows = [(10 * part + i, f"text {i + part}") for i in range(7)]
        log = make_docs(rows).select(F.col("doc_id").alias("tag"), F.col("doc_id").alias("ident"), F.unhex(F.md5("text")).alias("digest"))
        known.append(index.insert(log).count())
    assert known == [0, 6, 6, 6, 6]  # the text that each batch has beside those of the one before
    assert len(index.levels[0]) == 1 and sum(map(len, index.levels)) < 5
    want = {}
    for i, text in ((10 * part + i, i + part) for part in range(5) for i in range(7)):
        want[text] = (min(i, want.get(text, (i, 0))[0]), want.get(text, (i, 0))[1] + 1)
    assert sorted((r.ident, r.n) for r in index.entries().collect()) == sorted(want.values())
    index.compact()
    assert sum(map(len, index.levels)) == 1 and index.entries().count() == 11
    probe = make_docs([(1, "text 3"), (2, "text 99")]).select("doc_id", F.unhex(F.md5("text")).alias("digest"))
    assert [r.doc_id for r in index.lookup(probe).collect()] == [1]


def test_filters_pass_what_a_run_holds_and_little_else(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FILTER_DIGESTS", 2000)
    key = lambda low, high: spark.range(low, high).select(F.col("id").alias("tag"), F.col("id").alias("ident"), F.unhex(F.md5(F.col("id").cast("string"))).alias("digest"))
    index = exact_dedup.MergeIndex()
    index.insert(key(0, 20_000))
    (run,) = index.runs
    assert run.buckets == 10
    assert run.may_hold(key(0, 20_000)).count() == 20_000
    assert run.may_hold(key(20_000, 40_000)).count() < 200
    for most in (0, 2048):  # joined by a shuffle, and broadcast
        monkeypatch.setattr(exact_dedup, "BROADCAST_BUCKETS", most)
        assert index.lookup(key(19_990, 20_010)).count() == 10


def test_shuffled_joins_agree_with_broadcast_ones(small, monkeypatch):
    rows = lambda: sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.find_copies(small).collect())
    want = rows()
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(exact_dedup, "BROADCAST_BUCKETS", 0)
    assert rows() == want


@pytest.mark.parametrize("most", [200_000, 0])
def test_one_row_of_each_text_by_either_join(make_docs, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_KEYS", most)
    out = exact_dedup.drop_copies(make_docs(ROWS))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == sorted((i is None, i or 0) for i in [2, 3, 5, 6, 7, 9, None, -2])


def test_rows_that_share_half_of_their_key(make_docs, monkeypatch):
    """All rows collide in one 64-bit hash: no document is lost or swapped."""
    half = common.half_key
    monkeypatch.setattr(common, "half_key", lambda seed: F.lit(7).cast("long") if seed == 1 else half(seed))
    docs = make_docs(ROWS)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in exact_dedup.drop_copies(docs).collect()) == sorted((i is None, i or 0) for i in [2, 3, 5, 6, 7, 9, None, -2])
    found = exact_dedup.find_copies(docs, digest_bytes=1).collect()
    assert len(found) == len(ROWS) and all(brute(ROWS)[r.doc_id, r.text_sha256] == (r.keep_id, r.group_size) for r in found)
