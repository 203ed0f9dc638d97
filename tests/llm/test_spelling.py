import zlib
from collections import Counter

import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from changeloom.llm import spelling as S


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def variants(counts, ratio=10):
    out, form = {}, {}
    for w, n in counts.items():
        near = [v for v in counts if one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
        out[w] = (n, len(near))
    result = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        result.append((w, form[w], root, *out[w], counts[form[w]] if form[w] else None))
    return sorted(result, key=repr)


def words_of(rows, min_chars=7, min_count=2, damage=31):
    n = Counter()
    for i, text in rows:
        for run in regex.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= min_chars and k >= min_count}


def grouped(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_words_of_texts(spark, make_docs):
    text = "Überaus straße naïveté STRASSENBAHN strassenbahn straßenbahnen, ÀÖØ÷×ÿabc Āabcdefghā short abc̀defghijk don't "
    rows = [(1, text), (2, text * 3), (3, None), (None, text), (4, ""), (5, text), (5, text), (6, "verylongrun" * 4000 + " " + "verylongrun" * 4000)]
    got = {r.word: r.n for r in S.corpus_words(make_docs([r for r in rows], extra=("word", "n"))).collect()}
    assert got == words_of(rows)


def test_whole_table_against_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()]
    words = words_of(rows, min_count=6)
    got = grouped(S.group_variants(S.corpus_words(small, min_count=6)))
    assert got == variants(words) and any(r[1] for r in got)


def test_blocks_of_large_groups(spark):
    words = {f"prefix{a}{b}ending": 1 + (a == "e") * 40 + (a == b) * 300 for a in "abcdefgh" for b in "abcdefghijk"} | {"prefixxending": 2, "prefixabending": 500}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    assert grouped(S.group_variants(frame, block=7)) == variants(words)


def test_chains_end_in_their_root(spark):
    words = {"aaaaaaaa" + "b" * k: 10**k for k in range(9)} | {"aaaaaaaa" + "c": 3, "zzzzzzzzz": 1}
    assert grouped(S.group_variants(spark.createDataFrame(list(words.items()), "word string, n long"))) == variants(words)


def test_no_words(spark, make_docs):
    assert grouped(S.group_variants(S.corpus_words(make_docs([(1, None), (2, "few")])))) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abß\U0001f600", min_size=1, max_size=6), min_size=2, max_size=25, unique=True))
def test_tiles_find_just_the_pairs_one_edit_apart(words):
    import numpy as np
    import pyarrow as pa

    keyed = []
    for w in words:
        for longer in (len(w), len(w) + 1):
            half = longer // 2
            keyed += [(longer, "prefix", w[:half], 0, 0, 0, w, 1), (longer, "suffix", w[len(w) - half :], 0, 0, 0, w, 1)]
    keyed.sort(key=lambda r: r[:5])
    kinds = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64()]
    batch = pa.RecordBatch.from_arrays([pa.array([r[c] for r in keyed], kinds[c]) for c in range(8)], list("abcdefgh"))
    got = [(r["word"], r["near"]) for b in S.near_in_order(iter([batch])) for r in b.to_pylist()]
    assert sorted(got) == sorted((a, b) for a in words for b in words if one_edit(a, b))
    assert len(np.unique(list(map(hash, got)))) == len(got)


def test_plan_stays_apart_by_group(spark):
    """Words travel to their halves by one shuffle, and no task is handed a whole table."""
    words = spark.createDataFrame([("abcdefgh", 3), ("abcdefgi", 4)], "word string, n long")
    plan = S.near_words(words)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(longer" in plan and "SinglePartition" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
