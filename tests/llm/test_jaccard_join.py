import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from changeloom.llm import jaccard_join as J


def brute(rows, threshold=0.8):
    sketcher = J.Sketcher()
    sets = [set(sketcher.shingles(t).tolist()) for _, t in rows]
    holders, common = defaultdict(list), Counter()
    for i, s in enumerate(sets):
        for v in s:
            holders[v].append(i)
    for ids in holders.values():
        common.update((a, b) for a in ids for b in ids if a < b)
    links = [(a, b) for (a, b), n in common.items() if n >= threshold * (len(sets[a]) + len(sets[b]) - n) - 1e-9]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    degree = Counter()
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(i)
    out = {}
    for ids in members.values():
        least = min((rows[i][0] for i in ids if rows[i][0] is not None), default=None)
        for i in ids:
            out[i] = (least if len(ids) > 1 or rows[i][0] is None else rows[i][0], len(ids), degree[i])
    return out


def near_copies(n, words=120, edits=6, seed=0):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("options", [{}, {"block_sets": 7, "block_shingles": 600}])
def test_against_brute_force(make_docs, options):
    texts = near_copies(40) + near_copies(25, words=60, edits=3, seed=2) + [f"alone {i} " + " ".join(f"q{i}x{k}" for k in range(30)) for i in range(10)]
    rows = list(enumerate(texts)) + [(1000 + i, texts[i % 5].upper() + "!") for i in range(12)]
    want = brute(rows)
    found = {r.doc_id: (r.class_id, r.class_size, r.n_links) for r in J.jaccard_join(make_docs(rows, ("tag", "label", "cell")), **options).collect()}
    assert found == {rows[i][0]: w for i, w in want.items()}


def test_blocks_without_sets(make_docs):
    rows = list(enumerate(t for seed in range(6) for t in near_copies(2 + seed % 2, edits=3, seed=20 + seed)))
    want = brute(rows)
    out = J.jaccard_join(make_docs(rows), block_shingles=25).collect()
    assert {r.doc_id: (r.class_id, r.class_size, r.n_links) for r in out} == {rows[i][0]: w for i, w in want.items()}
    assert {r.doc_id: r.n_text_links for r in out} == {rows[i][0]: w[2] for i, w in want.items()} and max(w[2] for w in want.values()) > 0


def test_on_the_tables(small):
    rows = [(r.doc_id, r.text) for r in small.collect()]
    want = brute(rows)
    found = {r.doc_id: (r.class_id, r.class_size, r.n_links) for r in J.jaccard_join(small).collect()}
    assert found == {rows[i][0]: w for i, w in want.items()}


def test_odd_rows(make_docs):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, "?!"), (3, "?!"), (4, "one two"), (5, "One, two!"), (None, "one two"), (6, long), (7, long + " more"), (8, "a b c d e"), (8, "a b c d e")]
    docs = make_docs(rows, ("_key", "_n"))
    out = J.jaccard_join(docs).collect()
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append((r.class_id, r.class_size, r.n_links))
    assert by[1] == [(1, 1, 0)] and by[2] == [(2, 1, 0)] and by[3] == [(3, 1, 0)] * 2
    assert by[4] == by[5] == by[None] == [(4, 3, 2)] and by[6] == by[7] == [(6, 2, 1)] and by[8] == [(8, 2, 1)] * 2
    kept = J.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 3, 4, 6, 8]
    assert J.jaccard_join(make_docs([])).count() == 0


def test_no_links_at_all(make_docs):
    out = J.jaccard_join(make_docs([(i, f"p{i} q{i} r{i} s{i} t{i} u{i}") for i in range(5)])).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links, r.kept) for r in out) == [(i, i, 0, True) for i in range(5)]


def test_posterior_bound():
    for n in (32, 64, 96):
        least = J.least_matches(n, 0.8, 1e-5)
        draws = np.random.default_rng(0).beta(least, n - least + 2, 400_000)  # one match fewer
        assert (draws >= 0.8).mean() < 2e-4
        assert 0.4 * n < least < 0.8 * n


def test_minhash_estimates_similarity():
    sketcher = J.Sketcher(bands=64, rows=8)
    rng = np.random.default_rng(3)
    common, a, b = (rng.integers(0, 1 << 63, k).astype(np.uint64) for k in (800, 100, 100))
    same = sketcher.signature(np.concatenate([common, a])) == sketcher.signature(np.concatenate([common, b]))
    assert abs(same.mean() - 0.8) < 0.07


def test_sparse_and_dense_verification_agree(monkeypatch):
    texts = near_copies(60, words=80, edits=8, seed=4)
    verifier = J.Verifier({}, 0.8, 1e-5)
    sets = [verifier.sketcher.shingles(t) for t in texts]
    pairs = set(zip(*map(list, verifier.links(sets, np.arange(60), None)), strict=True))
    monkeypatch.setattr(J.Verifier, "_bits", staticmethod(lambda sets: None))
    assert pairs == set(zip(*map(list, verifier.links(sets, np.arange(60), None)), strict=True)) and len(pairs) > 20


def test_components():
    assert J.components(6, np.array([4, 3, 1]), np.array([3, 2, 0])).tolist() == [0, 0, 2, 2, 2, 5]
