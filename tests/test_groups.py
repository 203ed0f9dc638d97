import math
import random
import re
from collections import Counter, defaultdict

import pytest

from changeloom.operators import groups


def sums(groups_, links):
    n, w = Counter(), Counter()
    for scope, i, k in groups_:
        if i is not None and scope is not None:
            n[scope, i] += k
    for scope, a, b, k in links:
        if a != b and (scope, a) in n and (scope, b) in n:
            w[scope, min(a, b), max(a, b)] += k
    return n, w


def one_round(n, w, moving, fallback):
    to = {}
    for scope, i in moving:
        near = [(-k, a, b) for (s, a, b), k in w.items() if s == scope and i in (a, b)]
        if near:
            _, a, b = min(near)
            to[scope, i] = b if i == a else a
        elif fallback and fallback[scope] != i:
            to[scope, i] = fallback[scope]
    steps = {k: v for k, v in to.items() if not (to.get((k[0], v)) == k[1] and k[1] < v)}

    def root(scope, i):
        while (scope, i) in steps:
            i = steps[scope, i]
        return i

    roots = {k: root(*k) for k in n}
    merged, links = Counter(), Counter()
    for (scope, i), k in n.items():
        merged[scope, roots[scope, i]] += k
    for (scope, a, b), k in w.items():
        a, b = roots[scope, a], roots[scope, b]
        if a != b:
            links[scope, min(a, b), max(a, b)] += k
    return roots, merged, links


def plain(rows, links, least=None, most=None):
    n, w = sums(rows, links)
    told = {k: k[1] for k in n}
    while True:
        fallback = {}
        if least is not None:
            moving = [k for k, size in n.items() if size < least and any(s == k[0] and k[1] in (a, b) for s, a, b in w)]
        else:
            moving = []
            for scope in {s for s, _ in n}:
                mine = sorted((size, i) for (s, i), size in n.items() if s == scope)
                fallback[scope] = min((-size, i) for size, i in mine)[1]
                moving += [(scope, i) for _, i in mine[: min(max(0, len(mine) - most), math.ceil(len(mine) / 2))]]
        if not moving:
            return sorted((s, i, r) for (s, i), r in told.items())
        roots, n, w = one_round(n, w, moving, fallback)
        told = {k: roots[k[0], r] for k, r in told.items()}


def made(spark, rows, links):
    return spark.createDataFrame(rows, "scope string, id string, n long"), spark.createDataFrame(links, "scope string, a string, b string, w long")


def drawn(seed, n=60):
    rng = random.Random(seed)
    rows = [(rng.choice("xy"), f"g{rng.randrange(n)}", rng.randrange(1, 6)) for _ in range(n)] + [("z", "only", 1), ("w", None, 3), (None, "g", 2)]
    links = [(rng.choice("xyz"), f"g{rng.randrange(n)}", f"g{rng.randrange(n)}", rng.randrange(1, 3)) for _ in range(n)]
    return rows, links


@pytest.mark.parametrize("seed", range(2))
def test_agglomerate_against_plain_python(spark, seed):
    rows, links = drawn(seed)
    got = sorted(tuple(r) for r in groups.agglomerate(*made(spark, rows, links), 4).collect())
    assert got == plain(rows, links, least=4)
    n, w = sums(rows, links)
    roots, sizes = {(s, i): r for s, i, r in got}, Counter()
    for (s, i), k in n.items():
        sizes[s, roots[s, i]] += k
    assert not [x for s, a, b in w if (x := roots[s, a]) != roots[s, b] and min(sizes[s, x], sizes[s, roots[s, b]]) < 4]
    assert groups.agglomerate(*made(spark, [], []), 4).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_contract_against_plain_python(spark, seed):
    rows, links = drawn(seed)
    got = sorted(tuple(r) for r in groups.contract(*made(spark, rows, links), 7).collect())
    assert got == plain(rows, links, most=7)
    for scope in "xy":
        assert len({r for s, _, r in got if s == scope}) == 7
    assert groups.contract(*made(spark, [], links), 3).count() == 0


STEM = [("src/graph/PrMapNode.tsx", "graph", "pr map"), ("a/usePrMap.ts", "", "pr map"), ("pr-map-types.ts", "", "pr map"), ("GraphCanvas.tsx", "graph", "graph canvas"), ("checklists.test.ts", "", "checklist"), ("test_review.py", "", "review"), ("42.ts", "", "")]


def test_name_stems(spark):
    from pyspark.sql import functions as F

    from changeloom.functions.text import name_stem

    out = spark.createDataFrame(STEM, "path string, word string, want string").select(name_stem(F.col("path"), F.col("word")).alias("got"), "want").collect()
    assert [r.got for r in out] == [r.want for r in out]


def stem(path, word):
    """name_stem for the plain names of this test: words joined by capitals."""
    name = path.rsplit("/", 1)[-1].split(".")[0]
    words = [w.lower() for w in re.findall(r"[A-Z][a-z]*|[a-z]+", name)]
    return " ".join(words[:2] if len(words[0]) <= 3 or words[0] == word else words[:1])


def test_split_against_plain_python(spark):
    rng = random.Random(5)
    words = ["Pr", "Map", "Review", "Graph", "Table", "Check", "Note", "Cell", "Board", "Panel"]
    files = [("src/graph", f"src/graph/{a}{b}{c}.ts") for a in words for b in words for c in ("One", "Two") if rng.random() < 0.35] + [("src/graph", "src/graph/index.ts"), ("lib", "lib/a.ts"), ("lib", "lib/b.ts")]
    names = [f for _, f in files]
    imports = [(rng.choice(names), rng.choice(names)) for _ in range(160)] + [(f, names[0]) for f in names[1:40]] + [(names[3], names[3])] + [(None, names[0])]
    mine = [f for m, f in files if m == "src/graph"]
    edges = {(a, b) for a, b in imports if a != b and a in mine and b in mine}
    out, into = Counter(a for a, _ in edges), Counter(b for _, b in edges)
    bound = max(6, math.ceil(len(mine) * 0.25))
    free = {f: stem(f, "graph") for f in mine if not f.endswith("index.ts") and out[f] < bound and into[f] < bound}
    rows = [("m", k, n) for k, n in Counter(free.values()).items()]
    roots = {i: r for _, i, r in plain(rows, [("m", free[a], free[b], 1) for a, b in edges if a in free and b in free], least=3)}
    sizes = Counter(roots[s] for s in free.values())
    want = [(m, f, roots[free[f]] if f in free and sizes[roots[free[f]]] >= 3 else None) for m, f in files]
    got = groups.split_large(spark.createDataFrame(files + files[:3] + [("src/graph", None)], "module string, path string"), spark.createDataFrame(imports + imports[:9], "src string, dst string"))
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    parts = defaultdict(set)
    for _, f, p in want:
        parts[p].add(f)
    assert len(parts) > 3 and names[0] in parts[None]


def test_whole_tables_against_plain_python(spark):
    from changeloom.plans import change_queries as Q
    from changeloom.plans.registry import QUERIES, table
    from changeloom.plans.standins import edges

    sf = "/root/testdata/sf0.001"
    part = {r.p_partkey: (r.p_brand, f"{r.p_name} {r.p_type}") for r in table(spark, sf, "part").collect()}
    links = [(part[e.src][0], part[e.src][1], part[e.dst][1], e.weight) for e in edges(spark, sf).collect() if e.src in part and e.dst in part and part[e.src][0] == part[e.dst][0]]
    got = sorted(tuple(r) for r in QUERIES["feature_groups"](spark, sf).collect())
    assert got == plain([(b, n, 1) for b, n in part.values()], links, most=16)
    split = QUERIES["split_modules"](spark, sf).collect()
    assert sorted(r.path for r in split) == sorted(r.path for r in Q.named_parts(spark, sf).collect())
