import random
import re

import pytest
from pyspark.sql import functions as F

from changeloom.operators import review
from changeloom.plans import change_queries
from changeloom.plans.standins import sql


def table_of(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
    return t


@pytest.mark.parametrize("old_first", [True, False])
def test_pairs_against_the_plain_table(spark, old_first):
    rng, cases = random.Random(1), []
    for _ in range(300):
        a = [rng.choice("abcd") for _ in range(rng.randrange(12))]
        cases.append((a, [x for x in a if rng.random() < 0.7] + [rng.choice("abcd") for _ in range(rng.randrange(4))]))
    got = spark.createDataFrame([*cases, (None, ["a"]), (["a"], None)], "a array<string>, b array<string>").select(review.lcs_pairs(F.col("a"), F.col("b"), old_first).alias("p")).collect()
    for (a, b), r in zip(cases, got):
        t, pairs = table_of(a, b), [(p.old, p.new) for p in r.p]
        want, i, j = [], 0, 0
        while i < len(a) and j < len(b):
            if a[i] == b[j]:
                want.append((i, j))
                i, j = i + 1, j + 1
            elif t[i + 1][j] > t[i][j + 1] or old_first and t[i + 1][j] == t[i][j + 1]:
                i += 1
            else:
                j += 1
        assert pairs == want and len(pairs) == t[0][0]
    assert got[-1].p is None and got[-2].p is None


def walked(before, after):
    a, b = ([] if x is None else x.split("\n") for x in (before, after))
    t, out, i, j = table_of([x.strip() for x in a], [x.strip() for x in b]), [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i].strip() == b[j].strip():
            out.append((" ", b[j]))
            i, j = i + 1, j + 1
        elif j < len(b) and (i == len(a) or t[i][j + 1] >= t[i + 1][j]):
            out.append(("+", b[j]))
            j += 1
        else:
            out.append(("-", a[i]))
            i += 1
    return out


def within_gaps(rows):
    """Of each gap between lines that stay the lines that come and those that go."""
    out, come, go = [], [], []
    for sign, line in [*rows, (" ", None)]:
        if sign == " ":
            out.append((come, go, line))
            come, go = [], []
        else:
            (come if sign == "+" else go).append(line)
    return out


def test_block_diffs_against_a_walk(spark):
    sf, rng = "/root/testdata/sf0.001", random.Random(2)
    blocks = [tuple(r) for r in sql(spark, sf, change_queries.BLOCKS, "part").select("id", "before", "after").collect()]
    text = lambda: "\n".join(rng.choice(["a", " a", "b", "", "c"]) for _ in range(rng.randrange(1, 8)))
    blocks += [(10_000 + k, text(), text()) for k in range(200)] + [(20_000, None, "x\ny"), (20_001, "x", None), (20_002, None, None), (20_003, "", "")]
    got = {}
    for r in review.block_diff(spark.createDataFrame(blocks, "id long, before string, after string"), "before", "after", "id").collect():
        got.setdefault(r.id, []).append((r.nth, r.sign, r.line))
    for i, before, after in blocks:
        mine = sorted(got.get(i, []))
        assert [n for n, _, _ in mine] == list(range(1, len(mine) + 1))
        assert within_gaps([(s, x) for _, s, x in mine]) == within_gaps(walked(before, after)), (before, after)


def test_word_ranges(spark):
    rng = random.Random(3)
    line = lambda: "".join(rng.choice(["foo", "bar", " ", "(", "é", ",", "x1"]) for _ in range(rng.randrange(8)))
    cases = [(line(), line()) for _ in range(900)] + [("a " * 500, "a " * 499), (None, "x"), ("same", "same"), ("", "x"), ("let x = 1;", "let y = 1;")]
    got = spark.createDataFrame(cases, "a string, b string").select(review.word_ranges(F.col("a"), F.col("b")).alias("m"), review.word_diff(F.col("a"), F.col("b")).alias("d")).collect()
    marked = 0
    for (a, b), r in zip(cases, got):
        x, y = (re.findall(r"\w+|\s+|[^\w\s]", s or "", re.ASCII) for s in (a, b))
        alike = max(len(x), len(y)) <= 400 and a is not None and b is not None and a != b
        if alike:
            keep = review.longest_common(x, y)
            alike = 2 * sum(len(x[i]) for i, _ in keep) / max(1, len(a) + len(b)) >= 0.4
        assert (r.m is not None) == alike == (r.d is not None)
        if alike:
            marked += 1
            cut = lambda text, spans: "".join(c for k, c in enumerate(text) if not any(s.start <= k < s.end for s in spans))
            assert cut(a, r.m.old) == cut(b, r.m.new) == "".join(p.text for p in r.d if p.kind == "same")
            assert "".join(p.text for p in r.d if p.kind != "new") == a and "".join(p.text for p in r.d if p.kind != "old") == b
            assert all(s.end < t.start for side in (r.m.old, r.m.new) for s, t in zip(side, side[1:]))
    assert marked > 50
    assert [(s.start, s.end) for s in got[-1].m.old] == [(4, 5)]
