import random

import pytest

from changeloom.operators import contracts, review
from changeloom.plans import change_queries


@pytest.mark.parametrize("old_first", [True, False])
def test_strips_tell_what_one_table_tells(monkeypatch, old_first):
    rng, cases = random.Random(5), []
    for _ in range(200):
        a = [rng.choice("abcd") for _ in range(rng.randrange(40))]
        cases.append((a, [x for x in a if rng.random() < 0.7] + [rng.choice("abcd") for _ in range(rng.randrange(9))]))
    want = [review.longest_common(a, b, old_first) for a, b in cases]
    for cells, strips in ((1, 2), (40, 2), (90, 16)):
        monkeypatch.setattr(review, "TABLE_CELLS", cells)
        monkeypatch.setattr(review, "STRIPS", strips)
        assert [review.longest_common(a, b, old_first) for a, b in cases] == want


def test_block_diff_of_long_sides(spark):
    n = 8300  # a table of more than 67 million cells
    old, new = ["first", *(f"line {k}" for k in range(n)), "last"], ["other", *(f"line {k}" for k in range(n) if k != 4000), "last"]
    got = review.block_diff(spark.createDataFrame([(1, "\n".join(old), "\n".join(new))], "id int, before string, after string"), "before", "after", "id").orderBy("nth").collect()
    assert [(r.sign, r.line) for r in got if r.sign != " "] == [("+", "other"), ("-", "first"), ("-", "line 4000")]
    assert len(got) == n + 3 and got[-1].line == "last"


#: A function of 14 lines a part, of which only the last parameter changes.
LONG = """SELECT 'src/' || CAST(p_partkey AS varchar(12)) || '.ts' AS path, 'modified' AS status, '@@ -1,15 +1,15 @@' || chr(10) || ' export function job' || CAST(p_partkey AS varchar(12)) || '(' || repeat(chr(10) || '   a,', 12)
    || chr(10) || '-  last: ' || p_type || chr(10) || '+  final: ' || p_type || chr(10) || ' ) {' AS patch FROM {part}"""


@pytest.mark.parametrize("n", [10, 11, 160, 161, 700])
def test_signatures_and_blocks_are_read_to_their_ends(spark, n):
    sign = ["def wide(", *(f"    a{k}," for k in range(n - 2)), "):"]
    block = ["interface Shape {", *(f"  a{k}: x" for k in range(n - 2)), "}"]
    rest = ["open_call(", "    never closed"]
    patch = "\n".join(["@@ -1,9 +1,9 @@", *(f"-{x}" for x in [*sign, *block, "def last_one(", *rest]), "+def wide():"])
    rows = contracts.changed_contracts(spark.createDataFrame([("w.py", "modified", patch)], "path string, status string, patch string"), whole=True).collect()
    assert {r.name: r.before for r in rows} == {"wide": "\n".join(sign), "Shape": "\n".join(block), "last_one": "\n".join(["def last_one(", *rest])}


def test_patch_contracts_reads_whole_signatures(spark, monkeypatch):
    monkeypatch.setattr(change_queries, "PATCHES", LONG)
    rows = change_queries.patch_contracts(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200 and all(r.change == "changed" and "  last: " in r.before and "  final: " in r.after and r.after.endswith("\n)") for r in rows)


def test_contract_usages_follow_whole_signatures(spark, monkeypatch):
    monkeypatch.setattr(change_queries, "PATCHES", LONG)
    sf = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_suppkey", "l_partkey", "l_quantity").collect()
    edited = {(f"lib/{r.l_suppkey}.ts", r.l_orderkey) for r in lines if r.l_quantity > 45}
    parts = {r.p_partkey for r in spark.read.parquet(f"{sf}/part.parquet").select("p_partkey").collect()}
    calls = {(f"job{k}", f"lib/{r.l_suppkey}.ts", r.l_orderkey) for r in lines for k in (r.l_partkey, r.l_partkey + 1) if k in parts}
    got = {(r.name, r.path, r.line) for r in change_queries.contract_usages(spark, sf).collect()}
    assert got == {c for c in calls if c[1:] not in edited} and got
