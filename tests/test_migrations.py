import random

from pyspark.sql import functions as F

from changeloom.operators import migrations
from test_replay import SCHEMA, fold

OPS = "folder string, file string, ord int, seq int, op string, table string, column string, to string, type string, nullable boolean"


def key(r):
    return tuple((x is not None, x) for x in r)


def renamed(ops):
    """The renames of operations, one after the other: [(database, kind, table, from, to)]."""
    done, current = [], {}
    order = sorted(ops, key=lambda o: key(o[1:7]))
    for n, (database, ord_, _, op, table, column, to, *_) in enumerate(order):
        if op == "create_table" and table is not None:
            current[database, table] = [table, table, {}, []]
        elif op == "rename_table" and table is not None and to is not None and table != to:
            if any(o[0] == database and o[1] == ord_ and o[3] == "create_table" and o[4] == table for o in order[:n]):
                continue
            thing = current.pop((database, table), None)
            if thing is None or not thing[3]:  # a new chain: made tables start over
                thing = [table, to, {}, []]
                done.append((database, thing))
            thing[1] = to
            thing[3].append(n)
            current[database, to] = thing
    return sorted(((d, "table", t[1], t[0], t[1]) for d, t in done if t[0] != t[1]), key=key)


def test_chains_of_tables_against_one_after_the_other(spark):
    rng = random.Random(2)
    ops = [(rng.choice(["d", None]), rng.randrange(40), rng.randrange(9), rng.choice(["create_table", "rename_table", "rename_table"]), rng.choice("abcdef"), None, rng.choice(["a", "b", "c", "d", "e", "f", None]), None, None) for _ in range(300)]
    ops = list({o[:3]: o for o in ops}.values())
    got = [tuple(r) for r in migrations.renames(spark.createDataFrame(ops, SCHEMA)).where("kind = 'table'").collect()]
    assert sorted(got, key=key) == renamed(ops)


def test_renames_by_hand(spark):
    o = lambda ord_, seq, op, table, column=None, to=None: ("d", ord_, seq, op, table, column, to, None, None)
    ops = [
        o(1, 0, "rename_column", "a", "x", "y"), o(2, 0, "rename_table", "a", None, "b"), o(3, 0, "rename_column", "b", "y", "z"), o(4, 0, "rename_table", "b", None, "c"), o(5, 0, "rename_column", "c", "p", "q"),
        o(6, 0, "create_table", "new_t"), o(6, 1, "drop_table", "t"), o(6, 2, "rename_table", "new_t", None, "t"), o(7, 0, "rename_column", "t", "k", "l"), o(8, 0, "rename_column", "t", "l", "k"), o(9, 0, "rename_table", "s", None, "s"), o(9, 1, "rename_column", None, "k", "l"),
    ]
    got = {tuple(r) for r in migrations.renames(spark.createDataFrame(ops, SCHEMA)).collect()}
    assert got == {("d", "table", "c", "a", "c"), ("d", "column", "c", "x", "z"), ("d", "column", "c", "p", "q")}
    assert migrations.renames(spark.createDataFrame([], SCHEMA)).count() == 0


def test_trials_and_matching_against_plain_python(spark):
    rng = random.Random(3)
    make = lambda folder, file, kinds, n: [(folder, file, rng.randrange(5), k, rng.choice(kinds), rng.choice("tu"), rng.choice("abc"), rng.choice("bcd"), "int", True) for k in range(n)]
    schemas = [r for f in ("x", "y") for s in ("s1", "s2", "s3") for r in [(f, s, -1, k, "create_table", t, None, None, None, None) for k, t in enumerate("tu")] + make(f, s, ["add_column"], rng.randrange(1, 5))]
    logs = [r for f in ("x", "y", "z") for s in ("l1", "l2", "l3", "l4") for r in make(f, s, ["add_column", "drop_column"], rng.randrange(1, 4))] + [("x", "l5", 0, 0, "drop_table", "zz", None, None, None, None), ("x", "l6", 0, 0, "add_column", None, "a", None, None, None)]
    logs += [("y", "same", *r[2:]) for r in schemas if r[:2] == ("y", "s2")]
    want = []
    for folder, s, log in sorted({(a[0], a[1], b[1]) for a in schemas for b in logs if a[0] == b[0] and a[5] == b[5] and a[5]}):
        mine = lambda rows, name, part: [("k", (part, r[2]), *r[3:]) for r in rows if r[:2] == (folder, name)]  # noqa: B023, E731
        told = [t[-1] for t in fold(mine(schemas, s, 0) + mine(logs, log, 1))[0]][len(mine(schemas, s, 0)) :]
        n = [told.count(x) for x in ("clean", "reflected", "conflict")]
        want.append((folder, s, log, *n, "applies" if not n[1] + n[2] else "included" if not n[0] + n[2] else "neither"))
    trials = migrations.tried(spark.createDataFrame(schemas, OPS), spark.createDataFrame(logs, OPS))
    assert sorted(tuple(r) for r in trials.collect()) == want and {r[-1] for r in want} == {"applies", "included", "neither"}
    left, taken = sorted(want, key=lambda r: (r[6] == "neither", r[5], r[4], -r[3], r[1], r[2])), []
    while left:
        taken.append(left[0])
        left = [r for r in left if r[0] != left[0][0] or r[1] != left[0][1] and r[2] != left[0][2]]
    assert sorted(tuple(r) for r in migrations.matched(trials).collect()) == sorted(taken)
    assert migrations.matched(trials.limit(0)).count() == 0


COLS = "database string, table string, column string, type string, nullable boolean"


def test_catalog_and_drift(spark):
    m = [("d", "t", "a", "int", None), ("d", "t", "b", None, True), ("d", "u", None, None, None), ("d", "t", "a", "int", None), ("d", None, "x", "int", True)]
    s = [("d", "t", "a", "text", False), ("d", "t", "c", "num", None), ("e", "k", "a", "int", True), ("d", "w", "z", "int", None)]
    o = [("d", "t", "b", "float", False), ("e", "k", "b", None, None), ("f", "q", "a", "int", True), ("e", "n", "a", "int", True), (None, "k", "a", "int", True)]
    df = lambda rows: spark.createDataFrame(rows, COLS)
    got = {tuple(r) for r in migrations.catalog(df(m), df(s), df(o)).collect()}
    assert got == {
        ("d", "t", "a", "migration", "int", "migration", False, "schema"), ("d", "t", "b", "migration", "float", "model", True, "migration"), ("d", "t", "c", "schema", "num", "schema", None, None), ("d", "w", "z", "schema", "int", "schema", None, None),
        ("e", "k", "a", "schema", "int", "schema", True, "schema"), ("e", "k", "b", "model", None, None, None, None), ("e", "n", "a", "model", "int", "model", True, "model"), ("f", "q", "a", "model", "int", "model", True, "model"), (None, "k", "a", "model", "int", "model", True, "model"),
    }
    assert {tuple(r) for r in migrations.drift(df(m), df(s), df(o)).collect()} == {
        ("d", "t", "c", "schema", "field-no-column"), ("d", "t", "b", "schema", "column-no-field"), ("d", "w", None, "schema", "model-no-table"), ("d", "t", "a", "model", "column-no-field"), ("d", "u", None, "model", "table-no-model"),
        ("e", "k", "b", "model", "field-no-column"), ("e", "k", "a", "model", "column-no-field"), ("e", "n", None, "model", "model-no-table"),
    }
    assert migrations.drift(df([]), df([]), df(o)).count() == 0 and migrations.catalog(df([]), df([]), df([])).count() == 0
    assert migrations.drift(df(m), df([]), df([])).select(F.count("*")).first()[0] == 0
