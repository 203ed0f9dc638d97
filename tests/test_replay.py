import random

import pytest

from changeloom.operators import replay

SCHEMA = "database string, ord int, seq int, op string, table string, column string, to string, type string, nullable boolean"
SF = "/root/testdata/sf0.001"


def fold(ops):
    """One operation after the other: ([status], {database: {table: {column: (type, nullable)}}}) in the order of the operations."""
    state, told = {}, []
    order = sorted((o for o in ops if o[3] in replay.TABLE_OPS + replay.COLUMN_OPS), key=lambda o: [(x is not None, x) for x in (o[1], o[2], o[3], o[4], o[5], o[6])])
    for database, _, _, op, table, column, to, kind, nullable in order:
        tables = state.setdefault(database, {})
        of_table = op in replay.TABLE_OPS
        names, name = (tables, table) if of_table else (tables.get(table), column)
        if table is None or names is None or name is None or op in replay.MOVES and to is None:
            status = "conflict"
        elif op in replay.MAKES:
            status = "reflected" if name in names else "clean"
            names.setdefault(name, {} if of_table else [kind, nullable])
        elif op in replay.ENDS:
            status = "clean" if name in names else "reflected"
            names.pop(name, None)
        elif op in replay.MOVES:
            status = "clean" if name in names else "reflected" if to in names else "conflict"
            if name in names:
                names[to] = names.pop(name)
        elif name not in names:
            status = "conflict"
        else:
            status = "clean"
            names[name][op == "set_not_null"] = False if op == "set_not_null" else kind
        told.append((database, op, table, column, to, status))
    return told, state


def check(spark, ops):
    told, state = fold(ops)
    df = spark.createDataFrame([(*o, "x", 1) for o in ops], SCHEMA + ", status string, pos int")
    key = lambda r: tuple((x is not None, x) for x in r)
    got = sorted(((r.database, r.op, r.table, r.column, r.to, r.status) for r in replay.checked(df).collect()), key=key)
    assert got == sorted(told, key=key)
    want = [(d, t, c, kind, nullable, sum(x[0] == d and x[5] != "clean" for x in told)) for d, tables in state.items() for t, columns in tables.items() for c, (kind, nullable) in columns.items()]
    assert sorted((tuple(r) for r in replay.replay(df).collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("seed", range(3))
def test_against_one_after_the_other(spark, seed):
    rng = random.Random(seed)
    kinds = [*replay.TABLE_OPS, *["create_table", "rename_table", "add_column", "add_column"], *replay.COLUMN_OPS]
    ops = [(rng.choice(["d", "e", None]), rng.randrange(60), rng.randrange(4), rng.choice(kinds), rng.choice("tuvw"), rng.choice("abcd"), rng.choice("tuvw" if rng.random() < 0.5 else "abcd"), rng.choice(["int", "text", None]), rng.choice([True, False, None])) for _ in range(500)]
    check(spark, ops)


def test_chains_of_renames(spark):
    names = [f"n{k}" for k in range(9)]
    ops = [("d", 0, 0, "create_table", "n0", None, None, None, None), ("d", 0, 1, "add_column", "n0", "c0", None, "int", True)]
    ops += [("d", k + 1, 0, "rename_table", names[k], None, names[k + 1], None, None) for k in range(8)]
    ops += [("d", k + 1, 1, "rename_column", names[k + 1], f"c{k}", f"c{k + 1}", None, None) for k in range(8)]
    ops += [("d", 5, 2, "rename_table", "n8", None, "n1", None, None), ("d", 20, 0, "alter_type", "n8", "c8", None, "bigint", None), ("d", 21, 0, "set_not_null", "n8", "c8", None, None, None)]
    check(spark, ops)
    assert [tuple(r) for r in replay.replay(spark.createDataFrame(ops, SCHEMA)).collect()] == [("d", "n8", "c8", "bigint", False, 1)]


def test_nulls_repeats_and_no_rows(spark):
    ops = [("d", 1, 1, op, t, c, to, None, None) for op in (*replay.TABLE_OPS, *replay.COLUMN_OPS, "other", None) for t, c, to in ((None, "a", "b"), ("t", None, "u"), ("t", "a", None), ("t", "a", "t"), ("t", "a", "a"))]
    check(spark, ops + [(None, None, None, "create_table", "t", None, None, None, None)] * 2 + [(None, 1, 1, "add_column", "t", "a", None, None, None)])
    check(spark, [])


def test_whole_table(spark):
    from changeloom.plans.snapshot_queries import part_history

    ops = [tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in part_history(spark, SF).collect()]
    assert len(ops) > 150
    check(spark, ops)


def test_positions_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(replay, "BROADCAST_LIVES", 0)
    rows = [("d", 1, i, op, "t", f"c{i % 5}", f"r{i % 5}", "int", True) for i, op in enumerate(["create_table", *["add_column", "rename_column", "drop_column", "alter_type"] * 6])]
    told = replay.checked(spark.createDataFrame(rows, "database string, ord int, seq int, op string, table string, column string, to string, type string, nullable boolean"))
    assert "BroadcastHashJoin" not in told._jdf.queryExecution().executedPlan().toString() and told.count() == len(rows)
