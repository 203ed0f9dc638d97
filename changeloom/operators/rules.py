"""Deterministic findings: rules over differences and facts. All of them are native expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.functions.kinds import type_narrowing
from changeloom.functions.paths import ancestors
from changeloom.operators.relational import keep_newest


def checklist(items: list[tuple[int, str, int | None]], facts: DataFrame) -> DataFrame:
    """items (item_id, kind, limit) on facts (target, is_pr, description, n_issues, n_files, n_lines, touched): a status each."""
    of_pr = lambda ok: F.when(~F.col("is_pr"), "not_applicable").when(ok, "pass").otherwise("fail")
    plain = lambda ok: F.when(ok, "pass").otherwise("fail")
    status = (
        F.when(F.col("kind") == "description", of_pr(F.length(F.trim(F.coalesce("description", F.lit("")))) >= F.coalesce("limit", F.lit(1))))
        .when(F.col("kind") == "linked-issue", of_pr(F.col("n_issues") > 0))
        .when(F.col("kind") == "max-files", plain(F.col("n_files") <= F.coalesce("limit", F.lit(30))))
        .when(F.col("kind") == "max-lines", plain(F.col("n_lines") <= F.coalesce("limit", F.lit(500))))
        .when(F.col("kind") == "protected-paths", F.when(F.col("touched").isNull(), "unknown").otherwise(plain(F.col("touched") == 0)))
        .otherwise("unknown")
    )
    rules = F.array(*[F.struct(F.lit(i).alias("item_id"), F.lit(kind).alias("kind"), F.lit(limit).cast("int").alias("limit")) for i, kind, limit in items])
    return facts.select("*", F.inline(rules)).withColumn("status", status)


def migration_findings(ops: DataFrame, indexes: DataFrame) -> DataFrame:
    """Schema operations (database, ord, op, table, column, to, type, old_type, nullable, default, concurrently, created_here,
    ref_table, columns) that can fail or lose data: database, ord, rule, table, column.

    Tables that the same migration made are left alone. indexes: database, table, columns, of the schema after it.
    """
    old, op = ~F.coalesce("created_here", F.lit(False)), F.col("op")
    rules = F.array_compact(
        F.array(
            F.when((op == "drop_table") & old, "drop-table"),
            F.when((op == "drop_column") & old, "drop-column"),
            F.when((op == "rename_table") & old, "rename-table"),
            F.when((op == "rename_column") & old, "rename-column"),
            F.when(op.isin("add_column", "set_not_null") & old & (F.col("nullable") == False) & F.col("default").isNull(), "not-null-no-default"),  # noqa: E712
            F.when((op == "alter_type") & old & type_narrowing(F.col("old_type"), F.col("type")).isNotNull(), "type-narrowing"),
            F.when((op == "create_index") & old & ~F.coalesce("concurrently", F.lit(False)), "index-not-concurrent"),
        )
    )
    plain = ops.select("database", "ord", "table", "column", F.explode(rules).alias("rule"))
    keys = ops.where("op = 'add_foreign_key'").select("database", "ord", "table", "columns")
    covers = F.slice("index_columns", 1, F.size("columns")) == F.col("columns")
    bare = keys.join(indexes.select("database", "table", F.col("columns").alias("index_columns")), ["database", "table"], "left").groupBy("database", "ord", "table", "columns").agg(F.coalesce(F.bool_or(covers), F.lit(False)).alias("covered")).where("NOT covered")
    return plain.unionByName(bare.select("database", "ord", "table", F.array_join("columns", ",").alias("column"), F.lit("fk-no-index").alias("rule")))


def field_deltas(base: DataFrame, head: DataFrame, keys: list[str], aspect: str) -> DataFrame:
    """Fields (keys, name, type, required) of requests, responses or params that differ, and whether callers break.

    A request or a parameter breaks by a newly required or retyped field, a response by one that is gone,
    retyped or no longer certain.
    """
    b = base.select(*keys, "name", F.col("type").alias("b_type"), F.col("required").alias("b_required"), F.lit(True).alias("_b"))
    h = head.select(*keys, "name", F.col("type").alias("h_type"), F.col("required").alias("h_required"), F.lit(True).alias("_h"))
    j = b.join(h, [*keys, "name"], "full_outer")
    added, gone = F.col("_b").isNull(), F.col("_h").isNull()
    status = F.when(added, "added").when(gone, "removed").when(~F.col("b_type").eqNullSafe(F.col("h_type")) | ~F.col("b_required").eqNullSafe(F.col("h_required")), "changed")
    retyped = F.col("b_type").isNotNull() & F.col("h_type").isNotNull() & (F.col("b_type") != F.col("h_type"))
    if aspect == "response":
        breaking = gone | (~added & ~gone & (retyped | (F.col("b_required") & ~F.col("h_required"))))
    else:
        breaking = (added & F.col("h_required")) | (~added & ~gone & (retyped | (F.col("h_required") & ~F.col("b_required"))))
    return j.withColumn("status", status).where("status IS NOT NULL").select(*keys, "name", F.lit(aspect).alias("aspect"), "status", F.coalesce(breaking, F.lit(False)).alias("breaking"))


def auth_findings(base: DataFrame, head: DataFrame, unrolled: int = 6) -> DataFrame:
    """Endpoints (id, auth array) whose protection went (auth-removed) or that are new without any (new-endpoint-open).

    Beyond `unrolled` findings of a rule, one row with their number stands for the rest.
    """
    j = head.select("id", F.col("auth").alias("h")).join(base.select("id", F.col("auth").alias("b")), "id", "left")
    rule = F.when(F.col("b").isNull() & (F.size("h") == 0), "new-endpoint-open").when((F.size("b") > 0) & (F.size(F.array_except("b", "h")) > 0), "auth-removed")
    found = j.withColumn("rule", rule).where("rule IS NOT NULL").select("rule", "id")
    first = found.groupBy("rule").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    rows = keep_newest(found, ["rule"], unrolled, F.col("id")).select("rule", F.col("id").cast("string").alias("subject"), F.lit(1).cast("long").alias("n"))
    rest = first.where(F.col("n") > unrolled).select("rule", F.lit("(others)").alias("subject"), (F.col("n") - unrolled).alias("n"))
    return rows.unionByName(rest)


def infra_findings(diff: DataFrame) -> DataFrame:
    """Resource differences (id, status, stateful, prevent_destroy_before, prevent_destroy_after, renamed_from, moved): rules."""
    rules = F.array_compact(
        F.array(
            F.when((F.col("status") == "removed") & F.col("stateful"), "stateful-destroyed"),
            F.when(F.coalesce("prevent_destroy_before", F.lit(False)) & ~F.coalesce("prevent_destroy_after", F.lit(False)) & (F.col("status") != "removed"), "prevent-destroy-removed"),
            F.when(F.col("renamed_from").isNotNull() & ~F.coalesce("moved", F.lit(False)), "rename-without-moved"),
        )
    )
    return diff.select("id", F.explode(rules).alias("rule"))


def env_gaps(reads: DataFrame, decls: DataFrame, sets: DataFrame, platform: list[str] = ("NODE_ENV", "PATH", "HOME", "CI")) -> DataFrame:
    """Reads (name, file, line, fallback, test) that nothing sets: maybe-set, not-set (declared only) or undeclared.

    sets: name, scope (a folder that the value reaches), ref (a value kept elsewhere). decls: name, scope.
    """
    open_reads = reads.where(~F.coalesce("test", F.lit(False)) & F.col("fallback").isNull() & ~F.col("name").isin(list(platform)))
    folders = open_reads.select("name", "file", "line", F.explode(ancestors(F.col("file"))).alias("scope"))
    flag = lambda df, n: folders.join(df.select("name", "scope").distinct(), ["name", "scope"]).groupBy("name", "file", "line").agg(F.lit(True).alias(n))
    joined = open_reads.join(flag(sets.where("NOT ref"), "_set"), ["name", "file", "line"], "left").join(flag(sets.where("ref"), "_maybe"), ["name", "file", "line"], "left").join(flag(decls, "_declared"), ["name", "file", "line"], "left")
    return joined.where("_set IS NULL").select("name", "file", "line", F.when(F.col("_maybe"), "maybe-set").when(F.col("_declared"), "not-set").otherwise("undeclared").alias("gap"))


def test_findings(changed: DataFrame, reach: DataFrame, markers: DataFrame, added: DataFrame, deleted_tests: DataFrame) -> DataFrame:
    """focused and skipped tests on added lines, deleted tests, and changed code that no test reaches: file, line, rule."""
    marks = markers.join(added.select("file", "line"), ["file", "line"], "left_semi").select("file", "line", F.when(F.col("kind") == "focus", "focused").otherwise("skipped").alias("rule"))
    gone = deleted_tests.select("file", F.lit(None).cast("int").alias("line"), F.lit("deleted-test").alias("rule"))
    bare = changed.select("file").distinct().join(reach.select(F.col("id").alias("file")), "file", "left_anti").select("file", F.lit(None).cast("int").alias("line"), F.lit("untested").alias("rule"))
    return marks.unionByName(gone).unionByName(bare)
