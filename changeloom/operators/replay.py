"""Ordered schema operations: what each did, and the state of each database after them, without a task per database.

Operations: create_table, drop_table, rename_table (to), add_column, drop_column, rename_column (to), alter_type,
set_not_null; others are left out. They go by (ord, seq), ties by operation and names. Names are compared as they are.

What a name means changes with time, so names become lives first: a life starts where a thing is made or another is
renamed to it, and ends where it is dropped, renamed or replaced. Whether a rename takes place depends on whether its source is
alive, which may hang on earlier renames; all of them are assumed to and corrected in rounds, one for each
link of the longest chain. Lives that a rename joins are one thing, found by pointer jumping. Tables are
resolved in their database, then columns in their table, so work is spread over names, and attributes are
grouped by column. No group of operations is held by one task but those of one name.

An operation is clean if it applies. It is reflected if what it wants is there already (a table or column that
it makes exists, one that it drops does not, a rename's source is gone and its target there), else a conflict.
Reflected and conflicting ones change nothing. A rename to a name in use is clean and replaces what had it; one to
the same name changes nothing.

Edge cases. A null database is one of its own. Operations with a null table, or that lack a needed column or
target, are conflicts. Repeated rows count each. No rows: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeloom.checkpoints import cut
from changeloom.operators.graph import chased

#: Tables' lives up to this many are broadcast (about 1 KB each), more are joined by a shuffle.
BROADCAST_LIVES = 10_000
TABLE_OPS, COLUMN_OPS = ("create_table", "drop_table", "rename_table"), ("add_column", "drop_column", "rename_column", "alter_type", "set_not_null")
MAKES, ENDS, MOVES = ("create_table", "add_column"), ("drop_table", "drop_column"), ("rename_table", "rename_column")


def numbered(ops: DataFrame) -> DataFrame:
    """The known operations with pos, by which they are ordered and told apart."""
    known = ops.select("database", "ord", "seq", "op", "table", "column", "to", "type", "nullable").where(F.col("op").isin(*TABLE_OPS, *COLUMN_OPS))
    return cut(known.withColumn("pos", F.struct("ord", "seq", "op", "table", "column", "to", F.monotonically_increasing_id().alias("id"))), "operations")


def shuffled(df: DataFrame) -> DataFrame:
    """df, never to be broadcast: positions repeat so much that a table's files are a hundredth of its rows, and Spark goes by the files."""
    return df.hint("merge")


def lives(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """events (scope, pos, kind, name, to) to (status of each: pos, status) and the lives.

    kind: make, end, move, or look, which changes nothing. Lives: scope, name, root, start, stop (null: to the end); root is the pos where the thing
    was made, so lives of one thing share it.
    """
    sets = F.when(F.col("kind") == "make", True).when(F.col("kind") != "look", False)
    own = events.select("scope", "pos", "kind", "name", F.lit(False).alias("arrives"), sets.alias("sets"))
    arrive = events.where("kind = 'move'").select("scope", "pos", "kind", F.col("to").alias("name"), F.lit(True).alias("arrives"), F.lit(True).alias("sets"))
    rows = own.unionByName(arrive)
    before = Window.partitionBy("scope", "name").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)

    def with_state(found: DataFrame, failed: DataFrame | None) -> DataFrame:
        """found with `alive`: whether the name was in use before; moves in `failed` bring nothing."""
        if failed is not None:
            found = found.join(shuffled(failed.select("pos", F.lit(True).alias("_failed"))), "pos", "left").withColumn("sets", F.when(~(F.col("arrives") & F.coalesce("_failed", F.lit(False))), F.col("sets"))).drop("_failed")
        return found.withColumn("alive", F.coalesce(F.last("sets", ignorenulls=True).over(before), F.lit(False)))

    # Only names that something is moved to can hang on other moves.
    moved = cut(rows.where("kind = 'move'").select("scope", "name").distinct(), "moved-names")
    failed, n = None, -1
    if moved.limit(1).count():
        near = cut(rows.join(shuffled(moved), ["scope", "name"], "left_semi"), "moves")
        while True:
            now = cut(with_state(near, failed).where("kind = 'move' AND NOT arrives AND NOT alive").select("pos"), "failed-moves")
            gone = now.count() if failed is None else now.join(shuffled(failed), "pos", "left_anti").count() + failed.join(shuffled(now), "pos", "left_anti").count()
            failed = now
            if not gone:
                break
    seen = cut(with_state(rows, failed), "states")

    source, target = seen.where("NOT arrives"), seen.where("arrives").select("pos", F.col("alive").alias("taken"))
    joined = source.join(shuffled(target), "pos", "left")
    status = joined.select("pos", F.expr("CASE WHEN kind = 'make' THEN IF(alive, 'reflected', 'clean') WHEN kind = 'end' THEN IF(alive, 'clean', 'reflected') WHEN alive THEN 'clean' WHEN taken THEN 'reflected' ELSE 'conflict' END").alias("status"))
    starts = "(kind = 'make' AND NOT arrives AND NOT alive OR arrives AND sets)"
    stops = "(kind = 'end' AND alive OR kind = 'move' AND NOT arrives AND alive)"
    onward = Window.partitionBy("scope", "name").orderBy("pos")
    marks = seen.where(f"{starts} OR {stops}").withColumn("starts", F.expr(starts)).withColumn("stop", F.lead("pos").over(onward)).where("starts")
    parts = cut(marks.select("scope", "name", F.col("pos").alias("start"), "stop"), "lives")
    # A life that a move starts goes on from the one that it stops under the name it leaves.
    moves = seen.where("kind = 'move' AND NOT arrives AND alive").select("scope", F.col("pos").alias("start"), "name")
    links = moves.join(shuffled(parts.select("scope", "name", F.col("stop").alias("start"), F.col("start").alias("back"))), ["scope", "name", "start"]).select("start", "back")
    roots = chased(parts.select("start").join(shuffled(links), "start", "left").select("start", F.coalesce("back", "start").alias("root")))
    return status, parts.join(shuffled(roots), "start").select("scope", "name", "root", "start", "stop")


def few(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is small, and shuffled if not."""
    return F.broadcast(df) if df.limit(BROADCAST_LIVES + 1).count() <= BROADCAST_LIVES else shuffled(df)


def at_time(ops: DataFrame, alive: DataFrame, scope: str, name: str) -> DataFrame:
    """ops with `life`, the root of what its name means at its pos; null if nothing has it then."""
    spans = few(alive.select(F.col("scope").alias("_scope"), F.col("name").alias("_name"), F.col("root").alias("life"), "start", "stop"))
    during = (F.col("start") < F.col("pos")) & (F.col("stop").isNull() | (F.col("stop") > F.col("pos")))
    return ops.join(spans, F.col(scope).eqNullSafe(F.col("_scope")) & (F.col(name) == F.col("_name")) & during, "left").drop("_scope", "_name", "start", "stop")


def events_of(ops: DataFrame, scope: Column, name: str) -> DataFrame:
    kind = F.when(F.col("op").isin(*MAKES), "make").when(F.col("op").isin(*ENDS), "end").otherwise(F.when(F.col("to") == F.col(name), "look").otherwise("move"))
    fit = F.col(name).isNotNull() & (~F.col("op").isin(*MOVES) | F.col("to").isNotNull())
    return ops.where(fit).select(scope.alias("scope"), "pos", kind.alias("kind"), F.col(name).alias("name"), "to")


def resolved(ops: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(operations with table_life and status, lives of tables, lives of columns, attribute operations with column_life)."""
    ops = numbered(ops)
    tables = ops.where(F.col("op").isin(*TABLE_OPS))
    table_status, table_lives = lives(cut(events_of(tables, F.struct("database"), "table"), "table-events"))
    table_lives = cut(table_lives, "table-lives")
    placed = cut(at_time(ops.where(F.col("op").isin(*COLUMN_OPS)).withColumn("_scope_of", F.struct("database")), table_lives, "_scope_of", "table").withColumnRenamed("life", "table_life").drop("_scope_of"), "placed")
    there = placed.where("table_life IS NOT NULL")
    shaping = there.where(F.col("op").isin("add_column", "drop_column", "rename_column"))
    column_status, column_lives = lives(cut(events_of(shaping, F.col("table_life"), "column"), "column-events"))
    column_lives = cut(column_lives, "column-lives")
    attributes = there.where(F.col("op").isin("alter_type", "set_not_null"))
    attributes = cut(at_time(attributes, column_lives, "table_life", "column").withColumnRenamed("life", "column_life"), "attributes")
    attribute_status = attributes.select("pos", F.when(F.col("column_life").isNull(), "conflict").otherwise("clean").alias("status"))
    status = table_status.unionByName(column_status).unionByName(attribute_status)
    told = ops.join(shuffled(placed.select("pos", "table_life")), "pos", "left").join(shuffled(status), "pos", "left")
    return told.withColumn("status", F.coalesce("status", F.lit("conflict"))), table_lives, column_lives, attributes


def checked(ops: DataFrame) -> DataFrame:
    """ops (database, ord, seq, op, table, column, to, type, nullable) with status: clean, reflected or conflict."""
    return resolved(ops)[0].drop("pos", "table_life")


def replay(ops: DataFrame) -> DataFrame:
    """The columns that are there in the end: database, table, column, type, nullable, and the database's operations that did not fit.

    A type is the last one that an operation gave, null included; a nullable is what the column was added with, false after set_not_null.
    """
    told, table_lives, column_lives, attributes = resolved(ops)
    told = cut(told, "told")
    made = told.where("op = 'add_column' AND status = 'clean'").select(F.col("pos").alias("life"), "pos", "op", "type", "nullable")
    set_ = attributes.where("column_life IS NOT NULL").select(F.col("column_life").alias("life"), "pos", "op", "type", F.lit(False).alias("nullable"))
    last = lambda c, *kinds: F.max_by(F.when(F.col("op").isin(*kinds), F.struct(c)), F.when(F.col("op").isin(*kinds), F.col("pos")))[c].alias(c)
    state = made.unionByName(set_).groupBy("life").agg(last("type", "add_column", "alter_type"), last("nullable", "add_column", "set_not_null"))
    tables = table_lives.where("stop IS NULL").select("scope.database", F.col("name").alias("table"), F.col("root").alias("table_life"))
    columns = column_lives.where("stop IS NULL").select(F.col("scope").alias("table_life"), F.col("name").alias("column"), F.col("root").alias("life"))
    unfit = told.groupBy(F.col("database").alias("_database")).agg(F.count_if(F.col("status") != "clean").alias("conflicts"))
    out = tables.join(shuffled(columns), "table_life").join(shuffled(state), "life").join(few(unfit), F.col("database").eqNullSafe(F.col("_database")))
    return out.select("database", "table", "column", "type", "nullable", "conflicts")
