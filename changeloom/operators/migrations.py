"""Schema histories beyond their replay: renames by chains, logs paired with schemas, and one catalog of several sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeloom.checkpoints import cut
from changeloom.operators import graph, replay

#: Sources of a schema by precedence, the one that defines it first (fixed values).
SOURCES = ("migration", "schema", "model")


def chains(moves: DataFrame, made: DataFrame) -> DataFrame:
    """moves (scope, pos, from, to) with root, the pos of the first move of the chain that each goes on with.

    A move goes on with the one that last brought its name, unless the name was left or made anew since (made: scope, pos, name).
    """
    leaves = moves.select("scope", F.col("from").alias("name"), "pos", F.lit("left").alias("what"))
    comes = moves.select("scope", F.col("to").alias("name"), "pos", F.lit("came").alias("what"))
    news = made.select("scope", "name", "pos", F.lit("made").alias("what"))
    order = Window.partitionBy("scope", "name").orderBy("pos", "what")
    seen = leaves.unionByName(comes).unionByName(news).withColumn("last", F.lag(F.struct("pos", "what")).over(order))
    links = seen.where("what = 'left'").select(F.col("pos").alias("start"), F.when(F.col("last.what") == "came", F.col("last.pos")).otherwise(F.col("pos")).alias("root"))
    return moves.join(graph.chased(links).withColumnRenamed("start", "pos"), "pos")


def renames(ops: DataFrame) -> DataFrame:
    """What the operations rename in all, chains composed: database, kind (table or column), table (its last name), from, to.

    ops: database, ord (the migration), seq, op, table, column, to. A table that the same migration made before is a
    rebuild's copy, and its rename is none. Columns are followed through the renames of their table. What ends with its first name is left out.

    Edge cases: as in replay; renames without a name or a target, or to the same name, are left out.
    """
    ops = replay.numbered(ops.withColumns({"type": F.lit(None).cast("string"), "nullable": F.lit(None).cast("boolean")})).withColumn("scope", F.struct("database"))
    made = ops.where("op = 'create_table' AND table IS NOT NULL").select("scope", "ord", F.col("table").alias("name"), "pos")
    moves = ops.where("op = 'rename_table' AND table <> to").select("scope", "ord", "pos", F.col("table").alias("from"), "to")
    m, c = moves.alias("m"), made.alias("c")
    own = m.join(c, (F.col("m.scope") == F.col("c.scope")) & F.col("m.ord").eqNullSafe(F.col("c.ord")) & (F.col("m.from") == F.col("c.name")) & (F.col("c.pos") < F.col("m.pos")), "left_anti")
    tables = cut(chains(own.select("scope", "pos", "from", "to"), made.select("scope", "name", "pos")), "table-chains")
    first = tables.groupBy("scope", "root").agg(F.min_by("from", "pos").alias("first"), F.max_by("to", "pos").alias("last"))

    # What a table's name means where a column of it is renamed: a chain's table, one made before, or just itself.
    asked = ops.where("op = 'rename_column' AND column <> to AND table IS NOT NULL").select("scope", "pos", F.col("table").alias("name"), F.col("column").alias("from"), "to")
    means = tables.select("scope", F.col("to").alias("name"), "pos", F.struct(F.col("root").alias("chain"), F.lit(None).cast(made.schema["pos"].dataType).alias("made")).alias("means"))
    none = F.struct(F.lit(None).cast(made.schema["pos"].dataType).alias("chain"), F.lit(None).cast(made.schema["pos"].dataType).alias("made"))
    anew = made.select("scope", "name", "pos", F.struct(F.lit(None).cast(made.schema["pos"].dataType).alias("chain"), F.col("pos").alias("made")).alias("means"))
    left = tables.select("scope", F.col("from").alias("name"), "pos", none.alias("means"))
    told = means.unionByName(anew).unionByName(left)
    order = Window.partitionBy("scope", "name").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    both = asked.select("scope", "name", "pos", F.struct("from", "to").alias("move")).unionByName(told, allowMissingColumns=True)
    placed = both.withColumn("means", F.coalesce(F.last("means", ignorenulls=True).over(order), none)).where("move IS NOT NULL")
    heads = tables.join(first, ["scope", "root"]).select(F.col("root").alias("_chain"), "first").distinct()
    named = placed.join(heads, F.col("means.chain") == F.col("_chain"), "left")
    # The table's first name and, if it was made on the way, when: the same for all that is renamed in it.
    after = first.select(F.col("scope").alias("_scope"), F.col("first").alias("_first"), F.col("last").alias("_last"))
    scoped = named.select(F.struct("scope.database", F.coalesce("first", "name").alias("table"), "means.made").alias("scope"), "pos", "move.from", "move.to")
    columns = cut(chains(cut(scoped, "column-moves"), scoped.limit(0).select("scope", "pos", F.lit("").alias("name"))), "column-chains")
    inner = columns.groupBy("scope", "root").agg(F.min_by("from", "pos").alias("from"), F.max_by("to", "pos").alias("to"))
    last_names = inner.join(after, (inner.scope.database.eqNullSafe(F.col("_scope.database"))) & (inner.scope.table == F.col("_first")) & inner.scope.made.isNull(), "left")
    out = first.select("scope.database", F.lit("table").alias("kind"), F.col("last").alias("table"), F.col("first").alias("from"), F.col("last").alias("to"))
    out = out.unionByName(last_names.select("scope.database", F.lit("column").alias("kind"), F.coalesce("_last", "scope.table").alias("table"), "from", "to"))
    return out.where("from <> to")


def tried(schemas: DataFrame, logs: DataFrame) -> DataFrame:
    """Each schema replayed with each log of its folder that shares a table with it: folder, schema, log, n_clean, n_reflected, n_conflicts, verdict.

    schemas, logs: folder, file, and operations as in replay. All trials are one replay, keyed by schema and log. Verdict:
    applies (all clean), included (all reflected), else neither.
    """
    touched = lambda df, name: df.where("table IS NOT NULL").select("folder", F.col("file").alias(name), "table").distinct()
    pairs = cut(touched(schemas, "schema").join(touched(logs, "log"), ["folder", "table"]).select("folder", "schema", "log").distinct(), "trials")
    # Operations of the schema come first, those of the log after them.
    fields = ["seq", "op", "table", "column", "to", "type", "nullable"]
    key = F.to_json(F.struct("folder", "schema", "log")).alias("database")
    before = pairs.join(schemas.withColumnRenamed("file", "schema"), ["folder", "schema"]).select(key, F.struct(F.lit(0).alias("part"), F.col("ord").alias("ord")).alias("ord"), *fields)
    after = pairs.join(logs.withColumnRenamed("file", "log"), ["folder", "log"]).select(key, F.struct(F.lit(1).alias("part"), F.col("ord").alias("ord")).alias("ord"), *fields)
    status = replay.checked(before.unionByName(after)).where("ord.part = 1")
    n = lambda s: F.count_if(F.col("status") == s)
    told = status.groupBy("database").agg(n("clean").alias("n_clean"), n("reflected").alias("n_reflected"), n("conflict").alias("n_conflicts"))
    verdict = F.when((F.col("n_reflected") == 0) & (F.col("n_conflicts") == 0), "applies").when((F.col("n_clean") == 0) & (F.col("n_conflicts") == 0), "included").otherwise("neither")
    names = F.from_json("database", "folder string, schema string, log string")
    return told.select(names.alias("k"), "n_clean", "n_reflected", "n_conflicts", verdict.alias("verdict")).select("k.*", "n_clean", "n_reflected", "n_conflicts", "verdict")


def matched(trials: DataFrame) -> DataFrame:
    """Of the trials a matching, the best first: each schema with one log, each log with one schema.

    Best: applies or included before neither, then fewer conflicts, fewer reflected, more clean, then names. A pair that is the best
    left of both its schema and its log is taken in each round, which comes to the same as one after the other.
    """
    rank = F.struct((F.col("verdict") == "neither").alias("a"), F.col("n_conflicts").alias("b"), F.col("n_reflected").alias("c"), (-F.col("n_clean")).alias("d"), F.col("schema").alias("e"), F.col("log").alias("f"))
    left = cut(trials.withColumn("_rank", rank), "open-trials")
    taken = None
    while left.limit(1).count():
        of = lambda k: F.min("_rank").over(Window.partitionBy("folder", k))
        best = left.withColumn("_s", of("schema")).withColumn("_l", of("log")).where("_rank = _s AND _rank = _l").drop("_s", "_l")
        taken = cut(best if taken is None else taken.unionByName(best), "matched")
        gone = lambda k: taken.select("folder", k)  # noqa: B023, E731
        left = cut(left.join(gone("schema"), ["folder", "schema"], "left_anti").join(gone("log"), ["folder", "log"], "left_anti"), "open-trials")
    return (trials.withColumn("_rank", rank).limit(0) if taken is None else taken).drop("_rank")


def combined(migrations: DataFrame, schemas: DataFrame, models: DataFrame) -> DataFrame:
    """All sources' rows (database, table, column or null, type, nullable) by database, table and column: which sources have it."""
    rows = None
    for nth, df in enumerate((migrations, schemas, models)):
        part = df.select("database", "table", "column", "type", "nullable", F.lit(nth).alias("nth"))
        rows = part if rows is None else rows.unionByName(part)
    has = [F.bool_or(F.col("nth") == n).alias(f"has_{s}") for n, s in enumerate(SOURCES)]
    best = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("nth", c))).alias(f"_{c}")
    return rows.where("table IS NOT NULL").groupBy("database", "table", "column").agg(*has, best("type"), best("nullable"))


def named(nth: Column) -> Column:
    """The name of a source by its place; null for null, which element_at would take for the last."""
    return F.when(nth == 0, SOURCES[0]).when(nth == 1, SOURCES[1]).when(nth == 2, SOURCES[2])


def catalog(migrations: DataFrame, schemas: DataFrame, models: DataFrame) -> DataFrame:
    """One schema of three sources: database, table, column, source (the first that has the column), type, type_source, nullable, nullable_source.

    Each field is that of the first source that tells it, by precedence. Rows with a null column say that a table is there,
    and rows with a null table nothing. Of repeated rows the least value is taken.
    """
    c = combined(migrations, schemas, models).where("column IS NOT NULL")
    source = F.when(F.col("has_migration"), SOURCES[0]).when(F.col("has_schema"), SOURCES[1]).otherwise(SOURCES[2])
    return c.select("database", "table", "column", source.alias("source"), F.col("_type.type").alias("type"), named(F.col("_type.nth")).alias("type_source"), F.col("_nullable.nullable").alias("nullable"), named(F.col("_nullable.nth")).alias("nullable_source"))


def drift(migrations: DataFrame, schemas: DataFrame, models: DataFrame, complete: tuple[str, ...] = ("model",)) -> DataFrame:
    """Where lower sources differ from the one that defines a database: database, table, column, source, kind.

    The defining source is the first that has any table of the database. Kinds: model-no-table (a table it lacks), field-no-column (a
    column it lacks), column-no-field (one of its columns that the source, which has the table, lacks), and
    table-no-model (its table that a complete source of the database lacks).
    """
    cells = cut(combined(migrations, schemas, models), "cells")
    flags = [f"has_{s}" for s in SOURCES]
    tables = cut(cells.groupBy("database", "table").agg(*[F.bool_or(f).alias(f) for f in flags]), "tables")
    bases = tables.groupBy("database").agg(*[F.bool_or(f).alias(f"all_{f}") for f in flags])
    exact = F.when(F.col("all_has_migration"), 0).when(F.col("all_has_schema"), 1)
    both = tables.join(bases, tables.database.eqNullSafe(bases.database)).drop(bases.database).withColumn("exact", exact).where("exact IS NOT NULL")
    defined = lambda p="": F.when(F.col("exact") == 0, F.col(f"{p}has_migration")).otherwise(F.col(f"{p}has_schema"))
    of_table = []
    for n, s in enumerate(SOURCES[1:], 1):
        lower = F.col("exact") < n
        of_table.append(F.when(lower & F.col(f"has_{s}") & ~defined(), F.struct(F.lit(s).alias("source"), F.lit("model-no-table").alias("kind"))))
        if s in complete:
            of_table.append(F.when(lower & defined() & ~F.col(f"has_{s}") & F.col(f"all_has_{s}"), F.struct(F.lit(s).alias("source"), F.lit("table-no-model").alias("kind"))))
    opened = lambda marks: F.explode(F.filter(F.array(*marks), lambda x: x.isNotNull()))
    first = both.select("database", "table", F.lit(None).cast("string").alias("column"), opened(of_table).alias("d"))
    t = both.select(F.col("database").alias("_d"), F.col("table").alias("_t"), "exact", *[F.col(f).alias(f"t_{f}") for f in flags])
    inner = cells.where("column IS NOT NULL").join(t, F.col("database").eqNullSafe(F.col("_d")) & (F.col("table") == F.col("_t"))).where(defined("t_"))
    of_column = []
    for n, s in enumerate(SOURCES[1:], 1):
        lower = (F.col("exact") < n) & F.col(f"t_has_{s}")
        of_column.append(F.when(lower & F.col(f"has_{s}") & ~defined(), F.struct(F.lit(s).alias("source"), F.lit("field-no-column").alias("kind"))))
        of_column.append(F.when(lower & ~F.col(f"has_{s}") & defined(), F.struct(F.lit(s).alias("source"), F.lit("column-no-field").alias("kind"))))
    second = inner.select("database", "table", "column", opened(of_column).alias("d"))
    return first.unionByName(second).select("database", "table", "column", "d.source", "d.kind")
