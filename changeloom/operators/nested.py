"""Nested settings: JSON opened to dotted attributes, and overlays of partial records along a chain of bases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changeloom.checkpoints import cut
from changeloom.operators import graph
from changeloom.operators.relational import spread


def attributes(rows: DataFrame, json: str, keys: list[str], *, depth: int = 8, most: int | None = None) -> DataFrame:
    """keys, name, value of rows (keys, json): each value of the JSON under its dotted name, as `spec.containers[web].ports[0].port`.

    Opened level by level as VARIANT. Nulls have no attribute, a bare value is called `value`. A list without objects and
    lists is one value, as is what lies deeper than `depth` levels: compact JSON. Items of other lists go by their string `name`, which then
    is no attribute of its own unless they have nothing else, or by their place. Blanks in values are single spaces. most: the first so many names of
    each row's objects, in the order of keys. Texts that are no JSON and nulls have none. Repeated rows are opened each.
    """
    spark = rows.sparkSession
    start = spread(rows).select(*keys, F.monotonically_increasing_id().alias("_row"), F.try_parse_json(F.col(json)).alias("v")).where("v IS NOT NULL AND NOT is_variant_null(v)")
    level = cut(start.select(*keys, "_row", F.lit("").alias("prefix"), "v", F.array().cast("array<int>").alias("place"), F.lit(False).alias("named")), "level")
    names, found = ", ".join(f"`{k}`" for k in keys), []
    kind, inner = "schema_of_variant(v)", "exists(try_variant_get(v, '$', 'array<variant>'), x -> schema_of_variant(x) RLIKE '^(OBJECT|ARRAY)')"
    for n in range(depth + 1):
        level = level.withColumn("_open", F.expr(f"CASE WHEN {n} >= {depth} THEN false WHEN {kind} LIKE 'OBJECT%' THEN true WHEN {kind} LIKE 'ARRAY%' THEN coalesce({inner}, false) ELSE false END"))
        text = F.expr(f"CASE WHEN {kind} = 'STRING' THEN cast(v AS string) WHEN named THEN to_json(map_filter(try_variant_get(v, '$', 'map<string,variant>'), (k, x) -> k <> 'name')) ELSE to_json(v) END")
        found.append(level.where("NOT _open").select(*keys, "_row", "place", F.coalesce(F.nullif("prefix", F.lit("")), F.lit("value")).alias("name"), F.trim(F.regexp_replace(text, r"\s+", " ")).alias("value")))
        open_ = level.where("_open")
        if n == depth or not open_.limit(1).count():
            break
        open_.createOrReplaceTempView("_open_level")
        rows_ = spark.sql(f"SELECT {names}, _row, prefix, place, named, e.pos, e.key, e.value AS v, try_variant_get(e.value, '$.name', 'variant') AS title FROM _open_level, LATERAL variant_explode(v) e WHERE NOT is_variant_null(e.value) AND NOT (named AND e.key <=> 'name')")
        called = F.expr("key IS NULL AND title IS NOT NULL AND schema_of_variant(title) = 'STRING'")
        title = F.expr("cast(title AS string)")
        alone = called & F.expr("to_json(v) = to_json(parse_json(to_json(named_struct('name', cast(title AS string)))))")
        dotted = F.when(F.col("prefix") == "", F.col("key")).otherwise(F.concat("prefix", F.lit("."), F.col("key")))
        name = F.when(F.col("key").isNotNull(), dotted).when(called, F.concat("prefix", F.lit("["), title, F.lit("]"))).otherwise(F.concat("prefix", F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        value = F.when(alone, F.col("title")).otherwise(F.col("v"))
        level = cut(rows_.select(*keys, "_row", name.alias("prefix"), value.alias("v"), F.concat("place", F.array("pos")).alias("place"), F.coalesce(called & ~alone, F.lit(False)).alias("named")), "level")
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    if most is not None:
        out = out.withColumn("_n", F.row_number().over(Window.partitionBy("_row").orderBy("place"))).where(F.col("_n") <= most)
    return out.select(*keys, "name", "value")


def chain_of(bases: DataFrame, envs: DataFrame | None = None) -> DataFrame:
    """env, layer, nth of bases (layer, base): each layer's own chain, the farthest base first; of equally far ones the names decide.

    envs (layer): whose chains are wanted; all layers' without it. Loops are walked once.
    """
    all_layers = bases.select("layer").unionByName(bases.select(F.col("base").alias("layer"))).where("layer IS NOT NULL").distinct() if envs is None else envs.select("layer").distinct()
    found = graph.reach(bases.where("layer IS NOT NULL AND base IS NOT NULL").select(F.col("layer").alias("src"), F.col("base").alias("dst")), all_layers.select(F.col("layer").alias("origin"), F.col("layer").alias("id")), keyed=True)
    order = Window.partitionBy("origin").orderBy(F.desc("hops"), "id")
    return found.select(F.col("origin").alias("env"), F.col("id").alias("layer"), F.row_number().over(order).alias("nth"))


def ancestors(name: F.Column) -> F.Column:
    """A dotted name and all names that it lies in: a.b[c].d, a.b[c], a.b, a."""
    ends = F.filter(F.sequence(F.lit(1), F.length(name)), lambda i: (i == F.length(name)) | F.substr(name, i + 1, F.lit(1)).isin(".", "["))
    return F.transform(ends, lambda i: F.substr(name, F.lit(1), i))


def overlaid(edits: DataFrame, chain: DataFrame) -> DataFrame:
    """env, record, name, value: what each record is after the edits of the chain's layers, in their order.

    edits: layer, record, name (dotted), action (set, remove or replace), value. chain: env, layer, nth. A later layer's value wins; set with a null value and
    remove take the name and all under it away; replace takes away what earlier layers have under the name, as a list that is set anew, and may set a value itself.
    Settings under a name that no layer takes away are merged, so lists by key (`a[web].port`) merge. A value for a name takes away what lies under it before,
    and one under a name takes away the name's own value. The fold is two joins: each setting with the last layer that takes its name or one above it away.

    Edge cases. Null layers, records, names and actions: left out. Of repeated names of one layer, taking away comes first and the greatest value stays.
    """
    placed = cut(edits.where("layer IS NOT NULL AND record IS NOT NULL AND name IS NOT NULL AND action IN ('set', 'remove', 'replace')").join(chain, "layer").select("env", "record", "name", "action", "value", "nth"), "edits")
    sets = placed.where("action <> 'remove' AND value IS NOT NULL").groupBy("env", "record", "name", "nth").agg(F.max("value").alias("value"))
    # What takes away: under a name all that came before; a value also what lies under it; and a value under a name the name's own.
    gone = placed.where("action <> 'set' OR value IS NULL").select("env", "record", F.col("name").alias("above"), F.lit(False).alias("itself"), F.col("nth").alias("gone"))
    over = sets.select("env", "record", F.col("name").alias("above"), F.lit(True).alias("strict"), F.col("nth").alias("gone"))
    under = sets.select("env", "record", F.explode(ancestors(F.col("name"))).alias("above"), "name", F.col("nth").alias("gone")).where("above <> name")
    kills = gone.select("env", "record", "above", F.lit("all").alias("kind"), "gone").unionByName(over.select("env", "record", "above", F.lit("under").alias("kind"), "gone")).unionByName(under.select("env", "record", "above", F.lit("own").alias("kind"), "gone"))
    last = kills.groupBy("env", "record", "above", "kind").agg(F.max("gone").alias("gone"))
    opened = sets.select("env", "record", "name", "nth", "value", F.explode(ancestors(F.col("name"))).alias("above"))
    fits = (F.col("kind") == "all") | (F.col("kind") == "under") & (F.col("above") != F.col("name")) | (F.col("kind") == "own") & (F.col("above") == F.col("name"))
    taken = opened.join(last, ["env", "record", "above"]).where(fits & (F.col("gone") > F.col("nth"))).select("env", "record", "name", "nth").distinct()
    kept = sets.join(taken, ["env", "record", "name", "nth"], "left_anti")
    return kept.groupBy("env", "record", "name").agg(F.max_by("value", "nth").alias("value"))
