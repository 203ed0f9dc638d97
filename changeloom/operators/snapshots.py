"""Comparison of two snapshots of code, schema, infrastructure and API facts. All joins, no collected state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeloom.checkpoints import cut
from changeloom.operators.relational import latest_by


def overlaps(decls: DataFrame, lines: DataFrame, flag: str) -> DataFrame:
    """ids of declarations (id, file, start_line, end_line) that hold one of the lines (file, line)."""
    bins = decls.select("id", "file", "start_line", "end_line", F.explode(F.sequence(F.floor(F.col("start_line") / 64), F.floor(F.col("end_line") / 64))).alias("_bin"))
    hit = bins.join(lines.select("file", "line", F.floor(F.col("line") / 64).alias("_bin")), ["file", "_bin"]).where("line BETWEEN start_line AND end_line")
    return hit.select("id").distinct().withColumn(flag, F.lit(True))


def declaration_moves(base: DataFrame, head: DataFrame, changed: DataFrame) -> DataFrame:
    """(before_id, after_id, change): gone here, and new under the same kind and name in exactly one other changed file."""
    files = changed.select("file").distinct()
    sides = lambda a, b, p: a.join(files, "file", "left_semi").join(b, "id", "left_anti").select(F.col("id").alias(f"{p}_id"), F.col("file").alias(f"{p}_file"), "kind", "qualified", F.col("signature").alias(f"{p}_signature"), F.col("text_hash").alias(f"{p}_hash"))
    pairs = sides(base, head, "before").join(sides(head, base, "after"), ["kind", "qualified"]).where("before_file <> after_file")
    n = lambda c: F.count("*").over(Window.partitionBy(c))
    change = F.when(F.col("before_signature") != F.col("after_signature"), "signature").when(F.col("before_hash") != F.col("after_hash"), "body")
    return pairs.withColumn("_a", n("before_id")).withColumn("_b", n("after_id")).where("_a = 1 AND _b = 1").select("before_id", "after_id", change.alias("change"))


def declaration_changes(base: DataFrame, head: DataFrame, changed: DataFrame) -> DataFrame:
    """Declarations (id, file, kind, qualified, signature, text_hash, start_line, end_line) of changed files with their status.

    changed: file, side (old or new), line. Status: added, removed, moved, signature or body; a class whose
    lines changed but whose signature did not has none, its methods have.
    """
    files = changed.select("file").distinct()
    moves = declaration_moves(base, head, changed)
    new_lines, old_lines = (changed.where(F.col("side") == s).select("file", "line") for s in ("new", "old"))
    old = base.select("id", F.col("signature").alias("_old"))
    rows = head.join(files, "file", "left_semi").join(old, "id", "left").join(moves.select(F.col("after_id").alias("id"), F.coalesce("change", F.lit("moved")).alias("_move")), "id", "left")
    rows = rows.join(overlaps(head, new_lines, "_new"), "id", "left").join(overlaps(base, old_lines, "_gone"), "id", "left")
    touched = F.coalesce("_new", F.lit(False)) | F.coalesce("_gone", F.lit(False))
    status = F.when(F.col("_move").isNotNull(), F.col("_move")).when(F.col("_old").isNull(), "added").when(F.col("_old") != F.col("signature"), "signature").when(touched & (F.col("kind") != "class"), "body")
    gone = base.join(files, "file", "left_semi").join(head, "id", "left_anti").join(moves.select(F.col("before_id").alias("id")), "id", "left_anti")
    return rows.withColumn("status", status).where("status IS NOT NULL").select("id", "file", "status").unionByName(gone.select("id", "file", F.lit("removed").alias("status")))


def call_graph(base_calls: DataFrame, head_calls: DataFrame, changes: DataFrame, moves: DataFrame, added_lines: DataFrame) -> DataFrame:
    """Calls (src, dst, file, line) from or to a changed declaration: existing, new or removed, one row a pair.

    not_updated: the callee's signature changed, but neither the calling line nor the caller did.
    """
    new_id = moves.select(F.col("before_id").alias("_b"), F.col("after_id").alias("_a"))
    for end in ("src", "dst"):
        base_calls = base_calls.join(new_id, F.col(end) == F.col("_b"), "left").withColumn(end, F.coalesce("_a", end)).drop("_a", "_b")
    first = lambda df: latest_by(df, ["src", "dst"], F.col("file"), F.col("line"))
    ids = changes.select("id", F.col("status").alias("_s"))
    near = lambda df: df.join(ids.select(F.col("id").alias("src"), F.lit(True).alias("_from")), "src", "left").join(ids.select(F.col("id").alias("dst"), F.col("_s").alias("_to")), "dst", "left").where("_from OR _to IS NOT NULL")
    pair = ["src", "dst"]
    known = base_calls.select(pair).distinct().withColumn("_known", F.lit(True))
    head = near(first(head_calls)).join(known, pair, "left").join(added_lines.select("file", "line").distinct().withColumn("_written", F.lit(True)), ["file", "line"], "left")
    stale = (F.col("_to") == "signature") & F.col("_written").isNull() & F.col("_from").isNull()
    now = head.select(*pair, "file", "line", F.when(F.col("_known"), "existing").otherwise("new").alias("status"), F.coalesce(stale, F.lit(False)).alias("not_updated"))
    gone = near(first(base_calls)).join(head_calls, pair, "left_anti").select(*pair, "file", "line", F.lit("removed").alias("status"), F.lit(False).alias("not_updated"))
    return now.unionByName(gone)


def schema_diff(base: DataFrame, head: DataFrame, renames: DataFrame) -> DataFrame:
    """Columns (table, column, type, nullable, default) of two schemas by table and column: status and aspects.

    renames (table_before, table_after): named by migrations. A removed and an added table that have the same
    two or more column names, and are each other's only match, are a rename as well.
    """
    shape = lambda df, p: df.groupBy("table").agg(F.array_join(F.array_sort(F.collect_set(F.lower("column"))), ",").alias("shape"), F.count("*").alias("n")).where("n >= 2").select(F.col("table").alias(f"table_{p}"), "shape")
    named = renames.join(base.select(F.col("table").alias("table_before")).distinct(), "table_before", "left_semi").join(head.select(F.col("table").alias("table_after")).distinct(), "table_after", "left_semi")
    gone = shape(base.join(head, "table", "left_anti").join(named.select(F.col("table_before").alias("table")), "table", "left_anti"), "before")
    fresh = shape(head.join(base, "table", "left_anti").join(named.select(F.col("table_after").alias("table")), "table", "left_anti"), "after")
    by_shape = Window.partitionBy("shape")
    alike = gone.join(fresh, "shape").withColumn("_n", F.count("*").over(by_shape)).where("_n = 1").select("table_before", "table_after")
    moved = named.select("table_before", "table_after").unionByName(alike)
    b = base.join(moved, F.col("table") == F.col("table_before"), "left").withColumn("_before", F.col("table")).withColumn("table", F.coalesce("table_after", "table")).drop("table_before", "table_after")
    fields = ["type", "nullable", "default"]
    b = b.select("table", "column", F.col("_before").alias("table_before"), *[F.col(c).alias(f"b_{c}") for c in fields], F.lit(True).alias("_b"))
    h = head.select("table", "column", *[F.col(c).alias(f"h_{c}") for c in fields], F.lit(True).alias("_h"))
    aspects = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"b_{c}").eqNullSafe(F.col(f"h_{c}")), F.lit(c)) for c in fields])), ",")
    status = F.when(F.col("_b").isNull(), "added").when(F.col("_h").isNull(), "removed").when(aspects != "", "changed").when(F.col("table_before") != F.col("table"), "renamed")
    return b.join(h, ["table", "column"], "full_outer").withColumn("status", status).where("status IS NOT NULL").select("table", "column", "status", F.when(F.col("status") == "changed", aspects).otherwise("").alias("aspects"), F.when(F.col("table_before") != F.col("table"), F.col("table_before")).alias("renamed_from"))


def attribute_similarity(pairs: DataFrame, base: DataFrame, head: DataFrame) -> DataFrame:
    """pairs (before_id, after_id) with the share of equal attributes (id, name, value) among all names of either."""
    b = pairs.join(base.select(F.col("id").alias("before_id"), "name", F.col("value").alias("_v")), "before_id")
    h = pairs.join(head.select(F.col("id").alias("after_id"), "name", F.col("value").alias("_w")), "after_id")
    both = b.join(h, ["before_id", "after_id", "name"], "full_outer")
    return both.groupBy("before_id", "after_id").agg((F.count_if(F.col("_v").eqNullSafe(F.col("_w"))) / F.count("*")).alias("score"))


def resource_diff(base: DataFrame, head: DataFrame, base_attrs: DataFrame, head_attrs: DataFrame, moves: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Resources (id, tool, stack, kind, address): create, destroy, update, moved or renamed, with the id before and after.

    moves (before_id, after_id): written down. A destroyed and a created resource of one kind in one stack whose
    attributes are alike enough, and that are each other's single best, are a rename; a tie is none.
    """
    ids = lambda df, n: df.select(F.col("id").alias(n), "tool", "stack", "kind", "address")
    same = base.select("id").join(head.select("id"), "id").select(F.col("id").alias("before_id"), F.col("id").alias("after_id"))
    gone, fresh = base.join(head, "id", "left_anti"), head.join(base, "id", "left_anti")
    told = moves.join(gone.select(F.col("id").alias("before_id")), "before_id", "left_semi").join(fresh.select(F.col("id").alias("after_id")), "after_id", "left_semi")
    gone, fresh = gone.join(told.select(F.col("before_id").alias("id")), "id", "left_anti"), fresh.join(told.select(F.col("after_id").alias("id")), "id", "left_anti")
    near = ids(gone, "before_id").drop("address").join(ids(fresh, "after_id").drop("address"), ["tool", "stack", "kind"]).select("before_id", "after_id")
    scored = attribute_similarity(near, base_attrs, head_attrs).where(F.col("score") >= threshold)
    rank = lambda key: F.rank().over(Window.partitionBy(key).orderBy(F.desc("score")))
    best = scored.withColumn("_a", rank("before_id")).withColumn("_b", rank("after_id")).where("_a = 1 AND _b = 1")
    only = lambda key: F.count("*").over(Window.partitionBy(key)) == 1
    renamed = best.withColumn("_x", only("before_id")).withColumn("_y", only("after_id")).where("_x AND _y").select("before_id", "after_id")
    paired = same.withColumn("action", F.lit("same")).unionByName(told.select("before_id", "after_id").withColumn("action", F.lit("moved"))).unionByName(renamed.withColumn("action", F.lit("renamed")))
    differs = _attribute_changes(paired, base_attrs, head_attrs).select("before_id", "after_id").distinct().withColumn("_d", F.lit(True))
    known = paired.join(differs, ["before_id", "after_id"], "left").withColumn("action", F.when((F.col("action") == "same") & F.col("_d"), "update").otherwise(F.col("action"))).drop("_d")
    lost = base.select(F.col("id").alias("before_id")).join(known, "before_id", "left_anti").select("before_id", F.lit(None).cast(base.schema["id"].dataType).alias("after_id"), F.lit("destroy").alias("action"))
    made = head.select(F.col("id").alias("after_id")).join(known, "after_id", "left_anti").select(F.lit(None).cast(base.schema["id"].dataType).alias("before_id"), "after_id", F.lit("create").alias("action"))
    return known.unionByName(lost).unionByName(made).where("action <> 'same'")


def _attribute_changes(pairs: DataFrame, base: DataFrame, head: DataFrame) -> DataFrame:
    p = pairs.select("before_id", "after_id")
    b = p.join(base.select(F.col("id").alias("before_id"), "name", F.col("value").alias("value_before")), "before_id")
    h = p.join(head.select(F.col("id").alias("after_id"), "name", F.col("value").alias("value_after")), "after_id")
    return b.join(h, ["before_id", "after_id", "name"], "full_outer").where("NOT value_before <=> value_after")


def endpoint_diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """Endpoints (id, kind, method, path, handler, auth): added, removed, changed or re-pathed, with what breaks.

    A removed and an added endpoint of one kind and handler are one that moved: with the same method, or if
    there is just one of each.
    """
    cols = ["id", "kind", "method", "path", "handler", "auth"]
    side = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in cols])
    gone, fresh = side(base.join(head, "id", "left_anti"), "b"), side(head.join(base, "id", "left_anti"), "h")
    pairs = gone.join(fresh, (F.col("b_kind") == F.col("h_kind")) & (F.col("b_handler") == F.col("h_handler")))
    alike = F.col("b_method") == F.col("h_method")
    n = lambda c: F.count("*").over(Window.partitionBy(c))
    matched = pairs.withColumn("_same", alike).withColumn("_n", n("b_id")).withColumn("_m", n("h_id")).where("_same OR (_n = 1 AND _m = 1)")
    matched = latest_by(latest_by(matched, ["h_id"], F.desc("_same"), F.col("b_id")), ["b_id"], F.desc("_same"), F.col("h_id")).drop("_same", "_n", "_m")
    both = side(base, "b").join(side(head, "h"), F.col("b_id") == F.col("h_id")).unionByName(matched)
    free = F.col("h_kind") != "action"
    tested: list[tuple[str, Column, Column]] = [
        ("path", F.col("b_path") != F.col("h_path"), free),
        ("method", ~F.col("b_method").eqNullSafe(F.col("h_method")), free),
        ("auth", F.col("b_auth") != F.col("h_auth"), F.size(F.array_except("h_auth", "b_auth")) > 0),
    ]
    deltas = F.array_compact(F.array(*[F.when(differs, F.struct(F.lit(name).alias("aspect"), breaks.alias("breaking"))) for name, differs, breaks in tested]))
    changed = both.withColumn("_d", deltas).where(F.size("_d") > 0)
    changed = changed.select("h_id", F.when(F.col("b_id") == F.col("h_id"), "changed").otherwise("moved").alias("status"), F.col("b_id").alias("before_id"), F.array_join(F.transform("_d", lambda d: d["aspect"]), ",").alias("aspects"), F.exists("_d", lambda d: d["breaking"]).alias("breaking"))
    lost = gone.join(matched.select("b_id"), "b_id", "left_anti").select(F.col("b_id").alias("h_id"), F.lit("removed").alias("status"), F.col("b_id").alias("before_id"), F.lit("").alias("aspects"), F.lit(True).alias("breaking"))
    made = fresh.join(matched.select("h_id"), "h_id", "left_anti").select("h_id", F.lit("added").alias("status"), F.lit(None).cast(base.schema["id"].dataType).alias("before_id"), F.lit("").alias("aspects"), F.lit(False).alias("breaking"))
    return changed.unionByName(lost).unionByName(made).withColumnRenamed("h_id", "id")


def moved_lines(lines: DataFrame, least: int = 20) -> DataFrame:
    """Runs of removed lines that are added elsewhere: lines (block, pos, side, content) to from and to blocks.

    Lines meet by their trimmed content, runs are islands of equal distance, and a run counts if its letters
    and digits are `least` or more. Within one block it is an edit.
    """
    key = lines.withColumn("key", F.trim("content")).where("key <> ''").select("block", "pos", "side", "key", F.length(F.regexp_replace("key", "[^A-Za-z0-9]", "")).alias("chars"))
    old, new = (key.where(F.col("side") == s).select(F.col("block").alias(f"{p}_block"), F.col("pos").alias(f"{p}_pos"), "key", "chars") for s, p in (("old", "from"), ("new", "to")))
    pairs = old.join(new, ["key", "chars"]).where("from_block <> to_block").withColumn("_d", F.col("to_pos") - F.col("from_pos"))
    order = Window.partitionBy("from_block", "to_block", "_d").orderBy("from_pos")
    runs = pairs.withColumn("_g", F.col("from_pos") - F.row_number().over(order))
    return runs.groupBy("from_block", "to_block", "_d", "_g").agg(F.min("from_pos").alias("from_first"), F.max("from_pos").alias("from_last"), F.min("to_pos").alias("to_first"), F.sum("chars").alias("chars")).where(F.col("chars") >= least).drop("_d", "_g")


def paired_lines(lines: DataFrame) -> DataFrame:
    """The n-th removed line of a block with its n-th added line."""
    nth = F.row_number().over(Window.partitionBy("block", "side").orderBy("pos"))
    rows = lines.withColumn("nth", nth)
    side = lambda s: rows.where(F.col("side") == s).select("block", "nth", F.col("content").alias(s))
    return side("old").join(side("new"), ["block", "nth"], "full_outer")


def resolved_exports(exports: DataFrame, max_hops: int = 8) -> DataFrame:
    """Exports (file, name, target_file, target_name) followed to where the name is declared: (file, name, decl_file, decl_name).

    target_file is null where the name is declared. A name `*` hands on all names of the target. Each round
    joins what is known with the re-exports; cycles give no result.
    """
    known = cut(exports.where("target_file IS NULL").select("file", "name", F.col("file").alias("decl_file"), F.col("name").alias("decl_name")), "exports")
    named = exports.where("target_file IS NOT NULL AND name <> '*'").select("file", "name", "target_file", "target_name")
    stars = exports.where("target_file IS NOT NULL AND name = '*'").select("file", "target_file")
    frontier = known
    for _ in range(max_hops):
        at = frontier.select(F.col("file").alias("target_file"), F.col("name").alias("target_name"), "decl_file", "decl_name")
        found = named.join(at, ["target_file", "target_name"]).select("file", "name", "decl_file", "decl_name")
        through = stars.join(at, "target_file").where("target_name <> 'default'").select("file", F.col("target_name").alias("name"), "decl_file", "decl_name")
        new = latest_by(found.unionByName(through), ["file", "name"], F.col("decl_file"), F.col("decl_name")).join(known, ["file", "name"], "left_anti")
        frontier = cut(new, "exports")
        if frontier.isEmpty():
            break
        known = cut(known.unionByName(frontier), "exports")
    return known


def mounted_routes(mounts: DataFrame, routes: DataFrame, max_depth: int = 8) -> DataFrame:
    """Routes (router, method, path) under all prefixes that mounts (parent, router, prefix) give their router.

    A router that nothing mounts is a root.
    """
    roots = routes.select("router").union(mounts.select("parent")).distinct().join(mounts.select("router"), "router", "left_anti")
    level = cut(roots.withColumn("prefix", F.lit("")), "mounts")
    found = level
    for _ in range(max_depth):
        step = mounts.select(F.col("parent").alias("_p"), F.col("router").alias("_r"), F.col("prefix").alias("_x"))
        level = cut(level.join(step, F.col("router") == F.col("_p")).select(F.col("_r").alias("router"), F.concat("prefix", "_x").alias("prefix")).distinct(), "mounts")
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return routes.join(found, "router").select("router", "method", F.regexp_replace(F.concat("prefix", "path"), "/{2,}", "/").alias("path"))


#: Services of one selector, and workloads of the same labels, that one task pairs at most.
PAIR_BLOCK = 4096


def _kinds(rows: DataFrame, key: str, entries: str, least: int) -> tuple[DataFrame, DataFrame]:
    """(kinds: kind, entries; rows: kind, block, key): the distinct maps, and whose they are, rows of one map dealt to blocks."""
    listed = cut(rows.select(key, F.array_sort(F.map_entries(entries)).alias("entries")).where(F.size("entries") >= least).distinct(), "maps")
    kinds = cut(listed.groupBy("entries").agg(F.ceil(F.count("*") / PAIR_BLOCK).cast("int").alias("blocks")).withColumn("kind", F.monotonically_increasing_id()), "kinds")
    return kinds, listed.join(kinds, "entries").select("kind", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int").alias("block"), key)


def selected_workloads(services: DataFrame, workloads: DataFrame) -> DataFrame:
    """(service, workload) where all entries of the service's selector map are labels of the workload; repeated rows count once.

    Distinct selectors meet distinct labels by the selector's rarest entry, and the others are looked up there; rows only join
    the kinds that fit, block by block, so what travels is the input and the work is the result. Empty selectors match nothing, nor do null values.
    """
    asked, wanting = _kinds(services, "service", "selector", 1)
    given, having = _kinds(workloads, "workload", "labels", 1)
    has = given.select(F.col("kind").alias("_has"), F.col("entries").alias("_labels"), F.col("blocks").alias("_h"), F.explode("entries").alias("entry"))
    seen = has.groupBy("entry").agg(F.count("*").alias("n"))
    rare = asked.select("kind", "entries", "blocks", F.explode("entries").alias("entry")).join(seen, "entry").groupBy("kind", "entries", "blocks").agg(F.min_by("entry", F.struct("n", "entry")).alias("entry"))
    fits = F.forall("entries", lambda e: e["value"].isNotNull()) & (F.size(F.array_except("entries", "_labels")) == 0)
    met = cut(rare.join(has, "entry").where(fits).select("kind", "blocks", "_has", "_h"), "selected-kinds")
    cells = met.select("kind", "_has", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_i"), "_h").select("kind", "_has", "_i", F.explode(F.sequence(F.lit(0), F.col("_h") - 1)).alias("_j"))
    left = cells.join(wanting.withColumnRenamed("block", "_i"), ["kind", "_i"])
    right = cells.join(having.select(F.col("kind").alias("_has"), F.col("block").alias("_j"), "workload"), ["_has", "_j"])
    return left.join(right, ["kind", "_has", "_i", "_j"]).select("service", "workload")


def images_to_builds(images: DataFrame, builds: DataFrame) -> DataFrame:
    """images (image) with the one build (build, image) of the same name, else of the same last segment; several are none."""
    last = lambda c: F.substring_index(c, "/", -1)
    one = lambda df, key: df.groupBy(key).agg(F.count_distinct("build").alias("_n"), F.min("build").alias("build")).where("_n = 1").drop("_n")
    full = one(builds, "image").withColumnRenamed("build", "_full")
    tail = one(builds.withColumn("_tail", last("image")), "_tail").withColumnRenamed("build", "_short")
    several = builds.groupBy("image").agg(F.count_distinct("build").alias("_n")).where("_n > 1").select("image", F.lit(True).alias("_several"))
    j = images.join(full, "image", "left").join(several, "image", "left").withColumn("_tail", last("image")).join(tail, "_tail", "left")
    return j.select("image", F.when(F.col("_several"), F.lit(None)).otherwise(F.coalesce("_full", "_short")).alias("build"))


def spec_drift(code: DataFrame, spec: DataFrame) -> DataFrame:
    """Endpoints (method, path_key) in code and in the specification: both, code-only or spec-only."""
    c, s = (df.select("method", "path_key").distinct().withColumn(n, F.lit(True)) for df, n in ((code, "_c"), (spec, "_s")))
    return c.join(s, ["method", "path_key"], "full_outer").select("method", "path_key", F.when(F.col("_c") & F.col("_s"), "both").when(F.col("_c"), "code-only").otherwise("spec-only").alias("where"))
