"""What belongs to a change: files, tables, workloads and tests around it, cards of a map, stamps of findings. All native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeloom.checkpoints import cut
from changeloom.functions import kinds
from changeloom.functions.paths import ancestors, dir_name
from changeloom.operators.relational import keep_newest, longest_prefix


# --- around a change -------------------------------------------------------------------------------------------


def related_files(changed: DataFrame, edges: DataFrame, mentions: DataFrame, identifiers: DataFrame, most: int = 12) -> DataFrame:
    """Neighbours (file) of the changed files along edges (src, dst) that mention identifiers of the change, most of them first: file, shared.

    mentions: file, identifier.
    """
    near = edges.select(F.col("src").alias("file"), F.col("dst").alias("other")).union(edges.select("dst", "src")).join(changed.select(F.col("file").alias("other")), "other", "left_semi")
    files = near.select("file").distinct().join(changed.select("file"), "file", "left_anti")
    found = mentions.join(files, "file", "left_semi").join(identifiers.select("identifier").distinct(), "identifier", "left_semi")
    return found.groupBy("file").agg(F.count_distinct("identifier").alias("shared")).orderBy(F.desc("shared"), "file").limit(most)


def related_declarations(changed: DataFrame, calls: DataFrame, definitions: int = 12, callers: int = 8) -> DataFrame:
    """What changed declarations (id) call and what calls them (src, dst), each with how often: id, role, n."""
    ids = changed.select("id").distinct()
    side = lambda near, far, role, most: calls.join(ids.withColumnRenamed("id", near), near, "left_semi").join(ids.withColumnRenamed("id", far), far, "left_anti").groupBy(F.col(far).alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(most).select("id", F.lit(role).alias("role"), "n")
    return side("src", "dst", "definition", definitions).unionByName(side("dst", "src", "caller", callers))


def moved_texts(moves: DataFrame, base: DataFrame, head: DataFrame, most: int = 80) -> DataFrame:
    """moves (before_id, after_id, change) whose text changed as well, with the lines of both sides; base and head: id, start_line, end_line, text."""
    lines = lambda df, p: df.select(F.col("id").alias(f"{p}_id"), F.array_join(F.slice(F.split("text", "\n"), F.col("start_line"), F.least(F.lit(most), F.col("end_line") - F.col("start_line") + 1)), "\n").alias(p))
    return moves.where("change IS NOT NULL").join(lines(base, "before"), "before_id").join(lines(head, "after"), "after_id")


def moved_contracts(moved: DataFrame) -> DataFrame:
    """Of moves (before_id, after_id, change, ...) those that callers feel through the body: the code moved and changed, the signature did not."""
    return moved.where("change = 'body'").select(F.col("after_id").alias("id"), "before_id", F.lit("body").alias("kind"))


def touching(rows: DataFrame, paths: DataFrame, column: str = "file") -> DataFrame:
    """Rows whose file is one of the paths (path)."""
    return rows.join(paths.select(F.col("path").alias(column)).distinct(), column, "left_semi")


def tables_touching(paths: DataFrame, *sources: DataFrame) -> DataFrame:
    """Tables (table) that uses, models, histories, definitions or changes (table, file) in one of the paths name."""
    found = [touching(s.select("table", "file"), paths).select("table") for s in sources]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def annotated_tables(tables: DataFrame, deltas: DataFrame) -> DataFrame:
    """tables (table) with the change (table, status) of each and its place: changed ones first, then by name."""
    joined = tables.join(deltas.select("table", "status"), "table", "left")
    return joined.withColumn("place", F.row_number().over(Window.orderBy(F.col("status").isNull(), "table")))


def workloads_deploying(links: DataFrame, paths: DataFrame) -> DataFrame:
    """Workloads (workload, folder, resolved) whose resolved folder holds one of the paths."""
    owned = longest_prefix_all(paths, links.where("resolved"))
    return owned.select("workload").distinct()


def longest_prefix_all(paths: DataFrame, folders: DataFrame) -> DataFrame:
    """Each path with every folder (folder, ...) above it or equal to it."""
    opened = paths.select("path").distinct().select("path", F.explode(ancestors(F.col("path"))).alias("folder"))
    return opened.join(folders, "folder")


def with_parents(changes: DataFrame, ids: DataFrame) -> DataFrame:
    """Changes (id) of the ids, and of what lies under them: ids that continue one of them behind a slash."""
    opened = changes.withColumn("_up", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("id", "/"))), lambda n: F.array_join(F.slice(F.split("id", "/"), 1, n), "/"))))
    return opened.join(ids.select(F.col("id").alias("_up")), "_up", "left_semi").drop("_up").distinct()


def tests_of_files(files: DataFrame, reach: DataFrame, most: int = 20) -> DataFrame:
    """files (file) with the tests that reach them (file, test, hops) in one string, nearest first."""
    ranked = keep_newest(reach.join(files, "file", "left_semi"), ["file"], most, F.col("hops"), F.col("test"))
    listed = ranked.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "test"))), lambda x: x["test"]), ", ").alias("tests"))
    return files.join(listed, "file", "left")


def first_covering(reports: DataFrame) -> DataFrame:
    """reports (report, ord, file): of each file the first report that covers it."""
    return reports.groupBy("file").agg(F.min_by("report", F.struct("ord", "report")).alias("report"))


def neighbour_summaries(components: DataFrame, edges: DataFrame) -> DataFrame:
    """components (id) with what they depend on and what depends on them (src, dst), as sorted arrays."""
    side = lambda near, far, name: edges.groupBy(F.col(near).alias("id")).agg(F.array_sort(F.collect_set(far)).alias(name))
    none = F.array().cast("array<string>")
    joined = components.join(side("src", "dst", "uses"), "id", "left").join(side("dst", "src", "used_by"), "id", "left")
    return joined.withColumns({c: F.coalesce(c, none) for c in ("uses", "used_by")})


def comment_titles(lines: DataFrame, *keys: str) -> DataFrame:
    """Runs of comment lines that follow code or open a file: keys, line, title. lines: keys, line, content."""
    trimmed = lines.withColumn("content", F.trim("content")).where("content <> ''")
    comment = F.col("content").startswith("--") | F.col("content").startswith("/*") | F.col("content").startswith("#")
    flagged = trimmed.withColumn("_c", comment).withColumn("_before", F.lag("_c").over(Window.partitionBy(*keys).orderBy("line")))
    title = F.trim(F.regexp_replace(F.regexp_replace("content", r"^(--+|/\*+|#+)\s*", ""), r"\*+/\s*$", ""))
    return flagged.where("_c AND NOT coalesce(_before, false)").select(*keys, "line", F.left(title, F.lit(120)).alias("title"))


# --- repositories and findings ---------------------------------------------------------------------------------


def repo_status(job_state: Column, analysed: Column, queued: Column, stale: Column) -> Column:
    """analyzing, stale, error or up_to_date. job_state is 'unreadable' where it could not be read; queued: whether a new job could be added; stale: null if the check failed."""
    pending = job_state.isin("waiting", "active", "delayed")
    return (
        F.when(job_state == "unreadable", F.when(analysed, "up_to_date").otherwise("error"))
        .when(pending, F.when(analysed, "stale").otherwise("analyzing"))
        .when(job_state == "failed", "error")
        .when(~analysed, F.when(queued, "analyzing").otherwise("error"))
        .otherwise(F.when(F.coalesce(stale, F.lit(False)), "stale").otherwise("up_to_date"))
    )


def finding_fingerprint(category: Column, file: Column, line_range: Column, summary: Column) -> Column:
    none = F.lit("")
    return F.left(F.sha1(F.concat_ws("\0", category, F.coalesce(file, none), F.coalesce(line_range, none), F.trim(F.regexp_replace(summary, r"\s+", " ")))), F.lit(20))


def restamped(findings: DataFrame, kept: DataFrame, keys: list[str], **stamps: Column) -> DataFrame:
    """Findings, those of the kept ones with new stamps."""
    marked = findings.join(kept.select(*keys, F.lit(True).alias("_kept")).distinct(), keys, "left")
    return marked.select(*[F.when(F.col("_kept"), stamps[c]).otherwise(F.col(c)).alias(c) if c in stamps else F.col(c) for c in findings.columns])


def template_keys(text: Column) -> Column:
    """Names that a template sets, a line each; null where a loop of the template can add more."""
    plain = F.regexp_replace(F.regexp_replace(text, r"^<<-?\w+\n?", ""), r"\n?\s*\w+\s*$", "")
    found = F.array_distinct(F.filter(F.transform(F.split(plain, "\n"), lambda x: F.regexp_extract(x, r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=", 1)), lambda x: x != ""))
    return F.when(~plain.rlike(r"\{\{-?\s*range\b"), found)


def proxy_routes(tags: DataFrame) -> DataFrame:
    """tags (service, tag) of a proxy to routes: service, host, path, router."""
    rule = r"^traefik\.http\.routers\.([^.]+)\.rule=(.+)$"
    ruled = tags.where(F.col("tag").rlike(rule)).select("service", F.regexp_extract("tag", rule, 1).alias("router"), F.regexp_extract("tag", rule, 2).alias("_rule"))
    empty = lambda c: F.nullif(c, F.lit(""))
    routes = ruled.select("service", empty(F.regexp_extract("_rule", r"Host\(\s*`([^`]+)`", 1)).alias("host"), F.coalesce(empty(F.regexp_extract("_rule", r"Path(?:Prefix)?\(\s*`([^`]+)`", 1)), F.lit("/")).alias("path"), "router")
    prefix = r"^urlprefix-([^ /]*)(/[^ ]*)?(?:\s.*)?$"
    plain = tags.where(F.col("tag").rlike(prefix)).select("service", empty(F.regexp_extract("tag", prefix, 1)).alias("host"), F.coalesce(empty(F.regexp_extract("tag", prefix, 2)), F.lit("/")).alias("path"), F.lit(None).cast("string").alias("router"))
    return routes.unionByName(plain)


# --- cards of a map --------------------------------------------------------------------------------------------


def change_groups(files: DataFrame) -> DataFrame:
    """Changed files (path, owner, status) by card: id, name, files, status (the one that all of them have, else null)."""
    role, folder = kinds.file_role(F.col("path")), F.coalesce(F.nullif(dir_name(F.col("path")), F.lit("")), F.lit("."))
    key = F.when(role == "dependency", "dep").when(role == "config", "config").when(role == "docs", "docs").when(role == "test", F.concat(F.lit("test:"), F.coalesce("owner", folder))).when(F.col("owner").isNotNull(), F.concat(F.lit("code:"), "owner")).otherwise(F.concat(F.lit("new:"), folder))
    name = F.when(F.col("id") == "dep", "Dependencies").when(F.col("id") == "config", "Build & config").when(F.col("id") == "docs", "Documentation").when(F.col("id").startswith("test:"), F.concat(F.lit("Tests ("), F.substr("id", F.lit(6)), F.lit(")"))).otherwise(F.regexp_replace("id", "^(code|new):", ""))
    return files.withColumn("id", key).groupBy("id").agg(F.count("*").alias("files"), F.when(F.count_distinct("status") == 1, F.min("status")).alias("status")).withColumn("name", name)


def removed_apart(files: DataFrame, card: str = "card", large: int = 8, least: int = 2) -> DataFrame:
    """Files (card, status) of a large card with enough removed and enough other files: the removed ones on a card of their own."""
    whole, gone = Window.partitionBy(card), F.col("status") == "removed"
    counted = files.withColumn("_n", F.count("*").over(whole)).withColumn("_gone", F.count_if(gone).over(whole))
    apart = (F.col("_n") > large) & (F.col("_gone") >= least) & (F.col("_n") - F.col("_gone") >= least) & gone
    return counted.withColumn(card, F.when(apart, F.concat(F.col(card), F.lit(":removed"))).otherwise(F.col(card))).drop("_n", "_gone")


def grouped(files: DataFrame, members: DataFrame, leftover: str = "rest") -> DataFrame:
    """files (path) by the card (member, card) with the longest member that is the path or a folder above it; what fits none is left over."""
    return longest_prefix(files, members.select(F.col("member").alias("prefix"), "card")).withColumn("card", F.coalesce("card", F.lit(leftover))).drop("prefix")


def uncovered_files(files: DataFrame, members: DataFrame) -> DataFrame:
    """Files (path) on no card."""
    return longest_prefix(files, members.select(F.col("member").alias("prefix"), "card")).where("card IS NULL").select(*files.columns)


def resolved_layers(files: DataFrame, placements: DataFrame) -> DataFrame:
    """files (path) with the layer placed for the longest member (member, layer), else the one that the path tells."""
    return longest_prefix(files, placements.select(F.col("member").alias("prefix"), "layer")).withColumn("layer", F.coalesce("layer", kinds.layer(F.col("path")))).drop("prefix")


def groups_by_level(files: DataFrame) -> DataFrame:
    """files (path, feature, module) once for each level: architecture (layers), features and modules: level, card, files."""
    levels = {"architecture": kinds.layer(F.col("path")), "features": F.coalesce("feature", F.lit("other")), "modules": F.coalesce("module", F.lit("unowned"))}
    rows = files.select(F.explode(F.array(*[F.struct(F.lit(n).alias("level"), c.alias("card")) for n, c in levels.items()])).alias("x"))
    return rows.groupBy("x.level", "x.card").agg(F.count("*").alias("files"))


def paths_key(path: Column) -> Column:
    """The same text for the same set of paths, whatever their order; an aggregate."""
    return F.array_join(F.array_sort(F.collect_set(path)), "\n")


def split_card(cards: DataFrame, card: str, parts: DataFrame) -> DataFrame:
    """cards (card, member, origin): the members of one card on the parts' cards (part, member), which remember where they are from."""
    out = cards.where(F.col("card") != card)
    mine = cards.where(F.col("card") == card).join(parts, "member", "left")
    return out.unionByName(mine.select(F.coalesce("part", "card").alias("card"), "member", F.when(F.col("part").isNotNull(), F.lit(card)).otherwise(F.col("origin")).alias("origin")))


def merged_back(cards: DataFrame, card: str) -> DataFrame:
    """cards (card, member, origin) with all that was split off one card, and off what was split off it, back on it."""
    parents = cards.where("origin IS NOT NULL").select("card", "origin").distinct()
    back = frontier = cut(cards.sparkSession.createDataFrame([(card,)], "card string"), "cards")
    while True:
        new = parents.join(frontier.withColumnRenamed("card", "origin"), "origin").select("card").distinct().join(back, "card", "left_anti")
        frontier = cut(new, "cards")
        if frontier.isEmpty():
            break
        back = back.unionByName(frontier)
    own_origin = cards.where(F.col("card") == card).agg(F.min("origin").alias("o")).first()["o"]  # one row
    marked = cards.join(back.withColumn("_back", F.lit(True)), "card", "left")
    return marked.select(F.when(F.col("_back"), card).otherwise(F.col("card")).alias("card"), "member", F.when(F.col("_back"), F.lit(own_origin)).otherwise(F.col("origin")).alias("origin"))


#: Callers of a host, and what its routes lead to, that one task pairs at most.
HOST_BLOCK = 2048


def topology(routes: DataFrame, uses: DataFrame, calls: DataFrame) -> DataFrame:
    """Edges of an infrastructure, one for each pair and kind: routes (from, to), uses (from, to), and calls (from, host) by the route of the host (host, to).

    A pair that meets over several hosts is told by the least of them, so pairs need no shuffle to be told once. Hosts are cut into blocks of
    callers and of routes, and pairs of blocks meet.
    """
    kind = lambda df, k: df.select("from", "to", F.lit(k).alias("kind"))
    callers = cut(calls.where("host IS NOT NULL").groupBy("from").agg(F.array_sort(F.collect_set("host")).alias("_hosts")), "callers")
    called = cut(routes.where("host IS NOT NULL").groupBy("to").agg(F.array_sort(F.collect_set("host")).alias("_at")), "called")
    left, right = callers.select("from", "_hosts", F.explode("_hosts").alias("host")), called.select("to", "_at", F.explode("_at").alias("host"))
    blocks = lambda df, name: df.groupBy("host").agg(F.ceil(F.count("*") / HOST_BLOCK).cast("int").alias(name))
    dealt = cut(blocks(left, "_ln").join(blocks(right, "_rn"), "host"), "host-blocks")
    left = left.join(dealt, "host").select("from", "_hosts", "host", F.pmod(F.xxhash64("from"), "_ln").alias("_i"), F.explode(F.sequence(F.lit(0), F.col("_rn") - 1)).alias("_j"))
    right = right.join(dealt, "host").select("to", "_at", "host", F.explode(F.sequence(F.lit(0), F.col("_ln") - 1)).alias("_i"), F.pmod(F.xxhash64("to"), "_rn").alias("_j"))
    first = F.get(F.array_intersect("_hosts", "_at"), 0)
    by_host = left.withColumn("_i", F.col("_i").cast("int")).join(right.withColumn("_j", F.col("_j").cast("int")), ["host", "_i", "_j"]).where(((F.size("_hosts") == 1) | (F.size("_at") == 1) | (first == F.col("host"))) & (F.col("from") != F.col("to")))
    told = kind(routes, "route").unionByName(kind(uses, "uses")).where("`from` <> `to`").dropDuplicates(["from", "to", "kind"])
    return told.unionByName(kind(by_host, "calls"))


def journeys(routes: DataFrame, endpoints: DataFrame, reads: DataFrame) -> DataFrame:
    """Hops of a request by route (route, workload, prefix): the route, its workload, the endpoints (workload, endpoint, path) under the prefix, their tables (endpoint, table): route, hop, step."""
    base = routes.select("route", "workload", "prefix")
    reached = base.join(endpoints, "workload").where(F.col("path").startswith(F.col("prefix")))
    hop = lambda df, n, step: df.select("route", F.lit(n).alias("hop"), step.alias("step"))
    return hop(base, 1, F.col("route")).unionByName(hop(base, 2, F.col("workload"))).unionByName(hop(reached, 3, F.col("endpoint"))).unionByName(hop(reached.join(reads, "endpoint"), 4, F.col("table"))).distinct()


def public_declarations(decls: DataFrame) -> DataFrame:
    """Declarations (id, parent, exported, name) that others can use: exported ones, and members of exported ones whose names do not begin with # or _."""
    shown = decls.where("exported").select(F.col("id").alias("_id"))
    member = decls.where("NOT exported").join(shown, F.col("parent") == F.col("_id"), "left_semi").where(~F.col("name").rlike("^[#_]"))
    return decls.where("exported").unionByName(member)
