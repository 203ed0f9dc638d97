"""Catalogs: pages of history, test frameworks and what tests cover, settings with their tags, findings by contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeloom.checkpoints import cut
from changeloom.functions import kinds
from changeloom.functions.paths import ancestors, base_name, dir_name, extension
from changeloom.operators.relational import keep_newest, latest_by
from changeloom.operators.rules import env_gaps

# --- history ---------------------------------------------------------------------------------------------------


def history_page(commits: DataFrame, n: int = 50, before: DataFrame | None = None) -> DataFrame:
    """The n newest commits of each repository (repo, sha, authored_at, and others), older than where its page before ended, with nth.

    before: repo, authored_at, sha of the last commit seen; repositories that are not there start with their newest. Ties by sha. Each task keeps n of a repository.
    """
    rows = commits
    if before is not None:
        last = before.select(F.col("repo").alias("_repo"), F.col("authored_at").alias("_at"), F.col("sha").alias("_sha"))
        older = F.col("_repo").isNull() | (F.col("authored_at") < F.col("_at")) | (F.col("authored_at") == F.col("_at")) & (F.col("sha") > F.col("_sha"))
        rows = commits.join(last, F.col("repo") == F.col("_repo"), "left").where(older).drop("_repo", "_at", "_sha")
    return keep_newest(rows, ["repo"], n, F.col("authored_at").desc_nulls_last(), F.col("sha"))


#: Paths up to this many are broadcast (some 100 bytes each), more are joined by a shuffle.
BROADCAST_PATHS = 100_000


def day_of(rows: DataFrame, column: str) -> Column:
    """What orders as the column does, with fewer values: days of times, the first ten characters of texts, else the value."""
    kind = rows.schema[column].dataType.typeName()
    if kind == "timestamp":
        return F.floor(F.unix_micros(column) / 86_400_000_000)
    if kind == "timestamp_ntz":
        return F.to_date(column)
    return F.substring(column, 1, 10) if kind == "string" else F.col(column)


def path_history(touched: DataFrame, paths: DataFrame, n: int = 20) -> DataFrame:
    """Of each path (path: a file, a folder, or empty for all) the n newest commits of touched (sha, authored_at, file) that touch it or something under it: path, nth, sha, authored_at.

    A file is opened to the folders above it, which meet the paths by equality. The commits of a path and day are counted first, by bits of their hashes and so never too many: days before
    those that surely hold n are left out before commits are sorted or told apart.
    """
    opened = touched.where("file IS NOT NULL").select("sha", "authored_at", F.explode(ancestors(F.col("file"))).alias("path"))
    wanted = paths.select("path").distinct()
    few = wanted.limit(BROADCAST_PATHS + 1).count() <= BROADCAST_PATHS
    met = opened.join(F.broadcast(wanted) if few else wanted, "path").withColumn("_day", day_of(touched, "authored_at"))
    bits = F.expr("bit_or(shiftleft(1L, cast(pmod(xxhash64(sha), 64) AS int)))")
    days = met.groupBy("path", "_day").agg(F.bit_count(bits).alias("k"))
    newer = Window.partitionBy("path").orderBy(F.col("_day").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    since = cut(days.withColumn("_sum", F.sum("k").over(newer)).where(F.col("_sum") >= n).groupBy("path").agg(F.max_by(F.struct("_day"), -F.col("_sum")).alias("_since")), "since")
    late = F.col("_since").isNull() | F.col("_since._day").isNull() | (F.col("_day") >= F.col("_since._day"))
    found = met.join(F.broadcast(since) if few else since.hint("merge"), "path", "left").where(late).select("path", "sha", "authored_at").distinct()
    return keep_newest(found, ["path"], n, F.col("authored_at").desc_nulls_last(), F.col("sha"))


# --- tests -----------------------------------------------------------------------------------------------------

#: Which files set a framework up, by name; which dependencies and scripts of a package name one; what an import says; and the order of unit frameworks of one root (fixed values).
SETUP_FILES = [(r"^vitest\.(config|workspace)\.[cm]?[jt]s$", "vitest"), (r"^jest\.config\.([cm]?[jt]s|json)$", "jest"), (r"^playwright\.config\.[cm]?[jt]s$", "playwright"), (r"^cypress\.(config\.[cm]?[jt]s|json)$", "cypress"), (r"^\.mocharc(\.[a-z]+)?$", "mocha"), (r"^(pytest\.ini|conftest\.py)$", "pytest")]
PACKAGES = [(r"^vitest$", "vitest"), (r"^(jest|@jest/globals|ts-jest|babel-jest)$", "jest"), (r"^(@playwright/test|playwright)$", "playwright"), (r"^cypress$", "cypress"), (r"^mocha$", "mocha")]
SCRIPTS = [(r"\bvitest\b", "vitest"), (r"\bjest\b", "jest"), (r"\bplaywright\s+test\b", "playwright"), (r"\bcypress\s+(run|open)\b", "cypress"), (r"\bmocha\b", "mocha"), (r"\bnode\s+(?:[^&|;]*\s)?--test\b", "node")]
IMPORTS = [(r"^@playwright/test$", "playwright"), (r"^vitest(/|$)", "vitest"), (r"^@jest/globals$", "jest"), (r"^(node:)?test$", "node"), (r"^mocha$", "mocha"), (r"^cypress$", "cypress"), (r"^pytest$", "pytest"), (r"^org\.junit\b", "junit")]
UNIT_ORDER = "vitest jest mocha node".split()
PYTEST = r"""(?m)\[tool\.pytest|\[tool:pytest\]|^\[pytest\]|(^|[\s"'])pytest([<>=~!\s"',\]]|$)"""


def named_by(text: Column, table: list[tuple[str, str]]) -> Column:
    """All frameworks whose pattern is found in the text."""
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(name)) for p, name in table]), lambda x: x.isNotNull())


def framework_uses(files: DataFrame) -> DataFrame:
    """framework, root of files (path, text or null): the folders that are set up for a test framework, by setup files and manifests."""
    name = base_name(F.col("path"))
    package = F.from_json("text", "dependencies map<string,string>, devDependencies map<string,string>, scripts map<string,string>, jest map<string,string>")
    rows = files.where(~F.coalesce(F.col("path").rlike(r"(^|/)node_modules/"), F.lit(True))).select("path", name.alias("_name"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("_p", F.when(F.col("_name") == "package.json", package))
    of_map = lambda m, part, table: F.flatten(F.transform(F.coalesce(part(m), F.array().cast("array<string>")), lambda x: named_by(x, table)))
    found = F.concat(
        named_by(F.col("_name"), SETUP_FILES), of_map(F.col("_p.dependencies"), F.map_keys, PACKAGES), of_map(F.col("_p.devDependencies"), F.map_keys, PACKAGES), of_map(F.col("_p.scripts"), F.map_values, SCRIPTS),
        F.when(F.col("_p.jest").isNotNull(), F.array(F.lit("jest"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("_name").rlike(r"^(pyproject\.toml|setup\.cfg|tox\.ini|requirements[^/]*\.txt|Pipfile)$") & F.col("text").rlike(PYTEST), F.array(F.lit("pytest"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("_name").rlike(r"^(pom\.xml|build\.gradle(\.kts)?)$") & F.col("text").rlike("(?i)junit"), F.array(F.lit("junit"))).otherwise(F.array().cast("array<string>")),
    )
    uses = rows.select(F.explode(found).alias("framework"), dir_name(F.col("path")).alias("root"))
    # A Go module has tests if any file of the tree is one.
    go = rows.where("_name = 'go.mod'").select(F.lit("go").alias("framework"), dir_name(F.col("path")).alias("root"))
    return uses.unionByName(go.join(rows.where("path LIKE '%\\\\_test.go'").limit(1).select(F.lit(1).alias("_any")), F.col("_any") == 1, "left_semi")).distinct()


def framework_of(tests: DataFrame, imports: DataFrame, uses: DataFrame) -> DataFrame:
    """path, framework of tests (path): by what they import (path, nth, source), else by their language, else by what their nearest folder is set up for.

    End-to-end tests look for an end-to-end framework first. Folders above a test meet the uses (framework, root) by equality.
    """
    t = tests.where("path IS NOT NULL").select("path").distinct()
    hint = F.coalesce(*[F.when(F.col("source").rlike(p), name) for p, name in IMPORTS])
    by_import = imports.withColumn("_hint", hint).where("_hint IS NOT NULL").groupBy("path").agg(F.min_by("_hint", F.struct("nth", "source")).alias("_import"))
    near = t.select("path", F.posexplode(ancestors(dir_name(F.col("path")))).alias("_up", "root")).join(uses.select("root", "framework").distinct(), "root")
    unit = F.array_position(F.array(*map(F.lit, UNIT_ORDER)), F.col("framework"))
    by_root = near.groupBy("path").agg(
        F.min_by("framework", F.when(F.col("framework").isin(UNIT_ORDER), F.struct("_up", unit.alias("u")))).alias("_unit"),
        F.min_by("framework", F.when(F.col("framework").isin("playwright", "cypress"), F.struct("_up", "framework"))).alias("_e2e"),
    )
    any_pytest = uses.where("framework = 'pytest'").limit(1).select(F.lit(True).alias("_pytest"))
    ext, path = extension(F.col("path")), F.col("path")
    script, e2e = ext.rlike("^[cm]?[jt]sx?$"), path.rlike(kinds.E2E_PATH)
    chosen = (
        F.when(F.col("_import").isNotNull(), F.col("_import")).when(ext == "go", "go").when(ext == "py", F.when(F.coalesce("_pytest", F.lit(False)), "pytest").otherwise("unittest")).when(ext.isin("java", "kt", "kts", "scala"), "junit")
        .when(path.rlike(r"\.cy\.[^./]+$") | path.rlike(r"(^|/)cypress(/|$)"), "cypress").when(~script, "other").when(e2e & F.col("_e2e").isNotNull(), F.col("_e2e")).otherwise(F.coalesce("_unit", F.lit("other")))
    )
    return t.join(by_import, "path", "left").join(by_root, "path", "left").join(F.broadcast(any_pytest), F.lit(True), "left").select("path", chosen.alias("framework"))


def test_changes(base: DataFrame, head: DataFrame, sources: DataFrame, reach: DataFrame, added: DataFrame, coverage: DataFrame, base_sources: DataFrame, subjects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changed code, findings) of a change.

    base, head: tests (file). sources: code of the head (file); base_sources: of the base. reach: file, test, hops (which tests reach which code at the head). added: file, line (lines
    that the change wrote, of code and tests). coverage: file, line, hits. subjects: test, file (what a test of the base tested).

    Changed code: file, status (added or modified), n_lines, n_tests, n_changed_tests, hops, n_instrumented, n_missed. Findings: rule, file, line. `uncovered-lines`: all instrumented lines of those that
    were written are missed; `untested`: no test reaches the file, while one reaches another of its type in its folder; `deleted-test`: a test is gone, and something that it tested
    is still there. A line that the report doesn't have is neither covered nor missed; of repeated lines the most hits count.
    """
    lines = added.where("file IS NOT NULL AND line IS NOT NULL").select("file", "line").distinct()
    hits = coverage.groupBy("file", "line").agg(F.max("hits").alias("hits"))
    code = lines.join(sources.select("file").distinct(), "file", "left_semi")
    of_lines = code.join(hits, ["file", "line"], "left").groupBy("file").agg(F.count("*").alias("n_lines"), F.min("line").alias("first"), F.count("hits").alias("n_instrumented"), F.count_if(F.col("hits") == 0).alias("n_missed"), F.min(F.when(F.col("hits") == 0, F.col("line"))).alias("_missed"))
    r = reach.select("file", "test", "hops").join(head.select(F.col("file").alias("test")).distinct(), "test", "left_semi").groupBy("file", "test").agg(F.min("hops").alias("hops"))
    touched = lines.select(F.col("file").alias("test")).distinct().withColumn("_touched", F.lit(True))
    of_tests = r.join(touched, "test", "left").groupBy("file").agg(F.count("*").alias("n_tests"), F.count("_touched").alias("n_changed_tests"), F.min("hops").alias("hops"))
    was = base_sources.select("file").distinct().withColumn("_was", F.lit(True))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    place = F.struct(dir_name(F.col("file")).alias("folder"), extension(F.col("file")).alias("type"))
    tested = sources.select("file").join(of_tests.select("file"), "file", "left_semi").select(place.alias("_place")).distinct().withColumn("_tested", F.lit(True))
    joined = of_lines.join(of_tests, "file", "left").join(was, "file", "left").withColumn("_place", place).join(tested, "_place", "left")
    code_rows = joined.select("file", F.when(F.col("_was"), "modified").otherwise("added").alias("status"), "n_lines", zero("n_tests"), zero("n_changed_tests"), "hops", "n_instrumented", "n_missed")
    bare = joined.where("n_tests IS NULL AND _tested").select(F.lit("untested").alias("rule"), "file", F.col("first").alias("line"))
    missed = joined.where("n_missed > 0 AND n_missed = n_instrumented").select(F.lit("uncovered-lines").alias("rule"), "file", F.col("_missed").alias("line"))
    there = sources.select("file").unionByName(head.select("file")).distinct()
    gone = base.select(F.col("file").alias("test")).distinct().join(head.select(F.col("file").alias("test")), "test", "left_anti")
    left = gone.join(subjects.select("test", "file").join(there, "file", "left_semi").select("test").distinct(), "test", "left_semi")
    return code_rows, bare.unionByName(missed).unionByName(left.select(F.lit("deleted-test").alias("rule"), F.col("test").alias("file"), F.lit(None).cast("int").alias("line")))


def test_catalog(tests: DataFrame, frameworks: DataFrame, reach: DataFrame, sources: DataFrame, coverage: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tests: file, framework, kind, cases, n_sources; sources: file, n_tests, hops, n_lines, n_hit). tests: file, cases; frameworks: path, framework; reach: file, test, hops; coverage: file, line, hits."""
    r = reach.select("file", "test", "hops").join(sources.select("file").distinct(), "file", "left_semi").join(tests.select(F.col("file").alias("test")).distinct(), "test", "left_semi").groupBy("file", "test").agg(F.min("hops").alias("hops"))
    t = latest_by(tests.select("file", "cases"), ["file"], F.desc("cases")).join(frameworks.select(F.col("path").alias("file"), "framework"), "file", "left")
    n = r.groupBy(F.col("test").alias("file")).agg(F.count("*").alias("n_sources"))
    told = t.join(n, "file", "left").select("file", F.coalesce("framework", F.lit("other")).alias("framework"), kinds.test_kind(F.col("file"), F.col("framework")).alias("kind"), "cases", F.coalesce("n_sources", F.lit(0)).alias("n_sources"))
    seen = coverage.groupBy("file", "line").agg(F.max("hits").alias("hits")).groupBy("file").agg(F.count("*").alias("n_lines"), F.count_if(F.col("hits") > 0).alias("n_hit"))
    of = r.groupBy("file").agg(F.count("*").alias("n_tests"), F.min("hops").alias("hops"))
    return told, sources.select("file").distinct().join(of, "file", "left").join(seen, "file", "left").withColumn("n_tests", F.coalesce("n_tests", F.lit(0)))


# --- settings --------------------------------------------------------------------------------------------------

SECRET_NAME = r"(?i)(^|_)(secret|token|password|passwd|pwd|api_?key|private_?key|credentials?)(_|$)"


def env_catalog(reads: DataFrame, decls: DataFrame, sets: DataFrame, *, prefixes: tuple[str, ...] = ("NEXT_PUBLIC_", "VITE_", "REACT_APP_"), platform: tuple[str, ...] = ("NODE_ENV", "PATH", "HOME", "CI")) -> DataFrame:
    """name, n_reads, n_decls, n_sets, tags: every setting that is read, declared or set, with what is wrong or special about it.

    reads: name, file, line, fallback, test, client. decls: name, scope, via, client. sets: name, scope, target, ref, secret, client. Tags, in this order: platform; undeclared, not-set and maybe-set (of its reads, as in
    env_gaps); set-not-read (set, but neither read nor declared but as an example); secret (by its name, or a value marked so); client (by prefix, or a set or declaration for the client); and undefined-in-client (read
    there, and neither client nor platform). Null names are left out, null flags are false. Example sets are no sets.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    known = lambda df: df.where("name IS NOT NULL")
    reads, decls, sets = known(reads), known(decls), known(sets).where("NOT (target <=> 'example')")
    gaps = env_gaps(reads, decls.select("name", "scope"), sets.select("name", "scope", yes("ref").alias("ref")), list(platform)).groupBy("name").agg(F.collect_set("gap").alias("gaps"))
    r = reads.groupBy("name").agg(F.count("*").alias("n_reads"), F.bool_or(yes("client") & ~yes("test")).alias("r_client"))
    d = decls.groupBy("name").agg(F.count("*").alias("n_decls"), F.bool_or(F.col("via") != "example").alias("d_real"), F.bool_or(yes("client")).alias("d_client"))
    s = sets.groupBy("name").agg(F.count("*").alias("n_sets"), F.bool_or(yes("secret")).alias("s_secret"), F.bool_or(yes("client")).alias("s_client"))
    v = r.join(d, "name", "full").join(s, "name", "full").join(gaps, "name", "left")
    own, client = F.col("name").isin(list(platform)), F.col("name").rlike("^(" + "|".join(prefixes) + ")") | yes("d_client") | yes("s_client")
    gap = lambda g: F.coalesce(F.array_contains("gaps", g), F.lit(False))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    tags = [
        ("platform", own), ("undeclared", gap("undeclared")), ("not-set", gap("not-set")), ("maybe-set", gap("maybe-set")), ("set-not-read", ~own & (n("n_sets") > 0) & (n("n_reads") == 0) & ~yes("d_real")),
        ("secret", F.col("name").rlike(SECRET_NAME) | yes("s_secret")), ("client", client), ("undefined-in-client", ~own & ~client & yes("r_client")),
    ]
    listed = F.filter(F.array(*[F.when(c, F.lit(t)) for t, c in tags]), lambda x: x.isNotNull())
    return v.select("name", n("n_reads").alias("n_reads"), n("n_decls").alias("n_decls"), n("n_sets").alias("n_sets"), listed.alias("tags"))


# --- findings --------------------------------------------------------------------------------------------------


def impact_findings(verdicts: DataFrame, owners: DataFrame, most: int = 20) -> DataFrame:
    """One finding for each contract and file that it breaks: contract, file, component, line, n_lines, reason, places.

    verdicts: contract, file, line, reason (a caller's line that no longer fits). The first line and its reason stand for the file; places are the first `most` lines with theirs. owners: file, component. A repeated
    line counts once, by its least reason; blank reasons become `this usage no longer fits.`.
    """
    told = verdicts.where("contract IS NOT NULL AND file IS NOT NULL AND line IS NOT NULL").groupBy("contract", "file", "line").agg(F.min(F.nullif(F.trim("reason"), F.lit(""))).alias("reason"))
    text = F.coalesce("reason", F.lit("this usage no longer fits."))
    order = Window.partitionBy("contract", "file").orderBy("line")
    ranked = told.withColumn("_n", F.row_number().over(order))
    found = ranked.groupBy("contract", "file").agg(
        F.min("line").alias("line"), F.count("*").alias("n_lines"), F.min_by(text, "line").alias("reason"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") <= most, F.struct("line", text.alias("t"))))), lambda x: F.concat(F.lit("line "), x["line"].cast("string"), F.lit(": "), x["t"])), "\n").alias("places"),
    )
    of = owners.groupBy("file").agg(F.min("component").alias("component"))
    return found.join(of, "file", "left").select("contract", "file", "component", "line", "n_lines", "reason", "places")
