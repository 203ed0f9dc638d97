"""Facts out of text columns: lines, diffs, reports, settings. All of them are native expressions."""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeloom.functions.text import content_id, entropy
from changeloom.operators.relational import TASK_ROWS

#: Shapes of vendor tokens by kind (fixed values).
TOKENS = [
    ("openai", r"\bsk-(?:proj-|ant-)?[A-Za-z0-9_-]{20,}"),
    ("aws", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"), ("github", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"), ("stripe", r"\b[sr]k_live_[A-Za-z0-9]{16,}\b"), ("gitlab", r"\bglpat-[A-Za-z0-9_-]{20,}"),
    ("slack", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"), ("google", r"\bAIza[0-9A-Za-z_-]{35}"), ("sendgrid", r"\bSG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"), ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("url_password", r"\b[a-z][a-z0-9+.-]*://[^/\s:@]+:[^/\s:@]{4,}@(?:[\w.:\[\]-]*)"), ("assigned", r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\s*[:=]\s*[\"']?[A-Za-z0-9+/_.=-]{16,}"),
]
RANDOM = r"""[:=]\s*["']([A-Za-z0-9+/_=-]{20,})["']"""
LOCAL_HOST = r"@(localhost|127\.0\.0\.1|0\.0\.0\.0|\[?::1|host\.docker\.internal)"
PLACEHOLDER = r"(?i)x{4,}|example|changeme|<[a-z_]+>|\$\{|your[-_]|(.)\1{7,}"


def lines_of(files: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """One row for each line: line (from 1) and content."""
    return files.select(*keep, F.posexplode(F.split(text, "\n")).alias("_i", "content")).withColumn("line", F.col("_i") + 1).drop("_i")


def grep(files: DataFrame, pattern: str, *keep: str, whole_word: bool = False) -> DataFrame:
    """Lines that hold the pattern; files that do not hold it at all are not opened to lines."""
    found = rf"\b(?:{pattern})\b" if whole_word else pattern
    return lines_of(files.where(F.col("text").rlike(found)), "text", *keep).where(F.col("content").rlike(found))


#: What a line of a diff says: the paths of a file, without what follows them, and where a hunk stands. Line ends within a line end a path, as in the engine's patterns.
OLD_PATH, NEW_PATH = (re.compile(rf"{mark} ([^\r\u0085\u2028\u2029]*)[\r\u0085\u2028\u2029]?\Z") for mark in ("---", r"\+\+\+"))
HUNK = re.compile(r"@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@")


def diff_spans(text: str) -> list[tuple[str, str, int, int]]:
    """file, side, first and last line of what the hunks of a diff cover, without overlaps."""

    def path(found):
        name = re.sub("^[ab]/", "", found[1].strip(" ")) if found else ""
        return None if name == "/dev/null" else name

    spans, old, file = {}, None, None
    for line in text.split("\n"):
        if line.startswith("--- "):
            old = path(OLD_PATH.match(line)) or ""
        elif line.startswith("+++ "):
            new = path(NEW_PATH.match(line))
            file = new if new is not None else old or file
        elif file is not None and (hunk := HUNK.match(line)):
            for side, start, n in (("old", hunk[1], hunk[2]), ("new", hunk[3], hunk[4])):
                if int(n or 1) > 0:
                    spans.setdefault((file, side), []).append((int(start), int(start) + int(n or 1) - 1))
    out = []
    for (name, side), found in spans.items():
        first, last = None, None
        for start, end in sorted(found):
            if last is not None and start <= last + 1:
                last = max(last, end)
                continue
            if last is not None:
                out.append((name, side, first, last))
            first, last = start, end
        out.append((name, side, first, last))
    return out


def diff_lines(diffs: DataFrame, key: str = "diff_id") -> DataFrame:
    """Unified diffs (key, text), a row each, to key, file, side, line: the lines that were removed (old) and added (new), once each.

    A deleted file's lines are named by its old path. A text is read in its row, and only the spans of its hunks leave it.
    """
    types = {f.name: f.dataType.simpleString() for f in diffs.schema}

    def read(batches):
        for batch in batches:
            found = [(i, *span) for i, text in enumerate(batch["text"].to_pylist()) if text is not None for span in diff_spans(text)]
            which, *columns = zip(*found, strict=True) if found else ((),) * 5
            told = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch[key].take(pa.array(which, pa.int64())), *told], names=[key, "file", "side", "first", "last"])

    spans = diffs.select(key, "text").mapInArrow(read, f"`{key}` {types[key]}, file string, side string, first int, last int")
    return spans.select(key, "file", "side", F.explode(F.sequence("first", "last")).alias("line"))



def may_hold_secret(text: Column) -> Column:
    """Whether any of the shapes is found in the whole text: one search, so that texts without one are not opened to lines."""
    return text.rlike("|".join(f"(?:{p})" for p in (*(p for _, p in TOKENS), RANDOM)))


def secret_lines(lines: DataFrame, *keep: str) -> DataFrame:
    """Lines (content) that hold a secret: the kind and a fingerprint, never the value. Placeholders and local addresses are left out.

    Lines of more than 2000 characters are taken for generated ones and left out. Beside the known shapes, a value
    of 20 characters or more that is assigned to anything counts as random from 4.2 bits a character on.
    """
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract("content", p, 0).alias("value")) for k, p in TOKENS], F.struct(F.lit("random").alias("kind"), F.regexp_extract("content", RANDOM, 1).alias("value")))
    short = lines.where(F.length("content") <= 2000)
    found = short.select(*keep, F.explode(F.filter(kinds, lambda x: x["value"] != "")).alias("x")).where(~F.col("x.value").rlike(PLACEHOLDER))
    local, mixed = (F.col("x.kind") == "url_password") & F.col("x.value").rlike(LOCAL_HOST), entropy(F.col("x.value")) >= 4.2
    told = found.where(~local & ((F.col("x.kind") != "random") | mixed))
    return told.select(*keep, "x.kind", content_id(F.col("x.value"), length=12).alias("fingerprint"))


def lcov_lines(reports: DataFrame, key: str = "report") -> DataFrame:
    """LCOV reports (key, text) to key, file, line, hits."""
    rows = lines_of(reports, "text", key)
    order = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    file = F.last(F.when(F.col("content").startswith("SF:"), F.trim(F.substring("content", 4, 4096))), ignorenulls=True).over(order)
    found = rows.withColumn("file", file).where(F.col("content").rlike(r"^DA:\d+,\d+"))
    return found.select(key, "file", F.regexp_extract("content", r"^DA:(\d+),(\d+)", 1).cast("int").alias("line"), F.regexp_extract("content", r"^DA:(\d+),(\d+)", 2).cast("long").alias("hits"))


def cobertura_lines(reports: DataFrame, key: str = "report") -> DataFrame:
    """Cobertura XML reports (key, text) to key, file, line, hits."""
    classes = reports.select(key, F.explode(F.regexp_extract_all("text", F.lit(r'(?s)(<class [^>]*filename="[^"]*".*?</class>)'), F.lit(1))).alias("c"))
    lines = classes.select(key, F.regexp_extract("c", r'filename="([^"]*)"', 1).alias("file"), F.explode(F.regexp_extract_all("c", F.lit(r"(<line [^>]*>)"), F.lit(1))).alias("l"))
    return lines.select(key, "file", F.regexp_extract("l", r'number="(\d+)"', 1).cast("int").alias("line"), F.regexp_extract("l", r'hits="(\d+)"', 1).cast("long").alias("hits"))


def merged_coverage(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Most hits of each line, then lines, hit and missed of each file; lines are dealt by their number, before they are grouped and after."""
    n = max(1, math.ceil(lines.count() / TASK_ROWS))
    best = lines.repartition(n, *keys, "line").groupBy(*keys, "line").agg(F.max("hits").alias("hits")).repartition(n, *keys)
    return best.groupBy(*keys).agg(F.count("*").alias("n_lines"), F.count_if(F.col("hits") > 0).alias("n_hit"), F.count_if(F.col("hits") == 0).alias("n_missed"))


def dotenv_sets(files: DataFrame, *keep: str) -> DataFrame:
    """Assignments of env files: name, value (without quotes), line."""
    pattern = r"^\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*$"
    rows = lines_of(files, "text", *keep).where(F.col("content").rlike(pattern))
    value = F.regexp_replace(F.regexp_extract("content", pattern, 2), r"""^(["'])(.*)\1$""", "$2")
    return rows.select(*keep, "line", F.regexp_extract("content", pattern, 1).alias("name"), value.alias("value"))


def env_reads(files: DataFrame, *keep: str) -> DataFrame:
    """Names of environment variables that code reads, by line."""
    pattern = r"""(?:process\.env\.|process\.env\[["']|os\.environ\[["']|os\.environ\.get\(["']|os\.getenv\(["']|System\.getenv\("|env::var\("|os\.Getenv\(")([A-Za-z_]\w*)"""
    rows = lines_of(files.where(F.col("text").rlike(pattern)), "text", *keep)
    return rows.select(*keep, "line", F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(1))).alias("name"))


def placeholders(files: DataFrame, *keep: str) -> DataFrame:
    """`${NAME}` and `${NAME:default}` by line."""
    pattern = r"\$\{([A-Za-z_][A-Za-z0-9_.]*)(?::([^}]*))?\}"
    rows = lines_of(files.where(F.col("text").rlike(pattern)), "text", *keep).withColumn("m", F.explode(F.regexp_extract_all("content", F.lit(f"({pattern})"), F.lit(1))))
    has = F.col("m").contains(":")
    return rows.select(*keep, "line", F.regexp_extract("m", pattern, 1).alias("name"), F.when(has, F.regexp_extract("m", pattern, 2)).alias("fallback"))


def dockerfile_instructions(files: DataFrame, *keep: str) -> DataFrame:
    """Instructions with their stage: lines that end in a backslash are joined with the next, comments go."""
    joined = files.withColumn("text", F.regexp_replace(F.regexp_replace("text", r"(?m)^\s*#.*\n?", ""), r"\\[ \t]*\n\s*", " "))
    rows = lines_of(joined, "text", *keep).where(F.col("content").rlike(r"^\s*[A-Za-z]+\s+\S")).withColumn("instruction", F.upper(F.regexp_extract("content", r"^\s*([A-Za-z]+)", 1))).withColumn("value", F.trim(F.regexp_extract("content", r"^\s*[A-Za-z]+\s+(.*)$", 1)))
    order = Window.partitionBy(*keep).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    stage = F.sum(F.when(F.col("instruction") == "FROM", 1).otherwise(0)).over(order) - 1
    return rows.select(*keep, stage.alias("stage"), F.row_number().over(Window.partitionBy(*keep).orderBy("line")).alias("nth"), "instruction", "value")


def manifest_scripts(files: DataFrame, *keep: str) -> DataFrame:
    """name and command of the scripts of JSON manifests."""
    return files.select(*keep, F.explode(F.from_json(F.get_json_object("text", "$.scripts"), "map<string,string>")).alias("name", "command"))


def commit_log(text: DataFrame, column: str = "value") -> DataFrame:
    """Records of a log whose header has its fields between unit separators and whose lines after it are numstat rows."""
    lines = F.filter(F.split(column, "\n"), lambda x: F.trim(x) != "")
    records = text.where(F.trim(column) != "").select(lines.alias("_l"))
    header = F.split(F.get("_l", 0), "\x1f")
    stats = F.transform(F.filter(F.slice("_l", 2, F.greatest(F.lit(0), F.size("_l") - 1)), lambda x: x.rlike(r"^(\d+|-)\t(\d+|-)\t")), lambda x: F.split(x, "\t"))
    add = lambda i: F.aggregate(stats, F.lit(0).cast("long"), lambda a, s: a + F.when(s[i] == "-", 0).otherwise(s[i]).cast("long"))
    return records.select(F.get(header, 0).alias("name"), F.get(header, 1).alias("email"), F.get(header, 2).alias("authored_at"), add(0).alias("added"), add(1).alias("removed"), F.size(stats).alias("files"))


def test_markers(files: DataFrame, *keep: str) -> DataFrame:
    """Lines that focus or skip tests."""
    focus, skip = r"\b(?:it|test|describe)\.only\b|\bf(?:it|describe)\(", r"\b(?:it|test|describe)\.(?:skip|todo)\b|\bx(?:it|describe)\(|@(?:Disabled|Ignore)\b|@pytest\.mark\.skip"
    rows = lines_of(files.where(F.col("text").rlike(f"{focus}|{skip}")), "text", *keep)
    return rows.withColumn("kind", F.when(F.col("content").rlike(focus), "focus").when(F.col("content").rlike(skip), "skip")).where("kind IS NOT NULL").select(*keep, "line", "kind")



# --- reports and diffs of other formats ------------------------------------------------------------------------


def coverage_format(text: Column) -> Column:
    """lcov, cobertura, jacoco or istanbul, by how a report begins; null for none."""
    start = F.left(text, F.lit(2000))
    return F.when(start.rlike(r"(?m)^SF:"), "lcov").when(start.rlike(r"<report\b") & text.contains("<sourcefile"), "jacoco").when(start.rlike(r"<coverage\b"), "cobertura").when(start.rlike(r"^\s*\{") & text.contains('"statementMap"'), "istanbul")


def istanbul_lines(reports: DataFrame, key: str = "report") -> DataFrame:
    """Istanbul JSON reports (key, text) to key, file, line, hits: the statements that begin on a line, the most hit of them."""
    statement = "map<string, struct<path: string, statementMap: map<string, struct<start: struct<line: int>>>, s: map<string, bigint>>>"
    files = reports.select(key, F.explode(F.from_json("text", statement)).alias("_name", "f")).select(key, F.coalesce("f.path", "_name").alias("file"), "f.statementMap", "f.s")
    rows = files.select(key, "file", "s", F.explode("statementMap").alias("_id", "at")).where("at.start.line IS NOT NULL")
    return rows.groupBy(key, "file", F.col("at.start.line").alias("line")).agg(F.max(F.coalesce(F.col("s")[F.col("_id")], F.lit(0))).alias("hits"))


def jacoco_lines(reports: DataFrame, key: str = "report") -> DataFrame:
    """JaCoCo XML reports (key, text) to key, file (package and source file), line, hits (covered instructions); lines without instructions are left out."""
    packages = reports.select(key, F.explode(F.regexp_extract_all("text", F.lit(r'(?s)(<package\b.*?</package>)'), F.lit(1))).alias("p"))
    sources = packages.select(key, F.regexp_extract("p", r'<package\b[^>]*\bname="([^"]*)"', 1).alias("package"), F.explode(F.regexp_extract_all("p", F.lit(r'(?s)(<sourcefile\b.*?</sourcefile>)'), F.lit(1))).alias("s"))
    lines = sources.select(key, F.concat_ws("/", F.nullif("package", F.lit("")), F.regexp_extract("s", r'<sourcefile\b[^>]*\bname="([^"]*)"', 1)).alias("file"), F.explode(F.regexp_extract_all("s", F.lit(r"(<line\b[^>]*>)"), F.lit(1))).alias("l"))
    number = lambda name, kind: F.coalesce(F.nullif(F.regexp_extract("l", rf'\b{name}="(\d+)"', 1), F.lit("")), F.lit("0")).cast(kind)
    return lines.select(key, "file", number("nr", "int").alias("line"), number("ci", "long").alias("hits"), number("mi", "long").alias("_missed")).where("hits + _missed > 0").drop("_missed")


def coverage_lines(reports: DataFrame, key: str = "report") -> DataFrame:
    """Reports of the four formats, whichever each is, to key, file, line, hits."""
    known = reports.withColumn("_format", coverage_format(F.col("text")))
    readers = {"lcov": lcov_lines, "cobertura": cobertura_lines, "jacoco": jacoco_lines, "istanbul": istanbul_lines}
    found = [read(known.where(F.col("_format") == name), key).select(key, "file", "line", "hits") for name, read in readers.items()]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def split_diffs(diffs: DataFrame, key: str = "diff_id") -> DataFrame:
    """Diffs of many files (key, text) to key, path, patch: a row for each file with hunks, by its new name, else by its old one."""
    chunks = diffs.select(key, F.explode(F.split("text", r"(?m)^(?=diff --git )")).alias("patch")).where(F.col("patch").startswith("diff --git ") & F.col("patch").contains("\n@@ "))
    name = lambda pattern: F.nullif(F.regexp_extract("patch", pattern, 1), F.lit(""))
    path = F.coalesce(name(r"(?m)^(?:rename|copy) to (.*)$"), name(r"(?m)^\+\+\+ b/(.*)$"), name(r"(?m)^--- a/(.*)$"))
    return chunks.select(key, path.alias("path"), "patch").where("path IS NOT NULL")


def image_builds(files: DataFrame, *keep: str) -> DataFrame:
    """`docker build` commands of scripts: line, image (what -t or --tag names), dockerfile (-f or --file)."""
    rows = lines_of(files.where(F.col("text").contains("docker")), "text", *keep).where(F.col("content").rlike(r"\bdocker(?:\s+buildx)?\s+build\b"))
    option = lambda short, long: F.nullif(F.regexp_extract("content", rf"""(?:\s-{short}\s*|\s--{long}[= ])["']?([^\s"']+)""", 1), F.lit(""))
    return rows.select(*keep, "line", option("t", "tag").alias("image"), option("f", "file").alias("dockerfile"))


def same_but_space(old: Column, new: Column) -> Column:
    """Whether two lines differ in white space only."""
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    return bare(old) == bare(new)


def without_space_changes(lines: DataFrame) -> DataFrame:
    """Changed lines (block, side, pos, content) without pairs, the n-th removed and added of a block, that differ in white space only."""
    nth = F.row_number().over(Window.partitionBy("block", "side").orderBy("pos"))
    rows = lines.withColumn("_n", nth)
    side = lambda s, name: rows.where(F.col("side") == s).select("block", "_n", F.col("content").alias(name))
    same = side("old", "_a").join(side("new", "_b"), ["block", "_n"]).where(same_but_space(F.col("_a"), F.col("_b"))).select("block", "_n")
    return rows.join(same, ["block", "_n"], "left_anti").drop("_n")


def added_reads(base: DataFrame, head: DataFrame, added: DataFrame) -> DataFrame:
    """Variables (name, file) read more often at head than at base, on added lines: reads have name, file, line; added file, line."""
    count = lambda df, n: df.groupBy("name", "file").agg(F.count("*").alias(n))
    more = count(head, "_h").join(count(base, "_b"), ["name", "file"], "left").where("_h > coalesce(_b, 0)").select("name", "file")
    return head.join(more, ["name", "file"], "left_semi").join(added.select("file", "line").distinct(), ["file", "line"], "left_semi")


def query_tables(statements: DataFrame, *keep: str) -> DataFrame:
    """Tables that SQL texts (statement) name, with whether the text writes: keep, table, write. Names of its own WITH are left out."""
    plain = F.regexp_replace(F.regexp_replace("statement", r"(?s)/\*.*?\*/|--[^\n]*", " "), "'(?:[^']|'')*'", "''")
    names = F.regexp_extract_all(plain, F.lit(r"(?i)\b(?:from|join|into|update|table)\s+([A-Za-z_][\w.]*)"), F.lit(1))
    own = F.transform(F.regexp_extract_all(plain, F.lit(r"(?i)(?:\bwith(?:\s+recursive)?|,)\s*([A-Za-z_]\w*)\s*(?:\([^()]*\))?\s+as\s*\("), F.lit(1)), F.lower)
    write = plain.rlike(r"(?i)^\s*(?:with\b.*\)\s*)?(insert|update|delete|merge|create|alter|drop|truncate)\b")
    return statements.select(*keep, F.explode(F.array_except(F.array_distinct(F.transform(names, F.lower)), own)).alias("table"), write.alias("write"))


def acceptance_criteria(lines: DataFrame, *keys: str) -> DataFrame:
    """Criteria of a text's lines (keys, line, content): checkboxes, and items and Given/When/Then lines below a heading of acceptance criteria.

    A heading opens or closes the part; a Given starts a criterion that the steps behind it belong to.
    """
    order = Window.partitionBy(*keys).orderBy("line")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    heading = F.when(F.col("content").rlike(r"^\s*(#{1,6}\s|[A-Z][\w ]*:\s*$)"), F.col("content").rlike(r"(?i)acceptance criteria"))
    rows = lines.withColumn("_in", F.coalesce(F.last(heading, ignorenulls=True).over(so_far), F.lit(False)))
    box, item = r"^\s*[-*]\s+\[[ xX]\]\s+(.*\S)\s*$", r"^\s*(?:[-*]|\d+[.)])\s+(.*\S)\s*$"
    step = r"(?i)^\s*(?:[-*]\s+)?((?:given|when|then|and|but)\b.*\S)\s*$"
    is_step = F.col("_in") & F.col("content").rlike(step)
    kind = F.when(F.col("content").rlike(box), "checkbox").when(is_step, "step").when(F.col("_in") & F.col("content").rlike(item), "item")
    text = F.when(kind == "checkbox", F.regexp_extract("content", box, 1)).when(kind == "step", F.regexp_extract("content", step, 1)).otherwise(F.regexp_extract("content", item, 1))
    found = rows.withColumn("kind", kind).where("kind IS NOT NULL").withColumn("text", text)
    starts = (F.col("kind") != "step") | F.lower("text").startswith("given")
    numbered = found.withColumn("_c", F.sum(F.when(starts, 1).otherwise(0)).over(so_far))
    return numbered.groupBy(*keys, "_c").agg(F.min("line").alias("line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), " ").alias("text")).drop("_c")


def indented_blocks(lines: DataFrame, starts: DataFrame, *keys: str, deepest: int = 12) -> DataFrame:
    """The block of each declaration (keys, line): up to the line before the next one that is indented as little or less: keys, line, last.

    A line is opened to the depths from its own to the deepest that declarations have; the next of a depth ends a block.
    """
    depth = F.length(F.regexp_extract("content", r"^(\s*)", 1))
    full = lines.where(F.trim("content") != "").select(*keys, "line", depth.alias("_d"))
    opened = full.where(F.col("_d") <= deepest).select(*keys, "line", "_d", F.explode(F.sequence("_d", F.lit(deepest))).alias("_level"))
    following = opened.withColumn("_next", F.lead("line").over(Window.partitionBy(*keys, "_level").orderBy("line"))).where("_d = _level")
    end = full.groupBy(*keys).agg(F.max("line").alias("_end"))
    return following.join(starts.select(*keys, "line"), [*keys, "line"], "left_semi").join(end, [*keys]).select(*keys, "line", F.coalesce(F.col("_next") - 1, F.col("_end")).alias("last"))
