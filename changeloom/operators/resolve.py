"""From the names that code imports to files: candidates are opened to rows and joined by equality, the first that exists wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.functions.paths import dir_name, normal_path, shared_depth
from changeloom.operators.relational import longest_prefix

#: What a module of a script may end in, in order (fixed values).
ENDINGS = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js"]


def _probed(candidates: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """Of candidates (keys, rank, base) the file of the lowest rank, endings tried in order."""
    opened = candidates.where("base IS NOT NULL").select(*keys, "rank", F.posexplode(F.transform(F.array(*map(F.lit, ENDINGS)), lambda e: F.concat("base", e))).alias("_e", "path"))
    return opened.join(files.select("path"), "path", "left_semi").groupBy(*keys).agg(F.min_by("path", F.struct("rank", "_e")).alias("path"))


def workspace_imports(specs: DataFrame, packages: DataFrame, exports: DataFrame, files: DataFrame) -> DataFrame:
    """specs (specifier) that name a package of the workspace (name, dir, main) or something in it: specifier, path.

    exports (name, key, target): `.`, `./sub` or a key with one star. An export of exactly the key comes first, then
    one with a star, the plain folder, and for the package itself main, src/index and index.
    """
    name = F.regexp_extract("specifier", r"^(@[^/]+/[^/]+|[^/]+)", 1)
    split = specs.select("specifier").distinct().withColumn("name", name).withColumn("sub", F.substr("specifier", F.length(name) + 2))
    known = split.join(packages, "name").withColumn("key", F.when(F.col("sub") == "", ".").otherwise(F.concat(F.lit("./"), "sub")))
    put = lambda target: F.concat_ws("/", "dir", F.regexp_replace(target, r"^\./", ""))
    exact = known.join(exports, ["name", "key"]).select("specifier", F.lit(0).alias("rank"), put(F.col("target")).alias("base"))
    head, tail = F.substring_index("pattern", "*", 1), F.substring_index("pattern", "*", -1)
    starred = known.join(exports.where(F.col("key").contains("*")).withColumnRenamed("key", "pattern"), "name").where(F.startswith("key", head) & F.endswith("key", tail) & (F.length("key") >= F.length("pattern") - 1))
    middle = F.substr("key", F.length(head) + 1, F.length("key") - F.length(head) - F.length(tail))
    by_star = starred.select("specifier", F.lit(1).alias("rank"), put(F.replace("target", F.lit("*"), middle)).alias("base"))
    plain = F.array(
        F.struct(F.lit(2).alias("rank"), F.when(F.col("sub") != "", F.concat_ws("/", "dir", "sub")).alias("base")),
        *[F.struct(F.lit(3 + i).alias("rank"), F.when(F.col("sub") == "", F.concat_ws("/", "dir", F.regexp_replace(c, r"^\./", ""))).alias("base")) for i, c in enumerate((F.col("main"), F.lit("src/index"), F.lit("index")))],
    )
    rest = known.select("specifier", F.inline(plain))
    return _probed(exact.unionByName(by_star).unionByName(rest), files, ["specifier"])


def module_imports(imports: DataFrame, modules: DataFrame, files: DataFrame) -> DataFrame:
    """imports (spec) by the module (module, dir) whose path is the longest in front of theirs: spec, and each file of the package's folder."""
    owned = longest_prefix(imports.select("spec").distinct(), modules.select(F.col("module").alias("prefix"), "dir"), "spec").where("prefix IS NOT NULL")
    folder = F.array_join(F.filter(F.array("dir", F.substr("spec", F.length("prefix") + 2)), lambda x: x != ""), "/")
    return owned.select("spec", folder.alias("folder")).join(files.select("path", dir_name(F.col("path")).alias("folder")), "folder").select("spec", "path")


def nearest_declared(imports: DataFrame, declared: DataFrame) -> DataFrame:
    """imports (file, fqn) with the file that declares the name; of several the one that shares most folders with the importing file."""
    found = imports.join(declared.select("fqn", F.col("file").alias("path")), "fqn")
    return found.groupBy("file", "fqn").agg(F.min_by("path", F.struct((-shared_depth(F.col("file"), F.col("path"))).alias("far"), F.col("path"))).alias("path"))


def python_imports(imports: DataFrame, files: DataFrame, roots: list[str] = ("", "src/")) -> DataFrame:
    """imports (file, module): dotted names, relative ones with leading dots: file, module, path of the module or package."""
    dots = F.length(F.regexp_extract("module", r"^(\.*)", 1))
    tail = F.replace(F.substr("module", dots + 1), F.lit("."), F.lit("/"))
    folder = F.concat_ws("/", dir_name(F.col("file")), F.array_join(F.array_repeat(F.lit(".."), F.greatest(F.lit(0), dots - 1)), "/"))
    relative = normal_path(F.concat_ws("/", folder, tail))
    starts = F.when(dots > 0, F.array(relative)).otherwise(F.array(*[F.concat(F.lit(r), tail) for r in roots]))
    ends: Column = F.flatten(F.transform(starts, lambda s: F.array(F.concat(s, F.lit(".py")), F.concat_ws("/", F.nullif(s, F.lit("")), F.lit("__init__.py")))))
    opened = imports.distinct().select("file", "module", F.posexplode(ends).alias("nth", "path"))
    return opened.join(files.select("path"), "path", "left_semi").groupBy("file", "module").agg(F.min_by("path", "nth").alias("path"))


def rust_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """imports (spec: a::b::c) with the file of the longest front part that is a module (module, path)."""
    parts = F.split("spec", "::")
    opened = imports.select("spec").distinct().select("spec", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, 1, n), "::").alias("module")))).alias("p"))
    return opened.select("spec", "p.n", "p.module").join(modules, "module").groupBy("spec").agg(F.max_by("path", "n").alias("path"))
