"""Path and URL columns. All of them are native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Segments that say nothing about the resource (fixed values).
GROUP_SKIP = r"(?i)^(api|rest|v\d+|public|internal|\{.*\}|…)$"

#: Parameter syntaxes of routes, in order, and what becomes of them (fixed values).
ROUTE_SYNTAX = [(r"\(\?P<(\w+)>[^)]*\)", "{$1}"), (r"<(?:\w+:)?(\w+)>", "{$1}"), (r":(\w+)\??(\([^)]*\))?", "{$1}"), (r"\{(\w+):[^}]*\}", "{$1}"), ("/{2,}", "/")]


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]+)$", 1))


def normal_path(path: Column) -> Column:
    """`.` and `..` segments worked off; a `..` above the top goes."""
    step = lambda kept, s: F.when(s == "..", F.slice(kept, 1, F.greatest(F.lit(0), F.size(kept) - 1))).otherwise(F.concat(kept, F.array(s)))
    parts = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def join_path(*parts: Column) -> Column:
    """URL parts joined by single slashes, with one in front."""
    bare = F.filter(F.array(*(F.regexp_replace(p, "^/+|/+$", "") for p in parts)), lambda p: p != "")
    return F.concat(F.lit("/"), F.array_join(bare, "/"))


def shared_depth(a: Column, b: Column) -> Column:
    """How many leading directories two paths share."""
    same = F.zip_with(F.split(dir_name(a), "/"), F.split(dir_name(b), "/"), lambda x, y: x.eqNullSafe(y) & (x != ""))
    found = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, ok: F.struct((s["n"] + F.when(s["on"] & ok, 1).otherwise(0)).alias("n"), (s["on"] & ok).alias("on")))
    return found["n"]


def ancestors(path: Column) -> Column:
    """The path itself and every directory above it, longest first; the root is the empty string."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.when(n == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, 1, n), "/")))


def matches_glob(path: Column, pattern: Column) -> Column:
    """`dir/**`, `*.ext`, `prefix*` or an exact path."""
    p = F.regexp_replace(F.trim(pattern), "^/+", "")
    return (
        F.when(p == "", False)
        .when(F.endswith(p, F.lit("/**")), F.startswith(path, F.left(p, F.length(p) - 2)))
        .when(F.startswith(p, F.lit("*.")), F.endswith(path, F.substr(p, F.lit(2))))
        .when(F.endswith(p, F.lit("*")), F.startswith(path, F.left(p, F.length(p) - 1)))
        .otherwise(path == p)
    )


def under_folder(path: Column, folder: Column) -> Column:
    return (folder == "") | (path == folder) | F.startswith(path, F.concat(folder, F.lit("/")))


def route_path(path: Column) -> Column:
    """One parameter syntax, `{name}`, for `:name`, `<type:name>`, `{name:regex}` and `(?P<name>...)`; no anchors."""
    p = F.regexp_replace(F.trim(path), r"^\^|\$$", "")
    for pattern, to in ROUTE_SYNTAX:
        p = F.regexp_replace(p, pattern, to)
    p = F.when(p.startswith("/") | p.startswith("…"), p).otherwise(F.concat(F.lit("/"), p))
    return F.when((F.length(p) > 1) & p.endswith("/"), F.left(p, F.length(p) - 1)).otherwise(p)


def route_key(path: Column) -> Column:
    """The route without parameter names, for matching."""
    return F.lower(F.regexp_replace(route_path(path), r"\{[^}]*\}", "{}"))


def route_params(path: Column) -> Column:
    return F.regexp_extract_all(path, F.lit(r"\{(\w+)\*?\??\}"), F.lit(1))


def route_group(path: Column) -> Column:
    """The first segment that says something, and the segment after a parameter that follows it."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    numbered = F.transform(segments, lambda s, i: F.struct(i.alias("i"), s.alias("s")))
    first = F.get(F.filter(numbered, lambda x: ~x["s"].rlike(GROUP_SKIP)), 0)
    parameter = F.get(F.filter(numbered, lambda x: (x["i"] > first["i"]) & x["s"].rlike(r"^\{.*\}$")), 0)
    nested = F.get(segments, parameter["i"] + 1)
    return F.when(first.isNull(), "/").when(nested.isNotNull() & ~nested.rlike(r"^\{.*\}$"), F.concat_ws(" › ", first["s"], nested)).otherwise(first["s"])


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-z]+://(?:[^/@]*@)?([^/:?#]+)", 1))


def image_parts(ref: Column) -> Column:
    """struct<image, tag, digest> of a container image reference."""
    digest = F.regexp_extract(ref, r"@(sha256:[0-9a-f]+)$", 1)
    bare = F.regexp_replace(ref, r"@sha256:[0-9a-f]+$", "")
    tag = F.regexp_extract(bare, r":([^:/]+)$", 1)
    return F.struct(F.regexp_replace(bare, r":[^:/]+$", "").alias("image"), F.nullif(tag, F.lit("")).alias("tag"), F.nullif(digest, F.lit("")).alias("digest"))


def line_range(text: Column) -> Column:
    """struct<first, last> of `12`, `12-40` or `12–40`, in order; nulls if it is neither."""
    a, b = (F.regexp_extract(text, r"^\s*L?(\d+)(?:\s*[-–]\s*L?(\d+))?\s*$", i) for i in (1, 2))
    low = F.nullif(a, F.lit("")).cast("int")
    high = F.coalesce(F.nullif(b, F.lit("")).cast("int"), low)
    return F.struct(F.least(low, high).alias("first"), F.greatest(low, high).alias("last"))
