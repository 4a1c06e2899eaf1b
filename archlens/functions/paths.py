"""Paths, routes and their parameters as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that are never parameters; the second list is left out under ``compat``.
NOT_PARAMS = ["then", "catch", "finally", "toString", "valueOf", "constructor", "prototype", "length", "name", "apply", "call", "bind"]
ACCESSORS = ["get", "getAll", "has", "entries", "keys", "values", "forEach"]


def normalised(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def folder(path: Column) -> Column:
    """The folder of a path; empty for a file at the top."""
    return F.when(F.instr(path, "/") == 0, "").otherwise(F.regexp_replace(path, r"/[^/]*$", ""))


def collapsed(path: Column) -> Column:
    """``.`` and ``..`` segments worked out."""
    parts = F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda done, p: F.when(p.isin("", "."), done)
        .when((p == "..") & (F.size(done) > 0), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.array_append(done, p)))
    return F.array_join(parts, "/")


def is_excluded(path: Column) -> Column:
    return F.contains(path, F.lit("node_modules")) | F.contains(path, F.lit(".next")) | F.contains(path, F.lit(".generated")) | F.contains(path, F.lit("dist/"))


def route_path(folder: Column) -> Column:
    """The URL of a folder of pages: groups ``(x)`` and slots ``@x`` have no segment, ``(.)x`` keeps its own."""
    kept = F.filter(F.split(folder, "/"), lambda s: ~s.isin("", ".") & ~s.rlike(r"^\([^.)][^)]*\)$") & ~s.startswith("@"))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def segment_type(path: Column, compat: bool = False) -> Column:
    """The kind of a route; ``compat`` doesn't know ``(...)`` as intercepting."""
    marks = r"\(\.\.?\)" if compat else r"\(\.{1,3}\)"
    return (
        F.when(path.rlike(r"\[\[\.\.\."), "optional-catch-all").when(path.rlike(r"\[\.\.\."), "catch-all")
        .when(path.rlike(r"\["), "dynamic").when(path.rlike("@"), "parallel").when(path.rlike(marks), "intercepting").otherwise("static")
    )


def parent_route(path: Column) -> Column:
    """The route one segment up; null for ``/``."""
    up = F.nullif(F.regexp_replace(path, r"/[^/]+$", ""), F.lit(""))
    return F.when(path != "/", F.coalesce(up, F.lit("/")))


def is_route_group(folder: Column) -> Column:
    return F.contains(folder, F.lit("(")) & F.contains(folder, F.lit(")"))


def route_params(path: Column) -> Column:
    """Names in ``[x]``, ``[...x]`` and ``[[...x]]``."""
    return F.regexp_extract_all(path, F.lit(r"\[(?:\.\.\.)?(\w+)\]"), F.lit(1))


def is_param_name(name: Column, compat: bool = False) -> Column:
    return name.rlike(r"^[a-zA-Z_$][a-zA-Z0-9_$]*$") & ~name.isin(NOT_PARAMS if compat else NOT_PARAMS + ACCESSORS)
