"""Typed edges: building, deduplicating and separating them.

Edges have source, target, relationship and seq, the order in which they were found.
Every builder is an equi-join; "first match" and "last wins" are aggregates over ``ord``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archlens.operators.keep import keep_first, keep_last

#: The order in which kinds of edges are united.
KINDS = ["imports", "renders", "owns", "mounts", "routes-to", "parent-child", "reuses"]
#: The separated graphs.
GRAPHS = {"import": "imports", "render": "renders", "composite-ownership": "owns", "runtime-mount": "mounts"}


def as_edges(df: DataFrame, source: Column, target: Column, relationship: str, order: Column, at: Column | None = None) -> DataFrame:
    """Edges with ``order`` as seq and, inside equal ones, ``at``."""
    inside = F.lit(0) if at is None else at
    return df.select(source.alias("source"), target.alias("target"), F.lit(relationship).alias("relationship"), order.cast("long").alias("seq"), inside.cast("long").alias("at"))


def unified(*edges: DataFrame) -> DataFrame:
    """All edges, the first of each (source, target, relationship)."""
    united = reduce(DataFrame.unionByName, edges)
    return keep_first(united, ["source", "target", "relationship"], [c for c in ("seq", "at") if c in united.columns]).drop("at")


def separated(edges: DataFrame) -> dict[str, DataFrame]:
    """The edges of each separated graph; relationships of no graph are left out."""
    return {graph: edges.where(F.col("relationship") == kind) for graph, kind in GRAPHS.items()}


def routed(edges: DataFrame) -> DataFrame:
    """Edges with the graph that takes them in; unknown relationships go to the import graph."""
    graph = F.lit("import")
    for name, kind in GRAPHS.items():
        graph = F.when(F.col("relationship") == kind, name).otherwise(graph)
    return edges.withColumn("graph", graph)


def last_by_name(components: DataFrame) -> DataFrame:
    """name and id of the last component of each name."""
    return keep_last(components.select("name", "id", "ord"), ["name"], ["ord"])


def first_by_name(components: DataFrame) -> DataFrame:
    return keep_first(components.select("name", "id", "ord"), ["name"], ["ord"])


def render_edges(components: DataFrame) -> DataFrame:
    """A component renders the last component that has a child's name; ``ord`` is (file, pos)."""
    children = components.select("id", "ord", F.posexplode("jsx_children").alias("pos", "name"))
    joined = children.join(last_by_name(components).select("name", F.col("id").alias("target")), "name")
    return as_edges(joined, F.col("id"), F.col("target"), "renders", F.col("ord.file"), F.col("ord.pos") * F.lit(1 << 31) + F.col("pos"))


def first_per_file(components: DataFrame) -> DataFrame:
    return keep_first(components.select(F.col("relative_path").alias("file"), "id", "ord"), ["file"], ["ord"])


def route_edges(routes: DataFrame, components: DataFrame) -> DataFrame:
    """From a route to the first component of its page file and of its layout file."""
    first = first_per_file(components)
    node = F.concat(F.lit("route::"), F.col("path"))
    page = routes.join(first.select(F.col("file").alias("relative_path"), "id"), "relative_path")
    layout = routes.join(first.select(F.col("file").alias("layout"), "id"), "layout")
    return as_edges(page, node, F.col("id"), "routes-to", F.col("ord") * 2).unionByName(
        as_edges(layout, node, F.col("id"), "routes-to", F.col("ord") * 2 + 1))


def parent_edges(routes: DataFrame, compat: bool = False) -> DataFrame:
    """From a parent route to its children; under ``compat`` only if the parent comes earlier."""
    parents = routes.select(F.col("path").alias("parent"), F.col("ord").alias("parent_ord"))
    found = routes.join(parents, "parent")
    if compat:
        found = found.where("parent_ord < ord")
    node = lambda c: F.concat(F.lit("route::"), F.col(c))
    return as_edges(found, node("parent"), node("path"), "parent-child", F.col("ord")).dropDuplicates(["source", "target"])


def ownership_edges(composites: DataFrame, components: DataFrame) -> DataFrame:
    """From a composite's root to the first component named like a part of it, with or without the root's name.

    The OR of the two names is a union of equi-joins, of which the first match is kept.
    """
    parts = composites.select("root", F.posexplode("sub_components").alias("pos", "sub"))
    first = first_by_name(components)
    roots = first.select(F.col("name").alias("root"), F.col("id").alias("source"))
    both = parts.withColumn("name", F.concat("root", "sub")).unionByName(parts.withColumn("name", F.col("sub")))
    found = keep_first(both.join(first, "name").select("root", "sub", "pos", "id", "ord"), ["root", "sub"], ["ord"])
    joined = found.join(roots, "root").where("source <> id")
    return as_edges(joined, F.col("source"), F.col("id"), "owns", F.col("pos"))


def reuse_edges(components: DataFrame) -> DataFrame:
    """From the components of every file that uses a reusable component to it."""
    used = components.where("is_reusable").select("id", "ord", F.explode("used_in_files").alias("relative_path"))
    users = components.select("relative_path", F.col("id").alias("user"))
    return as_edges(used.join(users, "relative_path").where("user <> id"), F.col("user"), F.col("id"), "reuses", F.col("ord.file"), F.col("ord.pos"))


def sorted_edges(edges: DataFrame) -> DataFrame:
    """In the language's order of source and target."""
    return edges.orderBy(F.expr("source COLLATE UNICODE"), F.expr("target COLLATE UNICODE"), "relationship")


def shared_pairs(members: DataFrame, group: str, item: str) -> DataFrame:
    """Pairs of groups (low < high) that hold an item in common, and how many.

    One row for each item holds its groups; pairs come from its positions i < j.
    """
    held = members.select(group, item).distinct().groupBy(item).agg(F.array_sort(F.collect_set(group)).alias("groups")).where(F.size("groups") > 1)
    low = held.select(item, "groups", F.posexplode("groups").alias("i", "low"))
    pairs = low.select(item, "low", F.explode(F.slice("groups", F.col("i") + 2, F.greatest(F.size("groups") - F.col("i") - 1, F.lit(0)))).alias("high"))
    return pairs.groupBy("low", "high").agg(F.count("*").alias("shared"))
