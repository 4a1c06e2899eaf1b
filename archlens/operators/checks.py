"""Structural checks; each gives rows (check_no, category, severity, node, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archlens.operators import reach
from archlens.operators.keep import keep_first


def _rows(df: DataFrame, number: int, category: str, severity: str, node: Column, message: Column) -> DataFrame:
    return df.select(F.lit(number).alias("check_no"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), node.alias("node"), message.alias("message"))


def orphan_nodes(components: DataFrame, routes: DataFrame, edges: DataFrame) -> DataFrame:
    """Components that no route reaches; pages and layouts are left out."""
    seeds = routes.select(F.concat(F.lit("route::"), "path").alias("node")).distinct()
    reached = reach.reachable(edges, seeds)
    lost = components.where("type NOT IN ('page', 'layout')").join(reached.select(F.col("node").alias("id")), "id", "left_anti")
    return _rows(lost, 1, "orphan-node", "info", F.col("id"), F.concat(F.lit("no route reaches "), "name"))


def unresolved_tags(components: DataFrame) -> DataFrame:
    """Plain tags that no component is named like."""
    tags = components.select("id", F.explode("jsx_children").alias("tag")).where(~F.contains("tag", F.lit(".")))
    lost = tags.join(components.select(F.col("name").alias("tag")).distinct(), "tag", "left_anti")
    return _rows(lost, 2, "unresolved-jsx", "warning", F.col("id"), F.concat(F.lit("unknown tag "), "tag"))


def duplicate_ids(components: DataFrame) -> DataFrame:
    """Every component after the first with its id."""
    first = keep_first(components.select("id", "ord"), ["id"], ["ord"]).select("id", F.col("ord").alias("first"))
    again = components.join(first, "id").where("ord <> first")
    return _rows(again, 3, "duplicate-canonical-id", "error", F.col("id"), F.concat(F.lit("declared again: "), "id"))


def pages_without_component(routes: DataFrame, components: DataFrame) -> DataFrame:
    lost = routes.join(components.select("relative_path").distinct(), "relative_path", "left_anti")
    return _rows(lost, 4, "invalid-route-ownership", "warning", F.concat(F.lit("route::"), "path"), F.concat(F.lit("no component in "), "relative_path"))


def _cycles(edges: DataFrame, relationship: str) -> DataFrame:
    """(node, way): the nodes on cycles, and a shortest cycle of their component from its least node back to it."""
    own = edges.where(F.col("relationship") == relationship).select("source", "target")
    nodes = reach.cycle_nodes(own)
    way = F.concat_ws(" > ", "path", F.get("path", F.lit(0)))
    return nodes.join(reach.cycle_paths(own, nodes).select("component", way.alias("way")), "component")


def ownership_cycles(edges: DataFrame) -> DataFrame:
    return _rows(_cycles(edges, "owns"), 5, "circular-ownership", "error", F.col("node"), F.concat(F.lit("owns itself: "), "way"))


def contested_parts(composites: DataFrame) -> DataFrame:
    """Names of parts that a root after the first one claims."""
    claims = composites.select("root", F.explode("full_names").alias("name"))
    first = claims.groupBy("name").agg(F.min("root").alias("owner"))
    again = claims.join(first, "name").where("root <> owner")
    return _rows(again, 6, "duplicate-composite-registration", "error", F.col("root"), F.concat_ws(" ", "name", F.lit("belongs to"), "owner"))


def render_cycles(edges: DataFrame) -> DataFrame:
    return _rows(_cycles(edges, "renders"), 7, "impossible-render-tree", "warning", F.col("node"), F.concat(F.lit("renders itself: "), "way"))


def unknown_at_runtime(runtime: DataFrame, components: DataFrame) -> DataFrame:
    lost = runtime.join(components.select(F.col("id").alias("component")), "component", "left_anti")
    return _rows(lost, 8, "runtime-static-mismatch", "warning", F.col("component"), F.concat(F.lit("mounted but not declared: "), "component"))


def by_severity(found: DataFrame, severity: str = "severity") -> DataFrame:
    """(severity, n): how many of each severity."""
    return found.groupBy(F.col(severity).alias("severity")).agg(F.count("*").alias("n"))


def verify(components: DataFrame, routes: DataFrame, composites: DataFrame, edges: DataFrame, runtime: DataFrame | None = None) -> DataFrame:
    """All checks in their fixed order (check_no)."""
    found = [
        orphan_nodes(components, routes, edges), unresolved_tags(components), duplicate_ids(components), pages_without_component(routes, components),
        ownership_cycles(edges), contested_parts(composites), render_cycles(edges),
    ]
    if runtime is not None:
        found.append(unknown_at_runtime(runtime, components))
    return reduce(DataFrame.unionByName, found)
