"""Queries behind the explorer's views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archlens.operators.keep import keep_last, placed


def route_tree(paths: DataFrame) -> DataFrame:
    """(path, segment, parent, depth, is_route): every prefix of the paths; parent is null for ``/``."""
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    steps = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    own = F.concat(F.lit("/"), F.array_join(parts, "/"))
    prefix = paths.select(F.explode(steps).alias("node"), own.alias("own")).groupBy("node").agg(F.bool_or(F.col("node") == F.col("own")).alias("is_route"))
    parent = F.when(F.col("node") != "/", F.coalesce(F.nullif(F.regexp_replace("node", "/[^/]+$", ""), F.lit("")), F.lit("/")))
    return prefix.select(
        F.col("node").alias("path"), F.substring_index("node", "/", -1).alias("segment"), parent.alias("parent"),
        (F.size(F.split("node", "/")) - F.when(F.col("node") == "/", 2).otherwise(1)).alias("depth"), "is_route")


def grid(nodes: DataFrame, order: str, width: int = 300, height: int = 200) -> DataFrame:
    """``nodes`` with x and y on a square grid, in the given order."""
    count = nodes.agg(F.greatest(F.ceil(F.sqrt(F.count("*"))), F.lit(1)).alias("columns"))
    numbered = placed(nodes, [F.col(order)]).crossJoin(F.broadcast(count))  # one row of counts
    return numbered.withColumn("x", (F.col("place") % F.col("columns")) * width).withColumn("y", F.floor(F.col("place") / F.col("columns")) * height).drop("place", "columns")


def most_used(usage: DataFrame, least: int = 2) -> DataFrame:
    """Usage of what at least ``least`` groups use, most used first, ties by id."""
    return usage.where(F.size("used_in") >= least).orderBy(F.size("used_in").desc(), "id")


def runtime_table(runtime: DataFrame, names: DataFrame) -> DataFrame:
    """Telemetry with the component's name (names: component, name), else its id; most mounted first."""
    joined = runtime.join(names, "component", "left").withColumn("name", F.coalesce("name", "component"))
    return joined.orderBy(F.col("mount_count").desc(), "component")


def dependency_tree(items: DataFrame, group: Column, children: DataFrame) -> DataFrame:
    """Rows (group, item, child) of a tree of three levels; children has parent and child, and an item without any has a null child.

    The tree is as long as its leaves, so no row holds a whole group.
    """
    below = children.select("parent", "child").distinct()
    joined = items.withColumn("group", group).join(below, items["name"] == below["parent"], "left")
    return joined.select("group", F.col("name").alias("item"), "child")


def overview(routes: DataFrame, components: DataFrame) -> DataFrame:
    """One row of an overview's numbers: routes, dynamic ones, components, reusable ones, clients and their share in percent (rounded half up)."""
    of_routes = routes.agg(F.count("*").alias("routes"), F.count_if(F.col("segment_type") != "static").alias("dynamic_routes"))
    share = F.floor(100 * F.count_if(F.col("rendering") == "client") / F.greatest(F.count("*"), F.lit(1)) + 0.5)
    of_parts = components.agg(F.count("*").alias("components"), F.count_if("is_reusable").alias("reusable"), F.count_if(F.col("rendering") == "client").alias("clients"), share.alias("client_percent"))
    return of_routes.crossJoin(of_parts)  # one row each


def looked_up(names: DataFrame, components: DataFrame) -> DataFrame:
    """``names`` (name) with what the usage panel shows of the last component so called: id, type, files and routes that use it (null if none)."""
    last = keep_last(components.select("name", "ord", "id", "type", F.size("used_in_files").alias("n_files"), F.size("used_in_routes").alias("n_routes")), ["name"], ["ord"])
    return names.select("name").distinct().join(last.drop("ord"), "name", "left")


def last_segments(path: Column, n: int = 3) -> Column:
    """The last ``n`` segments of a path; all of a shorter one."""
    parts = F.split(path, "/")
    return F.array_join(F.when(F.size(parts) <= n, parts).otherwise(F.slice(parts, -n, n)), "/")
