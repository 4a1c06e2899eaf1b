"""Node and edge tables of the explorer's graphs: one route, what is reused, and everything.

Nodes are id, label, type, x and y; edges are source and target.  Nodes in a row of the
picture are numbered by ranges (``keep.placed``), so a view may have any number of them.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archlens.operators.keep import placed
from archlens.operators.views import grid

#: Rows of a route's picture, from the top.
ROWS = ["provider", "component", "dialog", "grid", "chart", "hook", "util"]

View = tuple[DataFrame, DataFrame]


def _node(identity: Column, label: Column, kind: Column, x: Column, y: Column) -> list[Column]:
    return [identity.alias("id"), label.alias("label"), kind.alias("type"), x.cast("double").alias("x"), y.cast("double").alias("y")]


def detail_nodes(intelligence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per route (column path): the route, and its items in a row for each type."""
    special = ["dialogs", "grids", "charts", "providers"]
    plain = F.col("components")
    for c in special:
        plain = F.array_except(plain, F.col(c))
    lists = {"provider": F.col("providers"), "component": plain, "dialog": F.col("dialogs"), "grid": F.col("grids"), "chart": F.col("charts"), "hook": F.col("hooks"), "util": F.col("utils")}
    rows = F.filter(F.array(*(F.struct(F.lit(t).alias("type"), F.array_sort(lists[t]).alias("items")) for t in ROWS)), lambda r: F.size(r["items"]) > 0)
    placed = intelligence.select("path", F.posexplode(rows).alias("row", "r")).select("path", "row", "r.type", F.size("r.items").alias("n"), F.posexplode("r.items").alias("place", "label"))
    identity = F.concat_ws("::", "type", "label")
    items = placed.select("path", *_node(identity, F.col("label"), F.col("type"), 300 - F.col("n") * 90 + 90 + F.col("place") * 180, 140 + F.col("row") * 120))
    top = intelligence.select("path", *_node(F.concat(F.lit("route::"), "path"), F.col("path"), F.lit("route"), F.lit(300), F.lit(0)))
    return top, items


def route_detail(intelligence: DataFrame, components: DataFrame, edges: DataFrame) -> View:
    """``detail_nodes``, and edges from the route to its items and from what renders to what is rendered among them."""
    top, items = detail_nodes(intelligence)
    to_items = items.select("path", F.concat(F.lit("route::"), "path").alias("source"), F.col("id").alias("target"))
    named = components.select("id", "name")
    renders = edges.where("relationship = 'renders'").join(named.select(F.col("id").alias("source"), F.col("name").alias("label")), "source").join(
        named.select(F.col("id").alias("target"), F.col("name").alias("child")), "target").select("label", "child").distinct()
    inside = items.select("path", F.col("label").alias("child"), F.col("id").alias("target")).where(F.startswith("target", F.lit("component::")))
    among = items.select("path", F.col("id").alias("source"), "label").join(renders, "label").join(inside, ["path", "child"]).select("path", "source", "target")
    return top.unionByName(items), to_items.unionByName(among)


def reuse(usage: DataFrame) -> View:
    """Components of two routes or more in the middle, most used first, their routes halved on both sides (usage: id, used_in)."""
    used = usage.where(F.size("used_in") > 1)
    ordered = placed(used, [F.size("used_in").desc(), F.col("id")])
    middle = ordered.select(*_node(F.concat(F.lit("reusable::"), "id"), F.col("id"), F.lit("component"), F.lit(400), F.col("place") * 160))
    routes = placed(used.select(F.explode("used_in").alias("path")).distinct(), [F.col("path")])
    left = routes.agg(F.ceil(F.count("*") / 2).alias("left"))  # one row
    right = F.col("place") >= F.col("left")
    sides = routes.crossJoin(F.broadcast(left)).select(*_node(
        F.concat(F.lit("route::"), "path"), F.col("path"), F.lit("route"), F.when(right, 800).otherwise(0), (F.col("place") - F.when(right, F.col("left")).otherwise(0)) * 80))
    links = used.select(F.concat(F.lit("reusable::"), "id").alias("target"), F.explode("used_in").alias("path")).select(F.concat(F.lit("route::"), "path").alias("source"), "target")
    return middle.unionByName(sides), links


def architecture(intelligence: DataFrame) -> View:
    """All routes in one row, all their components in another, an edge for each membership."""
    top = placed(intelligence.select("path"), [F.col("path")]).select(*_node(F.concat(F.lit("route::"), "path"), F.col("path"), F.lit("route"), F.col("place") * 280, F.lit(0)))
    pairs = intelligence.select(F.concat(F.lit("route::"), "path").alias("source"), F.explode("components").alias("label"))
    names = pairs.select("label").distinct()
    below = placed(names, [F.col("label")]).select(*_node(F.concat(F.lit("comp::"), "label"), F.col("label"), F.lit("component"), F.col("place") * 160, F.lit(250)))
    return top.unionByName(below), pairs.select("source", F.concat(F.lit("comp::"), "label").alias("target"))


def overview_nodes(intelligence: DataFrame) -> DataFrame:
    """All routes on a grid, with badges (what kinds of components they have), deps, comp, hooks and depth."""
    kinds = {"dialog": "dialogs", "grid": "grids", "chart": "charts", "provider": "providers"}
    badges = F.filter(F.array(*(F.when(F.size(column) > 0, F.lit(kind)) for kind, column in kinds.items())), lambda b: b.isNotNull())
    metrics = {"deps": F.col("dependency_count"), "comp": F.size("components"), "hooks": F.size("hooks"), "depth": F.coalesce("depth", F.lit(0))}
    told = intelligence.select("path", badges.alias("badges"), *(m.cast("long").alias(n) for n, m in metrics.items()))
    node = _node(F.concat(F.lit("route::"), "path"), F.col("path"), F.lit("route"), F.col("x"), F.col("y"))
    return grid(told, "path").select(*node, "badges", *metrics)


def _route(column: str) -> Column:
    return F.concat(F.lit("route::"), column)


def overview_children(routes: DataFrame) -> DataFrame:
    """Edges (source, target, label ``child``) from every route but ``/`` to those below it."""
    parents = routes.select(F.col("path").alias("parent"))
    return routes.where("parent <> '/'").select("path", "parent").join(parents, "parent").select(_route("parent").alias("source"), _route("path").alias("target"), F.lit("child").alias("label"))


def overview_shared(components: DataFrame) -> DataFrame:
    """Edges between routes that share a component, with its name as label.

    They are as many as a component's routes squared: ``edges.shared_pairs`` counts them instead.
    """
    used = components.where(F.size("used_in_routes") > 1).select("name", "used_in_routes", F.posexplode("used_in_routes").alias("i", "low"))
    after = F.slice("used_in_routes", F.col("i") + 2, F.greatest(F.size("used_in_routes") - F.col("i") - 1, F.lit(0)))
    return used.select("name", "low", F.explode(after).alias("high")).select(_route("low").alias("source"), _route("high").alias("target"), F.col("name").alias("label")).distinct()


def overview(intelligence: DataFrame, components: DataFrame) -> View:
    """All routes, with edges from parents, and between routes that share a component."""
    return overview_nodes(intelligence), overview_children(intelligence).unionByName(overview_shared(components))


def nodes(mode: str, tables: Mapping[str, DataFrame], path: str | None = None) -> DataFrame:
    """The nodes alone of a ``view``: of the tables they need the routes' only, but for ``reuse``."""
    if mode == "detail" and path is not None:
        top, items = detail_nodes(tables["route_intelligence"].where(F.col("path") == path))
        return top.unionByName(items)
    if mode in ("detail", "overview"):
        return overview_nodes(tables["route_intelligence"])
    return view(mode, tables, path)[0]


def view(mode: str, tables: Mapping[str, DataFrame], path: str | None = None) -> View:
    """The graph of a mode: ``detail`` of a path, ``reuse``, ``architecture`` or ``overview``; detail without a path is the overview."""
    if mode == "reuse":
        return reuse(tables["components"].select("id", F.col("used_in_routes").alias("used_in")))
    routes = tables["route_intelligence"]
    if mode == "detail" and path is not None:
        return route_detail(routes.where(F.col("path") == path), tables["components"], tables["edges"])
    if mode == "architecture":
        return architecture(routes)
    return overview(routes, tables["components"])
