"""Usage, reuse, composites, route facts and the project's summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archlens.operators.edges import first_by_name
from archlens.operators.keep import distinct_sorted, keep_first

#: Names before a dot that are no composite's root, and suffixes that are no part.
GLOBALS = [
    "React", "Object", "Array", "Promise", "JSON", "Math", "Number", "String", "Map", "Set", "Error", "Date", "RegExp", "Symbol",
    "WeakMap", "WeakSet", "Proxy", "Reflect", "Intl", "console", "document", "window", "globalThis", "process",
]
NO_PARTS = ["Provider", "Context"]


def usage(uses: DataFrame) -> DataFrame:
    """id, the distinct groups that use it (used_in) and the hits (usage_count), from rows (id, group)."""
    return uses.groupBy("id").agg(distinct_sorted("group").alias("used_in"), F.count("*").alias("usage_count"))


def with_files_used(components: DataFrame, imports: DataFrame) -> DataFrame:
    """``components`` with used_in_files (other files that import it) and is_reusable (two or more)."""
    files = imports.groupBy("id").agg(distinct_sorted("file").alias("files"))
    used = F.array_remove(F.coalesce("files", F.array().cast("array<string>")), F.col("relative_path"))
    return components.join(files, "id", "left").withColumn("used_in_files", used).withColumn("is_reusable", F.size("used_in_files") > 1).drop("files")


def module_parts(components: DataFrame, least_root: int = 4) -> DataFrame:
    """(root, sub): parts of a root in the same file, at least two, in files of three components or more."""
    sized = components.groupBy("relative_path").agg(F.count("*").alias("n")).where("n >= 3").select("relative_path")
    here = components.join(sized, "relative_path", "left_semi").select("relative_path", "name", "ord")
    roots = here.where(F.length("name") >= least_root).select("relative_path", F.col("name").alias("root"))
    found = here.join(roots, "relative_path").where(_is_part(F.col("name"), F.col("root")))
    subs = found.select("relative_path", "root", _suffix(F.col("name"), F.col("root")).alias("sub")).where(~F.col("sub").isin(NO_PARTS)).distinct()
    enough = subs.groupBy("relative_path", "root").agg(F.count("*").alias("n")).where("n >= 2")
    return subs.join(enough, ["relative_path", "root"], "left_semi").select("root", "sub").distinct()


def _suffix(name: Column, root: Column) -> Column:
    return F.substring(name, F.length(root) + 1, F.length(name))


def _is_part(name: Column, root: Column) -> Column:
    return F.startswith(name, root) & _suffix(name, root).rlike("^[A-Z]")


def prefixes(names: DataFrame, claimed: DataFrame | None = None, least: int = 4) -> DataFrame:
    """(root, sub): names that begin with another name and a capital, two or more for a root.

    A name is explored by its own prefixes before a capital, an equi-join in place of
    comparing all names.  A part belongs to its shortest qualifying root; a root that
    is itself a part has none.
    """
    free = names.select("name").distinct()
    if claimed is not None:
        free = free.join(claimed.select("name"), "name", "left_anti")
    cuts = F.filter(F.sequence(F.lit(least), F.greatest(F.length("name") - 1, F.lit(least))), lambda i: F.col("name").substr(i + 1, F.lit(1)).rlike("[A-Z]"))
    explored = free.where(F.length("name") > least).select("name", F.explode(cuts).alias("at")).select("name", F.col("name").substr(F.lit(1), F.col("at")).alias("root"))
    roots = free.where(F.col("name").rlike("^[A-Z][a-z]")).select(F.col("name").alias("root"))
    pairs = explored.join(roots, "root").withColumn("sub", _suffix(F.col("name"), F.col("root"))).where(~F.col("sub").isin(NO_PARTS))
    able = pairs.join(pairs.groupBy("root").agg(F.count("*").alias("n")).where("n >= 2"), "root", "left_semi")
    mine = keep_first(able.withColumn("size", F.length("root")), ["name"], ["size"])
    enough = mine.groupBy("root").agg(F.count("*").alias("n")).where("n >= 2")
    kept = mine.join(enough, "root", "left_semi")
    return kept.join(kept.select(F.col("name").alias("root")), "root", "left_anti").select("root", "sub")


def composites(signals: DataFrame, components: DataFrame, heuristic: DataFrame | None = None) -> DataFrame:
    """One row for each root from signals (root, sub, evidence); roots of ``heuristic`` (root, sub) count where no signal claims them."""
    merged = signals.groupBy("root").agg(distinct_sorted("sub").alias("sub_components"), distinct_sorted("evidence").alias("evidence"))
    merged = merged.withColumn("score", F.when(F.size("evidence") > 1, 0.95).otherwise(0.9))
    if heuristic is not None:
        weak = heuristic.join(merged, "root", "left_anti").groupBy("root").agg(distinct_sorted("sub").alias("sub_components"))
        merged = merged.unionByName(weak.withColumn("evidence", F.array(F.lit("prefix-heuristic"))).withColumn("score", F.lit(0.6)))
    first = first_by_name(components)
    subs = merged.select("root", F.explode("sub_components").alias("sub"))
    both = subs.withColumn("name", F.concat("root", "sub")).unionByName(subs.withColumn("name", F.col("sub")))
    ids = keep_first(both.join(first, "name").select("root", "sub", "id", "ord"), ["root", "sub"], ["ord"])
    ids = subs.join(ids, ["root", "sub"], "left").groupBy("root").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("sub", F.coalesce("id", F.concat(F.lit("unknown#"), "root", F.lit("."), "sub")).alias("id")))), lambda x: x["id"]).alias("sub_component_ids"))
    out = merged.join(ids, "root").join(first.select(F.col("name").alias("root"), F.col("id").alias("root_id")), "root", "left")
    names = F.array_sort(F.concat(F.transform("sub_components", lambda s: F.concat_ws(".", "root", s)), F.transform("sub_components", lambda s: F.concat("root", s))))
    return out.select(
        "root", F.coalesce("root_id", F.concat(F.lit("unknown#"), "root")).alias("root_id"), "sub_components", "sub_component_ids", names.alias("full_names"), "evidence", "score")


def collapsed(names: DataFrame, composites: DataFrame, components: DataFrame) -> DataFrame:
    """``names`` (name, ...) with canonical: the root's id for a part, else the id of the last component so named, else the name."""
    from archlens.operators.edges import last_by_name

    parts = keep_first(composites.select(F.explode("full_names").alias("name"), "root_id", "root"), ["name"], ["root"]).select("name", "root_id")
    ids = last_by_name(components).select("name", "id")
    return names.join(parts, "name", "left").join(ids, "name", "left").withColumn("canonical", F.coalesce("root_id", "id", "name")).drop("root_id", "id")


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def summary(components: DataFrame, routes: DataFrame) -> DataFrame:
    """One row of counts.  routes: hooks and utils (arrays), complexity (number)."""
    kind = lambda t: F.count_if(F.col("type") == t)
    parts = components.agg(
        F.count("*").alias("components"), F.count_if("is_reusable").alias("reusable_components"), kind("dialog").alias("dialogs"), kind("grid").alias("grids"),
        kind("chart").alias("charts"), kind("provider").alias("providers"), kind("layout").alias("layouts"), kind("page").alias("pages"),
        F.count_if(F.col("rendering") == "client").alias("client_components"), F.count_if(F.col("rendering") == "server").alias("server_components"))
    names = routes.select(F.explode("hooks").alias("name"), F.lit("hook").alias("kind")).unionByName(routes.select(F.explode("utils").alias("name"), F.lit("util").alias("kind"))).distinct()
    counted = names.agg(F.count_if(F.col("kind") == "hook").alias("hooks"), F.count_if(F.col("kind") == "util").alias("utils"))
    screens = routes.agg(F.count("*").alias("screens"), F.coalesce(half_up(F.avg("complexity")), F.lit(0)).alias("avg_complexity"), F.coalesce(F.max("complexity"), F.lit(0)).alias("max_complexity"))
    return screens.crossJoin(parts).crossJoin(counted)  # one row each
