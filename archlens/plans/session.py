"""The whole analysis: from a source tree to components, routes, edges, diagnostics and a summary."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archlens.functions import extract, lexical, names, paths, rules
from archlens.operators import checks, edges, intel, reach, symbols
from archlens.operators.keep import distinct_sorted, settled, stored
from archlens.sources import files as source_files


@dataclass
class Config:
    """Where to look and which rules to try first."""

    app_dir: str = "app"
    include: Sequence[str] = (r"\.(tsx?|jsx?)$",)
    exclude: Sequence[str] = ()
    roots: dict[str, str] = field(default_factory=lambda: {"@/": ""})
    rules: Sequence[rules.Rule] = ()
    compat: bool = False


def _ordered(columns: Sequence[str]) -> list[str]:
    """The columns of a file's list, without the file, the position first."""
    return sorted((c for c in columns if c != "file"), key=lambda c: (c not in ("pos", "seq"), c))


class Session:
    """``run(root)`` gives every table; nothing is written unless a sink is called."""

    def __init__(self, spark: SparkSession, config: Config | None = None):
        self.spark, self.config = spark, config or Config()

    def run(self, root: str) -> Tables:
        return self.analyse(source_files.scan(self.spark, root, self.config.include, self.config.exclude))

    def analyse(self, files: DataFrame, runtime: DataFrame | None = None) -> Tables:
        """All tables from files (path, content)."""
        return self.assemble(stored(self.facts(files)), runtime)

    def facts(self, files: DataFrame) -> DataFrame:
        """One row for each file: path, hash, and what its text alone says, as lists.

        Nothing in a row depends on another file, so the rows of files that haven't changed can be kept.
        """
        files = files.withColumn("path", paths.normalised(F.col("path"))).where(~paths.is_excluded(F.col("path")))
        files = lexical.once(files.withColumn("hash", F.sha2(F.coalesce("content", F.lit("")), 256)))  # contents are read once, here
        read = settled(extract.accesses(files))
        imports = settled(extract.import_facts(files))
        specifiers = imports.groupBy("file").agg(distinct_sorted("specifier").alias("imports"))
        every = settled(extract.declarations(files).drop("last", "brace"))
        declared = every.where(names.is_component_name(F.col("name")) | F.col("is_default")).join(specifiers, "file", "left")
        declared = declared.withColumn("imports", F.coalesce("imports", F.array().cast("array<string>"))).withColumn("jsx_children", extract.tags(F.col("body")))
        kind = rules.classify(F.col("name"), F.col("imports"), F.col("jsx_children"), F.col("file"), F.col("body"), self.config.rules)
        lists = {
            "imported": imports, "declared": declared.withColumn("type", kind).drop("body", "imports"),
            "names": every.select("file", "name", "is_default"), "signals": extract.signals_by_file(files, read),
            "params": extract.params(files, self.config.compat, read), "exports": symbols.re_exports(files),
        }
        whole = files.select(
            F.col("path").alias("file"), "hash", "client", extract.has_dynamic_import(F.col("code")).alias("is_dynamic_import"), F.array_sort(extract.hook_calls(F.col("code"))).alias("hooks"))
        # all rows of a file meet once, each kind in a column of its own
        rows = {"whole": whole, "imports": specifiers} | lists
        inside = {name: F.struct(*(_ordered(table.columns))) for name, table in rows.items()}
        kinds = {name: table.select(inside[name].alias("x")).schema["x"].dataType for name, table in rows.items()}
        tall = [table.select("file", *((inside[n] if n == name else F.lit(None).cast(kinds[n])).alias(n) for n in rows)) for name, table in rows.items()]
        out = reduce(DataFrame.unionByName, tall).groupBy("file").agg(
            F.min("whole").alias("whole"), F.min("imports").alias("imports"), *(F.sort_array(F.collect_list(n)).alias(n) for n in lists))
        listed = (F.when(F.size(n) > 0, F.col(n)).alias(n) for n in lists)
        return out.where("whole IS NOT NULL").select("file", *(F.col(f"whole.{c}").alias(c) for c in ("hash", "client", "is_dynamic_import", "hooks")), F.col("imports.imports").alias("imports"), *listed)

    def assemble(self, facts: DataFrame, runtime: DataFrame | None = None) -> Tables:
        """All tables from the files' facts; whatever joins one file to another is done there."""
        return Tables(self.config, facts, runtime)


class Tables(Mapping[str, DataFrame]):
    """The tables of a run by name.

    Each table, and each step that several of them need, is worked out when it is first asked for, and once.
    """

    NAMES = ("nodes", "components", "routes", "composites", "route_intelligence", "dependencies", "edges", "diagnostics", "params", "summary")

    def __init__(self, config: Config, facts: DataFrame, runtime: DataFrame | None = None):
        self.config, self.facts, self.runtime = config, facts, runtime

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.NAMES:
            raise KeyError(name)
        return getattr(self, name)

    def __iter__(self) -> Iterator[str]:
        return iter(self.NAMES)

    def __len__(self) -> int:
        return len(self.NAMES)

    def _part(self, name: str) -> DataFrame:
        """The rows of one of the files' lists."""
        return self.facts.select("file", F.explode(name).alias("x")).select("file", "x.*")

    @cached_property
    def _files(self) -> DataFrame:
        return settled(source_files.numbered(self.facts.select(F.col("file").alias("path"))))

    @cached_property
    def _imports(self) -> DataFrame:
        return settled(extract.resolved(self._part("imported"), self._files, self.config.roots))

    @cached_property
    def _declared(self) -> DataFrame:
        """Every component, by what its own file says."""
        whole = self._files.select(F.col("path").alias("file"), F.col("ord").alias("file_ord"))
        rows = self.facts.select("file", "client", "is_dynamic_import", F.coalesce("imports", F.array().cast("array<string>")).alias("imports"), F.explode("declared").alias("x"))
        rows = rows.select("file", "client", "is_dynamic_import", "imports", "x.*").where(names.is_component_name(F.col("name"))).join(whole, "file")
        return settled(rows.select(
            names.canonical_id(F.col("file"), F.col("name")).alias("id"), "name", F.col("file").alias("relative_path"), "type",
            F.when(F.col("client"), "client").otherwise("server").alias("rendering"), F.when(F.col("is_default"), "default").otherwise("named").alias("export_type"),
            "imports", "jsx_children", "is_dynamic_import", "line", "column",
            F.when(F.col("form") == "default", 0.9).otherwise(0.95).alias("confidence"), F.struct(F.col("file_ord").alias("file"), "pos").alias("ord")))

    @cached_property
    def _used_in_files(self) -> DataFrame:
        """The components with the files that use each."""
        bound = self._imports.where("resolved IS NOT NULL AND kind IN ('named', 'default')").select("file", "kind", "resolved", F.col("name").alias("imported"))
        if not self.config.compat:  # a name counts where it is declared, also if it comes through other files
            exported = extract.resolved(self._part("exports"), self._files, self.config.roots).select("file", "name", "original", F.col("resolved").alias("target"))
            bound = symbols.through_exports(bound, exported, self._part("names"))
        uses = bound.select(names.canonical_id(F.col("resolved"), F.col("imported")).alias("id"), "file")
        return settled(intel.with_files_used(self._declared, uses))

    @cached_property
    def routes(self) -> DataFrame:
        return settled(source_files.routes(self._files, self.config.app_dir, self.config.compat))

    @cached_property
    def composites(self) -> DataFrame:
        components = self._declared
        own = intel.module_parts(components).withColumn("evidence", F.lit("module-ownership"))
        signals = settled(self._part("signals").select("root", "sub", "evidence").unionByName(own).distinct())
        claimed = signals.select(F.col("root").alias("name")).union(signals.select(F.concat("root", "sub"))).union(signals.select("sub")).distinct()
        return settled(intel.composites(signals, components, intel.prefixes(components, claimed)))

    @cached_property
    def params(self) -> DataFrame:
        return settled(self._part("params").select("file", "seq", "param", "pattern", "scope"))

    @cached_property
    def usage(self) -> DataFrame:
        """(id, used_in, usage_count): the routes that use each component."""
        return settled(intel.usage(self._members.select("id", F.col("path").alias("group"))))

    @cached_property
    def components(self) -> DataFrame:
        roots = self.composites.select(F.col("root_id").alias("id"), F.col("root").alias("composite_root"), "sub_components").dropDuplicates(["id"])
        components = self._used_in_files.join(roots, "id", "left").withColumn("is_composite", F.col("composite_root").isNotNull())
        components = components.join(self.usage.drop("usage_count"), "id", "left").withColumn("used_in_routes", F.coalesce("used_in", F.array().cast("array<string>"))).drop("used_in")
        return settled(components.withColumn("is_reusable", F.col("is_reusable") | (F.size("used_in_routes") > 1)))

    @cached_property
    def edges(self) -> DataFrame:
        files_imported = self._imports.where("resolved IS NOT NULL").select("file", "pos", "resolved").distinct().join(self._files.select(F.col("path").alias("file"), "ord"), "file")
        return settled(edges.unified(
            edges.as_edges(files_imported, F.col("file"), F.col("resolved"), "imports", F.col("ord"), F.col("pos")),
            edges.render_edges(self.components), edges.ownership_edges(self.composites, self.components), edges.route_edges(self.routes, self.components),
            edges.parent_edges(self.routes, self.config.compat), edges.reuse_edges(self.components)))

    @cached_property
    def diagnostics(self) -> DataFrame:
        return checks.verify(self.components, self.routes, self.composites, self.edges, self.runtime)

    @cached_property
    def summary(self) -> DataFrame:
        numbers = self.route_intelligence.select("hooks", "utils", (F.col("component_count") + F.col("dependency_count")).alias("complexity"))
        return intel.summary(self.components, numbers)

    @cached_property
    def nodes(self) -> DataFrame:
        """(id, label, type, kind) of everything that edges join."""
        of_routes = self.routes.select(F.concat(F.lit("route::"), "path").alias("id"), F.col("path").alias("label"), F.col("segment_type").alias("type"), F.lit("route").alias("kind"))
        return self._declared.select("id", F.col("name").alias("label"), "type", F.lit("component").alias("kind")).unionByName(of_routes)

    # what each route reaches through imports, its components, and its aggregates

    @cached_property
    def _seeds(self) -> DataFrame:
        special = F.filter(F.array("relative_path", "layout", "template", "loading", "error"), lambda x: x.isNotNull())
        return self.routes.select(F.col("path").alias("root"), F.explode(special).alias("node"))

    @cached_property
    def _depth(self) -> DataFrame:
        graph = self._imports.where("resolved IS NOT NULL AND NOT type_only AND kind <> 'side_effect'").select(F.col("file").alias("source"), F.col("resolved").alias("target"))
        return settled(reach.depths(graph, self._seeds))

    @cached_property
    def dependencies(self) -> DataFrame:
        depth = self._depth
        kinds = self._imports.where("resolved IS NOT NULL AND NOT type_only AND kind IN ('named', 'default', 'namespace')").select("file", "name", F.col("resolved").alias("target"), rules.classify_export(F.col("name"), F.col("resolved")).alias("kind"))
        return settled(depth.join(kinds, depth["node"] == kinds["file"]).select(F.col("root").alias("path"), "name", "target", "kind").distinct())

    @cached_property
    def _members(self) -> DataFrame:
        """(path, id, name, type, ord): a route has the components of its own files, and those that it imports by name."""
        components, depth, walked = self._declared, self._depth, self.dependencies
        by_file = depth.select(F.col("root").alias("path"), F.col("node").alias("relative_path")).join(components.select("id", "name", "type", "relative_path", "ord"), "relative_path").select("path", "id", "name", "type", "ord")
        by_name = walked.where("kind IN ('component', 'provider')").select("path", "name").distinct().join(components.select("id", "name", "type", "ord"), "name").select("path", "id", "name", "type", "ord")
        inside = by_file.unionByName(by_name).distinct()
        imported = walked.select("path", "name").distinct().withColumn("imported", F.lit(True))
        roots = self._seeds.select(F.col("root").alias("path"), F.col("node").alias("relative_path"))
        own = roots.join(components.select("id", "relative_path"), "relative_path").select("path", "id").distinct().withColumn("own", F.lit(True))
        return settled(inside.join(imported, ["path", "name"], "left").join(own, ["path", "id"], "left").where("imported OR own").select("path", "id", "name", "type", "ord"))

    @cached_property
    def route_intelligence(self) -> DataFrame:
        depth, walked, members = self._depth, self.dependencies, self._members
        calls = self.facts.select(F.col("file").alias("node"), F.explode("hooks").alias("called"))
        read = self.params.select(F.col("file").alias("node"), "scope", "param")
        # all that a route has meets once, each kind of row with columns of its own
        rows = [
            depth.select(F.col("root").alias("path"), "depth"), members.select("path", "id", "type", F.col("name").alias("component")),
            walked.select("path", "kind", F.col("name").alias("dependency")), depth.join(calls, "node").select(F.col("root").alias("path"), "called").distinct(),
            depth.join(read, "node").select(F.col("root").alias("path"), "scope", "param")]
        of = lambda t: distinct_sorted(F.when(F.col("type") == t, F.col("component")))
        kind = lambda k: distinct_sorted(F.when(F.col("kind") == k, F.col("dependency")))
        read_by = lambda scope: distinct_sorted(F.when(F.col("scope") == scope, F.col("param")))
        told = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows).groupBy("path").agg(
            F.max("depth").alias("depth"), distinct_sorted("component").alias("components"), F.size(F.collect_set("id")).cast("long").alias("component_count"),
            of("dialog").alias("dialogs"), of("grid").alias("grids"), of("chart").alias("charts"), of("provider").alias("own_providers"),
            kind("hook").alias("hooks"), kind("util").alias("utils"), kind("provider").alias("providers"), distinct_sorted("dependency").alias("dependencies"),
            distinct_sorted("called").alias("called"), read_by("search").alias("search_params"), read_by("route").alias("read_params"))
        out = self.routes.join(told, "path", "left")
        empty = F.array().cast("array<string>")
        lists = {n: F.coalesce(n, empty) for n in ("components", "dialogs", "grids", "charts", "hooks", "utils", "dependencies", "search_params", "read_params")}
        out = out.withColumns(lists).withColumns({
            "providers": F.array_sort(F.array_union(F.coalesce("providers", empty), F.coalesce("own_providers", empty))),
            "hooks": F.array_sort(F.array_union(F.col("hooks"), F.coalesce("called", empty))),
            "component_count": F.coalesce("component_count", F.lit(0)), "dependency_count": F.size("dependencies"), # those of the path, in its order, then others that its files read
            "dynamic_params": F.array_distinct(F.concat(paths.route_params(F.col("path")), "read_params")),
        })
        return settled(out.drop("own_providers", "called", "read_params"))
