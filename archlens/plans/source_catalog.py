"""Named queries that run the analysis over the project of ``samples``, each with its DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archlens.functions import extract, rules
from archlens.operators import graph_views, symbols
from archlens.operators.keep import shared_folder
from archlens.plans import incremental
from archlens.plans.catalog import query, table
from archlens.plans.samples import SQL, analysed, project
from archlens.plans.session import Session
from archlens.sources import inject, snapshots
from archlens.sources.files import numbered, routes


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(spark, sf_dir).where("path NOT LIKE 'node_modules%'")


# --- facts from sources ---------------------------------------------------------------


@query(SQL + "SELECT file, pos, kind, name, specifier, type_only, resolved FROM im")
def src_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return extract.resolved(extract.import_facts(files), files).select("file", "pos", "kind", "name", "specifier", "type_only", "resolved")


@query(SQL + "SELECT file, name, form, form = 'default' AS is_default, line FROM de")
def src_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.declarations(_files(spark, sf_dir)).select("file", "name", "form", "is_default", "line")


@query(SQL + """SELECT file, coalesce(list_sort(list_distinct(list_concat(list(tag) FILTER (tag IS NOT NULL), CASE WHEN file LIKE 'components/r%' THEN ['Ghost'] ELSE [] END))), []) AS tags, bool_or(client) AS client, false AS dynamic,
  CASE WHEN file LIKE 'components/r%' THEN [regexp_replace(file, 'components/r([0-9]+)/.*', 'useRegion\\1')] ELSE [] END AS hooks FROM de WHERE file NOT LIKE 'hooks/%' GROUP BY file""")
def src_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("code")
    return extract.lexed(_files(spark, sf_dir).where("path NOT LIKE 'hooks/%'")).select(
        F.col("path").alias("file"), F.array_sort(extract.tags(text)).alias("tags"), "client", extract.has_dynamic_import(text).alias("dynamic"), extract.hook_calls(text).alias("hooks"))


@query(SQL + """SELECT 'app' || path || '/page.tsx' AS file, 'tab' || c % 3 AS param, 'useSearchParams' AS pattern, 'search' AS scope FROM cu
UNION ALL SELECT 'app' || path || '/page.tsx', 'id' || c, 'params', 'route' FROM cu WHERE c % 7 = 0""")
def src_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.params(_files(spark, sf_dir)).select("file", "param", "pattern", "scope")


@query("""SELECT 'Tabs' || r_regionkey AS root, x.sub AS sub, x.evidence AS evidence
FROM region, (VALUES ('List', 'dotted-jsx'), ('Panel', 'static-property'), ('Item', 'object-assign'), ('Trigger', 'object-assign')) x(sub, evidence)""")
def src_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite parts by tag, assignment and ``Object.assign``, in a file for each region."""
    r = F.col("r_regionkey").cast("string")
    text = F.concat(F.lit("export function Tabs"), r, F.lit("() { return <Tabs"), r, F.lit(".List />; }\nTabs"), r, F.lit(".Panel = Panel;\nMath.Big = 1;\nObject.assign(Tabs"), r, F.lit(", { Item, Trigger: X, low });\n"))
    return extract.composite_signals(table(spark, sf_dir, "region").select(F.concat(F.lit("t"), r).alias("path"), text.alias("content")))


@query(SQL + """SELECT path, 'app' || path || '/page.tsx' AS relative_path, CASE WHEN path LIKE '%[%' THEN 'dynamic' ELSE 'static' END AS segment_type,
  CASE WHEN r % 2 = 0 AND path = '/r' || r THEN 'app' || path || '/layout.tsx' END AS layout, coalesce(nullif(regexp_replace(path, '/[^/]+$', ''), ''), '/') AS parent
FROM (SELECT path, r FROM cu UNION ALL SELECT path, r FROM np UNION ALL SELECT path, r FROM rg)""")
def src_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes(numbered(_files(spark, sf_dir))).select("path", "relative_path", "segment_type", "layout", "parent")


@query(SQL + """SELECT name, CASE WHEN name LIKE 'use%' THEN 'hook' WHEN name LIKE '%Provider' THEN 'provider' ELSE 'component' END AS kind, count(*) AS n
FROM im WHERE resolved IS NOT NULL GROUP BY name""")
def src_export_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    found = extract.resolved(extract.import_facts(files), files).where("resolved IS NOT NULL")
    return found.groupBy("name", rules.classify_export(F.col("name"), F.col("resolved")).alias("kind")).agg(F.count("*").alias("n"))


@query(SQL + """SELECT im.file, im.name, resolved || '#' || im.name AS id, 'named' AS via, 0.85::DOUBLE AS confidence FROM im WHERE resolved IS NOT NULL
UNION ALL SELECT de.file, de.name, de.file || '#' || de.name, 'local', 0.95::DOUBLE FROM de WHERE de.file LIKE 'components/%'""")
def src_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What imported names, and names declared in components' files, stand for."""
    files = _files(spark, sf_dir)
    imports, declared = extract.resolved(extract.import_facts(files), files), extract.declarations(files)
    names = imports.where("resolved IS NOT NULL").select("file", "name").unionByName(declared.where("file LIKE 'components/%'").select("file", "name"))
    return symbols.resolve(names, imports, declared).select("file", "name", "id", "via", F.col("confidence").cast("decimal(3,2)").cast("double").alias("confidence"))


# --- tables of the session --------------------------------------------------------------


@query(SQL + """SELECT id, name, file AS relative_path, type, CASE WHEN client THEN 'client' ELSE 'server' END AS rendering, CASE WHEN form = 'default' THEN 'default' ELSE 'named' END AS export_type, line,
  n_files AS used_in_files, n_routes AS used_in_routes, n_files > 1 OR n_routes > 1 AS is_reusable,
  file LIKE 'components/r%' AND regexp_extract(name, '^Nation([0-9]+)$', 1) <> '' AND coalesce(try_cast(regexp_extract(name, '^Nation([0-9]+)$', 1) AS INTEGER), 1) % 4 = 0 AS is_composite FROM co""")
def src_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysed(spark, sf_dir)["components"].select(
        "id", "name", "relative_path", "type", "rendering", "export_type", "line", F.size("used_in_files").cast("long").alias("used_in_files"),
        F.size("used_in_routes").cast("long").alias("used_in_routes"), "is_reusable", "is_composite")


@query(SQL + "SELECT source, target, relationship FROM ed")
def src_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysed(spark, sf_dir)["edges"].select("source", "target", "relationship")


@query(SQL + """SELECT 'Nation' || k AS root, file || '#Nation' || k AS root_id, ['Cell', 'Row'] AS sub_components, [file || '#Nation' || k || 'Cell', file || '#Nation' || k || 'Row'] AS sub_component_ids,
  ['Nation' || k || '.Cell', 'Nation' || k || '.Row', 'Nation' || k || 'Cell', 'Nation' || k || 'Row'] AS full_names, ['module-ownership'] AS evidence, 0.9::DOUBLE AS score FROM nat WHERE k % 4 = 0""")
def src_composites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysed(spark, sf_dir)["composites"].select("root", "root_id", "sub_components", "sub_component_ids", "full_names", "evidence", F.col("score").cast("double").alias("score"))


@query(SQL + """, reach AS (SELECT path, list_sort(list_distinct(list('Nation' || j))) AS ns, list_sort(list_distinct(list('useRegion' || chain.r))) AS hs, count(*) + 1 AS depth FROM pg JOIN chain USING (k) GROUP BY path)
SELECT path, list_sort(list_concat(ns, [page])) AS components, hs AS hooks, list_sort(list_concat(ns, hs)) AS dependencies, [] AS providers, depth, CASE WHEN path LIKE '%[%' THEN [regexp_extract(path, '\\[(.*)\\]', 1)] ELSE [] END AS params,
  CASE WHEN page LIKE 'C%' THEN ['tab' || regexp_extract(page, '[0-9]+')::BIGINT % 3] ELSE [] END AS search_params FROM pg JOIN reach USING (path)
UNION ALL SELECT path, CASE WHEN r % 2 = 0 THEN ['Region' || r || 'Layout', 'Region' || r || 'Page', 'ThemeProvider'] ELSE ['Region' || r || 'Page'] END, [], CASE WHEN r % 2 = 0 THEN ['ThemeProvider'] ELSE [] END,
  CASE WHEN r % 2 = 0 THEN ['ThemeProvider'] ELSE [] END, (r % 2 = 0)::INTEGER, [], [] FROM rg""")
def src_route_intelligence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysed(spark, sf_dir)["route_intelligence"].select(
        "path", F.col("components"), F.col("hooks"), F.col("dependencies"), "providers", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.col("dynamic_params").alias("params"), "search_params")


@query(SQL + """SELECT 'orphan-node' AS category, 'info' AS severity, id AS node FROM co WHERE name LIKE 'Orphan%'
UNION ALL SELECT 'unresolved-jsx', 'warning', id FROM co WHERE tag LIKE 'Missing%'
UNION ALL SELECT 'impossible-render-tree', 'warning', id FROM co WHERE tag = name""")
def src_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysed(spark, sf_dir)["diagnostics"].select("category", "severity", "node")


@query(SQL + """, d AS (SELECT path, count(*) AS n, count(DISTINCT chain.r) AS h FROM pg JOIN chain USING (k) GROUP BY path),
x AS (SELECT 2 * n + 1 + h AS complexity FROM d UNION ALL SELECT CASE WHEN r % 2 = 0 THEN 4 ELSE 1 END FROM rg)
SELECT (SELECT count(*) FROM x) AS screens, count(*) AS components, (SELECT count(*) FROM reu) AS reusable_components, 0::BIGINT AS dialogs, 0::BIGINT AS grids, 0::BIGINT AS charts,
  count(*) FILTER (type = 'provider') AS providers, count(*) FILTER (type = 'layout') AS layouts, count(*) FILTER (type = 'page') AS pages, count(*) FILTER (client) AS client_components, count(*) FILTER (NOT client) AS server_components,
  (SELECT count(DISTINCT r) FROM own) AS hooks, 0::BIGINT AS utils, (SELECT floor(avg(complexity) + 0.5)::BIGINT FROM x) AS avg_complexity, (SELECT max(complexity) FROM x) AS max_complexity FROM co""")
def src_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysed(spark, sf_dir)["summary"]


@query(SQL + """SELECT * FROM (SELECT id, name AS label, type, 'component' AS kind FROM co
UNION ALL SELECT 'route::' || path, path, CASE WHEN path LIKE '%[%' THEN 'dynamic' ELSE 'static' END, 'route' FROM (SELECT path FROM pg UNION ALL SELECT path FROM rg))""")
def src_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysed(spark, sf_dir)["nodes"].select("id", "label", "type", "kind")


# --- views, rewriting and incremental runs ------------------------------------------------


@query(SQL + """, p AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS i FROM (SELECT path FROM pg UNION ALL SELECT path FROM rg)),
c AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS i FROM (SELECT DISTINCT name FROM mem))
SELECT 'route::' || path AS id, path AS label, 'route' AS type, (i * 280)::DOUBLE AS x, 0::DOUBLE AS y FROM p UNION ALL SELECT 'comp::' || name, name, 'component', (i * 160)::DOUBLE, 250::DOUBLE FROM c""")
def view_architecture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_views.view("architecture", analysed(spark, sf_dir))[0]


@query(SQL + """, u AS (SELECT co.id, mem.path FROM mem JOIN co USING (name)), n AS (SELECT id, count(DISTINCT path) AS n FROM u GROUP BY id HAVING count(DISTINCT path) > 1)
SELECT DISTINCT 'route::' || path AS source, 'reusable::' || id AS target FROM u JOIN n USING (id)""")
def view_reuse_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_views.view("reuse", analysed(spark, sf_dir))[1]


@query(SQL + """SELECT 'route::/r0' AS id, '/r0' AS label, 'route' AS type, 300::DOUBLE AS x, 0::DOUBLE AS y UNION ALL SELECT * FROM (VALUES
  ('provider::ThemeProvider', 'ThemeProvider', 'provider', 300::DOUBLE, 140::DOUBLE), ('component::Region0Layout', 'Region0Layout', 'component', 210::DOUBLE, 260::DOUBLE), ('component::Region0Page', 'Region0Page', 'component', 390::DOUBLE, 260::DOUBLE))""")
def view_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_views.nodes("detail", analysed(spark, sf_dir), "/r0").select("id", "label", "type", "x", "y")


@query(SQL + """, m AS (SELECT path, count(DISTINCT j) + count(DISTINCT chain.r) AS deps, count(DISTINCT j) + 1 AS comp, count(DISTINCT chain.r) AS hooks, count(*) + 1 AS depth, [] AS badges FROM pg JOIN chain USING (k) GROUP BY path
UNION ALL SELECT path, CASE WHEN r % 2 = 0 THEN 1 ELSE 0 END, CASE WHEN r % 2 = 0 THEN 3 ELSE 1 END, 0, CASE WHEN r % 2 = 0 THEN 1 ELSE 0 END, CASE WHEN r % 2 = 0 THEN ['provider'] ELSE [] END FROM rg),
n AS (SELECT *, row_number() OVER (ORDER BY path) - 1 AS i, ceil(sqrt(count(*) OVER ())) AS c FROM m)
SELECT 'route::' || path AS id, path AS label, ((i % c) * 300)::DOUBLE AS x, (floor(i / c) * 200)::DOUBLE AS y, badges, deps, comp, hooks, depth FROM n""")
def view_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the detail view falls back to without a path: all routes with badges and metrics."""
    return graph_views.nodes("detail", analysed(spark, sf_dir)).drop("type")


@query(SQL + """SELECT 'route::' || coalesce(nullif(regexp_replace(path, '/[^/]+$', ''), ''), '/') AS source, 'route::' || path AS target, 'child' AS label FROM (SELECT path, k, r FROM cu UNION ALL SELECT path, k, r FROM np)
WHERE coalesce(nullif(regexp_replace(path, '/[^/]+$', ''), ''), '/') IN (SELECT path FROM pg UNION ALL SELECT path FROM rg)""")
def view_overview_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_views.overview_children(analysed(spark, sf_dir)["routes"])


_SQL_CALL = "'{ ' || chr(10) || '  useComponentRegistration({ canonicalId: \"' || file || '#' || name || '\", type: \"component\", sourceFile: \"' || file || '\", exportName: \"' || name || '\", compositeRoot: null });'"


@query(SQL + """SELECT file AS path, CASE WHEN k % 4 = 0 THEN ['Nation' || k, 'Nation' || k || 'Row', 'Nation' || k || 'Cell'] ELSE ['Nation' || k] END AS injected, true AS transformed,
  CASE WHEN k % 4 = 0 THEN 3 ELSE 1 END::BIGINT AS calls, true AS headed FROM nat WHERE k % 3 = 0
UNION ALL SELECT file, [], false, 0, false FROM nat WHERE k % 3 <> 0""")
def src_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = inject.registered(_files(spark, sf_dir).where("path LIKE 'components/r%'"))
    again = inject.registered(done.select("path", F.col("code").alias("content"))).select("path", F.col("code").alias("twice"))
    calls = F.size(F.regexp_extract_all("code", F.lit(r'\{\n  useComponentRegistration\(\{ canonicalId: "([^"]+)"'), F.lit(1))).cast("long")
    headed = F.col("code").rlike('^"use client"\nimport \\{ useComponentRegistration \\} from ') & (F.col("code") == F.col("twice"))
    return done.join(again, "path").select("path", "injected", "transformed", calls.alias("calls"), headed.alias("headed"))


@query(SQL + """SELECT file, regexp_replace(specifier, '^(\\.{1,2}/.*)$', '\\1.js') AS specifier FROM im WHERE kind <> 'side_effect'
UNION ALL SELECT file, './c.css.js' FROM im WHERE kind = 'side_effect'""")
def src_js_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return extract.import_facts(files.withColumn("content", inject.with_js_suffix(F.col("content")))).select("file", "specifier")


@query(SQL + """SELECT 'app' || path || '/page.tsx' AS path, CASE WHEN c % 10 = 0 THEN 'new' ELSE 'changed' END AS status FROM cu WHERE c % 10 = 0 OR c % 10 = 1
UNION ALL SELECT 'gone.tsx', 'removed'""")
def src_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New, changed and removed files against a snapshot to which changes were applied one after the other."""
    files = _files(spark, sf_dir)
    number = F.regexp_extract("path", r"/(?:c|\[id)(\d+)\]?/page\.tsx$", 1)
    tagged = files.withColumn("c", F.nullif(number, F.lit("")).cast("long"))
    old = snapshots.hashed(tagged.where("c IS NULL OR c % 10 <> 0").withColumn("content", F.when(F.col("c") % 10 == 1, F.lit("old")).otherwise(F.col("content"))))
    extra = spark.createDataFrame([("gone.tsx", "0"), ("app/dropped.tsx", "1")], "path string, hash string")
    before = snapshots.without(snapshots.updated(old, extra), extra.where("path = 'app/dropped.tsx'"))
    todo = snapshots.changed(files, before).select("path")
    status = snapshots.difference(snapshots.hashed(files), before).where("status <> 'unchanged'")
    return status.join(todo.withColumn("todo", F.lit(True)), "path", "left").where("todo OR status = 'removed'").select("path", "status")


@query(SQL + """SELECT source, target, relationship, (SELECT count(*) FROM cu WHERE c % 10 < 2) AS analysed, 1::BIGINT AS removed FROM ed""")
def src_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges after an update in which a tenth of the pages changed, a tenth came and a file went; only their texts are analysed again."""
    files = _files(spark, sf_dir)
    number = F.nullif(F.regexp_extract("path", r"/(?:c|\[id)(\d+)\]?/page\.tsx$", 1), F.lit("")).cast("long")
    old = files.withColumn("c", number).where("c IS NULL OR c % 10 <> 0").withColumn("content", F.when(F.col("c") % 10 == 1, F.lit("export function Old() { return <ThemeProvider /> }")).otherwise(F.col("content"))).drop("c")
    gone = spark.createDataFrame([("components/gone.tsx", "export function Gone() { return <Nation0 /> }")], "path string, content string")
    runs = incremental.Incremental(Session(spark), f"{shared_folder(spark)}/facts-{uuid.uuid4().hex}")
    runs.update(old.unionByName(gone))
    done = runs.run(files)
    return done.tables["edges"].select("source", "target", "relationship", F.lit(done.analysed).cast("long").alias("analysed"), F.lit(done.removed).cast("long").alias("removed"))
