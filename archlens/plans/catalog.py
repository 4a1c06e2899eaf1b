"""Named queries over the driver's tables, each with its DuckDB SQL.

The tables hold no source trees, so every operator is run on an analogue: pages
stand for routes, parts and suppliers for components, orders for edges, events
for telemetry.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archlens.functions import names, paths, rules, values
from archlens.operators import checks, edges, intel, keep, reach, views
from archlens.sources import inject, snapshots
from archlens.streaming import runtime

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The path of a URL without scheme, host, query, fragment and closing slash.
_PATH = r"^[a-z]+://[^/]+|[?#].*$|/$"
_SQL_PATH = r"regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+', ''), '[?#].*$', ''), '/$', '')"


def _page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://[^/]+", ""), r"[?#].*$", ""), "/$", "")
    return table(spark, sf_dir, "pages").select("page_id", "url", path.alias("raw"))


# --- routes and scans -----------------------------------------------------------------


@query(rf"""
WITH p AS (SELECT page_id, regexp_replace({_SQL_PATH}, '[0-9]+', '[id]') AS path FROM pages)
SELECT CASE WHEN path = '' THEN '/' ELSE path END AS route, CASE WHEN path LIKE '%[%' THEN 'dynamic' ELSE 'static' END AS segment_type,
  CASE WHEN path = '' THEN NULL ELSE coalesce(nullif(regexp_replace(path, '/[^/]+$', ''), ''), '/') END AS parent, count(*) AS pages, min(page_id) AS first_page
FROM p GROUP BY ALL""")
def route_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    route = paths.route_path(F.regexp_replace("raw", "[0-9]+", "[id]"))
    pages = _page_paths(spark, sf_dir).select("page_id", route.alias("route"))
    return pages.select("page_id", "route", paths.segment_type(F.col("route")).alias("segment_type"), paths.parent_route(F.col("route")).alias("parent")).groupBy(
        "route", "segment_type", "parent").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))


@query(r"""
WITH q AS (SELECT page_id, unnest(regexp_extract_all(url, '[?&]([a-zA-Z_]\w*)=', 1)) AS param, regexp_extract(url, '^([a-z]+)://', 1) AS scheme FROM pages)
SELECT param, count(DISTINCT page_id) AS used_in, arg_min(scheme, page_id) AS access_pattern FROM q GROUP BY param""")
def route_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = pages.select("page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.explode(F.regexp_extract_all("url", F.lit(r"[?&]([a-zA-Z_]\w*)="), F.lit(1))).alias("param"))
    return found.where(paths.is_param_name(F.col("param"))).groupBy("param").agg(F.count_distinct("page_id").alias("used_in"), F.min_by("scheme", "page_id").alias("access_pattern"))


@query(r"SELECT page_id, url FROM pages WHERE regexp_matches(url, '/(en|de)/') AND NOT contains(url, 'm.') AND NOT contains(url, 'utm_')")
def file_scan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where(F.col("url").rlike("/(en|de)/") & ~F.contains("url", F.lit("m.")) & ~F.contains("url", F.lit("utm_"))).select("page_id", "url")


@query(r"SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages")
def tag_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array_distinct(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1)))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(tags).alias("tag"))


@query(r"SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS specifier FROM pages")
def import_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(found).alias("specifier"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(html, '^\s*<!DOCTYPE html><html lang="en"') THEN 'client' ELSE 'server' END AS rendering FROM pages""")
def rendering_env(spark: SparkSession, sf_dir: str) -> DataFrame:
    client = F.col("html").rlike(r'^\s*<!DOCTYPE html><html lang="en"')
    return table(spark, sf_dir, "pages").select("page_id", F.when(client, "client").otherwise("server").alias("rendering"))


# --- names, rules and identities --------------------------------------------------------


@query(r"""
SELECT p_partkey, CASE WHEN regexp_matches(p_name, '(?i)widget$') THEN 'provider' WHEN regexp_matches(p_name, '(?i)provider$|context$') THEN 'provider'
  WHEN regexp_matches(p_name, '(?i)dialog|modal|sheet|drawer|popover') THEN 'dialog' WHEN regexp_matches(p_name, '(?i)grid|table') THEN 'grid'
  WHEN regexp_matches(p_name, '(?i)chart|sparkline|visualization') OR (regexp_matches(p_name, '(?i)graph') AND NOT regexp_matches(p_name, '(?i)graphql')) THEN 'chart'
  ELSE 'component' END AS type FROM part""")
def classify_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    none = F.array().cast("array<string>")
    kind = rules.classify(F.col("p_name"), none, none, F.col("p_type"), custom=[rules.Rule("provider", ["(?i)widget$"])])
    return parts.select("p_partkey", kind.alias("type"))


@query(r"""
WITH n AS (SELECT p_partkey, p_brand, p_type, CASE p_partkey % 4 WHEN 0 THEN 'use' || p_type WHEN 1 THEN p_type || 'Provider' WHEN 2 THEN p_brand ELSE p_name END AS name FROM part)
SELECT p_partkey, name, CASE WHEN regexp_matches(name, '^use[A-Z]') THEN 'hook' WHEN regexp_matches(name, '(?i)(provider|context)$') THEN 'provider'
  WHEN regexp_matches(name, '^[A-Z][a-zA-Z0-9]*') AND NOT regexp_matches(name, '^[A-Z_]+$') THEN 'component' WHEN regexp_matches(name, '^[a-z]') THEN 'util' ELSE 'unknown' END AS kind FROM n""")
def export_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.concat(F.lit("use"), "p_type")).when(k == 1, F.concat("p_type", F.lit("Provider"))).when(k == 2, F.col("p_brand")).otherwise(F.col("p_name"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", name.alias("name"))
    return parts.select("p_partkey", "name", rules.classify_export(F.col("name"), F.col("p_brand")).alias("kind"))


@query("SELECT c_custkey, c_name || '#' || c_custkey::VARCHAR AS id, c_name AS path, c_custkey::VARCHAR AS name FROM customer")
def canonical_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = table(spark, sf_dir, "customer").select("c_custkey", names.canonical_id(F.col("c_name"), F.col("c_custkey").cast("string")).alias("id"))
    return built.select("c_custkey", "id", names.id_path(F.col("id")).alias("path"), names.id_name(F.col("id")).alias("name"))


@query("""SELECT p_partkey, array_to_string(list_transform(string_split(replace(p_name, ' ', '-'), '-'), lambda w: upper(w[1:1]) || w[2:]), '') AS name FROM part""")
def pascal_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", names.inferred_name(F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(".tsx"))).alias("name"))


# --- edges and joins --------------------------------------------------------------------


def _trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    supply = edges.as_edges(lines, F.concat(F.lit("s"), "l_suppkey"), F.concat(F.lit("p"), "l_partkey"), "renders", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    placed = edges.as_edges(orders, F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("o"), "o_orderkey"), "imports", F.col("o_orderkey"))
    return edges.unified(placed, supply)


_SQL_EDGES = """(SELECT source, target, relationship, min(seq)::BIGINT AS seq FROM (
  SELECT 's' || l_suppkey AS source, 'p' || l_partkey AS target, 'renders' AS relationship, l_orderkey * 10 + l_linenumber AS seq FROM lineitem
  UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'imports', o_orderkey FROM orders) GROUP BY ALL)"""


@query(f"SELECT * FROM {_SQL_EDGES}")
def edges_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trade_edges(spark, sf_dir)


@query(f"SELECT CASE relationship WHEN 'imports' THEN 'import' ELSE 'render' END AS graph, count(*) AS edges, count(DISTINCT source) AS sources FROM {_SQL_EDGES} GROUP BY 1")
def separated_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.routed(_trade_edges(spark, sf_dir)).groupBy("graph").agg(F.count("*").alias("edges"), F.count_distinct("source").alias("sources"))


@query("""
WITH last AS (SELECT p_name AS name, max(p_partkey) AS id FROM part GROUP BY p_name)
SELECT l_suppkey AS source, id AS target, count(*) AS uses FROM lineitem JOIN part ON l_partkey = p_partkey JOIN last ON p_name = name GROUP BY ALL""")
def render_edges_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    last = edges.last_by_name(parts.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ord")))
    sold = table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    # counts by name first: the join then has one row for each supplier and name
    named = sold.groupBy("l_suppkey", F.col("p_name").alias("name")).agg(F.count("*").alias("uses"))
    return named.join(last, "name").groupBy(F.col("l_suppkey").alias("source"), F.col("id").alias("target")).agg(F.sum("uses").alias("uses"))


@query("""
SELECT n_nationkey, n_name, min(c_custkey) AS page, (SELECT min(s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey) AS layout
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL""")
def first_match_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = keep.keep_first(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_custkey").alias("page")), ["n_nationkey"], ["page"])
    layout = keep.keep_first(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.col("s_suppkey").alias("layout")), ["n_nationkey"], ["layout"])
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name").join(page, "n_nationkey", "left").join(layout, "n_nationkey", "left")


@query("""SELECT o_orderkey AS child, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS parent FROM orders QUALIFY parent IS NOT NULL""")
def parent_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    ranked = orders.select("o_custkey", F.col("o_orderkey").alias("key"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("ord"))
    routes = ranked.select(F.concat_ws("/", F.lit(""), "o_custkey", "ord").alias("path"), F.concat_ws("/", F.lit(""), "o_custkey", F.col("ord") - 1).alias("parent"), "ord", "key")
    linked = edges.parent_edges(routes, compat=True)
    key = routes.select(F.concat(F.lit("route::"), "path").alias("node"), "key")
    return linked.join(key.select(F.col("node").alias("target"), F.col("key").alias("child")), "target").join(key.select(F.col("node").alias("source"), F.col("key").alias("parent")), "source").select("child", "parent")


@query("""
SELECT r_name AS root, n_name AS sub, r_regionkey::VARCHAR AS source, n_nationkey::VARCHAR AS target FROM region JOIN nation ON n_regionkey = r_regionkey""")
def ownership_or_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    groups = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("root")).agg(F.array_sort(F.collect_list("n_name")).alias("sub_components"))
    own = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    # even nations are named with their region in front, the others alone
    named = own.select(F.when(F.col("n_nationkey") % 2 == 0, F.concat("r_name", "n_name")).otherwise(F.col("n_name")).alias("name"), F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_nationkey").cast("long").alias("ord"))
    roots = region.select(F.col("r_name").alias("name"), F.concat(F.lit("r"), "r_regionkey").alias("id"), (F.col("r_regionkey") + 1000).cast("long").alias("ord"))
    found = edges.ownership_edges(groups, named.unionByName(roots))
    n = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("target"), F.col("n_name").alias("sub"))
    r = region.select(F.concat(F.lit("r"), "r_regionkey").alias("source"), F.col("r_name").alias("root"))
    return found.join(n, "target").join(r, "source").select("root", "sub", F.substring("source", 2, 10).alias("source"), F.substring("target", 2, 10).alias("target"))


_SQL_PART_NATION = "(SELECT DISTINCT l_partkey AS part, s_nationkey AS nation FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"


def _part_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part, nation) of every line."""
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"))
    return table(spark, sf_dir, "lineitem").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_partkey").alias("part"), "nation")


@query(f"SELECT nation AS source, part AS target FROM {_SQL_PART_NATION} QUALIFY count(*) OVER (PARTITION BY part) > 1")
def reuse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = intel.usage(_part_nations(spark, sf_dir).select(F.col("part").alias("id"), F.col("nation").alias("group")))
    return used.where(F.size("used_in") > 1).select(F.explode("used_in").alias("source"), F.col("id").alias("target"))


@query(f"""
WITH hits AS (SELECT l_partkey AS part, count(*) AS usage_count FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)
SELECT p_partkey AS id, p_type AS type, coalesce(n.routes, 0) AS routes, coalesce(usage_count, 0) AS usage_count
FROM part LEFT JOIN (SELECT part, count(*) AS routes FROM {_SQL_PART_NATION} GROUP BY part) n ON p_partkey = n.part LEFT JOIN hits ON p_partkey = hits.part""")
def component_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = intel.usage(_part_nations(spark, sf_dir).select(F.col("part").alias("id"), F.col("nation").alias("group")))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("type"))
    return parts.join(used, "id", "left").select("id", "type", F.coalesce(F.size("used_in").cast("long"), F.lit(0)).alias("routes"), F.coalesce("usage_count", F.lit(0)).alias("usage_count"))


@query("""
WITH b AS (SELECT DISTINCT s_nationkey AS nation, p_brand AS brand FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)
SELECT x.nation AS low, y.nation AS high, count(*) AS shared FROM b x JOIN b y ON x.brand = y.brand AND x.nation < y.nation GROUP BY ALL""")
def shared_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    nations = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"))
    return edges.shared_pairs(lines.join(brands, "l_partkey").join(nations, "l_suppkey"), "nation", "brand")


@query("""
WITH b AS (SELECT DISTINCT s_nationkey AS nation, p_brand AS brand FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)
SELECT x.nation AS low, y.nation AS high, count(*) AS shared FROM b x JOIN b y ON x.brand = y.brand AND x.nation < y.nation GROUP BY ALL""")
def shared_pairs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``shared_pairs`` over every line, whatever its quantity."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    nations = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"))
    return edges.shared_pairs(lines.join(brands, "l_partkey").join(nations, "l_suppkey"), "nation", "brand")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)")
def unresolved_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(known, "l_partkey", "left_anti").select("l_orderkey", "l_linenumber", "l_partkey")


@query("""
WITH d AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents) SELECT doc_id, first_id FROM d WHERE doc_id <> first_id""")
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    first = docs.groupBy("hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("hash", "first_id")
    return docs.join(first, "hash").where("doc_id <> first_id").select("doc_id", "first_id")


@query("""
WITH b AS (SELECT DISTINCT p_brand AS brand, l_suppkey AS root FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT brand, root, first_root FROM (SELECT *, min(root) OVER (PARTITION BY brand) AS first_root FROM b) WHERE root <> first_root""")
def dup_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand"))
    pairs = table(spark, sf_dir, "lineitem").join(brands, F.col("l_partkey") == F.col("p_partkey")).select("brand", F.col("l_suppkey").alias("root")).distinct()
    first = pairs.groupBy("brand").agg(F.min("root").alias("first_root"))
    return pairs.join(first, "brand").where("root <> first_root")


# --- aggregates --------------------------------------------------------------------------


@query("""
SELECT (SELECT count(*) FROM orders) AS screens, count(*) AS components, count(*) FILTER (c_acctbal > 5000) AS reusable_components,
  count(*) FILTER (c_mktsegment = 'BUILDING') AS dialogs, count(*) FILTER (c_mktsegment = 'MACHINERY') AS grids, 0::BIGINT AS charts, 0::BIGINT AS providers,
  0::BIGINT AS layouts, count(*) FILTER (c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) AS pages,
  count(*) FILTER (c_nationkey % 2 = 0) AS client_components, count(*) FILTER (c_nationkey % 2 = 1) AS server_components,
  (SELECT count(DISTINCT o_orderstatus) FROM orders) AS hooks, (SELECT count(DISTINCT o_orderpriority) FROM orders) AS utils,
  (SELECT floor(avg(o_custkey % 50) + 0.5)::BIGINT FROM orders) AS avg_complexity, (SELECT max(o_custkey % 50) FROM orders) AS max_complexity
FROM customer""")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "dialog").when(F.col("c_mktsegment") == "MACHINERY", "grid").otherwise("page")
    parts = table(spark, sf_dir, "customer").select(kind.alias("type"), (F.col("c_acctbal") > 5000).alias("is_reusable"), F.when(F.col("c_nationkey") % 2 == 0, "client").otherwise("server").alias("rendering"))
    routes = table(spark, sf_dir, "orders").select(F.array("o_orderstatus").alias("hooks"), F.array("o_orderpriority").alias("utils"), (F.col("o_custkey") % 50).alias("complexity"))
    return intel.summary(parts, routes)


@query("""SELECT CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warning' ELSE 'info' END AS severity, count(*) AS n FROM events GROUP BY 1""")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "warning").otherwise("info")
    return checks.by_severity(table(spark, sf_dir, "events").select(severity.alias("severity")))


# --- graph -------------------------------------------------------------------------------


def _order_graph(spark: SparkSession, sf_dir: str, some: bool = False) -> tuple[DataFrame, DataFrame]:
    """Edges nation -> customer -> order, and the orders as seeds of the reversed graph; ``some``: only partly shipped orders of low priority."""
    customer = table(spark, sf_dir, "customer")
    orders = table(spark, sf_dir, "orders")
    if some:
        orders = orders.where("o_orderstatus = 'P' AND o_orderpriority = '5-LOW'")
    down = customer.select(F.concat(F.lit("n"), "c_nationkey").alias("source"), F.concat(F.lit("c"), "c_custkey").alias("target"))
    return down.unionByName(orders.select(F.concat(F.lit("c"), "o_custkey").alias("source"), F.concat(F.lit("o"), "o_orderkey").alias("target"))), orders


@query("""
SELECT DISTINCT 'n' || c_nationkey AS root, node FROM customer LEFT JOIN orders o ON o_custkey = c_custkey, LATERAL (SELECT unnest(['n' || c_nationkey, 'c' || c_custkey, 'o' || o_orderkey]) AS node) WHERE node IS NOT NULL""")
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    down, _ = _order_graph(spark, sf_dir)
    seeds = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("root")).distinct().withColumn("node", F.col("root"))
    return reach.depths(down, seeds).select("root", "node")


@query("""
SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW')""")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    down, orders = _order_graph(spark, sf_dir, some=True)
    up = down.select(F.col("target").alias("source"), F.col("source").alias("target"))
    reached = reach.reachable(up, orders.select(F.concat(F.lit("o"), "o_orderkey").alias("node")))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("c"), "c_custkey").alias("node"))
    return customers.join(reached, "node", "left_anti").select("c_custkey")


@query("""
SELECT 'n' || c_nationkey AS root, CASE WHEN count(o_orderkey) > 0 THEN 2 ELSE 1 END AS depth
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_nationkey""")
def min_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    down, _ = _order_graph(spark, sf_dir)
    seeds = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("root")).distinct().withColumn("node", F.col("root"))
    return reach.depths(down, seeds).groupBy("root").agg(F.max("depth").alias("depth"))


@query("""
WITH RECURSIVE e AS (SELECT n_nationkey AS s, (n_nationkey * n_nationkey + 1) % 25 AS t FROM nation),
r AS (SELECT s, t, 1 AS d FROM e UNION SELECT r.s, e.t, d + 1 FROM r JOIN e ON r.t = e.s WHERE d < 25)
SELECT DISTINCT s::BIGINT AS node FROM r WHERE s = t""")
def cycle_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey").cast("long")
    return reach.cycle_nodes(table(spark, sf_dir, "nation").select(key.alias("source"), ((key * key + 1) % 25).alias("target"))).select("node")


# --- composites --------------------------------------------------------------------------

_SQL_NAMES = """(SELECT DISTINCT upper(p_name[1:1]) || split_part(p_name, ' ', 1)[2:] AS name FROM part
  UNION SELECT DISTINCT array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || w[2:]), '') FROM part)"""


def _part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = table(spark, sf_dir, "part").select(names.pascal_case(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("name"))
    first = table(spark, sf_dir, "part").select(names.pascal_case(F.substring_index("p_name", " ", 1)).alias("name"))
    return whole.union(first).distinct()


@query(f"""
WITH n AS (SELECT name FROM {_SQL_NAMES}),
p AS (SELECT a.name AS root, b.name[length(a.name) + 1:] AS sub FROM n a JOIN n b ON starts_with(b.name, a.name) AND length(b.name) > length(a.name) AND length(a.name) >= 4 AND regexp_matches(b.name[length(a.name) + 1:], '^[A-Z]'))
SELECT root, sub FROM p QUALIFY count(*) OVER (PARTITION BY root) >= 2""")
def prefix_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intel.prefixes(_part_names(spark, sf_dir))


@query(f"""
WITH n AS (SELECT name FROM {_SQL_NAMES}),
p AS (SELECT a.name AS root, b.name AS name FROM n a JOIN n b ON starts_with(b.name, a.name) AND length(b.name) > length(a.name) AND length(a.name) >= 4 AND regexp_matches(b.name[length(a.name) + 1:], '^[A-Z]')
  QUALIFY count(*) OVER (PARTITION BY a.name) >= 2)
SELECT n.name, 'part.tsx#' || coalesce(p.root, n.name) AS canonical FROM n LEFT JOIN p USING (name)""")
def canonical_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _part_names(spark, sf_dir)
    components = found.select("name", names.canonical_id(F.lit("part.tsx"), F.col("name")).alias("id"), F.xxhash64("name").alias("ord"))
    groups = intel.composites(components.select("name", "id").limit(0).select(F.col("name").alias("root"), F.col("name").alias("sub"), F.col("id").alias("evidence")), components, intel.prefixes(found))
    return intel.collapsed(found, groups, components).select("name", "canonical")


# --- telemetry ---------------------------------------------------------------------------


def _telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views mount, clicks render, errors unmount; users are the components."""
    kind = F.when(F.col("event_type") == "view", "mount").when(F.col("event_type") == "click", "render").when(F.col("event_type") == "error", "unmount")
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("component"), kind.alias("event"), F.col("value").alias("duration"), "ts", F.col("event_id").alias("seq")).where("event IS NOT NULL")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("average_render", F.round("average_render", 6))


_SQL_RUNTIME = """
WITH f AS (SELECT user_id, min(struct_pack(ts := ts, id := event_id)) AS first FROM events WHERE event_type = 'view' GROUP BY 1),
l AS (SELECT e.* FROM events e JOIN f USING (user_id) WHERE struct_pack(ts := ts, id := event_id) >= first),
runtime AS (SELECT user_id::VARCHAR AS component, count(*) FILTER (event_type = 'view') AS mount_count, count(*) FILTER (event_type = 'error') AS unmount_count,
  count(*) FILTER (event_type = 'click') + 1 AS render_count, round(coalesce(avg(value) FILTER (event_type = 'click'), 0), 6) AS average_render,
  max(ts) FILTER (event_type = 'view') AS last_mounted, max(ts) FILTER (event_type = 'error') AS last_unmounted FROM l GROUP BY 1)
"""


@query(_SQL_RUNTIME + "SELECT * FROM runtime")
def runtime_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(runtime.fold(_telemetry(spark, sf_dir)))


@query("""
SELECT v.event_id, v.user_id, s.value AS route FROM (SELECT * FROM events WHERE event_type = 'view') v
LEFT JOIN LATERAL (SELECT value FROM events s WHERE s.event_type = 'signup' AND s.user_id = v.user_id AND (s.ts, s.event_id) <= (v.ts, v.event_id) ORDER BY s.ts DESC, s.event_id DESC LIMIT 1) s ON true""")
def runtime_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("seq", F.col("event_id"))
    mounts = events.where("event_type = 'view'").select("user_id", "ts", "seq", "event_id")
    changes = events.where("event_type = 'signup'").select("user_id", "ts", "seq", F.col("value").alias("route"))
    return runtime.current_route(mounts, changes, "user_id", "route", default=None).select("event_id", "user_id", "route")


def _sql_half(name: str, when: str) -> str:
    return f"""{name}_f AS (SELECT user_id, min(struct_pack(ts := ts, id := event_id)) AS first FROM events WHERE event_type = 'view' AND {when} GROUP BY 1),
{name} AS (SELECT user_id::VARCHAR AS component, count(*) FILTER (event_type = 'view') AS mounts, count(*) FILTER (event_type = 'error') AS unmounts, count(*) FILTER (event_type = 'click') AS clicks,
  sum(value) FILTER (event_type = 'click') AS total, max(ts) FILTER (event_type = 'view') AS lm, max(ts) FILTER (event_type = 'error') AS lu
  FROM events JOIN {name}_f USING (user_id) WHERE {when} AND struct_pack(ts := ts, id := event_id) >= first GROUP BY 1)"""


@query(f"""
WITH {_sql_half('a', "ts < TIMESTAMP '2024-01-16'")}, {_sql_half('b', "ts >= TIMESTAMP '2024-01-16'")}
SELECT component, coalesce(a.mounts, 0) + coalesce(b.mounts, 0) AS mount_count, coalesce(a.unmounts, 0) + coalesce(b.unmounts, 0) AS unmount_count,
  coalesce(a.clicks, 0) + coalesce(b.clicks, 0) + 1 AS render_count,
  round(coalesce((coalesce(a.total, 0) + coalesce(b.total, 0)) / nullif(coalesce(a.clicks, 0) + coalesce(b.clicks, 0), 0), 0), 6) AS average_render,
  coalesce(b.lm, a.lm) AS last_mounted, coalesce(b.lu, a.lu) AS last_unmounted
FROM a FULL JOIN b USING (component)""")
def runtime_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _telemetry(spark, sf_dir)
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    return _rounded(runtime.merge(runtime.fold(events.where(early)), runtime.fold(events.where(~early))))


@query(_SQL_RUNTIME + "SELECT * FROM runtime")
def runtime_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stateful fold over the events as a file stream, equal to ``runtime_agg``."""
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    kind = F.when(F.col("event_type") == "view", "mount").when(F.col("event_type") == "click", "render").when(F.col("event_type") == "error", "unmount")
    facts = stream.select(F.col("user_id").cast("string").alias("component"), kind.alias("event"), F.col("value").alias("duration"), "ts", F.col("event_id").alias("seq")).where("event IS NOT NULL")
    return _rounded(runtime.collected(runtime.fold_stream(facts)))


@query(_SQL_RUNTIME + "SELECT runtime.*, coalesce(c_name, component) AS name FROM runtime LEFT JOIN customer ON c_custkey::VARCHAR = component")
def runtime_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("component"), F.col("c_name").alias("name"))
    return views.runtime_table(_rounded(runtime.fold(_telemetry(spark, sf_dir))), people)


# --- incremental runs, views, sinks ------------------------------------------------------


@query("""
WITH old AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 0)
SELECT d.doc_id::VARCHAR AS path, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN sha256(d.text) <> sha256(o.text) THEN 'changed' ELSE 'unchanged' END AS status FROM documents d LEFT JOIN old o USING (doc_id)""")
def incremental_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", F.col("text").alias("content"))
    old = docs.where("doc_id % 10 <> 0").withColumn("content", F.when(F.col("doc_id") % 7 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return snapshots.difference(snapshots.hashed(docs), snapshots.hashed(old))


@query(rf"""
WITH p AS (SELECT DISTINCT list_filter(string_split({_SQL_PATH}, '/'), lambda s: s <> '') AS parts FROM pages),
n AS (SELECT '/' || array_to_string(parts[1:k], '/') AS path, k = len(parts) AS own, k FROM p, LATERAL (SELECT unnest(range(0, len(parts) + 1)) AS k))
SELECT path, CASE WHEN path = '/' THEN '' ELSE regexp_extract(path, '[^/]*$') END AS segment, CASE WHEN path = '/' THEN NULL ELSE coalesce(nullif(regexp_replace(path, '/[^/]+$', ''), ''), '/') END AS parent,
  max(k)::INTEGER AS depth, bool_or(own) AS is_route FROM n GROUP BY ALL""")
def route_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.route_tree(_page_paths(spark, sf_dir).select(F.col("raw").alias("path")))


@query("""
WITH k AS (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1)
SELECT n_name AS "group", count(*) AS items, sum(coalesce(orders, 0))::BIGINT AS children FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN k ON o_custkey = c_custkey GROUP BY 1""")
def dep_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    items = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("name"), "n_name", "c_custkey")
    children = table(spark, sf_dir, "orders").join(items.select("c_custkey", F.col("name").alias("parent")), F.col("o_custkey") == F.col("c_custkey")).select("parent", F.col("o_orderkey").cast("string").alias("child"))
    tree = views.dependency_tree(items.select("name", "n_name"), F.col("n_name"), children)
    return tree.groupBy("group").agg(F.count_distinct("item").alias("items"), F.count("child").alias("children"))


@query("""
WITH n AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS i, ceil(sqrt(count(*) OVER ())) AS c FROM nation)
SELECT n_nationkey, ((i % c) * 300)::BIGINT AS x, (floor(i / c) * 200)::BIGINT AS y FROM n""")
def view_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = views.grid(table(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey")
    return placed.select("n_nationkey", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))


@query(f"SELECT part AS id, count(*) AS groups FROM {_SQL_PART_NATION} GROUP BY part HAVING count(*) > 1")
def usage_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = intel.usage(_part_nations(spark, sf_dir).select(F.col("part").alias("id"), F.col("nation").alias("group")))
    return views.most_used(used).select("id", F.size("used_in").cast("long").alias("groups"))


@query("""SELECT page_id, regexp_replace(html, '<article>', '<article><!-- seen -->', 'g') AS code, contains(html, '<article>') AS transformed FROM pages""")
def text_inject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inject.injected(table(spark, sf_dir, "pages"), "html", "<article>", "<!-- seen -->").select("page_id", "code", "transformed")


@query()
def manifest_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(spark, sf_dir).select(F.to_json(F.struct("*")).alias("json"))


@query("""
SELECT 'orders' AS step, count(*) AS rows FROM orders UNION ALL SELECT 'customers', count(*) FROM customer UNION ALL SELECT 'routes', count(DISTINCT o_custkey) FROM orders""")
def pass_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log to which each step of a run adds how many rows it gave."""
    import uuid

    log = snapshots.Log(spark, f"{keep.shared_folder(spark)}/ledger-{uuid.uuid4().hex}", "step string, rows long")
    orders = table(spark, sf_dir, "orders")
    for name, step in (("orders", orders), ("customers", table(spark, sf_dir, "customer")), ("routes", orders.select("o_custkey").distinct())):
        log.add(step.agg(F.count("*").alias("rows")).select(F.lit(name).alias("step"), "rows"))
    return log.read()


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '.000Z' AS day, printf('%.2f', o_totalprice) AS price FROM orders""")
def values_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", values.iso(F.col("o_orderdate")).alias("day"), values.fixed(F.col("o_totalprice"), 2).alias("price"))
