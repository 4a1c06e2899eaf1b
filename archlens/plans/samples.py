"""A source project that is generated from the driver's tables, for queries that run the analysis itself.

Nations are components (each renders the next one of its group of five; every fourth has
two parts, a private helper and texts that only look like code), regions are hooks, layouts and pages, customers are pages.  What the analysis
must find follows from the tables, so plain SQL over them can say it without reading sources.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archlens.operators.keep import spread
from archlens.plans.session import Session, Tables


def _text(*parts: Column | str | int) -> Column:
    """Strings and columns of numbers, joined; names of columns are written ``{name}``."""
    return F.concat(*(F.col(p[1:-1]).cast("string") if isinstance(p, str) and p[:1] == "{" and p[-1:] == "}" and p[1:-1].isidentifier() else p if isinstance(p, Column) else F.lit(p) for p in parts))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, r, file of each nation and nk, nr of the next one in its group (null for the last)."""
    own = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r"))
    own = own.withColumn("file", _text("components/r", "{r}", "/n", "{k}", ".tsx"))
    after = own.select((F.col("k") - 1).alias("k"), F.col("k").alias("nk"), F.col("r").alias("nr")).where("k % 5 <> 4")
    return own.join(after, "k", "left")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c, k, r and the folder of each customer's page."""
    people = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("k"))
    leaf = F.when(F.col("c") % 7 == 0, _text("[id", "{c}", "]")).otherwise(_text("c", "{c}"))
    people = people.join(F.broadcast(nations(spark, sf_dir).select("k", "r")), "k")  # a row for each nation
    return spread(people, "c").withColumn("folder", _text("app/r", "{r}", "/n", "{k}", "/", leaf))


#: Literals that look like comments, imports, tags and hooks, before the first import of every nation's file.
_ODD = """const glob = "src/*.ts", odd = '<Odd /> useOdd( import O from "odd"', re = /["'`{]/; """


def project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content) of all files."""
    nation, people = nations(spark, sf_dir), customers(spark, sf_dir)
    region = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").alias("r"))
    none = F.lit("")
    parts = F.when(F.col("k") % 4 == 0, _text(
        "export function Nation", "{k}", "Row() { return <div />; }\nexport function Nation", "{k}", "Cell() { return <Nation", "{k}", "Row />; }\n")).otherwise(none)
    shown = F.when(F.col("nk").isNull(), F.lit("<p />")).otherwise(_text("<Nation", "{nk}", " />"))
    component = _text(
        F.when(F.col("k") % 3 == 0, F.lit('"use client"\n')).otherwise(none),
        _ODD, "import { useRegion", "{r}", ' } from "../../hooks/use-region', "{r}", '";\n',
        F.when(F.col("nk").isNull(), none).otherwise(_text("import { Nation", "{nk}", ' } from "@/components/r', "{nr}", "/n", "{nk}", '";\n')),
        "export function Nation", "{k}", "({ a }: P): { b: number } { useRegion", "{r}", "(); return ", shown, "; }\n", parts,
        "// export function Dead", "{k}", "() { return <Dead /> }\nfunction helper", "{k}", "() { return <Ghost /> }\n")
    page = _text(
        "import { Nation", "{k}", ' } from "@/components/r', "{r}", "/n", "{k}", '";\nimport type { Props } from "../types";\nimport React from "react";\nimport "./c.css";\nexport default function C', "{c}",
        'Page({ params }) { const sp = useSearchParams(); sp.get("tab', (F.col("c") % 3).cast("string"), '"); ',
        F.when(F.col("c") % 7 == 0, _text("const own = params.id", "{c}", "; ")).otherwise(none), "return <Nation", "{k}", " />; }\n")
    nation_page = _text("import { Nation", "{k}", ' } from "@/components/r', "{r}", "/n", "{k}", '";\nexport default function N', "{k}", "Page() { return <Nation", "{k}", " />; }\n")
    rows = [
        nation.select(F.col("file").alias("path"), component.alias("content")),
        people.select(_text("{folder}", "/page.tsx").alias("path"), page.alias("content")),
        nation.where("k % 2 = 0").select(_text("app/r", "{r}", "/n", "{k}", "/page.tsx").alias("path"), nation_page.alias("content")),
        region.select(_text("hooks/use-region", "{r}", ".ts").alias("path"), _text("export function useRegion", "{r}", "() { return 1; }\n").alias("content")),
        region.select(_text("app/r", "{r}", "/page.tsx").alias("path"), _text("export default function Region", "{r}", "Page() { return <Missing", "{r}", " />; }\n").alias("content")),
        region.where("r % 2 = 0").select(_text("app/r", "{r}", "/layout.tsx").alias("path"), _text(
            'import { ThemeProvider } from "@/components/theme";\nexport default function Region', "{r}", "Layout() { return <ThemeProvider></ThemeProvider>; }\n").alias("content")),
        region.select(_text("components/orphan", "{r}", ".tsx").alias("path"), _text("export function Orphan", "{r}", "() { return <Orphan", "{r}", " />; } // <Ghost />\n").alias("content")),
        region.where("r = 0").select(F.lit("components/theme.tsx").alias("path"), F.lit("export function ThemeProvider() { return <div />; }\n").alias("content")),
        region.where("r = 0").select(F.lit("node_modules/x/index.ts").alias("path"), F.lit("export function Hidden() { return 1; }\n").alias("content")),
    ]
    return reduce(DataFrame.unionByName, rows)


_analysed: dict[tuple[str, str], Tables] = {}


def analysed(spark: SparkSession, sf_dir: str) -> Tables:
    """The session's tables of the project; worked out once for an application and folder."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _analysed:
        _analysed.clear()
        _analysed[key] = Session(spark).analyse(project(spark, sf_dir))
    return _analysed[key]


#: The same project as relations, in DuckDB's SQL: files of nations (nat), pages (cu, np), what imports what (im), who is in which route (mem).
SQL = """
WITH own AS (SELECT n_nationkey AS k, n_regionkey AS r, 'components/r' || n_regionkey || '/n' || n_nationkey || '.tsx' AS file FROM nation),
nat AS (SELECT a.*, b.k AS nk, b.r AS nr, b.file AS nfile FROM own a LEFT JOIN own b ON b.k = a.k + 1 AND a.k % 5 <> 4),
cu AS (SELECT c_custkey AS c, k, r, file AS nfile, '/r' || r || '/n' || k || '/' || CASE WHEN c_custkey % 7 = 0 THEN '[id' || c_custkey || ']' ELSE 'c' || c_custkey END AS path FROM customer JOIN own ON c_nationkey = k),
np AS (SELECT *, '/r' || r || '/n' || k AS path FROM own WHERE k % 2 = 0),
rg AS (SELECT r_regionkey AS r, '/r' || r_regionkey AS path FROM region),
im AS (
  SELECT file, 0 AS pos, 'named' AS kind, 'useRegion' || r AS name, '../../hooks/use-region' || r AS specifier, false AS type_only, 'hooks/use-region' || r || '.ts' AS resolved FROM nat
  UNION ALL SELECT file, 1, 'named', 'Nation' || nk, '@/components/r' || nr || '/n' || nk, false, nfile FROM nat WHERE nk IS NOT NULL
  UNION ALL SELECT 'app' || path || '/page.tsx', 0, 'named', 'Nation' || k, '@/' || regexp_replace(nfile, '.tsx$', ''), false, nfile FROM cu
  UNION ALL SELECT 'app' || path || '/page.tsx', 1, 'named', 'Props', '../types', true, NULL FROM cu
  UNION ALL SELECT 'app' || path || '/page.tsx', 2, 'default', 'React', 'react', false, NULL FROM cu
  UNION ALL SELECT 'app' || path || '/page.tsx', 0, 'side_effect', NULL, './c.css', false, NULL FROM cu
  UNION ALL SELECT 'app' || path || '/page.tsx', 0, 'named', 'Nation' || k, '@/' || regexp_replace(file, '.tsx$', ''), false, file FROM np
  UNION ALL SELECT 'app' || path || '/layout.tsx', 0, 'named', 'ThemeProvider', '@/components/theme', false, 'components/theme.tsx' FROM rg WHERE r % 2 = 0),
de AS (
  SELECT file, 'Nation' || k AS name, 'function' AS form, 2 + (k % 3 = 0)::INTEGER + (nk IS NOT NULL)::INTEGER AS line, CASE WHEN nk IS NOT NULL THEN 'Nation' || nk END AS tag, k % 3 = 0 AS client FROM nat
  UNION ALL SELECT file, 'Nation' || k || 'Row', 'function', 3 + (k % 3 = 0)::INTEGER + (nk IS NOT NULL)::INTEGER, NULL, k % 3 = 0 FROM nat WHERE k % 4 = 0
  UNION ALL SELECT file, 'Nation' || k || 'Cell', 'function', 4 + (k % 3 = 0)::INTEGER + (nk IS NOT NULL)::INTEGER, 'Nation' || k || 'Row', k % 3 = 0 FROM nat WHERE k % 4 = 0
  UNION ALL SELECT 'app' || path || '/page.tsx', 'C' || c || 'Page', 'default', 5, 'Nation' || k, false FROM cu
  UNION ALL SELECT 'app' || path || '/page.tsx', 'N' || k || 'Page', 'default', 2, 'Nation' || k, false FROM np
  UNION ALL SELECT 'hooks/use-region' || r || '.ts', 'useRegion' || r, 'function', 1, NULL, false FROM rg
  UNION ALL SELECT 'app' || path || '/page.tsx', 'Region' || r || 'Page', 'default', 1, 'Missing' || r, false FROM rg
  UNION ALL SELECT 'app' || path || '/layout.tsx', 'Region' || r || 'Layout', 'default', 2, 'ThemeProvider', false FROM rg WHERE r % 2 = 0
  UNION ALL SELECT 'components/orphan' || r || '.tsx', 'Orphan' || r, 'function', 1, 'Orphan' || r, false FROM rg
  UNION ALL SELECT 'components/theme.tsx', 'ThemeProvider', 'function', 1, NULL, false),
chain AS (SELECT a.k, b.k AS j, b.r FROM own a JOIN own b ON b.k // 5 = a.k // 5 AND b.k >= a.k),
pg AS (SELECT path, k, 'C' || c || 'Page' AS page FROM cu UNION ALL SELECT path, k, 'N' || k || 'Page' FROM np),
mem AS (
  SELECT path, page AS name FROM pg UNION ALL SELECT path, 'Nation' || j FROM pg JOIN chain USING (k)
  UNION ALL SELECT path, 'Region' || r || 'Page' FROM rg UNION ALL SELECT path, unnest(['Region' || r || 'Layout', 'ThemeProvider']) FROM rg WHERE r % 2 = 0),
co AS (
  SELECT file || '#' || name AS id, name, file, form, line, tag, client, CASE WHEN name = 'ThemeProvider' THEN 'provider' WHEN file LIKE '%/page.tsx' THEN 'page' WHEN file LIKE '%/layout.tsx' THEN 'layout' ELSE 'component' END AS type,
    (SELECT count(DISTINCT im.file) FROM im WHERE resolved = de.file AND im.name = de.name) AS n_files, coalesce(m.n, 0) AS n_routes
  FROM de LEFT JOIN (SELECT name, count(DISTINCT path) AS n FROM mem GROUP BY 1) m USING (name) WHERE name NOT LIKE 'use%'),
reu AS (SELECT * FROM co WHERE n_files > 1 OR n_routes > 1),
ed AS (
  SELECT DISTINCT file AS source, resolved AS target, 'imports' AS relationship FROM im WHERE resolved IS NOT NULL
  UNION ALL SELECT a.id, b.id, 'renders' FROM co a JOIN co b ON a.tag = b.name
  UNION ALL SELECT a.id, b.id, 'owns' FROM co a JOIN co b ON a.file = b.file AND b.name IN (a.name || 'Row', a.name || 'Cell')
  UNION ALL SELECT 'route::' || replace(regexp_replace(substr(file, 4), '/[^/]*$', ''), 'app', ''), id, 'routes-to' FROM co WHERE type IN ('page', 'layout')
  UNION ALL SELECT 'route::' || np.path, 'route::' || cu.path, 'parent-child' FROM cu JOIN np USING (k)
  UNION ALL SELECT 'route::' || rg.path, 'route::' || np.path, 'parent-child' FROM np JOIN rg USING (r)
  UNION ALL SELECT DISTINCT u.id, c.id, 'reuses' FROM reu c JOIN im ON im.resolved = c.file AND im.name = c.name JOIN co u ON u.file = im.file WHERE u.id <> c.id)
"""
