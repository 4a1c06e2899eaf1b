"""Named queries over graphs that the tables plant: cycles with their ways, and names through chains of re-exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archlens.functions import extract, lexical
from archlens.operators import reach, symbols
from archlens.plans.catalog import query, table
from archlens.plans.samples import _text

#: Customers in fives; of each five, by its number: a ring of five, a pair, a loop, and a ring with a chord that makes it shorter.
_SQL_FIVES = """
WITH c AS (SELECT c_custkey AS k, c_custkey // 5 AS g, c_custkey % 5 AS i, count(*) OVER (PARTITION BY c_custkey // 5) AS n FROM customer),
f AS (SELECT DISTINCT g FROM c WHERE n = 5)
"""


@query(_SQL_FIVES + """SELECT CASE g % 4 WHEN 0 THEN [5 * g, 5 * g + 1, 5 * g + 2, 5 * g + 3, 5 * g + 4] WHEN 1 THEN [5 * g, 5 * g + 1] WHEN 2 THEN [5 * g] ELSE [5 * g, 5 * g + 1, 5 * g + 4] END AS path,
  CASE g % 4 WHEN 0 THEN 5 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 3 END AS length FROM f""")
def cycle_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shortest cycle of every strongly connected component, as an ordered path."""
    k = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k")).withColumn("g", F.floor(F.col("k") / 5))
    whole = k.groupBy("g").agg(F.count("*").alias("n")).where("n = 5").select("g", (F.col("g") % 4).alias("kind"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"))
    node = lambda i: (5 * F.col("g") + i).alias("x")
    ring = whole.select("g", "kind", "i", node(F.col("i")).alias("source"), node((F.col("i") + 1) % 5).alias("target"))
    loops = ring.where("kind = 2 AND i = 0").select("source", F.col("source").alias("target"))
    pairs = ring.where("kind = 1 AND i = 0").select(F.col("target").alias("source"), F.col("source").alias("target"))
    chords = ring.where("kind = 3 AND i = 1").select("source", (F.col("source") + 3).alias("target"))
    chains = ring.where("(kind IN (1, 2) AND i < 4) OR kind IN (0, 3)").select("source", "target")
    return reach.cycle_paths(chains.unionByName(loops).unionByName(pairs).unionByName(chords)).select("path", F.col("length").cast("long").alias("length"))


#: Files of a chain of re-exports.
CHAIN = 40


def barrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a chain of CHAIN files for each nation, renamed, named and starred in turn, and a file for each customer that imports through it."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    link = nation.select("k", F.explode(F.sequence(F.lit(0), F.lit(CHAIN - 1))).alias("j"))
    name = lambda j: F.concat(F.lit("Q"), F.floor((j + 2) / 3).cast("string"))
    j = F.col("j")
    onward = _text(F.lit('"./i'), (j + 1).cast("string"), F.lit('";\n'))
    text = (
        F.when(j == CHAIN - 1, F.concat(F.lit("export function "), name(j), F.lit("() { return <div />; }\n")))
        .when(j % 3 == 0, F.concat(F.lit("export { "), name(j + 1), F.lit(" as "), name(j), F.lit(" } from "), onward))
        .when(j % 3 == 1, F.concat(F.lit("export * from "), onward)).otherwise(F.concat(F.lit("export { "), name(j), F.lit(" } from "), onward)))
    links = link.select(_text("lib/n", "{k}", "/i", "{j}", ".ts").alias("path"), text.alias("content"))
    defaults = nation.select(_text("lib/n", "{k}", "/d.ts").alias("path"), F.lit('export { Q0 as default } from "./i0";\nexport { Round } from "./e";\n').alias("content"))
    circle = nation.select(_text("lib/n", "{k}", "/e.ts").alias("path"), F.lit('export { Round } from "./d";\n').alias("content"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("k"))
    way = F.col("c") % 4
    clause = F.when(way == 0, "import { Q0 } from").when(way == 1, "import { Q0 as Own } from").when(way == 2, "import Own from").otherwise("import { Round, Q0 } from")
    users = people.select(_text("use/c", "{c}", ".tsx").alias("path"), F.concat(
        clause, F.lit(' "@/lib/n'), F.col("k").cast("string"), F.when(way >= 2, "/d").otherwise("/i0"), F.lit('";\nexport function User'), F.col("c").cast("string"),
        F.lit("() { return <"), F.when(way.isin(1, 2), "Own").when(way == 3, "Round").otherwise("Q0"), F.lit(" />; }\n")).alias("content"))
    return links.unionByName(defaults).unionByName(circle).unionByName(users)


@query(f"""SELECT 'use/c' || c_custkey || '.tsx' AS file, CASE c_custkey % 4 WHEN 0 THEN 'Q0' ELSE CASE c_custkey % 4 WHEN 3 THEN 'Round' ELSE 'Own' END END AS name,
  CASE c_custkey % 4 WHEN 3 THEN 'lib/n' || c_nationkey || '/d.ts#Round' ELSE 'lib/n' || c_nationkey || '/i{CHAIN - 1}.ts#Q{(CHAIN + 1) // 3}' END AS id, CASE c_custkey % 4 WHEN 2 THEN 'default' ELSE 'named' END AS via FROM customer""")
def src_barrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a tag stands for, through aliases, defaults, stars, and a circle that leads nowhere."""
    files = lexical.once(barrels(spark, sf_dir))
    imports, declared = extract.resolved(extract.import_facts(files), files), extract.declarations(files)
    exports = extract.resolved(symbols.re_exports(files), files).select("file", "name", "original", F.col("resolved").alias("target"))
    names = declared.where("file LIKE 'use/%'").select("file", F.explode(extract.tags(F.col("body"))).alias("name"))
    return symbols.resolve(names, imports, declared, exports).select("file", "name", "id", "via")
