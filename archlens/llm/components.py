"""Connected components of a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from archlens.llm.common import saved


def _large_star(edges: DataFrame) -> DataFrame:
    """Link a node's larger neighbours to the least node around it; a > b in the result.

    The least nodes are a table of their own, so that Spark can split the rows of a node
    with very many neighbours in the join.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = saved(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least", narrow=True)
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them; a > b in the edges.

    After a large star a node has few smaller neighbours: at most one for each of its neighbours before.
    """
    least = F.min("b").over(Window.partitionBy("a"))
    both = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")
    return edges.withColumn("m", least).select(both).select("e.*").where("a <> b").distinct()


def _seen(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The edges as a work table, and their number and a sum of hashes, observed while they are written."""
    seen = Observation()
    table = saved(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "edges", narrow=True)
    return table, seen.get


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Rows (node, label) for the nodes of the edges (a, b); label is the least node reachable.

    Every round writes a work table, so lineage stays short.  Rounds are about the
    logarithm of the longest path; more than ``most_rounds`` raise an error.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    current, state = _seen(edges.where("a <> b").select(high.alias("a"), low.alias("b")).distinct())
    for _ in range(most_rounds):
        current, new = _seen(_small_star(_large_star(current)))
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct())
