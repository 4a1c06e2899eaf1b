"""Reachability, depth and cycles on edge tables, as loops of joins that stop when nothing is new.

Each round joins only the frontier; tables are checkpointed in the shared folder.
Edges have source and target.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archlens.operators.keep import settled

MOST_ROUNDS = 1000
#: Rounds whose results are kept apart.
MOST_PARTS = 24


def depths(edges: DataFrame, seeds: DataFrame, most: int = MOST_ROUNDS) -> DataFrame:
    """(root, node, depth): the fewest steps from each root to each node; seeds have root and node."""
    edges = settled(edges.select("source", "target").distinct())
    frontier = settled(seeds.select("root", "node").distinct().withColumn("depth", F.lit(0)))
    rounds = [frontier]  # what each round reached is written once
    for step in range(1, most + 1):
        reached = frontier.join(edges, frontier["node"] == edges["source"]).select("root", F.col("target").alias("node")).distinct()
        seen = reduce(DataFrame.unionByName, rounds)
        frontier = settled(reached.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(step)))
        if frontier.isEmpty():
            return seen
        rounds.append(frontier)
        if len(rounds) > MOST_PARTS:  # so that plans stay short
            rounds = [settled(reduce(DataFrame.unionByName, rounds))]
    raise RuntimeError(f"more than {most} rounds")


def reachable(edges: DataFrame, seeds: DataFrame, most: int = MOST_ROUNDS) -> DataFrame:
    """The nodes (node) that any seed (node) reaches, seeds included."""
    rooted = seeds.select(F.lit(0).alias("root"), "node")
    return depths(edges, rooted, most).select("node")


def cycle_nodes(edges: DataFrame, most: int = MOST_ROUNDS) -> DataFrame:
    """(node, component): the nodes on cycles, and the greatest node of their strongly connected component.

    Nodes without a way in or out are trimmed; then every node takes the greatest
    node that reaches it as colour, and what reaches a colour's own node inside the
    colour is one component.  Rounds repeat on what is left.
    """
    left = settled(edges.select("source", "target").distinct())
    loops = left.where("source = target").select(F.col("source").alias("node"))
    found = loops.select("node", F.col("node").alias("component")).limit(0)
    for _ in range(most):
        left = _trimmed(left, most)
        if left.isEmpty():
            break
        nodes = left.select(F.col("source").alias("node")).union(left.select("target")).distinct()
        colour = settled(nodes.withColumn("colour", F.col("node")))
        moved = colour
        while True:  # only colours that have changed move on
            sent = left.join(moved, left["source"] == moved["node"]).groupBy(F.col("target").alias("node")).agg(F.max("colour").alias("sent"))
            moved = settled(sent.join(colour, "node").where("sent > colour").select("node", F.col("sent").alias("colour")))
            if moved.isEmpty():
                break
            colour = settled(colour.join(moved.select("node", F.col("colour").alias("new")), "node", "left").select("node", F.coalesce("new", "colour").alias("colour")))
        source, target = colour.select(F.col("node").alias("source"), F.col("colour").alias("c1")), colour.select(F.col("node").alias("target"), F.col("colour").alias("c2"))
        inside = left.join(source, "source").join(target, "target").where("c1 = c2")
        back = inside.select(F.col("target").alias("source"), F.col("source").alias("target"))
        seeds = colour.where("node = colour").select(F.col("colour").alias("root"), "node")
        component = settled(depths(back, seeds, most).select("node", F.col("root").alias("component")))
        sizes = component.groupBy("component").agg(F.count("*").alias("n"))
        several = component.join(sizes.where("n > 1"), "component").select("node", "component")
        found = settled(found.unionByName(several))
        left = settled(left.join(component.select(F.col("node").alias("source")), "source", "left_anti").join(component.select(F.col("node").alias("target")), "target", "left_anti"))
    alone = loops.join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.unionByName(alone)


def cycle_paths(edges: DataFrame, cycles: DataFrame | None = None, most: int = MOST_ROUNDS) -> DataFrame:
    """(component, length, path): for every component of ``cycle_nodes`` a shortest cycle through its least node, from that node on.

    A breadth-first search of all components at once keeps each node's least predecessor; the
    way back from the last node of the cycle is then read off it, a step for all components in each round.
    """
    cycles = settled(cycle_nodes(edges, most) if cycles is None else cycles)
    if cycles.isEmpty():
        return cycles.groupBy("component").agg(F.lit(0).alias("length"), F.collect_list("node").alias("path"))
    at = lambda end: cycles.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in"))
    inside = edges.select("source", "target").distinct().join(at("source"), "source").join(at("target"), "target").where("source_in = target_in")
    inside = settled(inside.select(F.col("source_in").alias("component"), "source", "target"))
    first = settled(cycles.groupBy("component").agg(F.min("node").alias("first")))
    frontier = settled(first.select("component", F.col("first").alias("node"), F.lit(None).cast(cycles.schema["node"].dataType).alias("before"), F.lit(0).alias("depth")))
    rounds, closed = [frontier], None
    for step in range(1, most + 1):
        onward = inside.join(frontier.select("component", F.col("node").alias("source")), ["component", "source"])
        back = onward.join(first, "component").where("target = first").groupBy("component").agg(F.min("source").alias("node")).withColumn("length", F.lit(step))
        found = settled(back)  # the components whose cycle is closed by this step need no further search
        closed = found if closed is None else settled(closed.unionByName(found))
        seen = reduce(DataFrame.unionByName, rounds)
        new = onward.join(found, "component", "left_anti").groupBy("component", F.col("target").alias("node")).agg(F.min("source").alias("before"))
        frontier = settled(new.join(seen.select("component", "node"), ["component", "node"], "left_anti").select("component", "node", "before", F.lit(step).alias("depth")))
        if frontier.isEmpty():
            break
        rounds.append(frontier)
        if len(rounds) > MOST_PARTS:
            rounds = [settled(reduce(DataFrame.unionByName, rounds))]
    else:
        raise RuntimeError(f"more than {most} rounds")
    parents = settled(reduce(DataFrame.unionByName, rounds).select("component", "node", "before"))
    steps = [closed.select("component", "node", (F.col("length") - 1).alias("place"), "length")]
    while True:
        step = settled(steps[-1].where("place > 0").join(parents, ["component", "node"]).select("component", F.col("before").alias("node"), (F.col("place") - 1).alias("place"), "length"))
        if step.isEmpty():
            break
        steps.append(step)
        if len(steps) > MOST_PARTS:
            steps = [settled(reduce(DataFrame.unionByName, steps[:-1])), step]
    path = F.transform(F.array_sort(F.collect_list(F.struct("place", "node"))), lambda x: x["node"])
    return reduce(DataFrame.unionByName, steps).groupBy("component", "length").agg(path.alias("path"))


def _trimmed(edges: DataFrame, most: int) -> DataFrame:
    """Without the edges of nodes that nothing enters or nothing leaves, again and again."""
    count = edges.count()
    for _ in range(most):
        out, into = edges.select(F.col("source").alias("n")).distinct(), edges.select(F.col("target").alias("n")).distinct()
        both = out.join(into, "n", "left_semi")
        edges = settled(edges.join(both, edges["source"] == both["n"], "left_semi").join(both, edges["target"] == both["n"], "left_semi"))
        now = edges.count()
        if now == count:
            return edges
        count = now
    raise RuntimeError(f"more than {most} rounds")
