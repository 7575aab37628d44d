"""Shortest paths and strongly connected components as DataFrame fixpoints: for graphs too large to broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from streetflow.plans.cut import cut


def sssp(links: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, cost): least cost from each source, over links (u, v, w) with w >= 0.

    Each round relaxes the links out of the nodes that improved; a minimum per node is a partial aggregate.
    """
    best = cut(sources.select("source", F.col("source").alias("node"), F.lit(0.0).alias("cost")))
    front = best
    while True:
        step = front.join(links, F.col("node") == F.col("u")).groupBy("source", F.col("v").alias("node"))
        step = step.agg(F.min(F.col("cost") + F.col("w")).alias("new"))
        merged = best.join(step, ["source", "node"], "full").select(
            "source", "node", F.least("cost", "new").alias("cost"),
            (F.col("new").isNotNull() & (F.col("cost").isNull() | (F.col("new") < F.col("cost")))).alias("better"),
        )
        merged = cut(merged)
        best, front = merged.drop("better"), merged.where("better").drop("better")
        if front.isEmpty():
            return best


def strong_components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): the smallest node that is mutually reachable.

    Rounds on the nodes that are left: nodes without links on one side are components of their own; the smallest label
    flows forward to a fixpoint, and a node belongs to its label if the label's node can be reached from it backward
    inside the class. The found classes leave, and links between classes go.
    """
    edges = cut(links.select("u", "v").where("u <> v").distinct())
    left = cut(nodes.select("node").distinct())
    done = None
    while True:
        # Trim until each node has links in and out.
        while True:
            core = left.join(edges.select(F.col("u").alias("node")).distinct(), "node", "left_semi").join(
                edges.select(F.col("v").alias("node")).distinct(), "node", "left_semi"
            )
            core = cut(core)
            lone = left.join(core, "node", "left_anti").select("node", F.col("node").alias("component"))
            done = lone if done is None else done.union(lone)
            if core.count() == left.count():
                break
            left = core
            ends = [left.select(F.col("node").alias(x)) for x in "uv"]
            edges = cut(edges.join(ends[0], "u", "left_semi").join(ends[1], "v", "left_semi"))
        if left.isEmpty():
            return cut(done)
        label = _flow(edges, left.select("node", F.col("node").alias("label")))
        named = label.select(F.col("node").alias("u"), F.col("label").alias("lu"))
        inner = edges.join(named, "u").join(named.select(F.col("u").alias("v"), F.col("lu").alias("lv")), "v").where("lu = lv")
        back = inner.select(F.col("v").alias("u"), F.col("u").alias("v"))
        reach = _reach(back, label.where("node = label").select("node"))
        found = cut(label.join(reach, "node", "left_semi").select("node", F.col("label").alias("component")))
        done = done.union(found)
        left = cut(left.join(found, "node", "left_anti"))
        edges = cut(inner.select("u", "v").join(left.select(F.col("node").alias("u")), "u", "left_semi").join(
            left.select(F.col("node").alias("v")), "v", "left_semi"))


def _flow(edges: DataFrame, label: DataFrame) -> DataFrame:
    """The smallest label that reaches each node."""
    label = cut(label)
    while True:
        low = edges.join(label, F.col("u") == F.col("node")).groupBy(F.col("v").alias("node")).agg(F.min("label").alias("low"))
        after = cut(
            label.join(low, "node", "left").select(
                "node", F.least("label", "low").alias("label"), (F.col("low") < F.col("label")).alias("moved")
            )
        )
        label = after.drop("moved")
        if after.where("moved").isEmpty():
            return label


def _reach(edges: DataFrame, start: DataFrame) -> DataFrame:
    seen = front = cut(start)
    while True:
        new = edges.join(front, F.col("u") == F.col("node")).select(F.col("v").alias("node")).distinct()
        front = cut(new.join(seen, "node", "left_anti"))
        if front.isEmpty():
            return seen
        seen = cut(seen.union(front))


def largest_component(components: DataFrame) -> DataFrame:
    """(node) of the largest component, the smallest label on a tie."""
    sizes = components.groupBy("component").agg(F.count("*").alias("n"))
    top = sizes.orderBy(F.desc("n"), "component").limit(1)
    return components.join(F.broadcast(top), "component").select("node")
