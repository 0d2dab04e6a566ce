"""Connected components of a link table by hooking and contraction; links never reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(links: DataFrame) -> DataFrame:
    """links: a, b. Returns node, label: every node of a link and the smallest node of its component.

    Each round hooks every node to its smallest neighbour (or itself), follows two such steps, and replaces the links
    by those between the nodes reached. The nodes of a component at least halve in a round.
    """
    ordered = lambda df, a, b: df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()
    edges, steps = materialise(ordered(links, "a", "b"), "edges"), []
    while edges.take(1):
        both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a"))
        up = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("p"))
        parent = materialise(up.join(up.select(F.col("x").alias("p"), F.col("p").alias("pp")), "p").select("x", F.col("pp").alias("p")), "parents")
        to = lambda name, parent=parent: parent.select(F.col("x").alias(name), F.col("p").alias(f"p{name}"))
        edges = materialise(ordered(edges.join(to("a"), "a").join(to("b"), "b"), "pa", "pb"), "edges")
        steps.append(parent)
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    out = steps[0].select(F.col("x").alias("node"), F.col("p").alias("label"))
    for step in steps[1:]:
        out = out.join(step.select(F.col("x").alias("label"), "p"), "label", "left").select("node", F.coalesce("p", "label").alias("label"))
    return materialise(out, "labels")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels: node, label for all nodes. The labels once the links between nodes hold, too."""
    of = lambda name: labels.select(F.col("node").alias(name), F.col("label").alias(f"l{name}"))
    between = links.join(of("a"), "a").join(of("b"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    moved = components(between).select(F.col("node").alias("label"), F.col("label").alias("to"))
    return materialise(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
