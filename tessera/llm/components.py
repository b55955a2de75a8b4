"""Connected components of a large edge table by least labels and pointer jumping.

Labels and edges stay in tables: nothing about the graph reaches the driver but one count per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its least node."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    while True:
        heard = both.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("heard"))
        nearer = label.join(heard, "node", "left").select("node", F.col("component").alias("was"), F.least("component", "heard").alias("component"))
        roots = label.select(F.col("node").alias("component"), F.col("component").alias("root"))
        jumped = cut(nearer.join(roots, "component", "left").select("node", "was", F.coalesce(F.least("root", "component"), "component").alias("component")), "labels")
        label = jumped.select("node", "component")
        if jumped.where("component <> was").isEmpty():
            return label


def merged(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after ``links`` (a, b) join nodes whose components ``label`` holds; unnamed nodes stand alone.
    Only the contracted graph of components is walked again."""
    if label is None:
        return components(links)
    of = lambda c: label.select(F.col("node").alias(c), F.col("component").alias(f"{c}_c"))
    held = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_c", "a").alias("a"), F.coalesce("b_c", "b").alias("b"))
    moved = components(held).select(F.col("node").alias("component"), F.col("component").alias("root"))
    old = label.join(moved, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    new = moved.select(F.col("component").alias("node"), F.col("root").alias("component")).join(label.select("node"), "node", "left_anti")
    return cut(old.unionByName(new), "labels")
