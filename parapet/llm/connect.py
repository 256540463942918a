"""Connected components of an edge table, by contraction.

Every round each node points to its least neighbour, pointers are followed to the end, and
the edges are rewritten between the ends. Stars and cliques vanish in one round. Every
round is written to the shared folder; labels and edges never leave the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parapet.llm.shared import stage


def _roots(parents: DataFrame) -> DataFrame:
    """Follow pointers until nothing changes; each pass doubles the distance."""
    while True:
        above = parents.select(F.col("label").alias("_label"), F.col("node").alias("_node"))
        moved = stage(
            parents.join(above, F.col("label") == F.col("_node"), "left").select(
                "node", F.coalesce("_label", "label").alias("label"),
                (F.col("_label") != F.col("label")).alias("moved")), "roots")
        parents = moved.select("node", "label")
        if moved.filter("moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges`` (``u, v`` of one type): the least node
    of its component. An empty table gives an empty one; loops and repeats are harmless."""
    edges = stage(edges.select("u", "v").filter("u <> v"), "edges")
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parents = _roots(stage(
            both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least"))
            .select("node", F.least("node", "least").alias("label")), "parents"))
        if labels is None:
            labels = parents
        else:
            new = parents.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
            labels = stage(labels.join(new, F.col("label") == F.col("_node"), "left").select(
                "node", F.coalesce("_label", "label").alias("label")), "labels")
        for end in ("u", "v"):
            new = parents.select(F.col("node").alias(end), F.col("label").alias("_label"))
            edges = edges.join(new, end, "left").withColumn(
                end, F.coalesce("_label", end)).drop("_label")
        edges = stage(edges.filter("u <> v").distinct(), "edges")
        if edges.isEmpty():
            return labels
