"""Connected components by contraction: every node takes the least of its neighbours, edges follow, loops go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievegrid.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of edges (a, b).

    The graph at least halves in each round, and a star of any size takes one. Rounds are written to the shared
    folder. Neighbours are reduced to their least before the shuffle, so the hub of a star is no burden.
    """
    edges = stored(edges.where("a <> b").distinct(), "edges")
    labels = stored(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to")), "least")
        at = lambda c: least.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))
        moved = edges.join(at("a"), "a").join(at("b"), "b").where("a_to <> b_to")
        edges = stored(moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "edges")
        labels = stored(labels.join(at("component"), "component", "left").select("node", F.coalesce("component_to", "component").alias("component")), "labels")
    return labels
