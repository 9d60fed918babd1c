"""Connected components by minimum labels with pointer jumping; every step is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b. node, component (its smallest reachable node) of all nodes that have an edge; loops and repeats are fine."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        stepped = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        # a label's own label, as it was, is a node of the same component
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        moved = stored(stepped.join(jump, "component").select("node", "old", F.least("component", "further").alias("component")), "labels")
        labels = moved.select("node", "component")
        if moved.where("component <> old").isEmpty():
            return labels
