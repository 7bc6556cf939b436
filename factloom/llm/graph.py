"""Connected components by repeated contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, component) for every vertex of edges; component is the smallest vertex reachable.

    Each round hooks every vertex below its smallest neighbour, jumps pointers until each tree is a
    star, and contracts; of the vertices that are left at least half go in a round. Nulls and loops
    are ignored; an empty table gives an empty one.
    """
    edges = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    edges = written(edges.where("a is not null and b is not null and a < b").distinct(), "edges")
    labels = written(edges.select(F.explode(F.array("a", "b")).alias("v")).distinct().withColumn("component", F.col("v")), "labels")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("p"))
        parent = written(parent.select("x", F.least("x", "p").alias("p")), "parent")
        while True:
            up = parent.select(F.col("x").alias("p"), F.col("p").alias("pp"))
            jumped = written(parent.join(up, "p", "left").select("x", F.coalesce("pp", "p").alias("p"), (F.coalesce("pp", "p") < F.col("p")).alias("moved")), "parent")
            moved = not jumped.where("moved").isEmpty()
            parent = jumped.select("x", "p")
            if not moved:
                break
        labels = written(
            labels.join(parent, labels["component"] == parent["x"], "left").select("v", F.coalesce("p", "component").alias("component")), "labels"
        )
        pa, pb = parent.select(F.col("x").alias("a"), F.col("p").alias("pa")), parent.select(F.col("x").alias("b"), F.col("p").alias("pb"))
        edges = edges.join(pa, "a").join(pb, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        edges = written(edges.where("a < b").distinct(), "edges")
    return labels
