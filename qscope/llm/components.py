"""Connected components of an edge table, distributed: hook to the least neighbour, jump
pointers to the roots, contract, repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qscope.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(k, comp) for every end of edges(a, b): comp is the least k of its component. Each
    round at least halves the nodes of every component that is not yet one node; what is
    left of the edges shrinks with it."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    live = scratch.table(both.where("a != b").distinct())
    labels = scratch.table(live.select(F.col("a").alias("k")).distinct().withColumn("comp", F.col("k")))
    while live.limit(1).count():
        # Every node points to the least of itself and its neighbours.
        parent = scratch.table(live.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p")))
        while True:
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            jumped = scratch.table(parent.join(up, "p", "left").select("a", F.coalesce("pp", "p").alias("p"), (F.coalesce("pp", "p") != F.col("p")).alias("moved")))
            moved = jumped.where("moved").limit(1).count()
            scratch.drop(parent)
            parent = jumped.select("a", "p")
            parent._scratch_path = jumped._scratch_path
            if not moved:
                break
        root = parent.select(F.col("a").alias("comp"), "p")
        new = scratch.table(labels.join(root, "comp", "left").select("k", F.coalesce("p", "comp").alias("comp")))
        ra, rb = parent.select("a", F.col("p").alias("ra")), parent.select(F.col("a").alias("b"), F.col("p").alias("rb"))
        left = scratch.table(live.join(ra, "a").join(rb, "b").where("ra != rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
        scratch.drop(labels, live, parent)
        labels, live = new, left
    return labels
