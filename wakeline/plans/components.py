"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .materialize import drop_materialized, materialize


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Rows ``(node, component)`` for every end of an edge; a component is named by its least node.

    Every round takes the least label among a node's neighbours (a partial
    aggregate, so hubs don't gather) and then the label of that label, so that
    the rounds grow with the logarithm of the longest path. Tables between
    rounds are written to the shared folder. Self-loops are allowed, and no
    edges give no rows.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    both = materialize(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component")), "labels")
    while True:
        seen = labels.select(F.col("node").alias("v"), F.col("component").alias("c"))
        near = both.join(seen, "v").groupBy("u").agg(F.min("c").alias("m"))
        step = labels.join(near, labels.node == near.u).select("node", F.col("component").alias("old"), F.least("component", "m").alias("mid"))
        step = materialize(step, "step")
        roots = step.select(F.col("node").alias("r"), F.col("mid").alias("top"))
        jumped = step.join(roots, step.mid == roots.r, "left").select("node", "old", F.least("mid", F.coalesce("top", "mid")).alias("component"))
        after = materialize(jumped, "labels")
        moved = after.where("old <> component").limit(1).count()
        drop_materialized(step)
        drop_materialized(labels)
        labels = after
        if not moved:
            return labels.select("node", "component")
