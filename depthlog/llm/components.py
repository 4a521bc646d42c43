"""Connected components of an edge table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from depthlog.operators.staging import stage


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of `edges` (src, dst of one ordered type).

    A round passes the smallest label along each edge, with partial sums of minima before the shuffle, then jumps to
    the label's own label; rounds grow with the logarithm of the diameter. Each round is staged, so a lost executor
    costs one round. Self-links and repeated edges do no harm; an empty table gives an empty result.
    """
    both = stage(edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src")))
                 .filter("src is not null and dst is not null").distinct())
    labels = stage(both.groupBy(F.col("src").alias("node"))
                   .agg(F.least(F.min("src"), F.min("dst")).alias("component")))
    while True:
        passed = (both.join(labels.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "component")
                  .union(labels).groupBy("node").agg(F.min("component").alias("component")))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("above"))
        jumped = stage(passed.join(up, "component").select("node", F.least("component", "above").alias("component")))
        moved = jumped.join(labels.withColumnRenamed("component", "before"), "node").filter("component <> before")
        if not moved.limit(1).count():
            return jumped
        labels = jumped
