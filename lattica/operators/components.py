"""Connected components by hooking, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.session import discard, materialize


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """node and component (its least reachable node) for every node on an edge.

    Each round takes the least node around a node, follows that one's own
    choice, and contracts: edges between the chosen nodes are all that the next
    round sees, each once, and loops are gone. Many trees over the same nodes
    shrink to one in the first round. It ends when no edge is left. A star's
    centre is a hot key of the joins: they are skewed on one side only, which
    adaptive execution splits, and the group-by combines before it shuffles.
    Rounds are stored in the shared folder.
    """
    spark = edges.sparkSession
    low, high = F.least(F.col(u), F.col(v)).alias("u"), F.greatest(F.col(u), F.col(v)).alias("v")
    left = materialize(edges.filter(F.col(u) != F.col(v)).select(low, high).distinct(), "edges")
    labels = materialize(left.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    while not left.isEmpty():
        ends = left.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"))
        hook = materialize(ends.groupBy("e.u").agg(F.least(F.col("u"), F.min("e.v")).alias("p")), "hook")
        up = hook.select(F.col("u").alias("p"), F.col("p").alias("next"))
        jump = materialize(hook.join(up, "p").select("u", "p", "next"), "jump")
        step = jump.select("u", "next")
        own = step.toDF("a", "b")
        # a node's choice and that one's own may differ still: an edge keeps them together
        chosen = step.select(F.col("next").alias("a")).distinct().join(own, "a").select("a", "b")
        again = left.join(step.toDF("u", "a"), "u").join(step.toDF("v", "b"), "v").select("a", "b").unionByName(chosen).filter("a <> b")
        contracted = materialize(again.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
        moved = step.toDF("component", "next")
        stored = materialize(labels.join(moved, "component", "left").select("node", F.coalesce("next", "component").alias("component")), "labels")
        discard(spark, left, labels, hook, jump)
        left, labels = contracted, stored
    return labels
