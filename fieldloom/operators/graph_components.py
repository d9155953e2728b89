"""Connected components by min-label hooking with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.sources.scratch import Scratch


def connected_components(spark: SparkSession, edges: DataFrame, scratch: Scratch | None = None, max_rounds: int = 60) -> DataFrame:
    """Smallest node id reachable from each node of ``edges(a, b)``.

    Returns ``(node, component)``.  Self loops make their node known, null ends
    are ignored, repeated edges count once, an empty table gives an empty one.
    Every round is two equi-joins and one partial aggregate; both join sides are
    written tables, so a hub with very many edges is split by the adaptive skew
    join.  Labels only fall and halve their distance to the root each round; the
    loop ends when no label changes and fails loudly at ``max_rounds``.
    """
    scratch = scratch or Scratch(spark, "components")
    e = edges.select(F.col("a").alias("a"), F.col("b").alias("b")).where("a is not null and b is not null")
    both = scratch.write(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    lab = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    for _ in range(max_rounds):
        near = both.join(lab.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hooked = scratch.write(lab.join(near, "node", "left").select("node", F.least("component", "near").alias("component"), F.col("component").alias("old")), "hooked")
        up = hooked.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = scratch.write(hooked.join(up, "component", "left").select("node", F.least("component", "up").alias("component"), "old"), "labels")
        changed = not new.where("component <> old").isEmpty()
        scratch.drop(lab, hooked)
        lab = new
        if not changed:
            scratch.drop(both)
            return lab.select("node", "component")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
