"""Connected components by min-label hooking with pointer jumping, over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import Workspace


def connected_components(ws: Workspace, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(a, b), any direction, ties and repeats allowed -> (v, label): the smallest vertex that v reaches.

    Each round takes the least label among a vertex's neighbours (partial aggregation first) and then
    the label of that label. Labels and edges are read from written tables, so both sides of each join
    are plain exchanges that adaptive execution can split when one vertex has very many neighbours.
    Null ends are dropped. An empty edge table gives an empty result. Raises if not done after `rounds`.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    e = ws.save(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = ws.save(e.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    for _ in range(rounds):
        near = e.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        hooked = ws.save(labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label")), "hooked")
        up = hooked.select(F.col("v").alias("label"), F.col("label").alias("up"))
        jumped = ws.save(hooked.join(up, "label", "left").select("v", "old", F.least("label", "up").alias("label")), "jumped")
        changed = jumped.where("label <> old").limit(1).count()
        ws.drop(hooked, labels)
        labels = jumped
        if not changed:
            ws.drop(e)
            return labels.select("v", "label")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
