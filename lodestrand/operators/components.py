"""Connected components of an edge list by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node of its component) for every node named in ``edges`` (a, b).

    Each round a node takes the smallest label among its neighbours and then the label of that label, so long chains
    shorten by more than half a round. Self-loops and repeated edges change nothing; rows with a null end are dropped;
    no edges give no rows. Aggregation is by key with partial minima, so a hub with very many edges reduces on the map
    side. Labels are written to the shared folder each round. Labels only ever fall, so the rounds come to an end.
    """
    pairs = edges.filter("a is not null and b is not null and a <> b").select("a", "b")
    both = stored(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        hooked = labels.join(seen, "node").select("node", "component", F.least("component", "m").alias("m"))
        jumped = hooked.alias("h").join(labels.select(F.col("node").alias("m"), F.col("component").alias("mm")), "m", "left")
        after = stored(jumped.select("node", F.least("m", F.coalesce("mm", "m")).alias("component"), F.col("component").alias("before")))
        labels = after.select("node", "component")
        if after.filter("component <> before").isEmpty():
            return labels
