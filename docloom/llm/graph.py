"""Connected components by rounds of smallest-neighbour links and path halving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import released, stored


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) -> (id, component): the smallest id reachable, for each id on an edge.

    A round gives each vertex the smallest label among its neighbours, then the label of that
    label. Labels only fall, so rounds end when none changes; with the jump the number of rounds
    grows as the logarithm of the longest path. Joins are on the edge's far end, aggregates are
    partial minima, so one vertex of very many edges is split or pre-aggregated. A round's tables go
    once the next one's are written.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct()
    both = stored(both, "edges")
    labels = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("l")).select(F.col("a").alias("id"), "l"), "labels")
    while True:
        low = both.join(labels.select(F.col("id").alias("b"), "l").hint("merge"), "b").groupBy(F.col("a").alias("id")).agg(F.min("l").alias("m"))
        near = labels.join(low.hint("merge"), "id").select("id", "l", F.least("l", "m").alias("m"))
        up = labels.select(F.col("id").alias("m"), F.col("l").alias("u"))
        new = stored(near.join(up.hint("merge"), "m", "left").select("id", F.least("m", F.coalesce("u", "m")).alias("l"), (F.least("m", F.coalesce("u", "m")) < F.col("l")).alias("changed")), "labels")
        released(labels)
        labels = new
        if not new.filter("changed").limit(1).count():
            released(both)
            return labels.select("id", F.col("l").alias("component"))
