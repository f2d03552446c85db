"""Distributed connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Union-find as joins: the smallest id reachable from each end of ``edges(src, dst)``.

    Each round sends the smallest label over every edge and then lets each row follow the label of its label
    (pointer doubling), so a chain of n links ends after about log n rounds.  Messages are reduced by a minimum
    before the shuffle, so a hub with very many links costs one row per task.  Rows with a null end and self
    links add nothing.  No edges: no rows.  Returns ``id, component`` for ids that have an edge.
    """
    pairs = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).filter("a is not null and b is not null and a <> b")
    both = materialize(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component")))
    for _ in range(max_rounds):
        sent = (
            both.join(labels.select(F.col("id").alias("b"), "component").hint("merge"), "b")
            .groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        )
        lower = labels.join(sent.hint("merge"), "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("via"))
        roots = labels.select(F.col("id").alias("via"), F.col("component").alias("root"))
        after = materialize(lower.join(roots.hint("merge"), "via", "left").select("id", "old", F.least("via", "root").alias("component")))
        changed = after.filter("component <> old").limit(1).count()
        labels = after.select("id", "component")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
