"""Connected components of pairs, and folds in a fixed order over components of any size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window as W, functions as F

from ..tables import snapshot

#: Rows of a component that are folded in one row at a time.
FOLD_ROWS = 2000


def components(pairs: DataFrame) -> DataFrame:
    """``id, component`` for both ends of ``pairs(a, b)``: the smallest id that can be reached.

    Each round sends the smallest label over every pair, reduced before the shuffle, so that a hub costs a row a task;
    then labels follow the labels of their labels.  A chain of n pairs takes about log n rounds.  Null ends and pairs
    of an id with itself link nothing.
    """
    linked = pairs.select("a", "b").filter("a <> b")
    both = snapshot(linked.unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = snapshot(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component")))
    while True:
        sent = both.join(labels.select(F.col("id").alias("b"), "component").hint("merge"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        nearer = labels.join(sent.hint("merge"), "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("via"))
        roots = labels.select(F.col("id").alias("via"), F.col("component").alias("root"))
        after = snapshot(nearer.join(roots.hint("merge"), "via", "left").select("id", "was", F.least("via", "root").alias("component")))
        labels = after.select("id", "component")
        if not after.filter("component <> was").limit(1).count():
            return labels


def in_order(rows: DataFrame, fold: Callable[[DataFrame], DataFrame], strike: Callable[[DataFrame, DataFrame], DataFrame], at: str = "at") -> DataFrame:
    """What a fold over each component of ``rows(component, at, ...)`` in order of ``at`` gives, for components of any size.

    ``fold`` decides whole components of a bounded size, each in one row.  A component that is larger is folded by its first
    ``FOLD_ROWS`` rows; ``strike(rest, decided)`` then gives the rows that the decisions leave open, and so on.  So a
    component of n rows takes n / FOLD_ROWS rounds at most, and far fewer where decisions strike many rows.
    """
    rows, done = snapshot(rows), None
    while True:
        sizes = rows.groupBy("component").agg(F.count("*").alias("n"))
        giants = snapshot(sizes.filter(F.col("n") > FOLD_ROWS).select("component"))
        if not giants.limit(1).count():
            last = fold(rows)
            return last if done is None else done.unionByName(last)
        place = F.row_number().over(W.partitionBy("component").orderBy(at))
        first = snapshot(rows.withColumn("place", place).filter(F.col("place") <= FOLD_ROWS).drop("place"))
        decided = snapshot(fold(first))
        done = decided if done is None else done.unionByName(decided)
        over = rows.join(giants.hint("merge"), "component", "left_semi")
        border = first.groupBy("component").agg(F.max(at).alias("border"))
        rest = over.join(border.hint("merge"), "component").filter(F.col(at) > F.col("border")).drop("border")
        rows = snapshot(strike(rest, decided))
