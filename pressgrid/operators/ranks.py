"""Ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..tables import sided, snapshot

#: Rows of a part of the sorted table, about.
PART_ROWS = 1_000_000


def ranked(df: DataFrame, group: str, order: list[str], name: str = "place") -> DataFrame:
    """``df`` with each row's number in its group, from 1, in ascending order with nulls first.

    Rows are sorted by range into parts, so a group of very many rows spreads over tasks; a row's number is its number in
    its part and the group's rows in the parts before.  Only groups that go on from part to part are told apart by more than their
    part, and of those there are no more than parts.  Rows that tie throughout are numbered in any order.
    """
    rows = snapshot(df.withColumn("_row", F.monotonically_increasing_id()))
    keys = [F.col(group), *[F.col(k) for k in order], F.col("_row")]
    parts = max(1, -(-rows.count() // PART_ROWS))
    placed = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    placed = snapshot(placed.withColumn("_nth", F.row_number().over(W.partitionBy(group, "_part").orderBy("_at"))))
    if parts == 1:
        return placed.withColumn(name, F.col("_nth").cast("bigint")).drop("_row", "_part", "_at", "_nth")
    counts = placed.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_its_part")).agg(F.count("*").alias("_n"))
    earlier = W.partitionBy("_group").orderBy("_its_part").rowsBetween(W.unboundedPreceding, -1)
    before = snapshot(counts.withColumn("_before", F.sum("_n").over(earlier)).filter("_before is not null").drop("_n"))
    met = placed.join(sided(before), F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_its_part")), "left")
    return met.withColumn(name, F.col("_nth") + F.coalesce("_before", F.lit(0))).drop("_row", "_part", "_at", "_nth", "_group", "_its_part", "_before")
