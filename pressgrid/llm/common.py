"""Helpers that the training-data operators share: written tables, checked broadcasts, text scans."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..tables import scratch, sided

#: White space of the contracts: blank and the controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark's setting to drop the shuffle files of a query that has ended.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: lineage ends here, its size is known.

    What the write shuffled isn't read again, so Spark may drop those files as soon as the table stands.
    """
    spark = df.sparkSession
    path, before = scratch(spark), spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that a Python worker has few texts as objects of its own at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def row_key(docs: DataFrame) -> list[Column]:
    """96 bits of hashes over all columns of a row, as ``r1`` and ``r2``: rows that are equal throughout share them."""
    columns = [F.col(f"`{k}`") for k in docs.columns]
    return [F.xxhash64(*columns).alias("r1"), F.hash(*columns).alias("r2")]


def fraction_filter(key, fraction: float):
    """A repeatable sample by a hash of ``key``; everything where ``fraction`` is 1 or more."""
    if fraction >= 1:
        return F.lit(True)
    return F.pmod(F.xxhash64(key.cast("string"), F.lit("sample")), F.lit(1_000_000)) < int(fraction * 1_000_000)
