"""Written tables that end lineage, and joins by what they measure."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A side is broadcast only if it was written and has no more rows, nor bytes in its files, than these.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Only a session without that setting, as in local tests, gets a temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='pressgrid-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/pressgrid"


def scratch_folder(spark: SparkSession) -> str:
    """Where this application's tables of one job are written: see :func:`clear_scratch`."""
    return f"{shared_folder(spark)}/scratch-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession) -> str:
    """A new path for a table of this application."""
    return f"{scratch_folder(spark)}/{uuid.uuid4().hex}"


def snapshot(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes what this application has written between its steps; to be called when its results are written.

    Results that weren't written, and still read such tables, are lost.  Indexes and corpora stand elsewhere and stay.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sided(small: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hints how to join with ``small``, a table that was written: broadcast if it is small by measure, else sort-merge."""
    size = int(small._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    few = size <= BROADCAST_BYTES and small.limit(limit + 1).count() <= limit
    return small.hint("broadcast" if few else "merge")
