"""Versions of a corpus, committed by batch number.

A corpus that batches add to is a folder: each commit writes the rows that are new, a folder a table, and last a small
table that names, for each table, all folders that make it up.  A batch that dies between two tables has committed
nothing; played again it begins from the last commit and writes over what it left.  One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import SCHEMAS, Corpus

#: What tells rows of a table apart.
KEYS = {"entities": ["id"], "aliases": ["entity_id", "alias"], "articles": ["id"], "links": ["article_id", "entity_id"], "images": ["id"], "faces": ["image_id"], "events": ["ts", "kind", "loop", "summary"]}


def _commits(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema("name string, folder string, number bigint").parquet(f"{path}/commits")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def last_commit(spark: SparkSession, path: str) -> tuple[int, dict[str, list[str]]]:
    """Number of the last batch that was committed, and the folders of each table; -1 where nothing was."""
    commits = _commits(spark, path)
    newest = commits.agg(F.max("number")).first()[0] if commits is not None else None
    if newest is None:
        return -1, {}
    folders: dict[str, list[str]] = {}
    for r in commits.filter(F.col("number") == newest).orderBy("folder").collect():  # a row for each folder
        folders.setdefault(r["name"], []).append(r["folder"])
    return newest, folders


def _open(spark: SparkSession, path: str, folders: dict[str, list[str]]) -> Corpus:
    tables = {k: spark.read.option("mergeSchema", "true").parquet(*[f"{path}/{x}" for x in v]) for k, v in folders.items()}
    return Corpus.empty(spark, **tables)


def read_version(spark: SparkSession, path: str) -> Corpus:
    """The corpus as the last commit left it; an empty one where there is none."""
    return _open(spark, path, last_commit(spark, path)[1])


def _mark(spark: SparkSession, path: str, number: int, folders: dict[str, list[str]]) -> None:
    rows = [(k, x) for k, v in folders.items() for x in v]
    spark.createDataFrame(rows, "name string, folder string").coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/number={number}")


def commit(before: Corpus, after: Corpus, path: str, number: int, tables: tuple[str, ...] = tuple(SCHEMAS)) -> bool:
    """Adds the rows of ``tables`` that ``after`` has and ``before`` has not; False where the batch was committed already.

    ``before`` is what :func:`read_version` gave.  Rows are told apart by key, so a commit costs as much as the batch adds.
    """
    spark = after.entities.sparkSession
    last, folders = last_commit(spark, path)
    if number <= last:
        return False
    folders = {k: list(v) for k, v in folders.items()}
    for k in tables:
        new, old = getattr(after, k), getattr(before, k)
        if k in folders:
            same = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in KEYS[k]]
            new = new.alias("n").join(old.select(*KEYS[k]).alias("o").hint("merge"), same, "left_anti")
        folder = f"tables/{k}/batch-{number:010d}"
        new.write.mode("overwrite").parquet(f"{path}/{folder}")
        folders.setdefault(k, []).append(folder)
    _mark(spark, path, number, folders)
    return True


def compact(spark: SparkSession, path: str) -> None:
    """Each table of the last commit as one folder, under the same batch number; readers of the old folders aren't disturbed."""
    number, folders = last_commit(spark, path)
    whole = {}
    for k, df in _open(spark, path, folders).items():
        if k in folders:
            whole[k] = [f"tables/{k}/until-{number:010d}"]
            df.write.mode("overwrite").parquet(f"{path}/{whole[k][0]}")
    if whole:
        _mark(spark, path, number, whole)
