"""The corpus pipeline: language ID, exact dedup, near-dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept; all but the last return the
columns of documents.  The result is one row per packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pressgrid.llm import exact_dedup, langid, minhash, mixing, packing
from pressgrid.llm.common import materialize, row_key, sided, table

#: Packing depends on a tokenizer: SQL can't express the result.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: null, empty and letterless texts.  Each row is judged by itself."""
    return langid.with_language(docs, langid.learn_profiles(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group that is equal without white space, whatever the ids; see the operator for ties."""
    return exact_dedup.without_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each near-duplicate class: five-word shingles, similarity 0.8 or more.

    Decided by doc_id and text together: of several texts under one id each is judged by its own class.  Rows without
    an id or a word stay, and rows that repeat a document that stays.
    """
    found = minhash.near_duplicates(docs, shingle_words=5, percent=80)
    dropped = materialize(found.filter("not kept").select("doc_id", "text_key").distinct())
    here = [F.col("d.doc_id") == F.col("g.doc_id"), minhash.text_key(F.col("d.text")) == F.col("g.text_key")]
    return docs.alias("d").join(sided(dropped).alias("g"), here, "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mix takes: none, or up to three.

    Rows are told apart by all their columns.  Rows equal throughout get the sum of their copies, null ids are rows
    like others, and documents without a word are never taken.
    """
    names = {k: f"column {i}" for i, k in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{k}`").alias(v) for k, v in names.items()])
    rows = rows.select("*", *row_key(rows))
    asked = rows.select(*[F.col(f"`{names[k]}`").alias(k) for k in ("doc_id", "text", "source")], "r1", "r2")
    taken = mixing.mix(asked, keep=("r1", "r2")).filter("taken > 0").select((F.col("taken") / F.col("size")).cast("int").alias("times"), "r1", "r2")
    repeats = rows.groupBy("r1", "r2").agg(F.count("*").alias("rows")).filter("rows > 1")
    copies = taken.groupBy("r1", "r2").agg(F.sum("times").cast("int").alias("times")).join(repeats.hint("merge"), ["r1", "r2"], "left")
    copies = materialize(copies.select(F.col("r1").alias("c1"), F.col("r2").alias("c2"), F.sequence(F.lit(1), "times").alias("times"), F.coalesce("rows", F.lit(1)).alias("rows")))
    found = rows.join(sided(copies), F.expr("r1 = c1 and r2 = c2"))
    once = found.filter("rows = 1").unionByName(found.filter("rows > 1").dropDuplicates(["r1", "r2"]))
    return once.select(*[F.col(f"`{v}`").alias(k) for k, v in names.items()], F.explode("times").alias("turn of the copy")).select(*[F.col(f"`{k}`") for k in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every row; null and empty texts are the end id alone, and copies of a document are packed each."""
    return packing.pack(docs)


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents; each result is written and read back.  An empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
