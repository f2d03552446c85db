"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, materialize, row_key, sided


def normalized(text: Column) -> Column:
    """The text without any white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, "")


def full_hash(text: Column) -> Column:
    return F.sha2(normalized(text), 256)


def _refined(docs: DataFrame, keys: list[str], prefix_chars: int) -> tuple[DataFrame, DataFrame]:
    """The ``keys``, ``length`` and ``prefix`` of every row, and the pairs of length and prefix that several rows share.

    Lengths are few, so the first refinement is a broadcast filter and no shuffle by length.
    """
    bare = docs.select(*keys, normalized(F.col("text")).alias("bare"))
    marks = materialize(bare.select(*keys, F.char_length("bare").alias("length"), F.xxhash64(F.substring("bare", 1, prefix_chars)).alias("prefix")))
    lengths = materialize(marks.groupBy("length").agg(F.count("*").alias("n")).filter("n > 1").select("length"))
    same_length = marks.join(sided(lengths), "length", "left_semi")
    return marks, materialize(same_length.groupBy("length", "prefix").agg(F.count("*").alias("n")).filter("n > 1").select("length", "prefix"))


def without_duplicates(docs: DataFrame, prefix_chars: int = 64) -> DataFrame:
    """``docs`` with one row of each group that is equal without white space, columns as they are.

    The row with the longest original text stays, then that with the smallest doc_id (null last), then by a hash of all its columns;
    of rows equal throughout, one.  Null text is an empty text.  Rows whose length or prefix no other has are
    never hashed in full and never shuffled.  An empty table gives no rows.
    """
    names = {k: f"column {i}" for i, k in enumerate(docs.columns)}
    back = [F.col(f"`{v}`").alias(k) for k, v in names.items()]
    rows = docs.toDF(*names.values())
    rows = rows.select("*", *row_key(rows))
    plain = rows.select(F.col(f"`{names['doc_id']}`").alias("doc_id"), F.col(f"`{names['text']}`").cast("string").alias("text"), "r1", "r2")
    marks, prefixes = _refined(plain, ["r1", "r2"], prefix_chars)
    left = materialize(marks.join(sided(prefixes), ["length", "prefix"], "left_semi").groupBy("r1", "r2").agg(F.count("*").alias("rows")))

    # Rows are told apart by a hash of all their columns; of those left, texts are read again for a full hash.
    asked = plain.join(sided(left.select(F.col("r1").alias("l1"), F.col("r2").alias("l2"))), F.expr("r1 = l1 and r2 = l2"), "left_semi")
    place = F.struct((-F.char_length(F.coalesce("text", F.lit("")))).alias("c"), F.col("doc_id").isNull().alias("u"), F.col("doc_id").alias("d"), F.col("r1"), F.col("r2"))
    hashed = materialize(asked.select("r1", "r2", full_hash(F.col("text")).alias("print"), place.alias("place")))
    best = hashed.groupBy("print").agg(F.min("place").alias("best")).select("best.r1", "best.r2")
    stays = left.join(best.hint("merge"), ["r1", "r2"], "left_semi").filter("rows > 1").select("r1", "r2", F.lit(True).alias("repeated"))
    goes = left.join(best.hint("merge"), ["r1", "r2"], "left_anti").select("r1", "r2", F.lit(False).alias("repeated"))
    told = materialize(stays.unionByName(goes).select(F.col("r1").alias("t1"), F.col("r2").alias("t2"), "repeated"))
    found = rows.join(sided(told), F.expr("r1 = t1 and r2 = t2"), "left")
    once = found.filter("repeated").dropDuplicates(["r1", "r2"])
    return found.filter("repeated is null").unionByName(once).select(*back)


def exact_duplicates(docs: DataFrame, prefix_chars: int = 64) -> DataFrame:
    """Groups of documents that are equal without white space, from ``docs(doc_id, text)``.

    One narrow scan gives each row its length without white space and the hash of its first ``prefix_chars``
    characters.  Rows alone with their length leave, then rows alone with length and prefix.  Only the texts of
    rows that are left are read again for a full hash.  Of a group, the row with the longest original text stays,
    then the smallest doc_id.

    Returns ``full_hash, keep_id, group_size`` for each group of two rows or more.  Null text is an empty text,
    and empty texts are one group.  Null ids lose every tie.  Rows that repeat a doc_id and a text count one by
    one in group_size.  An empty table gives no groups.
    """
    text = F.col("text").cast("string")
    marks, prefixes = _refined(docs, ["doc_id"], prefix_chars)
    left = materialize(marks.join(sided(prefixes), ["length", "prefix"], "left_semi").select("doc_id").distinct())
    full = docs.select("doc_id", text.alias("text")).join(sided(left.withColumnRenamed("doc_id", "left_id")), F.expr("doc_id <=> left_id"), "left_semi")
    hashed = full.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).alias("chars"), full_hash(F.col("text")).alias("full_hash"))
    order = F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("u"), F.col("doc_id").alias("d"))
    groups = hashed.groupBy("full_hash").agg(F.min(order).alias("best"), F.count("*").alias("group_size")).filter("group_size > 1")
    return groups.select("full_hash", F.col("best.d").alias("keep_id"), "group_size")


def deduplicate(docs: DataFrame, prefix_chars: int = 64) -> DataFrame:
    """A decision for every row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Defined results are those of :func:`exact_duplicates`; a row that no other equals keeps itself with a group
    of one.  kept compares ids null-safely, so rows that repeat the id of the kept row share its fate.
    """
    groups = materialize(exact_duplicates(docs, prefix_chars))
    rows = docs.select("doc_id", full_hash(F.col("text")).alias("text_sha256"))
    found = rows.join(groups.withColumnRenamed("full_hash", "text_sha256").hint("merge"), "text_sha256", "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256",
    )
