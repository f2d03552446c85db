"""Exact top-k inner products by term-at-a-time accumulation over blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import materialize

#: Rows of a block of candidates, and of a block of queries: alike, so that neither side is copied much more often than the other.
CANDIDATE_BLOCK, QUERY_BLOCK = 8192, 8192


def quantized(vectors: DataFrame, scale: int = 256, keep: tuple[str, ...] = ()) -> DataFrame:
    """``vec_id, weights`` and what is kept: floor(scale * x) of each component; rows with a null or non-finite component leave."""
    whole = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(whole & F.col("vec_id").isNotNull()).select("vec_id", *keep, F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("weights"))


def _postings(rows: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each term, the rows that hold it and their weights."""
    if not rows:
        return []
    where = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    term = np.concatenate([np.arange(len(x)) for x in rows]) if len(where) else where
    weight = np.concatenate(rows).astype(np.int64) if len(where) else where
    held = weight != 0
    where, term, weight = where[held], term[held], weight[held]
    order = np.argsort(term, kind="stable")
    where, weight = where[order], weight[order]
    ends = np.cumsum(np.bincount(term, minlength=0)) if len(term) else np.empty(0, np.int64)
    return [(where[a:b], weight[a:b]) for a, b in zip([0, *ends[:-1]], ends)]


def _search(k: int):
    def run(_, queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("vec_id", kind="stable", ignore_index=True)
        ids = block["vec_id"].to_numpy()
        lists = _postings([np.asarray(x, np.int64) for x in block["weights"]])
        n, out = len(ids), []
        for query, weights in zip(queries["query_id"], queries["weights"]):
            scores = np.zeros(n, np.int64)
            for (where, held), weight in zip(lists, np.asarray(weights, np.int64)):
                if weight:
                    scores[where] += held * weight
            others = np.flatnonzero(ids != query)
            rank = scores[others] * n - others  # of equal scores, the smaller id first
            best = others[np.argpartition(rank, -k)[-k:]] if len(others) > k else others
            out.append(pd.DataFrame({"query_id": query, "vec_id": ids[best], "score": scores[best]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    return run


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256) -> DataFrame:
    """The ``k`` highest integer inner products of each query row of ``vectors(vec_id, embedding)`` with all others.

    Queries (rows where the column ``is_query`` holds) and candidates are dealt to blocks of about a fixed size by
    a hash of their place in a written table, which a task that runs again finds unchanged; each pair of blocks is one task, in which a query's terms add their weights to the
    scores of the rows in the terms' posting lists.  A block gives its own best k, a window merges them.  Ties go to the
    smaller vec_id.  Returns ``query_id, rank, vec_id, score``; a query without candidates has no rows.  Vectors that
    are null or hold null or non-finite components take no part, nor do rows without an id.  Where lengths
    differ, missing components count as 0.  Rows of one vec_id are never candidates of each other, and repeated
    rows are listed each.
    """
    rows = materialize(quantized(vectors, scale))
    queries = materialize(rows.filter(is_query).dropDuplicates(["vec_id", "weights"]))
    blocks = max(1, -(-rows.count() // CANDIDATE_BLOCK))
    query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))

    def dealt(count: int, salt: str):
        return F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(salt)), F.lit(count)).cast("int")

    left = queries.select(F.col("vec_id").alias("query_id"), "weights", dealt(query_blocks, "q").alias("q")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = rows.select("vec_id", "weights", dealt(blocks, "c").alias("c")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    found = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInPandas(_search(k), "query_id bigint, vec_id bigint, score bigint")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
