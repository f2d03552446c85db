"""Sorted pages and priority batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.names import sort_key
from ..functions.rules import DEFAULT_PROVIDER
from .filters import favorites, live


def review_queue(images: DataFrame, limit: int = 50, provider: str | None = None) -> DataFrame:
    """Flagged images of both kinds: a null provider first, then other providers, then by score; with the unlimited total."""
    rows = images.filter(F.col("association_status").isin("flagged", "human_flagged"))
    if provider:
        rows = rows.filter(F.coalesce("provider", F.lit(DEFAULT_PROVIDER)) == provider)
    tier = F.when(F.col("provider").isNull(), 0).when(F.col("provider") != DEFAULT_PROVIDER, 1).otherwise(2)
    page = rows.withColumn("tier", tier).orderBy("tier", F.col("match_score").desc_nulls_last(), "id").limit(min(limit, 200))
    return with_total(page, rows)


def with_total(page: DataFrame, rows: DataFrame) -> DataFrame:
    """``page`` with the number of all ``rows`` it was taken from, one number that is broadcast."""
    return page.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))


def article_page(articles: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest articles first, with the total of all."""
    page = articles.orderBy(F.col("published_at").desc_nulls_last(), F.col("scraped_at").desc_nulls_last(), "id").offset(offset).limit(limit)
    return with_total(page, articles)


def entity_page(entities: DataFrame, limit: int = 50, offset: int = 0, sort_by: str = "name") -> DataFrame:
    key = F.col("name") if sort_by == "name" else sort_key(F.col("name"))
    return live(entities).orderBy(key, "id").offset(offset).limit(limit)


def favorite_page(entities: DataFrame, limit: int = 100) -> DataFrame:
    return favorites(live(entities)).orderBy(F.col("image_count").desc_nulls_last(), "name", "id").limit(limit)


def next_batch(entities: DataFrame, as_of: str, n: int, favorite_days: int = 7, stale_days: int = 30) -> DataFrame:
    """The next entities to sync: favourites that are due, then the never synced, both by mentions, then the stalest (T5).

    The tiers are filled in order, so one sort on tier and key gives what three queries would.
    """
    now, last = F.lit(as_of).cast("timestamp_ntz"), F.col("last_synced_at")
    due = F.col("is_favorite").eqNullSafe(True) & (last.isNull() | (last < now - F.expr(f"interval {favorite_days} days")))
    tier = F.when(due, 1).when(last.isNull(), 2).when(last < now - F.expr(f"interval {stale_days} days"), 3)
    rows = entities.withColumn("tier", tier).filter("tier is not null")
    by_mentions = F.when(F.col("tier") < 3, F.col("mentions"))
    return rows.orderBy("tier", by_mentions.desc_nulls_last(), F.when(F.col("tier") == 3, last), "id").limit(n)


def surname_groups(entities: DataFrame, limit: int = 30) -> DataFrame:
    """Live entities that share a surname, the groups with most images first."""
    from ..functions.names import surname_key
    from .aggregates import ordered_members

    rows = live(entities).withColumn("surname", surname_key(F.col("name"))).filter("surname <> ''")
    return ordered_members(rows, "surname").filter(F.size("members") > 1).orderBy(F.col("images").desc(), "surname").limit(limit)


def first_name_page(entities: DataFrame, limit: int = 200) -> DataFrame:
    """By first name in French order."""
    return live(entities).withColumn("key", sort_key(F.col("name"))).orderBy(F.collate("key", "fr"), "id").limit(limit).drop("key")


def full_listing(entities: DataFrame, cap: int = 500) -> DataFrame:
    """The strict tombstone filter drops entities without a status."""
    return live(entities, strict=True).orderBy(F.col("image_count").desc_nulls_last(), "id").limit(cap)
