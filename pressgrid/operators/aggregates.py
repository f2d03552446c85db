"""Counters, distributions, timelines and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.dates import period_key
from ..functions.names import bucket_letter, sort_key
from ..functions.rules import DEFAULT_PROVIDER, safe_ratio
from ..functions.vectors import l2_normalize
from ..schema import Corpus
from ..tables import sided, snapshot
from .filters import favorites, live
from .ranks import ranked

#: Links that one task of :func:`recompute_counts` takes, about.
LINKS_OF_TASK = 200_000


def recompute_counts(c: Corpus) -> DataFrame:
    """Entities with fresh counters, and first_seen from the earliest linked article where it is null (A1, A2).

    Links meet their articles in as many tasks as there are links for, each with a bounded number of them.
    """
    im = c.images.groupBy(F.col("entity_id").alias("id")).agg(
        F.count("*").alias("n_images"), F.count_if(F.col("is_duplicate").eqNullSafe(False)).alias("n_unique"))
    links = snapshot(c.links.select("article_id", "entity_id").distinct())
    tasks = max(1, -(-links.count() // LINKS_OF_TASK))
    times = c.articles.select(F.col("id").alias("article_id"), "scraped_at").repartition(tasks, "article_id").groupBy("article_id").agg(F.min("scraped_at").alias("scraped_at"))
    seen = links.repartition(tasks, "article_id").hint("merge").join(times, "article_id", "left")
    ar = seen.groupBy(F.col("entity_id").alias("id")).agg(F.count("article_id").alias("n_articles"), F.min("scraped_at").alias("earliest"))
    joined = c.entities.join(im.hint("merge"), "id", "left").join(ar.hint("merge"), "id", "left")
    zero = lambda x: F.coalesce(x, F.lit(0).cast("bigint"))
    return joined.withColumns({
        "image_count": zero("n_images"), "unique_image_count": zero("n_unique"), "article_count": zero("n_articles"), "first_seen": F.coalesce("first_seen", "earliest"),
    }).drop("n_images", "n_unique", "n_articles", "earliest")


def pose_distribution(c: Corpus, entity: int | None = None, per_entity: bool = False) -> DataFrame:
    """Images by pose, of one entity, of each, or of all; without a face or pose: unknown (A3)."""
    images = c.images if entity is None else c.images.filter(F.col("entity_id") == entity)
    rows = images.select("id", "entity_id").join(c.faces.select(F.col("image_id").alias("id"), "pose"), "id", "left")
    keys = ["entity_id"] if per_entity else []
    return rows.groupBy(*keys, F.coalesce("pose", F.lit("unknown")).alias("pose")).agg(F.count("*").alias("n"))


def _image_articles(c: Corpus) -> DataFrame:
    return c.images.select(F.col("id").alias("image_id"), "entity_id", "article_id", "association_status", "match_score").join(
        c.articles.select(F.col("id").alias("article_id"), "domain", "published_at", "title"), "article_id")


def source_distribution(c: Corpus) -> DataFrame:
    """Distinct images by entity and domain (A4)."""
    return _image_articles(c).groupBy("entity_id", "domain").agg(F.countDistinct("image_id").alias("n"))


def coverage_range(c: Corpus) -> DataFrame:
    """First and last publication date by way of the images (A5)."""
    return _image_articles(c).groupBy("entity_id").agg(F.min("published_at").alias("first_day"), F.max("published_at").alias("last_day"))


def timeline(c: Corpus, as_of: str, days: int = 365, entity: int | None = None) -> DataFrame:
    """Distinct articles by entity and day over the trailing days, both ends included."""
    links = c.links if entity is None else c.links.filter(F.col("entity_id") == entity)
    end = F.lit(as_of).cast("date")
    recent = c.articles.filter((F.col("published_at") >= F.date_sub(end, days)) & (F.col("published_at") <= end))
    rows = links.join(recent.select(F.col("id").alias("article_id"), "published_at"), "article_id")
    return rows.groupBy("entity_id", F.col("published_at").alias("day")).agg(F.countDistinct("article_id").alias("n"))


def media_timeline(c: Corpus, granularity: str, entity: int | None = None) -> DataFrame:
    """Images by entity and period."""
    rows = _image_articles(c).filter("published_at is not null")
    rows = rows if entity is None else rows.filter(F.col("entity_id") == entity)
    return rows.groupBy("entity_id", period_key(F.col("published_at"), granularity).alias("period")).agg(F.count("*").alias("n"))


def timeline_summary(days: DataFrame) -> DataFrame:
    """Active days, total and peak of ``entity_id, day, n``."""
    return days.groupBy("entity_id").agg(F.count("*").alias("active_days"), F.sum("n").alias("total"), F.max("n").alias("peak"))


def corpus_stats(c: Corpus) -> DataFrame:
    """Totals in one row: each table is read once, for its own aggregate."""
    e = c.entities.agg(F.count("*").alias("entities"))
    a = c.articles.agg(F.count("*").alias("articles"))
    i = c.images.agg(F.count("*").alias("images"), F.count("aligned_path").alias("aligned"), F.count_if(F.col("is_duplicate").eqNullSafe(True)).alias("duplicates"))
    one = e.crossJoin(F.broadcast(a)).crossJoin(F.broadcast(i))  # three tables of one row
    return one.withColumn("alignment_rate", safe_ratio(F.col("aligned"), F.col("images"), 3))


def top_entities(entities: DataFrame, n: int = 10) -> DataFrame:
    return live(entities).select("id", "name", "image_count").orderBy(F.col("image_count").desc_nulls_last(), "id").limit(n)


def letter_histogram(entities: DataFrame, sort_by: str = "name", only_favorites: bool = False) -> DataFrame:
    """Live entities by first letter."""
    rows = favorites(live(entities)) if only_favorites else live(entities)
    key = F.col("name") if sort_by == "name" else sort_key(F.col("name"))
    return rows.groupBy(bucket_letter(key).alias("letter")).agg(F.count("*").alias("n"))


def flagged_by_period(c: Corpus, low: str | None = None, high: str | None = None, limit: int = 20) -> DataFrame:
    """Entities with most images flagged by the audit in a period; images without an article drop (A10)."""
    rows = _image_articles(c).filter("association_status = 'flagged'")
    if low:
        rows = rows.filter(F.col("published_at") >= F.lit(low).cast("date"))
    if high:
        rows = rows.filter(F.col("published_at") <= F.lit(high).cast("date"))
    per = rows.groupBy("entity_id").agg(
        F.count("*").alias("flagged"), F.round(F.avg("match_score"), 4).alias("mean_score"), F.min("published_at").alias("first_day"), F.max("published_at").alias("last_day"))
    total = c.images.groupBy("entity_id").agg(F.count("*").alias("total"))
    joined = per.join(total, "entity_id").join(c.entities.select(F.col("id").alias("entity_id"), "name"), "entity_id")
    return joined.withColumn("ratio", safe_ratio(F.col("flagged"), F.col("total"), 3)).orderBy(F.col("flagged").desc(), "entity_id").limit(limit)


def gauges(c: Corpus) -> DataFrame:
    """Entities, tombstones, images, flagged of both kinds and their ratio, in one row."""
    e = c.entities.agg(F.count("*").alias("entities"), F.count_if(F.col("kb_status") == "not_person").alias("tombstones"))
    i = c.images.agg(F.count("*").alias("images"), F.count_if(F.col("association_status").isin("flagged", "human_flagged")).alias("flagged"))
    return e.crossJoin(F.broadcast(i)).withColumn("flagged_ratio", safe_ratio(F.col("flagged"), F.col("images"), 6))


def by_provider(images: DataFrame) -> DataFrame:
    return images.groupBy(F.coalesce("provider", F.lit(DEFAULT_PROVIDER)).alias("provider")).agg(F.count("*").alias("n"))


def queue_status(images: DataFrame) -> DataFrame:
    """Counts over the fixed statuses, in one row."""
    return images.agg(
        F.count_if(F.col("scrape_status") == "downloaded").alias("downloaded"), F.count_if(F.col("scrape_status") == "failed").alias("failed"),
        F.count_if(F.col("analysis_status") == "pending").alias("pending"), F.count_if(F.col("analysis_status") == "done").alias("done"), F.count("*").alias("total"))


def sync_status(entities: DataFrame, as_of: str, favorite_days: int = 7, stale_days: int = 30) -> DataFrame:
    """How far article syncing has come, in one pass."""
    now, last = F.lit(as_of).cast("timestamp_ntz"), F.col("last_synced_at")
    due = last.isNull() | (last < now - F.expr(f"interval {favorite_days} days"))
    return entities.agg(
        F.count("*").alias("total"), F.count(last).alias("ever_synced"), F.count_if(last.isNull()).alias("never_synced"),
        F.count_if(F.col("is_favorite").eqNullSafe(True) & due).alias("favorites_due"), F.count_if(last < now - F.expr(f"interval {stale_days} days")).alias("stale"))


def article_counts(c: Corpus, articles: DataFrame | None = None) -> DataFrame:
    """Entities and images of each article, of a page of articles or of all."""
    page = (c.articles if articles is None else articles).select("id")
    e = c.links.groupBy(F.col("article_id").alias("id")).agg(F.countDistinct("entity_id").alias("entities"))
    i = c.images.filter("article_id is not null").groupBy(F.col("article_id").alias("id")).agg(F.count("*").alias("images"))
    zero = F.lit(0).cast("bigint")
    return page.join(e, "id", "left").join(i, "id", "left").select("id", F.coalesce("entities", zero).alias("entities"), F.coalesce("images", zero).alias("images"))


def same_kb_groups(entities: DataFrame, only_live: bool = True) -> DataFrame:
    """Knowledge-base ids that several entities share; the merge plan reads them without the tombstone filter."""
    rows = live(entities) if only_live else entities
    return rows.filter("kb_id is not null").groupBy("kb_id").agg(F.count("*").alias("members")).filter("members > 1")


def alias_text(aliases: DataFrame) -> DataFrame:
    """Aliases of each entity, in order, with blanks between."""
    return aliases.groupBy("entity_id").agg(F.array_join(F.sort_array(F.collect_list("alias")), " ").alias("alias_text"))


def centroids(images: DataFrame, flags: tuple[str, ...] = ("flagged", "human_flagged")) -> DataFrame:
    """Mean of each entity's vectors without the flagged ones, of length 1, and their number.

    Means are taken position by position, so a task holds sums of one vector's length for each entity it sees.
    """
    kept = images.filter(F.col("vector").isNotNull() & ~F.coalesce(F.col("association_status").isin(*flags), F.lit(False)))
    cells = kept.select("entity_id", F.posexplode("vector").alias("pos", "x"))
    means = cells.groupBy("entity_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    whole = means.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda p: p["m"]).alias("mean"), F.max("n").alias("centroid_n"))
    return whole.select("entity_id", l2_normalize(F.col("mean")).alias("centroid"), "centroid_n")


def composite_vector(images: DataFrame, mode: str = "equal") -> DataFrame:
    """Weighted mean of an entity's vectors, equal or falling from 1.0 to 0.1 in order of scraped_at and id.

    Places come from :func:`ranked`, so an entity may have any number of images; sums are taken before the shuffle.
    """
    rows = images.filter("vector is not null").select("entity_id", "scraped_at", "id", "vector")
    if mode == "equal":
        rows = rows.withColumn("w", F.lit(1.0))
    else:
        placed = ranked(rows, "entity_id", ["scraped_at", "id"])
        totals = snapshot(rows.groupBy("entity_id").agg((F.count("*") - 1).alias("last")))
        met = placed.join(sided(totals.withColumnRenamed("entity_id", "its_entity")), F.col("entity_id").eqNullSafe(F.col("its_entity")))
        rows = met.withColumn("w", F.when(F.col("last") > 0, 1.0 - 0.9 * (F.col("place") - 1) / F.col("last")).otherwise(1.0))
    cells = rows.select("entity_id", "w", F.posexplode("vector").alias("pos", "x"))
    sums = cells.groupBy("entity_id", "pos").agg((F.sum(F.col("w") * F.col("x").cast("double")) / F.sum("w")).alias("m"))
    return sums.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda p: p["m"]).alias("vector"))


def reset_centroids(entities: DataFrame, ids: DataFrame) -> DataFrame:
    """``entities`` with the centroids of ``ids(id)`` forgotten, so that the next audit makes them anew."""
    held = [k for k in ("centroid", "centroid_n") if k in entities.columns]
    if not held:
        return entities
    hit = entities.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)).hint("merge"), "id", "left")
    return hit.withColumns({k: F.when(F.col("_hit").isNull(), F.col(k)) for k in held}).select(*entities.columns)


def duplicate_count(images: DataFrame) -> DataFrame:
    return images.groupBy("entity_id").agg(F.count_if(F.col("is_duplicate").eqNullSafe(True)).alias("duplicates"))


def ingest_summary(outcomes: DataFrame) -> DataFrame:
    """Rows by outcome of an intake run."""
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


def recompute_summary(entities: DataFrame) -> DataFrame:
    """Sums of the counters."""
    return entities.agg(F.count("*").alias("entities"), *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("article_count", "image_count", "unique_image_count")])


def audit_summary(images: DataFrame) -> DataFrame:
    """Entities with images, confirmed and flagged ones."""
    return images.agg(
        F.countDistinct("entity_id").alias("entities"), F.count_if(F.col("association_status") == "confirmed").alias("confirmed"),
        F.count_if(F.col("association_status") == "flagged").alias("flagged"))


def last_run(events: DataFrame) -> DataFrame:
    """Each loop's last success with its summary, and its last error, over all time."""
    ok, bad = F.col("kind") == "success", F.col("kind") == "error"
    return events.filter("loop is not null and kind in ('success', 'error')").groupBy("loop").agg(
        F.max(F.when(ok, F.col("ts"))).alias("last_success"), F.max(F.when(bad, F.col("ts"))).alias("last_error"),
        F.max_by("summary", F.when(ok, F.col("ts"))).alias("last_summary"))


def contact_sheet(images: DataFrame, n: int = 24) -> DataFrame:
    """Each entity's first aligned images that are neither duplicates nor flagged by the audit."""
    usable = images.filter("aligned_path is not null and is_duplicate <=> false and not association_status <=> 'flagged'")
    place = F.row_number().over(W.partitionBy("entity_id").orderBy("scraped_at", "id"))
    return usable.withColumn("place", place).filter(F.col("place") <= n).select("entity_id", "place", "id")


def primary_detection(detections: DataFrame) -> DataFrame:
    """The largest box of each image."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return detections.groupBy("image_id").agg(F.max_by(F.struct("x1", "y1", "x2", "y2"), area).alias("box"), F.count("*").alias("faces"))


def ordered_members(entities: DataFrame, key: str) -> DataFrame:
    """Members of each group, most images first, then by name."""
    row = F.struct((-F.coalesce("image_count", F.lit(0))).alias("order"), F.col("name").alias("name"), F.col("id").alias("id"))
    return entities.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["id"]).alias("members"), F.sum(F.coalesce("image_count", F.lit(0))).alias("images"))
