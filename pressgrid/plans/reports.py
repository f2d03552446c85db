"""Composite reports that users call by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.dates import age_at_death
from ..functions.rules import diversity_note, flag_origin, heat_level, pipe_list, safe_ratio
from ..operators import aggregates as A, pages as P
from ..operators.filters import date_range, favorites, letter_filter, live, where_domain
from ..operators.joins import alias_collisions, articles_of, cooccurrence, images_wide
from ..schema import Corpus
from ..streaming.jobs import business_events, job_health


def entity_list(c: Corpus, letter: str | None = None, only_favorites: bool = False, sort_by: str = "name", limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of live entities, with the total of the filter in each row."""
    rows = live(c.entities)
    rows = letter_filter(rows, letter, sort_by) if letter else rows
    rows = favorites(rows) if only_favorites else rows
    total = rows.agg(F.count("*").alias("total"))
    return P.entity_page(rows, limit, offset, sort_by).select("id", "name", "slug").crossJoin(F.broadcast(total))


def entity_card(c: Corpus) -> DataFrame:
    """Names, lists and age at death of each entity (R2)."""
    return c.entities.join(A.alias_text(c.aliases).withColumnRenamed("entity_id", "id"), "id", "left").select(
        "id", "name", "alias_text", pipe_list(F.col("nationalities_text")).alias("nationalities"), age_at_death(F.col("birth_date"), F.col("death_date")).alias("age_at_death"))


def gallery(c: Corpus, entity_id: int, pose: str | None = None, unique_only: bool = False, status: str | None = None, low: str | None = None, high: str | None = None, limit: int = 100) -> DataFrame:
    """An entity's images with filters: the total without them, and the number with them."""
    mine = c.with_(images=c.images.filter(F.col("entity_id") == entity_id))
    total = mine.images.agg(F.count("*").alias("total"))
    rows = images_wide(mine)
    if pose:
        rows = rows.filter(F.col("pose") == pose)
    if unique_only:
        rows = rows.filter(F.col("is_duplicate").eqNullSafe(False))
    if status:
        rows = rows.filter(F.col("association_status") == status)
    rows = date_range(rows, low, high)
    filtered = rows.agg(F.count("*").alias("filtered"))
    return rows.orderBy("id").limit(limit).select("id", "pose", "association_status", "published_at").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(filtered))


def article_list(c: Corpus, entity_id: int | None = None, domain: str | None = None, low: str | None = None, high: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of articles with their entities and images counted, for the page alone."""
    rows = c.articles if entity_id is None else articles_of(c, entity_id)
    rows = where_domain(rows, domain) if domain else rows
    page = P.article_page(date_range(rows, low, high), limit, offset)
    return page.select("id", "title", "published_at", "total").join(A.article_counts(c, page), "id")


def article_detail(c: Corpus, article_id: int) -> DataFrame:
    """Entities by name and images by id of an article, in one row."""
    e = c.links.filter(F.col("article_id") == article_id).join(c.entities.select(F.col("id").alias("entity_id"), "name"), "entity_id")
    i = c.images.filter(F.col("article_id") == article_id)
    names = e.agg(F.array_join(F.array_sort(F.collect_list("name")), "; ").alias("entities"))
    ids = i.agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("images"))
    return c.articles.filter(F.col("id") == article_id).select("id", "title").crossJoin(F.broadcast(names)).crossJoin(F.broadcast(ids))


def review_queue(c: Corpus, limit: int = 50) -> DataFrame:
    """The review queue with the origin of each flag."""
    return P.review_queue(c.images, limit).select("id", "entity_id", "association_status", flag_origin(F.col("association_status")).alias("origin"), "match_score", "total")


def entity_profile(c: Corpus) -> DataFrame:
    """Poses, domains, coverage and duplicates of every entity, a row each."""
    poses = A.pose_distribution(c, per_entity=True).groupBy("entity_id").agg(*[F.coalesce(F.sum(F.when(F.col("pose") == p, F.col("n"))), F.lit(0)).alias(f"pose_{p}") for p in ("front", "left", "right", "unknown")])
    domains = A.source_distribution(c).groupBy("entity_id").agg(F.count("*").alias("domains"))
    uniques = c.images.groupBy("entity_id").agg(F.count_if(F.col("is_duplicate").eqNullSafe(False)).alias("unique_images"))
    out = poses.join(domains, "entity_id", "left").join(A.coverage_range(c), "entity_id", "left").join(A.duplicate_count(c.images), "entity_id").join(uniques, "entity_id")
    return out.withColumn("note", diversity_note(F.col("unique_images")))


def compare(c: Corpus, a: int, b: int) -> DataFrame:
    """Articles of two entities and those they share."""
    counts = c.links.agg(
        F.countDistinct(F.when(F.col("entity_id") == a, F.col("article_id"))).alias("articles_a"), F.countDistinct(F.when(F.col("entity_id") == b, F.col("article_id"))).alias("articles_b"))
    return cooccurrence(c.links, 0, (a, b)).crossJoin(F.broadcast(counts))


def calendar(c: Corpus, entity_id: int, as_of: str, days: int = 365) -> DataFrame:
    """A dense calendar in whole weeks from Monday: days outside the range are null, days without articles 0."""
    end = F.lit(as_of).cast("date")
    start = F.date_sub(end, days)
    first, last = F.date_trunc("week", start).cast("date"), F.date_add(F.date_trunc("week", end).cast("date"), 6)
    grid = c.articles.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias("day"))
    n = A.timeline(c, as_of, days, entity_id).select("day", "n")
    inside = (F.col("day") >= start) & (F.col("day") <= end)
    cells = grid.hint("merge").join(n, "day", "left").withColumn("n", F.when(inside, F.coalesce("n", F.lit(0))))
    return cells.crossJoin(F.broadcast(n.agg(F.max("n").alias("peak")))).select(
        "day", "n", ((F.dayofweek("day") + 5) % 7).alias("weekday"),
        F.when(inside, F.round(heat_level(F.col("n"), F.col("peak")), 6)).alias("level"))


def visibility(c: Corpus, entity_id: int, titles: int = 50) -> DataFrame:
    """Monthly images of an entity with the number of its distinct titles and unique images."""
    own = articles_of(c, entity_id).select("title").distinct()
    some = own.orderBy("title").limit(titles).agg(F.count("*").alias("titles"))
    unique = c.images.filter(F.col("entity_id") == entity_id).agg(F.count_if(F.col("is_duplicate").eqNullSafe(False)).alias("unique_images"))
    return A.media_timeline(c, "month", entity_id).crossJoin(F.broadcast(some)).crossJoin(F.broadcast(unique))


def visibility_report(c: Corpus, entity_id: int, titles: int = 50) -> dict[str, DataFrame]:
    """The parts of the visibility report: the entity's profile, its monthly timeline, and its titles by name."""
    own = articles_of(c, entity_id).filter("title is not null").select("title").distinct().orderBy("title").limit(titles)
    return {"profile": entity_profile(c).filter(F.col("entity_id") == entity_id), "timeline": visibility(c, entity_id, titles), "titles": own}


def duplicate_candidates(c: Corpus, limit: int = 30) -> DataFrame:
    """Same knowledge-base id, same surname, colliding alias: three categories in one table."""
    kb = A.ordered_members(live(c.entities).filter("kb_id is not null"), "kb_id").filter("size(members) > 1").orderBy("kb_id").limit(limit)
    names = P.surname_groups(c.entities, limit)
    clash = alias_collisions(c.entities, c.aliases).orderBy("collision_on", "first_id").limit(limit)
    text = lambda x: F.array_join(F.transform(x, lambda i: i.cast("string")), ",")
    return (
        kb.select(F.lit("kb_id").alias("category"), F.col("kb_id").alias("key"), text("members").alias("members"))
        .unionByName(names.select(F.lit("surname").alias("category"), F.col("surname").alias("key"), text("members").alias("members")))
        .unionByName(clash.select(F.lit("alias").alias("category"), F.col("collision_on").alias("key"), F.concat_ws(",", "first_id", "second_id").alias("members"))))


def job_status(c: Corpus, as_of: str) -> DataFrame:
    """Health of each loop, with the share of images that the audit flagged."""
    ratio = c.images.agg(safe_ratio(F.count_if(F.col("association_status") == "flagged"), F.count("*"), 4).alias("flag_ratio"))
    return job_health(c.events, as_of).select("loop", "successes", "errors", "last_summary").crossJoin(F.broadcast(ratio))


def metric_rows(c: Corpus, as_of: str) -> DataFrame:
    """All metrics as rows ``metric, labels, value``."""
    none = F.create_map().cast("map<string,string>")
    g = A.gauges(c)
    names = ("entities", "tombstones", "images", "flagged", "flagged_ratio")
    flat = g.select(F.explode(F.array(*[F.struct(F.lit(f"corpus_{x}").alias("metric"), F.col(x).cast("double").alias("value")) for x in names])).alias("m")).select("m.metric", none.alias("labels"), "m.value")
    provider = A.by_provider(c.images).select(F.lit("corpus_images_by_provider").alias("metric"), F.create_map(F.lit("provider"), F.col("provider")).alias("labels"), F.col("n").cast("double").alias("value"))
    health = job_health(c.events, as_of)
    loops = [health.select(F.lit(f"job_{x}").alias("metric"), F.create_map(F.lit("loop"), F.col("loop")).alias("labels"), F.col(x).cast("double").alias("value")) for x in ("successes", "errors")]
    kinds = business_events(c.events, as_of).select(F.lit("job_events_24h").alias("metric"), F.create_map(F.lit("kind"), F.col("kind")).alias("labels"), F.col("n").cast("double").alias("value"))
    return flat.unionByName(provider).unionByName(loops[0]).unionByName(loops[1]).unionByName(kinds)


def corpus_snapshot(c: Corpus) -> DataFrame:
    """Live persons, tombstones, favourites, images, and flagged of both kinds with their ratio."""
    e = c.entities.agg(
        F.count_if(~F.col("kb_status").eqNullSafe("not_person")).alias("persons"), F.count_if(F.col("kb_status") == "not_person").alias("tombstones"),
        F.count_if(F.col("is_favorite").eqNullSafe(True)).alias("favorites"))
    i = A.gauges(c).select("images", "flagged", "flagged_ratio")
    return e.crossJoin(F.broadcast(i))


def anomalies(c: Corpus, flagged_share: float = 0.15, per_day: int = 50) -> DataFrame:
    """Entities with a high share of flagged images, days with very many images, images from elsewhere."""
    share = c.images.groupBy("entity_id").agg((F.count_if(F.col("association_status") == "flagged") / F.count("*")).alias("x")).filter(F.col("x") > flagged_share)
    days = A.media_timeline(c, "day").filter(F.col("n") >= per_day)
    other = A.by_provider(c.images).filter("provider <> 'feed'")
    return (
        share.select(F.lit("flagged_share").alias("kind"), F.col("entity_id").cast("string").alias("subject"), F.round("x", 4).alias("value"))
        .unionByName(days.select(F.lit("busy_day").alias("kind"), F.concat_ws("/", "entity_id", "period").alias("subject"), F.col("n").cast("double").alias("value")))
        .unionByName(other.select(F.lit("outside").alias("kind"), F.col("provider").alias("subject"), F.col("n").cast("double").alias("value"))))


def sync_report(c: Corpus, as_of: str, n: int = 5) -> DataFrame:
    """Sync progress beside the next batch."""
    return P.next_batch(c.entities, as_of, n).select("id", "tier").crossJoin(F.broadcast(A.sync_status(c.entities, as_of)))
