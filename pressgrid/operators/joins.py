"""Joins between entities, articles, links and images."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.names import name_variants, slug
from ..schema import Corpus
from ..tables import sided, snapshot
from .filters import live


def article_mentions(c: Corpus) -> DataFrame:
    """Each link with its article and entity."""
    a = c.articles.select(F.col("id").alias("article_id"), "title", "published_at", "domain")
    e = c.entities.select(F.col("id").alias("entity_id"), "name", "kb_status")
    return c.links.select("article_id", "entity_id").join(a, "article_id").join(e, "entity_id")


def images_wide(c: Corpus) -> DataFrame:
    """Each image with its entity, article and face, where there are any."""
    e = c.entities.select(F.col("id").alias("entity_id"), F.col("name").alias("entity_name"), "slug", "kb_status")
    a = c.articles.select(F.col("id").alias("article_id"), F.col("title").alias("article_title"), "published_at", "domain")
    f = c.faces.withColumnRenamed("image_id", "id")
    return c.images.join(e, "entity_id", "left").join(a, "article_id", "left").join(f, "id", "left")


def articles_of(c: Corpus, entity_id: int) -> DataFrame:
    """Articles that mention an entity."""
    return c.articles.join(c.links.filter(F.col("entity_id") == entity_id).select(F.col("article_id").alias("id")), "id", "left_semi")


def orphan_articles(c: Corpus) -> DataFrame:
    """Articles without a link."""
    return c.articles.join(c.links.select(F.col("article_id").alias("id")), "id", "left_anti")


#: Entities of a block of an article that names more than these.
ARTICLE_BLOCK = 1000
#: Links whose pairs one task makes, about: more links are more tasks, not larger ones.
LINKS_OF_TASK = 200_000


def cooccurrence(links: DataFrame, min_shared: int = 1, pair: tuple[int, int] | None = None) -> DataFrame:
    """Shared articles of each two entities, or of one pair.

    One pair is two filtered scans and a count.  All pairs join the links with themselves on the article.  An article of very
    many entities is dealt into blocks, and each two of its blocks meet under a key of their own: its pairs, which are the
    result, spread over as many tasks, and none is left out.
    """
    links = links.select("article_id", "entity_id").distinct()
    if not pair:
        links = snapshot(links)  # counted and read several times
    if pair:
        low, high = sorted(pair)
        left = links.filter(F.col("entity_id") == low).select("article_id")
        right = links.filter(F.col("entity_id") == high).select("article_id")
        found = left.join(right, "article_id").agg(F.count("*").alias("shared"))
        return found.select(F.lit(low).alias("entity_a"), F.lit(high).alias("entity_b"), "shared").filter(F.col("shared") >= min_shared)
    large = links.groupBy(F.col("article_id").alias("large_id")).agg(F.count("*").alias("n")).filter(F.col("n") > ARTICLE_BLOCK)
    large = snapshot(large.select("large_id", F.ceil(F.col("n") / ARTICLE_BLOCK).cast("int").alias("blocks")))
    few = large.limit(1).count()
    plain = links.join(sided(large), F.expr("article_id = large_id"), "left_anti") if few else links
    a, b = plain.withColumnRenamed("entity_id", "entity_a"), plain.withColumnRenamed("entity_id", "entity_b")
    tasks = max(1, -(-links.count() // LINKS_OF_TASK))
    pairs = a.repartition(tasks, "article_id").hint("merge").join(b.repartition(tasks, "article_id"), "article_id").filter("entity_a < entity_b").select("entity_a", "entity_b")
    if few:
        dealt = links.join(sided(large), F.expr("article_id = large_id")).withColumn("block", F.pmod(F.xxhash64("entity_id"), F.col("blocks")).cast("int"))
        left = dealt.select("article_id", F.col("entity_id").alias("x"), F.col("block").alias("low"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("high"))
        right = dealt.select("article_id", F.col("entity_id").alias("y"), F.col("block").alias("high"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("low"))
        met = left.hint("merge").join(right, ["article_id", "low", "high"]).filter("low < high or x < y")
        pairs = pairs.unionByName(met.select(F.least("x", "y").alias("entity_a"), F.greatest("x", "y").alias("entity_b")))
    return pairs.groupBy("entity_a", "entity_b").agg(F.count("*").alias("shared")).filter(F.col("shared") >= min_shared)


def first_entity(c: Corpus) -> DataFrame:
    """One entity for each article: the one with the lowest id."""
    first = c.links.groupBy(F.col("article_id").alias("id")).agg(F.min("entity_id").alias("entity_id"))
    names = c.entities.select(F.col("id").alias("entity_id"), F.col("name").alias("entity_name"))
    return c.articles.select("id", "title").join(first, "id", "left").join(names, "entity_id", "left").select("id", "title", "entity_id", "entity_name")


def variants_table(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """``entity_id, position, variant``."""
    own = aliases.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "alias"))), lambda x: x["alias"]).alias("aliases"))
    joined = entities.select(F.col("id").alias("entity_id"), "name").join(own, "entity_id", "left")
    return joined.select("entity_id", F.posexplode(name_variants(F.col("name"), F.col("aliases"))).alias("position", "variant"))


def associate(candidates: DataFrame, article_entities: DataFrame, variants: DataFrame) -> DataFrame:
    """The entity that an image's texts name: first in the article's order, then in the variants' order.

    ``candidates(image_id, article_id, alt, caption)``, ``article_entities(article_id, entity_id, entity_pos)``.
    An equality join on the article bounds the text comparison to its own entities.  Variants are broadcast if few by measure:
    a merge would send an image's texts once for each entity of its article.
    """
    text = F.lower(F.trim(F.concat_ws(" ", F.when(F.col("alt") != "", F.col("alt")), F.when(F.col("caption") != "", F.col("caption")))))
    texts = candidates.select("image_id", "article_id", text.alias("words")).filter("words <> ''")
    met = texts.hint("merge").join(article_entities, "article_id").join(sided(snapshot(variants)), "entity_id").filter(F.contains("words", F.lower("variant")))
    return met.groupBy("image_id").agg(F.min_by("entity_id", F.struct("entity_pos", "position")).alias("entity_id"))


def resolve_mentions(mentions: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """``raw_name`` to an entity: by slug, else by alias, else new; tombstones reject the mention.

    Of an alias with several owners the one with the highest alias id counts.
    """
    known = entities.select(F.col("slug").alias("own_slug"), F.col("id").alias("by_slug"))
    owners = aliases.groupBy(F.col("alias").alias("raw_name")).agg(F.max_by("entity_id", "id").alias("by_alias"))
    status = entities.select(F.col("id").alias("entity_id"), "kb_status")
    found = mentions.withColumn("own_slug", slug(F.col("raw_name"))).join(known.hint("merge"), "own_slug", "left").join(owners.hint("merge"), "raw_name", "left")
    found = found.withColumn("entity_id", F.coalesce("by_slug", "by_alias")).join(status.hint("merge"), "entity_id", "left")
    outcome = F.when(F.col("kb_status").eqNullSafe("not_person"), "rejected").when(F.col("by_slug").isNotNull(), "slug").when(F.col("by_alias").isNotNull(), "alias").otherwise("new")
    return found.select(*mentions.columns, "own_slug", "entity_id", outcome.alias("outcome"))


def with_canonical(images: DataFrame) -> DataFrame:
    """Each duplicate with the URL of what it duplicates.

    Images that duplicate nothing come under their own id, where they match nothing: null keys would all meet in one task.
    """
    base = images.select(F.col("id").alias("_of"), F.col("source_url").alias("canonical_url"))
    met = images.withColumn("_key", F.coalesce("duplicate_of", "id")).join(base.hint("merge"), F.expr("_key = _of and duplicate_of is not null"), "left")
    return met.drop("_key", "_of")


def resolve_labels(ids: DataFrame, labels: DataFrame, languages: tuple[str, ...] = ("fr", "en")) -> DataFrame:
    """``key, kb_ids`` to ``key, labels`` in order, each label in the first language that has it; ids without one drop."""
    rank = sum((F.when(F.col("lang") == x, i).otherwise(0) for i, x in enumerate(languages)), F.lit(0))
    best = labels.filter(F.col("lang").isin(*languages)).groupBy("kb_id").agg(F.min_by("label", rank).alias("label"))
    flat = ids.select("key", F.posexplode("kb_ids").alias("pos", "kb_id")).join(best.hint("merge"), "kb_id")
    lists = flat.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"]).alias("labels"))
    return ids.select("key").join(lists.hint("merge"), "key", "left").select("key", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))


def missing_files(images: DataFrame, manifest: DataFrame) -> DataFrame:
    """Images whose file isn't in the list of paths."""
    return images.filter("local_path is not null").join(manifest.select(F.col("path").alias("local_path")), "local_path", "left_anti")


def alias_collisions(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Live entities whose name is another live entity's alias, each pair once: the bigger first."""
    owners = aliases.groupBy("alias").agg(F.max_by("entity_id", "id").alias("owner"))
    alive = live(entities).select("id", "name", F.coalesce("image_count", F.lit(0)).alias("images"))
    met = alive.join(owners, F.col("name") == F.col("alias")).filter("owner <> id")
    other = alive.select(F.col("id").alias("owner"), F.col("name").alias("other_name"), F.col("images").alias("other_images"))
    pairs = met.join(other, "owner").withColumn("key", F.concat_ws("/", F.least("id", "owner"), F.greatest("id", "owner")))
    once = pairs.groupBy("key").agg(F.min(F.struct("id", "owner", "name", "other_name", "images", "other_images")).alias("p")).select("p.*")
    ahead = (F.col("images") > F.col("other_images")) | ((F.col("images") == F.col("other_images")) & (F.col("name") <= F.col("other_name")))
    return once.select(
        F.col("name").alias("collision_on"), F.when(ahead, F.col("id")).otherwise(F.col("owner")).alias("first_id"),
        F.when(ahead, F.col("owner")).otherwise(F.col("id")).alias("second_id"))
