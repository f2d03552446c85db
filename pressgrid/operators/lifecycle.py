"""Table-to-table maintenance: intake, decisions, purges, erasure, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.names import canonical_name, inverted_name
from ..functions.rules import label_score, statement_dates, statement_ids
from ..schema import Corpus
from ..tables import snapshot
from .aggregates import recompute_counts, reset_centroids
from .filters import demo_rows
from .joins import associate, missing_files, resolve_labels, resolve_mentions, variants_table

#: Properties and the class of people in the knowledge base.
INSTANCE_OF, HUMAN = "P31", "Q5"
BIRTH, DEATH, BIRTH_PLACE, DEATH_PLACE, COUNTRY, OCCUPATION, EMPLOYER = "P569", "P570", "P19", "P20", "P27", "P106", "P108"


#: Rows of a hash range that is numbered in one task, on average.
RANGE_ROWS = 100_000


def _numbered(df: DataFrame, order: str, after: DataFrame, key: str = "id") -> DataFrame:
    """New ids beyond the highest there is.  Rank within a hash range plus the ranges before keeps it off one task."""
    df = snapshot(df)
    ranges = max(1, -(-df.count() // RANGE_ROWS))
    top = after.agg(F.coalesce(F.max(key), F.lit(-1)).alias("top"))
    part = df.withColumn("_part", F.pmod(F.xxhash64(order), F.lit(ranges)))
    sizes = part.groupBy("_part").agg(F.count("*").alias("n"))
    starts = sizes.select("_part", (F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("start"))
    placed = part.withColumn("_nth", F.row_number().over(W.partitionBy("_part").orderBy(order)))
    return placed.join(F.broadcast(starts), "_part").crossJoin(F.broadcast(top)).withColumn(key, F.col("top") + F.col("start") + F.col("_nth")).drop("_part", "_nth", "start", "top")


def upsert_entities(mentions: DataFrame, entities: DataFrame, aliases: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities and aliases after ``mentions(raw_name, source)``, and each mention's entity (M1).

    Names of one slug make one new entity.  The raw form becomes an alias where it is neither the canonical nor the
    stored name nor known.  Mentions of tombstones are left out.
    """
    found = resolve_mentions(mentions.distinct(), entities, aliases)
    fresh = found.filter("outcome = 'new'").groupBy(F.col("own_slug").alias("slug")).agg(F.min(canonical_name(F.col("raw_name"))).alias("name"))
    new = _numbered(fresh, "slug", entities).withColumn("first_seen", F.lit(as_of).cast("timestamp_ntz"))
    after = entities.unionByName(new, allowMissingColumns=True)
    made = new.select(F.col("slug").alias("own_slug"), F.col("id").alias("new_id"))
    kept = found.filter("outcome <> 'rejected'").join(made, "own_slug", "left").withColumn("entity_id", F.coalesce("entity_id", "new_id"))
    stored = after.select(F.col("id").alias("entity_id"), F.col("name").alias("stored"))
    extra = kept.join(stored, "entity_id").filter((F.col("raw_name") != canonical_name(F.col("raw_name"))) & (F.col("raw_name") != F.col("stored")))
    extra = extra.groupBy("entity_id", F.col("raw_name").alias("alias")).agg(F.min("source").alias("source"))
    extra = extra.join(aliases.select("entity_id", "alias"), ["entity_id", "alias"], "left_anti")
    after_aliases = aliases.unionByName(_numbered(extra, "alias", aliases), allowMissingColumns=True)
    return after, after_aliases, kept.select("raw_name", "entity_id")


def upsert_articles(incoming: DataFrame, articles: DataFrame) -> DataFrame:
    """Articles with the unknown URLs of ``incoming(url, title, ...)`` added; the first of a URL wins (M2)."""
    first = W.partitionBy("url").orderBy(F.col("published_at").asc_nulls_last(), "title")
    new = incoming.join(articles.select("url"), "url", "left_anti").withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return articles.unionByName(_numbered(new, "url", articles), allowMissingColumns=True)


def upsert_links(incoming: DataFrame, links: DataFrame) -> DataFrame:
    """Links with the missing ones of ``incoming(article_id, entity_id)`` added (M3)."""
    new = incoming.select("article_id", "entity_id").distinct().join(links.select("article_id", "entity_id"), ["article_id", "entity_id"], "left_anti")
    return links.unionByName(new, allowMissingColumns=True)


def attribute_images(candidates: DataFrame, article_entities: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """``image_id, entity_id, outcome``: named in the text, else the article's only person, else ignored (M4)."""
    candidates = snapshot(candidates.select("image_id", "article_id", "alt", "caption"))  # read for the names and for all images
    named = associate(candidates, article_entities, variants_table(entities, aliases)).withColumnRenamed("entity_id", "named_id")
    only = article_entities.groupBy("article_id").agg(F.min("entity_id").alias("only_id"), F.countDistinct("entity_id").alias("persons")).filter("persons = 1")
    met = candidates.join(named.hint("merge"), "image_id", "left").join(only.hint("merge"), "article_id", "left")
    return met.select("image_id", F.coalesce("named_id", "only_id").alias("entity_id"), F.when(F.col("named_id").isNotNull(), "named").when(F.col("only_id").isNotNull(), "only_person").otherwise("ignored").alias("outcome"))


def append_images(images: DataFrame, incoming: DataFrame, provider: str) -> DataFrame:
    """Images with those of ``incoming`` whose source_url is new, marked with the provider."""
    new = incoming.join(images.select("source_url"), "source_url", "left_anti").dropDuplicates(["source_url"]).withColumn("provider", F.lit(provider))
    return images.unionByName(_numbered(new, "source_url", images), allowMissingColumns=True)


def apply_reassign(images: DataFrame, decisions: DataFrame) -> DataFrame:
    """``decisions(id, entity_id)``: a new entity makes the image manual without a score; the same one changes nothing."""
    to = decisions.select("id", F.col("entity_id").alias("_to"))
    met = images.join(to, "id", "left")
    moved = F.col("_to").isNotNull() & ~F.col("_to").eqNullSafe(F.col("entity_id"))
    return met.withColumns({
        "association_status": F.when(moved, "manual").otherwise(F.col("association_status")), "match_score": F.when(~moved, F.col("match_score")),
        "entity_id": F.when(moved, F.col("_to")).otherwise(F.col("entity_id")),
    }).select(*images.columns)


def reassign(c: Corpus, decisions: DataFrame) -> Corpus:
    """:func:`apply_reassign` on a corpus: centroids of both entities are reset, counters follow."""
    moved = c.images.join(decisions.select("id", F.col("entity_id").alias("_to")), "id").filter("not (_to <=> entity_id)")
    touched = moved.select(F.explode(F.array("entity_id", "_to")).alias("id")).filter("id is not null")
    after = c.with_(images=apply_reassign(c.images, decisions), entities=reset_centroids(c.entities, touched))
    return after.with_(entities=recompute_counts(after))


def _set_status(images: DataFrame, ids: DataFrame, status: Column) -> DataFrame:
    met = images.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return met.withColumn("association_status", F.when(F.col("_hit").isNotNull(), status).otherwise(F.col("association_status"))).select(*images.columns)


def apply_flags(images: DataFrame, ids: DataFrame) -> DataFrame:
    """Flagged by a person, unless it is flagged already."""
    already = F.col("association_status").isin("flagged", "human_flagged")
    return _set_status(images, ids, F.when(already, F.col("association_status")).otherwise("human_flagged"))


def apply_confirms(images: DataFrame, ids: DataFrame) -> DataFrame:
    return _set_status(images, ids, F.lit("manual"))


def delete_images(c: Corpus, ids: DataFrame) -> Corpus:
    """Images and their faces go, counters follow."""
    gone = ids.select("id").distinct()
    after = c.with_(images=c.images.join(gone, "id", "left_anti"), faces=c.faces.join(gone.withColumnRenamed("id", "image_id"), "image_id", "left_anti"))
    return after.with_(entities=recompute_counts(after))


def erase_entities(c: Corpus, slugs: DataFrame) -> tuple[Corpus, DataFrame]:
    """Everything about the entities of ``slugs(slug)`` goes; articles stay.

    The report counts rows by table, and articles that are left without any link by the erasure.
    """
    ids = c.entities.join(slugs.select("slug").distinct(), "slug", "left_semi").select("id")
    own = ids.withColumnRenamed("id", "entity_id")
    images = c.images.join(own, "entity_id", "left_semi")
    gone = images.select(F.col("id").alias("image_id"))
    after = c.with_(
        entities=c.entities.join(ids, "id", "left_anti"), aliases=c.aliases.join(own, "entity_id", "left_anti"), links=c.links.join(own, "entity_id", "left_anti"),
        images=c.images.join(own, "entity_id", "left_anti"), faces=c.faces.join(gone, "image_id", "left_anti"))
    touched = c.links.join(own, "entity_id", "left_semi")
    orphans = touched.select("article_id").distinct().join(after.links.select("article_id"), "article_id", "left_anti")
    parts = {"entities": ids, "aliases": c.aliases.join(own, "entity_id", "left_semi"), "links": touched, "images": images, "faces": c.faces.join(gone, "image_id", "left_semi"), "orphans": orphans}
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("what"), "n") for k, df in parts.items()]
    report = counts[0]
    for x in counts[1:]:
        report = report.unionByName(x)
    return after, report


def purge_not_person(c: Corpus, ids: DataFrame) -> Corpus:
    """Children go; the row stays as a tombstone with counters at 0 and nothing else known."""
    own = ids.select(F.col("id").alias("entity_id")).distinct()
    hit = c.entities.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    dead = F.col("_hit").isNotNull()
    kept = {"id", "name", "slug", "kb_id", "first_seen", "_hit"}
    fixed = {"kb_status": F.lit("not_person"), "is_favorite": F.lit(False)} | {k: F.lit(0) for k in ("article_count", "image_count", "unique_image_count")}
    entities = hit.select(*[
        F.when(dead, fixed.get(k, F.lit(None))).otherwise(F.col(k)).cast(c.entities.schema[k].dataType).alias(k) if k not in kept else F.col(k) for k in c.entities.columns])
    gone = c.images.join(own, "entity_id", "left_semi").select(F.col("id").alias("image_id"))
    return c.with_(
        entities=entities, aliases=c.aliases.join(own, "entity_id", "left_anti"), links=c.links.join(own, "entity_id", "left_anti"),
        images=c.images.join(own, "entity_id", "left_anti"), faces=c.faces.join(gone, "image_id", "left_anti"))


def label_ids(statements: Column) -> Column:
    """Knowledge-base ids whose labels an entity needs, once each, in order of the five properties (U4)."""
    return F.array_distinct(F.flatten(F.array(*[statement_ids(statements, p) for p in (BIRTH_PLACE, DEATH_PLACE, COUNTRY, OCCUPATION, EMPLOYER)])))


def not_person(statements: Column) -> Column:
    """Types are known and none of them is a person; without types the benefit of doubt stays."""
    types = statement_ids(statements, INSTANCE_OF)
    return (F.size(types) > 0) & ~F.array_contains(types, HUMAN)


def recheck(c: Corpus, kb: DataFrame) -> Corpus:
    """Enriched entities whose types in ``kb(kb_id, statements)`` aren't people become tombstones."""
    done = c.entities.filter("kb_status = 'done' and kb_id is not null").select("id", "kb_id")
    return purge_not_person(c, done.join(kb.filter(not_person(F.col("statements"))).select("kb_id"), "kb_id", "left_semi").select("id"))


def invalid_images(images: DataFrame, manifest: DataFrame) -> DataFrame:
    """``id, reason`` of images that failed to download or to be analysed, or whose file is gone."""
    gone = missing_files(images, manifest).select("id", F.lit(True).alias("_gone"))
    reason = F.when(F.col("scrape_status") == "failed", "scrape_failed").when(F.col("analysis_status").isin("no_face", "failed"), "analysis_failed").when(F.col("_gone"), "missing_file")
    return images.join(gone, "id", "left").select("id", reason.alias("reason")).filter("reason is not null")


def purge_invalid(c: Corpus, manifest: DataFrame) -> tuple[Corpus, DataFrame]:
    bad = invalid_images(c.images, manifest)
    return delete_images(c, bad), bad.groupBy("reason").agg(F.count("*").alias("n"))


def enrich(entities: DataFrame, hits: DataFrame, statements: DataFrame, labels: DataFrame, pages: DataFrame, as_of: str, languages: tuple[str, ...] = ("fr", "en")) -> DataFrame:
    """Facts from a snapshot of the knowledge base.

    ``hits(query, lang, rank, kb_id, label)`` give an id to entities without one, in the first language that has any; a
    known id without a score gets one from its label.  Types other than people make a tombstone, which gets no facts.
    Summaries come from ``pages(title, lang, type, extract)``, by label and then by name, disambiguations aside.
    """
    rank = F.lit(len(languages))
    for i, x in enumerate(languages):
        rank = F.when(F.col("lang") == x, i).otherwise(rank)
    known = lambda df: df.filter(F.col("lang").isin(*languages))
    named = entities.withColumn("_query", F.coalesce(inverted_name(F.col("name")), F.col("name")))
    best = known(hits).groupBy(F.col("query").alias("_query")).agg(F.min_by(F.struct("kb_id", "label"), F.struct(rank, "rank")).alias("_hit"))
    by_id = known(labels).groupBy("kb_id").agg(F.min_by("label", rank).alias("_label"))
    found = named.join(best, "_query", "left").withColumn("_found", F.col("kb_id").isNull() & F.col("_hit").isNotNull())
    found = found.withColumn("kb_id", F.coalesce("kb_id", "_hit.kb_id")).join(by_id, "kb_id", "left").join(statements, "kb_id", "left")
    label = F.when(F.col("_found"), F.col("_hit.label")).when(F.col("kb_score").isNull(), F.col("_label"))
    found = found.withColumns({"_title": label, "kb_score": F.when(F.col("_found") | F.col("kb_score").isNull(), F.when(label.isNotNull(), label_score(label, F.col("_query")))).otherwise(F.col("kb_score"))})
    status = F.when(F.col("kb_id").isNull(), "not_found").when(F.coalesce(not_person(F.col("statements")), F.lit(False)), "not_person").otherwise("done")
    found = found.withColumn("kb_status", status)
    text = known(pages).filter("type <> 'disambiguation' and extract is not null").groupBy("title").agg(F.min_by("extract", rank).alias("extract"))
    found = found.join(text.toDF("_title", "_by_label"), "_title", "left").join(text.toDF("_query", "_by_name"), "_query", "left")

    def place(prop: str) -> Column:
        return F.try_element_at(statement_ids(F.col("statements"), prop), F.lit(1))

    lists = {"nationalities": COUNTRY, "occupations": OCCUPATION}
    single = {"birth_place": BIRTH_PLACE, "death_place": DEATH_PLACE, "employer": EMPLOYER}
    wanted = {k: statement_ids(F.col("statements"), p) for k, p in lists.items()} | {k: F.array_compact(F.array(place(p))) for k, p in single.items()}
    done = F.col("kb_status") == "done"
    out = found.withColumns({
        "summary": F.when(done, F.coalesce("_by_label", "_by_name", "summary")).otherwise(F.col("summary")),
        "birth_date": F.when(done, F.try_element_at(statement_dates(F.col("statements"), BIRTH), F.lit(1))),
        "death_date": F.when(done, F.try_element_at(statement_dates(F.col("statements"), DEATH), F.lit(1))),
        "kb_synced_at": F.lit(as_of).cast("timestamp_ntz"),
    })
    # The ids of all columns meet the labels at once, and come back as a column each; only people get facts.
    asked_of = F.create_map(*[x for k, ids in wanted.items() for x in (F.lit(k), F.when(done, F.coalesce(ids, F.array().cast("array<string>"))))])
    out = snapshot(out.withColumn("_wanted", asked_of))
    asked = out.select("id", F.explode("_wanted").alias("column", "kb_ids")).filter("kb_ids is not null").select(F.struct("id", "column").alias("key"), "kb_ids")
    found = resolve_labels(asked, labels, languages)
    value = lambda k: F.max(F.when(F.col("key.column") == k, F.col("labels")))
    told = found.groupBy(F.col("key.id").alias("id")).agg(*[(value(k) if k in lists else F.try_element_at(value(k), F.lit(1))).alias(f"_{k}") for k in wanted])
    before = {k: F.col(k) if k in entities.columns else F.lit(None).cast("array<string>" if k in lists else "string") for k in wanted}
    out = out.join(told.hint("merge"), "id", "left").withColumns({k: F.when(F.col("kb_status") == "done", F.col(f"_{k}")).otherwise(before[k]) for k in wanted})
    return out.select(*dict.fromkeys([*entities.columns, "birth_date", "death_date", "kb_synced_at", *wanted]))


def set_favorites(entities: DataFrame, decisions: DataFrame) -> DataFrame:
    """``decisions(id, favorite)``: setting is refused on tombstones, unsetting is not."""
    met = entities.join(decisions.select("id", F.col("favorite").alias("_to")), "id", "left")
    refused = F.col("_to").eqNullSafe(True) & F.col("kb_status").eqNullSafe("not_person")
    return met.withColumn("is_favorite", F.when(F.col("_to").isNotNull() & ~refused, F.col("_to")).otherwise(F.col("is_favorite"))).select(*entities.columns)


def cleanup_demo(c: Corpus, captions: list[str], url_pattern: str, dry_run: bool = True) -> tuple[Corpus, DataFrame]:
    """Test images go, and the articles that have only such images with their links."""
    bad = demo_rows(c.images, captions, url_pattern)
    rest = c.images.join(bad.select("id"), "id", "left_anti")
    own = bad.filter("article_id is not null").select(F.col("article_id").alias("id")).distinct().join(rest.select(F.col("article_id").alias("id")), "id", "left_anti")
    report = bad.agg(F.count("*").alias("images")).crossJoin(F.broadcast(own.agg(F.count("*").alias("articles"))))
    if dry_run:
        return c, report
    after = delete_images(c, bad.select("id"))
    after = after.with_(articles=c.articles.join(own, "id", "left_anti"), links=c.links.join(own.withColumnRenamed("id", "article_id"), "article_id", "left_anti"))
    return after.with_(entities=recompute_counts(after)), report


def mark_synced(entities: DataFrame, ids: DataFrame, at: str) -> DataFrame:
    met = entities.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return met.withColumn("last_synced_at", F.when(F.col("_hit").isNotNull(), F.lit(at).cast("timestamp_ntz")).otherwise(F.col("last_synced_at"))).select(*entities.columns)


def backfill_faces(faces: DataFrame, landmarks: DataFrame) -> DataFrame:
    """Mesh and face count where they are missing, from ``landmarks(image_id, mesh, n)``; at least one face."""
    found = landmarks.select("image_id", F.col("mesh").alias("_mesh"), F.greatest(F.lit(1), "n").cast("bigint").alias("_n"))
    return faces.join(found, "image_id", "left").withColumns({"mesh": F.coalesce("mesh", "_mesh"), "face_count": F.coalesce("face_count", "_n")}).select(*faces.columns)


def refresh_mentions(entities: DataFrame, feed: DataFrame) -> DataFrame:
    """Mention counts of ``feed(slug, mentions)`` where they are over 0."""
    new = feed.groupBy("slug").agg(F.max("mentions").alias("_new"))
    return entities.join(new, "slug", "left").withColumn("mentions", F.when(F.col("_new") > 0, F.col("_new")).otherwise(F.col("mentions"))).select(*entities.columns)
