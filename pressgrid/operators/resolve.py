"""Entity merging and splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.rules import caption_rule
from ..schema import Corpus
from ..tables import sided, snapshot
from .aggregates import recompute_counts, reset_centroids
from .components import components, in_order

#: How much a canonical entity may grow by one merge, and the least score for one.
MAX_GROWTH, LEAST_SCORE = 1.5, 1.0


def elect_canonical(entities: DataFrame, by: str = "kb_id") -> DataFrame:
    """Members of each group that shares a key, ranked: most images, longest name, earliest first_seen (null first), lowest id."""
    order = W.partitionBy(by).orderBy(F.col("image_count").desc_nulls_last(), F.char_length("name").desc(), F.col("first_seen").asc_nulls_first(), "id")
    rows = entities.filter(F.col(by).isNotNull()).withColumns({"place": F.row_number().over(order), "members": F.count("*").over(W.partitionBy(by))})
    return rows.filter("members > 1")


def _low(score: Column) -> Column:
    return score.isNull() | (score < LEAST_SCORE)


def blocked_merges(entities: DataFrame) -> DataFrame:
    """Pairs of a duplicate and its canonical that the guards refuse, each judged by itself (M7)."""
    ranked = elect_canonical(entities).select("kb_id", "id", "place", F.coalesce("image_count", F.lit(0)).alias("n"), "kb_score")
    first = ranked.filter("place = 1").select("kb_id", F.col("id").alias("canonical_id"), F.col("n").alias("canonical_n"), F.col("kb_score").alias("canonical_score"))
    pairs = ranked.filter("place > 1").withColumnRenamed("id", "duplicate_id").join(first, "kb_id")
    growth = (F.col("canonical_n") > 0) & ((F.col("canonical_n") + F.col("n")) / F.when(F.col("canonical_n") > 0, F.col("canonical_n")) > MAX_GROWTH)
    reason = F.when(growth, "growth").when(_low(F.col("canonical_score")), "canonical_score").when(_low(F.col("kb_score")), "duplicate_score")
    return pairs.select("kb_id", "canonical_id", "duplicate_id", reason.alias("reason")).filter("reason is not null")


def plan_kb_merges(entities: DataFrame) -> DataFrame:
    """Verdict on each duplicate of a knowledge-base id, the canonical growing with every merge before it (M6).

    A fold over each group's ranked list; groups are entities of one id and stay small.
    """
    ranked = elect_canonical(entities)
    item = F.struct("place", "id", F.coalesce("image_count", F.lit(0)).cast("bigint").alias("n"), "kb_score")
    lists = ranked.groupBy("kb_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    head = F.col("items")[0]
    start = F.struct(head["n"].alias("n"), F.array().cast("array<struct<duplicate_id:bigint,reason:string>>").alias("done"))

    def step(acc: Column, x: Column) -> Column:
        grown = (acc["n"] > 0) & ((acc["n"] + x["n"]) / F.when(acc["n"] > 0, acc["n"]) > MAX_GROWTH)
        reason = F.when(grown, "growth").when(_low(head["kb_score"]), "canonical_score").when(_low(x["kb_score"]), "duplicate_score")
        return F.struct(
            F.when(reason.isNull(), acc["n"] + x["n"]).otherwise(acc["n"]).alias("n"),
            F.array_append(acc["done"], F.struct(x["id"].cast("bigint").alias("duplicate_id"), reason.alias("reason"))).alias("done"))

    folded = lists.select("kb_id", head["id"].alias("canonical_id"), F.explode(F.aggregate(F.slice("items", 2, F.size("items")), start, step)["done"]).alias("d"))
    return folded.select("kb_id", "canonical_id", "d.duplicate_id", F.col("d.reason").isNull().alias("merge"), "d.reason")


def plan_centroid_merges(pairs: DataFrame, max_distance: float = 0.20) -> DataFrame:
    """Merges of near centroids in order of distance; a pair of which a member is gone is skipped (M8).

    ``pairs`` as of candidate_pairs, whose verdicts stand.  A pair is a merge for certain once no earlier open pair removes one of its two;
    rounds of all such pairs strike the later ones of what they remove, as long as a round settles a quarter of what is open.
    Where pairs wait for each other in long chains, the open rest is folded: pairs of different components of the pair graph can't meet, so
    each component is folded by itself in that order; a very large one block by block, where what is gone strikes later pairs.
    """
    order = ["distance", "canonical_id", "duplicate_id"]
    at = F.struct(*order).alias("at")
    able = snapshot(pairs.filter((F.col("distance") <= max_distance) & F.col("can_auto")).select(*order).distinct())
    merges, left = able.limit(0), able.count()
    while left:
        firsts = snapshot(able.groupBy(F.col("duplicate_id").alias("gone")).agg(F.min(at).alias("since")))
        sooner = firsts.toDF("canonical_id", "sooner")
        now = firsts.join(sooner.hint("merge"), F.col("since.canonical_id") == F.col("canonical_id"), "left").filter("sooner is null or sooner >= since")
        now = snapshot(now.select("gone", "since"))
        merges = merges.unionByName(now.select("since.*"))
        gone, before = sided(now), left
        for k in ("canonical_id", "duplicate_id"):
            able = able.join(gone, (F.col(k) == F.col("gone")) & (at >= F.col("since")), "left_anti")
        able = snapshot(able)
        left = able.count()
        if left * 4 > before * 3:
            break
    return merges.unionByName(_folded_merges(able.withColumn("at", at)) if left else able).select("canonical_id", "duplicate_id", "distance")


def _folded_merges(able: DataFrame) -> DataFrame:
    """What :func:`plan_centroid_merges` takes of the open pairs ``able(canonical_id, duplicate_id, at)``, component by component."""
    labels = components(able.select(F.col("canonical_id").alias("a"), F.col("duplicate_id").alias("b")))
    placed = able.join(labels.withColumnRenamed("id", "canonical_id").hint("merge"), "canonical_id")

    def fold(rows: DataFrame) -> DataFrame:
        lists = rows.groupBy("component").agg(F.array_sort(F.collect_list("at")).alias("pairs"))
        start = F.struct(F.array().cast("array<bigint>").alias("gone"), F.array().cast("array<struct<distance:double,canonical_id:bigint,duplicate_id:bigint>>").alias("done"))

        def step(acc: Column, p: Column) -> Column:
            own = F.struct(p["distance"].cast("double").alias("distance"), p["canonical_id"].cast("bigint").alias("canonical_id"), p["duplicate_id"].cast("bigint").alias("duplicate_id"))
            free = ~F.array_contains(acc["gone"], p["canonical_id"]) & ~F.array_contains(acc["gone"], p["duplicate_id"])
            return F.when(free, F.struct(F.array_append(acc["gone"], own["duplicate_id"]).alias("gone"), F.array_append(acc["done"], own).alias("done"))).otherwise(acc)

        return lists.select(F.explode(F.aggregate("pairs", start, step)["done"]).alias("p")).select("p.canonical_id", "p.duplicate_id", "p.distance")

    def strike(rest: DataFrame, decided: DataFrame) -> DataFrame:
        gone = decided.select(F.col("duplicate_id").alias("gone"))
        for k in ("canonical_id", "duplicate_id"):
            rest = rest.join(gone.hint("merge"), F.col(k) == F.col("gone"), "left_anti")
        return rest

    return in_order(placed, fold, strike)


def resolve_chains(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``duplicate_id, canonical_id`` with chains followed to their end, by pointer doubling."""
    now = snapshot(edges.select("duplicate_id", "canonical_id").filter("duplicate_id <> canonical_id").dropDuplicates(["duplicate_id"]))
    for _ in range(max_rounds):
        on = now.select(F.col("duplicate_id").alias("canonical_id"), F.col("canonical_id").alias("further"))
        after = snapshot(now.join(on, "canonical_id", "left").select("duplicate_id", F.coalesce("further", "canonical_id").alias("canonical_id"), F.col("further").isNotNull().alias("moved")))
        now = after.select("duplicate_id", "canonical_id")
        if not after.filter("moved").limit(1).count():
            return now
    raise ValueError("the merges form a ring")


def _moved(df: DataFrame, edges: DataFrame, key: str = "entity_id") -> DataFrame:
    """``df`` with the key of duplicates turned into their canonical's."""
    own = edges.select(F.col("duplicate_id").alias(key), F.col("canonical_id").alias("_to"))
    return df.join(own, key, "left").withColumn(key, F.coalesce("_to", key)).drop("_to").select(*df.columns)


def merged_links(links: DataFrame, edges: DataFrame) -> DataFrame:
    """Links of duplicates move; those that the canonical has already collapse."""
    return _moved(links, edges).dropDuplicates(["article_id", "entity_id"])


def merged_aliases(aliases: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """The duplicate's aliases and its old name become the canonical's, once each."""
    names = edges.join(entities.select(F.col("id").alias("duplicate_id"), "name"), "duplicate_id")
    added = names.select(F.lit(None).cast("bigint").alias("id"), F.col("canonical_id").alias("entity_id"), F.col("name").alias("alias"), F.lit("merge").alias("source"))
    rows = _moved(aliases, edges).select("id", "entity_id", "alias", "source").unionByName(added)
    order = W.partitionBy("entity_id", "alias").orderBy(F.col("id").asc_nulls_last(), "source")
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def apply_merges(c: Corpus, edges: DataFrame) -> Corpus:
    """Merges duplicates into canonicals: images, links, aliases, fresh counters, centroids reset, duplicates gone (M5).

    Edges of one id with itself, or with an id that isn't there, do nothing.
    """
    known = c.entities.select("id")
    valid = edges.join(known.toDF("duplicate_id"), "duplicate_id", "left_semi").join(known.toDF("canonical_id"), "canonical_id", "left_semi")
    flat = resolve_chains(valid)
    left = c.entities.join(flat.select(F.col("duplicate_id").alias("id")), "id", "left_anti")
    left = reset_centroids(left, flat.select(F.col("canonical_id").alias("id")))
    after = c.with_(entities=left, aliases=merged_aliases(c.aliases, c.entities, flat), links=merged_links(c.links, flat), images=_moved(c.images, flat))
    return after.with_(entities=recompute_counts(after))


def merge_refusals(requests: DataFrame, entities: DataFrame) -> DataFrame:
    """Why a merge that a person asks for is refused; null where it isn't (M9)."""
    e = entities.select("id", F.col("kb_status").eqNullSafe("not_person").alias("dead"))
    met = requests.join(e.toDF("canonical_id", "dead_a"), "canonical_id", "left").join(e.toDF("duplicate_id", "dead_b"), "duplicate_id", "left")
    reason = F.when(F.col("canonical_id") == F.col("duplicate_id"), "same").when(F.col("dead_a").isNull() | F.col("dead_b").isNull(), "unknown").when(F.col("dead_a") | F.col("dead_b"), "tombstone")
    return met.select("canonical_id", "duplicate_id", reason.alias("refusal"))


def merge_manual(c: Corpus, requests: DataFrame) -> tuple[Corpus, DataFrame]:
    """Applies the merges ``requests(canonical_id, duplicate_id)`` that aren't refused; and what was said to each (M9)."""
    said = snapshot(merge_refusals(requests, c.entities))
    return apply_merges(c, said.filter("refusal is null").select("canonical_id", "duplicate_id")), said


def split_images(images: DataFrame, source_id: int, rules: list[tuple[int, list[str], list[str]]], names: list[list[str]]) -> DataFrame:
    """Where each image of a wrongly merged entity goes: ``id, target_id, ambiguous`` (first step of M19).

    ``rules`` are (entity, wanted, unwanted) in order, the first that fits counts.  An image that none takes
    is ambiguous if its caption has words of two of the ``names`` lists or more.
    """
    target = F.lit(None).cast("bigint")
    for entity, wanted, unwanted in reversed(rules):
        target = F.when(caption_rule(F.col("caption"), wanted, unwanted), F.lit(entity)).otherwise(target)
    mentions = sum((caption_rule(F.col("caption"), words).cast("int") for words in names), F.lit(0))
    return images.filter(F.col("entity_id") == source_id).select("id", target.alias("target_id"), (target.isNull() & (mentions >= 2)).alias("ambiguous"))


def split_entity(c: Corpus, source_id: int, rules: list[tuple[int, list[str], list[str]]], names: list[list[str]], moved_aliases: dict[str, int] | None = None) -> Corpus:
    """Undoes a wrong merge: captions route images, ambiguous ones are flagged, links follow the images, aliases move."""
    routes = snapshot(split_images(c.images, source_id, rules, names))
    images = c.images.join(routes, "id", "left").withColumns({
        "entity_id": F.coalesce("target_id", "entity_id"),
        "association_status": F.when(F.coalesce("ambiguous", F.lit(False)), "flagged").otherwise(F.col("association_status")),
    }).select(*c.images.columns)
    added = routes.filter("target_id is not null").join(c.images.select("id", "article_id"), "id").filter("article_id is not null").select("article_id", F.col("target_id").alias("entity_id"))
    links = c.links.unionByName(added, allowMissingColumns=True).dropDuplicates(["article_id", "entity_id"])
    owner = F.col("entity_id")
    for alias, entity in (moved_aliases or {}).items():
        owner = F.when((F.col("entity_id") == source_id) & (F.col("alias") == alias), F.lit(entity)).otherwise(owner)
    aliases = c.aliases.withColumn("entity_id", owner).dropDuplicates(["entity_id", "alias"])
    touched = routes.select(F.col("target_id").alias("id")).filter("id is not null").unionByName(c.entities.select("id").filter(F.col("id") == source_id))
    after = c.with_(images=images, links=links, aliases=aliases, entities=reset_centroids(c.entities, touched))
    return after.with_(entities=recompute_counts(after))
