"""Full-text search over postings: prefix-AND match, BM25 order, snippets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import fold, tokens
from ..schema import Corpus
from ..tables import sided, snapshot
from .filters import live
from .pages import with_total

K1, B = 1.2, 0.75


def documents(table: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """Search documents: ``doc_id`` and an array of texts; lists' pipes become blanks, null an empty text."""
    return table.select(F.col(key).alias("doc_id"), F.array(*[F.translate(F.coalesce(F.col(c).cast("string"), F.lit("")), "|", " ") for c in columns]).alias("texts"))


def build_index(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings ``term, doc_id, col, pos`` and sizes ``doc_id, length`` (X1); words are written once for both."""
    cells = docs.select("doc_id", F.posexplode("texts").alias("col", "text"))
    words = snapshot(cells.select("doc_id", "col", tokens(F.col("text")).alias("words")))
    postings = words.select("doc_id", "col", F.posexplode("words").alias("pos", "term"))
    lengths = words.groupBy("doc_id").agg(F.sum(F.size("words")).alias("length"))
    return postings.select("term", "doc_id", "col", "pos"), lengths


def query_terms(query: str) -> list[str]:
    """Parts between blanks, without what isn't a letter or digit; empty parts drop."""
    return [t for t in (re.sub(r"[^\w]|_", "", x) for x in query.split()) if t]


def match(postings: DataFrame, query: str) -> DataFrame:
    """Documents in which every term begins some word of any column: ``doc_id, term_no, tf`` for each term.

    A term is a range of the term column, so sorted postings prune by file statistics.
    """
    terms = query_terms(query)
    if not terms:
        return postings.limit(0).select("doc_id", F.lit(0).alias("term_no"), F.lit(0).cast("bigint").alias("tf"))
    spark = postings.sparkSession
    prefixes = spark.range(1).select(*[fold(F.lit(t)).alias(f"t{i}") for i, t in enumerate(terms)]).first()
    begins = [F.startswith("term", F.lit(p)) for p in prefixes]
    some = begins[0]
    for test in begins[1:]:
        some = some | test
    # One scan for all terms: each document counts the words that each term begins.
    counts = postings.filter(some).groupBy("doc_id").agg(*[F.count_if(test).alias(f"n{i}") for i, test in enumerate(begins)])
    whole = counts.filter(" and ".join(f"n{i} > 0" for i in range(len(terms))))
    return whole.select("doc_id", F.posexplode(F.array(*[f"n{i}" for i in range(len(terms))])).alias("term_no", "tf"))


def rank(hits: DataFrame, lengths: DataFrame) -> DataFrame:
    """BM25 over all columns together: ``doc_id, score``; statistics take in every document.

    The hits are written once: their document frequencies and their scores both come from there.
    """
    hits, lengths = snapshot(hits), snapshot(lengths)
    stats = lengths.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
    df = hits.groupBy("term_no").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    rows = hits.join(F.broadcast(df), "term_no").join(lengths.hint("merge"), "doc_id").crossJoin(F.broadcast(stats))
    return rows.groupBy("doc_id").agg(F.sum(idf * weight).alias("score"))


def _bind(value: Column, then) -> Column:
    """``then(value)`` with the value computed once: inside ``then`` it is a lambda's variable."""
    return F.transform(F.array(value), then)[0]


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _best_window(words: Column, prefixes: list[Column], size: int) -> Column:
    """``struct(score, snippet)`` of the window of ``size`` of the words that says most; null without hits.

    A window may begin at any hit.  It counts 1000 for each different term of the query in it, and 1 for each further hit;
    the earliest of the best is taken, and moved back so that its hits stand in the middle.
    """
    def mask(w: Column) -> Column:
        return _bind(tokens(w), lambda ts: sum((F.when(F.exists(ts, lambda x: F.startswith(x, p)), 1 << i).otherwise(0) for i, p in enumerate(prefixes)), F.lit(0)))

    def rated(h: Column, i: Column, hits: Column) -> Column:
        def of(near: Column) -> Column:
            some = F.aggregate(near, F.lit(0), lambda acc, x: acc.bitwiseOR(x["terms"]))
            score = F.bit_count(some) * 999 + F.aggregate(near, F.lit(0), lambda acc, x: acc + F.bit_count(x["terms"]))
            return F.struct((-score).alias("score"), h["at"].alias("first"), F.element_at(near, -1)["at"].alias("last"))

        return _bind(F.filter(F.slice(hits, i + 1, F.lit(size)), lambda x: x["at"] < h["at"] + size), of)  # no window holds more hits than words

    def shown(best: Column, hits: Column) -> Column:
        n = F.size(words)
        middle = best["first"] - F.floor((size - (best["last"] - best["first"])) / F.lit(2)).cast("int")
        return _bind(F.greatest(F.lit(0), F.least(middle, n - size)), lambda start: F.struct((-best["score"]).alias("score"), F.concat(
            F.when(start > 0, "…").otherwise(""),
            F.array_join(F.transform(F.slice(words, start + 1, F.lit(size)), lambda w: F.when(mask(w) > 0, F.concat(F.lit("<mark>"), w, F.lit("</mark>"))).otherwise(w)), " "),
            F.when(n > start + size, "…").otherwise("")).alias("snippet")))

    found = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("at"), mask(w).alias("terms"))), lambda h: h["terms"] > 0)
    return _bind(found, lambda hits: F.when(F.size(hits) > 0, _bind(F.array_min(F.transform(hits, lambda h, i: rated(h, i, hits))), lambda best: shown(best, hits))))


def snippet(text: Column, query: str, size: int = 12) -> Column:
    """The window of ``size`` words that has most of the query's terms, hits marked, with an ellipsis where text is cut.

    A text without hits gives its beginning; a query without terms, or a null text, gives null.
    """
    prefixes = [fold(F.lit(t)) for t in query_terms(query)]
    if not prefixes:
        return F.lit(None).cast("string")
    head = lambda words: F.concat(F.array_join(F.slice(words, 1, F.lit(size)), " "), F.when(F.size(words) > size, "…").otherwise(""))
    return _bind(_words(text), lambda words: F.coalesce(_best_window(words, prefixes, size)["snippet"], head(words)))


def best_snippet(texts: Column, query: str, size: int = 12) -> Column:
    """The best :func:`snippet` over an array of columns' texts, the first of those that say as much; null without hits."""
    prefixes = [fold(F.lit(t)) for t in query_terms(query)]
    if not prefixes:
        return F.lit(None).cast("string")

    def rated(text: Column, i: Column) -> Column:
        return _bind(_best_window(_words(text), prefixes, size), lambda b: F.struct((-F.coalesce(b["score"], F.lit(0))).alias("score"), i.alias("i"), b["snippet"].alias("snippet")))

    return F.array_min(F.transform(texts, rated))["snippet"]


def search(
    scopes: dict[str, tuple[DataFrame, DataFrame]], query: str, scope: str = "all", limit: int = 20,
    shown: dict[str, DataFrame] | None = None, about: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Hits of each scope, best first, at most ``limit`` each, with the number of all its hits.

    ``scopes`` maps a name to postings and lengths.  Where ``shown`` has ids ``doc_id`` for a scope, hits and total are
    of those alone, such as entities that aren't tombstones; the statistics take in all.  Where ``about`` has
    ``doc_id, entity_id, name, texts`` for a scope, a hit carries its entity and a snippet.  Ties go to the smaller id.
    A scope that isn't known is an error.
    """
    if scope != "all" and scope not in scopes:
        raise ValueError(f"unknown scope {scope}: all, {', '.join(scopes)}")
    found = None
    for name, (postings, lengths) in scopes.items():
        if scope not in ("all", name):
            continue
        scored = rank(match(postings, query), lengths)
        if shown and name in shown:
            scored = scored.join(shown[name].select("doc_id").hint("merge"), "doc_id", "left_semi")
        scored = snapshot(scored)
        top = with_total(scored.orderBy(F.col("score").desc(), "doc_id").limit(limit), scored).select(F.lit(name).alias("scope"), "doc_id", "score", "total")
        if about:
            known = about.get(name)
            if known is None:
                top = top.withColumns({"entity_id": F.lit(None).cast("bigint"), "name": F.lit(None).cast("string"), "snippet": F.lit(None).cast("string")})
            else:
                top = snapshot(top)
                few = known.join(sided(top.select("doc_id")), "doc_id", "left_semi")
                top = top.join(few.hint("merge"), "doc_id", "left").withColumn("snippet", best_snippet(F.col("texts"), query)).drop("texts")
            top = top.select("scope", "doc_id", "score", "total", "entity_id", "name", "snippet")
        found = top if found is None else found.unionByName(top)
    return found


def global_search(c: Corpus, query: str, scope: str = "all", limit: int = 20) -> DataFrame:
    """Search over entities, articles and images of a corpus, each hit with its entity and a snippet.

    Tombstones are neither hits nor in the total.  An article's entity is that with the lowest id.  What is searched of a table
    is written once: postings, lengths and hits' texts come from there.
    """
    def has(df: DataFrame, *names: str) -> list[str]:
        return [k for k in names if k in df.columns]

    aliases = c.aliases.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_list("alias")), " ").alias("alias_text"))
    entities = c.entities.join(aliases.hint("merge"), F.expr("id = entity_id"), "left").drop("entity_id")
    columns = {"entities": has(entities, "name", "alias_text", "summary", "birth_place", "death_place", "occupations", "employer"), "articles": has(c.articles, "title", "domain"), "images": has(c.images, "caption", "alt_text", "copyright")}
    tables = {"entities": entities.select("id", *columns["entities"]), "articles": c.articles.select("id", *columns["articles"]), "images": c.images.select("id", "entity_id", *columns["images"])}
    if scope != "all" and scope not in tables:
        raise ValueError(f"unknown scope {scope}: all, {', '.join(tables)}")
    who = c.entities.select(F.col("id").alias("entity_id"), "name")
    tables = {k: snapshot(df) for k, df in tables.items() if scope in ("all", k)}
    owner = {"entities": lambda: c.entities.select(F.col("id").alias("doc_id"), F.col("id").alias("entity_id")), "articles": lambda: c.links.groupBy(F.col("article_id").alias("doc_id")).agg(F.min("entity_id").alias("entity_id")), "images": lambda: tables["images"].select(F.col("id").alias("doc_id"), "entity_id")}
    docs = {k: documents(df, columns[k]) for k, df in tables.items()}
    scopes = {k: build_index(df) for k, df in docs.items()}
    about = {k: df.select("doc_id", "texts").join(owner[k]().hint("merge"), "doc_id", "left").join(who.hint("merge"), "entity_id", "left") for k, df in docs.items()}
    return search(scopes, query, scope, limit, {"entities": live(c.entities).select(F.col("id").alias("doc_id"))}, about)


def search_entities(entities: DataFrame, postings: DataFrame, lengths: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Live entities by relevance; tombstones drop after the match, so statistics include them."""
    scored = rank(match(postings, query), lengths).withColumnRenamed("doc_id", "id")
    return live(entities).join(scored, "id").select("id", "name", "score").orderBy(F.col("score").desc(), "id").limit(limit)


def refresh_index(postings: DataFrame, lengths: DataFrame, changed: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index after the documents of ``changed(doc_id)`` changed, came or went; ``docs`` has all as they are now."""
    ids = changed.select("doc_id").distinct()
    new_postings, new_lengths = build_index(docs.join(ids, "doc_id", "left_semi"))
    return postings.join(ids.hint("merge"), "doc_id", "left_anti").unionByName(new_postings), lengths.join(ids.hint("merge"), "doc_id", "left_anti").unionByName(new_lengths)
