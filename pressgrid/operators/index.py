"""A standing full-text index in segments, and top-k search that skips blocks by their bounds.

An index is a folder of Parquet tables.  A segment is written once: postings sorted by term, in blocks of documents; the
documents' lengths; and which terms each file holds.  Changed documents get tombstones for the segments before and come
back in a new segment.  A version of the manifest, one small table, says which segments and tombstones count, so a
reader sees a whole change or nothing of it.  One writer at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.names import fold, tokens
from ..tables import shared_folder, sided, snapshot
from .search import B, K1, query_terms

#: Documents of a block at most, about; a block's documents are of like length, so that bounds tell blocks apart.
BLOCK_DOCS = 1024
#: Tokens of a block at most, about: one task packs a block.
BLOCK_TOKENS = 1_000_000
#: Lengths of a block lie within this factor.
LENGTH_STEP = 1.25
#: Tokens of a file of postings, about.
FILE_TOKENS = 2_000_000
#: A row of at least so many postings goes to the files of such rows.
DENSE_POSTINGS = 32
#: Parts of a block's tombstones, by hash: a posting is looked up in one of them.
DEAD_PARTS = 64

MANIFEST = "segment string, tombstones string, docs bigint, tokens bigint"


@dataclass(frozen=True)
class Index:
    """A version of an index: folders of its segments and of its tombstones, and how many live documents and tokens it has."""

    path: str
    version: int
    segments: tuple[str, ...]
    tombstones: tuple[str, ...]
    docs: int
    tokens: int

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(*[f"{s}/{name}" for s in self.segments])


def open_index(spark: SparkSession, path: str) -> Index:
    """The newest version of the index in a folder."""
    rows = spark.read.parquet(f"{path}/manifest")
    newest = rows.filter(F.col("version") == rows.agg(F.max("version")).first()[0]).collect()  # a row for each segment and tombstone table
    first = newest[0]
    return Index(path, first["version"], tuple(sorted(r["segment"] for r in newest if r["segment"])), tuple(sorted(r["tombstones"] for r in newest if r["tombstones"])), first["docs"], first["tokens"])


def _commit(spark: SparkSession, index: Index) -> Index:
    rows = [(s, None, index.docs, index.tokens) for s in index.segments] + [(None, t, index.docs, index.tokens) for t in index.tombstones]
    spark.createDataFrame(rows or [(None, None, 0, 0)], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{index.path}/manifest/version={index.version}")
    return index


def branch(spark: SparkSession, index: Index, path: str) -> Index:
    """An index of its own in another folder, which begins with the same segments; neither sees what the other gets later."""
    return _commit(spark, replace(index, path=path, version=0))


def _name(folder: str) -> str:
    return folder.rsplit("/", 1)[-1]


def _write_terms(spark: SparkSession, folder: str) -> None:
    """Which terms each file of postings holds: a row for a file."""
    file = F.concat(F.lit(f"{folder}/postings/"), F.col("_metadata.file_name"))
    known = spark.read.parquet(f"{folder}/postings").groupBy(file.alias("file")).agg(F.min("term").alias("first_term"), F.max("term").alias("last_term"))
    known.coalesce(1).write.mode("overwrite").parquet(f"{folder}/terms")


def _write_segment(docs: DataFrame, folder: str) -> tuple[int, int]:
    """Writes ``docs(doc_id, texts)`` as a segment; returns its documents and tokens.  Ids are unique, empty documents count.

    Texts are taken apart once: their tokens are written as plain text.  A block's documents then meet in one task, which
    counts and packs its postings, and packed rows alone are sorted by range of term: rows of few postings and rows of many in
    files of their own, so that a file's bytes follow its number of rows.
    """
    spark, segment = docs.sparkSession, _name(folder)
    words = docs.select("doc_id", tokens(F.array_join(F.transform("texts", lambda t: F.coalesce(t, F.lit(""))), " ")).alias("words"))
    spelled = snapshot(words.select("doc_id", F.size("words").cast("bigint").alias("length"), F.array_join("words", " ").alias("text")))
    step = F.floor(F.log(F.col("length") + 1.0) / math.log(LENGTH_STEP)).cast("int")
    sizes = spelled.select("doc_id", "length", step.alias("step"))
    orders = sizes.groupBy("step").agg(F.count("*").alias("n"), F.sum("length").alias("sum")).collect()  # a row for each order of length
    pieces = {r["step"]: max(-(-r["n"] // BLOCK_DOCS), -(-r["sum"] // BLOCK_TOKENS)) for r in orders}
    many = F.create_map(*[F.lit(x) for k, n in pieces.items() for x in (k, n)]) if pieces else F.create_map(F.lit(0), F.lit(1))
    block = F.col("step") * 1_000_000 + F.pmod(F.xxhash64("doc_id"), F.try_element_at(many, F.col("step"))).cast("int")
    held, size = sum(r["n"] for r in orders), sum(r["sum"] for r in orders)

    met = spelled.select("doc_id", "length", "text", step.alias("step")).withColumn("block", block).drop("step").repartition(max(1, -(-size // FILE_TOKENS)), "block")
    counted = met.select("block", "doc_id", "length", F.explode(F.split("text", " ")).alias("term")).filter("term <> ''").groupBy("block", "term", "doc_id", "length").agg(F.count("*").cast("int").alias("tf"))
    lists = counted.groupBy("block", "term").agg(
        F.count("*").cast("int").alias("n"), F.max("tf").alias("max_tf"), F.min("length").alias("min_length"), F.sum("tf").alias("tokens"), F.sort_array(F.collect_list(F.struct("doc_id", "tf", "length"))).alias("p"))
    packed = snapshot(lists.select("term", F.lit(segment).alias("segment"), "block", "n", "max_tf", "min_length", "tokens", F.col("p.doc_id").alias("docs"), F.col("p.tf").alias("tfs"), F.col("p.length").alias("lengths")))
    dense = F.col("n") >= DENSE_POSTINGS
    share = packed.agg(F.coalesce(F.sum(F.when(dense, F.col("tokens"))), F.lit(0)).alias("dense")).first()["dense"]
    for mode, rows, own in (("overwrite", packed.filter(~dense), size - share), ("append", packed.filter(dense), share)):
        if own or mode == "overwrite":
            rows.repartitionByRange(max(1, -(-own // FILE_TOKENS)), "term", "block").sortWithinPartitions("term", "block").write.mode(mode).parquet(f"{folder}/postings")
    _write_terms(spark, folder)
    sizes.select("doc_id", "length", block.alias("block"), F.lit(segment).alias("segment")).write.mode("overwrite").parquet(f"{folder}/docs")
    return held, size


def create_index(docs: DataFrame, path: str) -> Index:
    """A new index of ``docs(doc_id, texts)`` in an empty folder, in one segment."""
    segment = f"{path}/segment-0"
    held, size = _write_segment(docs, segment)
    return _commit(docs.sparkSession, Index(path, 0, (segment,), (), held, size))


def refresh(index: Index, changed: DataFrame, docs: DataFrame, name: str | None = None) -> Index:
    """The index after the documents of ``changed(doc_id)`` changed, came or went; ``docs(doc_id, texts)`` has those that are there now.

    One more segment is written, and tombstones of what stood before; nothing else is touched.  Under a ``name`` that the
    index has already nothing is done, so a batch that is played again changes nothing.
    """
    spark = docs.sparkSession
    name = name or f"change-{index.version + 1}"
    segment, dead = f"{index.path}/segment-{name}", f"{index.path}/tombstones-{name}"
    if segment in index.segments:
        return index
    ids = snapshot(changed.select("doc_id").distinct())
    gone = live_docs(spark, index).join(sided(ids), "doc_id", "left_semi").select("segment", "block", "doc_id", "length")
    gone.write.mode("overwrite").parquet(dead)
    lost = spark.read.parquet(dead).agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).first()
    held, size = _write_segment(docs.join(sided(ids), "doc_id", "left_semi"), segment)
    return _commit(spark, Index(index.path, index.version + 1, (*index.segments, segment), (*index.tombstones, dead), index.docs - lost["n"] + held, index.tokens - lost["tokens"] + size))


def merge_segments(index: Index, spark: SparkSession) -> Index:
    """All live postings as one segment, without tombstones; older versions stay readable until their folders are deleted."""
    name = f"segment-merged-{index.version + 1}"
    folder = f"{index.path}/{name}"
    # Blocks keep their segment in their number's place: a merged block is one block of one old segment.
    number = {_name(s): i for i, s in enumerate(index.segments)}
    place = F.create_map(*[F.lit(x) for s, i in number.items() for x in (s, i)])
    fresh = F.try_element_at(place, F.col("segment")).cast("bigint") * 1_000_000_000 + F.col("block")
    kept = _alive(spark, index, index.table(spark, "postings")).filter("n > 0").withColumn("block", fresh).withColumn("segment", F.lit(name))
    files = max(1, -(-index.tokens // FILE_TOKENS))
    kept.repartitionByRange(files, "term", "block").sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{folder}/postings")
    _write_terms(spark, folder)
    live_docs(spark, index).withColumn("block", fresh).withColumn("segment", F.lit(name)).select("doc_id", "length", "block", "segment").write.mode("overwrite").parquet(f"{folder}/docs")
    return _commit(spark, Index(index.path, index.version + 1, (folder,), (), index.docs, index.tokens))


def index_stream(stream: DataFrame, path: str, checkpoint: str, merge_at: int = 16):
    """Keeps an index in step with a stream of ``doc_id, texts``; null texts mean that the document is gone.

    Each batch is one segment, named by its number; when there are ``merge_at`` segments they are merged.  A document that
    comes several times in a batch takes any one of its rows.
    """
    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = snapshot(batch.dropDuplicates(["doc_id"]))
        index = refresh(open_index(spark, path), rows, rows.filter("texts is not null"), f"batch-{number}")
        if len(index.segments) >= merge_at:
            merge_segments(index, spark)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _dead(spark: SparkSession, index: Index) -> DataFrame | None:
    if not index.tombstones:
        return None
    return spark.read.parquet(*index.tombstones)


def live_docs(spark: SparkSession, index: Index) -> DataFrame:
    """``doc_id, length, block, segment`` of the documents as they are now."""
    docs, dead = index.table(spark, "docs"), _dead(spark, index)
    return docs if dead is None else docs.join(sided(dead.select("segment", "doc_id")), ["segment", "doc_id"], "left_anti")


def _alive(spark: SparkSession, index: Index, rows: DataFrame) -> DataFrame:
    """Blocks of postings without the documents that have a tombstone in their segment."""
    dead = _dead(spark, index)
    if dead is None:
        return rows
    part = lambda x: F.pmod(F.hash(x), F.lit(DEAD_PARTS))
    parts = dead.groupBy("segment", "block", part("doc_id").alias("part")).agg(F.collect_set("doc_id").alias("ids"))
    held = parts.groupBy("segment", "block").agg(F.map_from_entries(F.collect_list(F.struct("part", "ids"))).alias("held"))  # no more than a block's documents
    gone = snapshot(held.select("segment", "block", F.transform(F.sequence(F.lit(0), F.lit(DEAD_PARTS - 1)), lambda i: F.try_element_at("held", i)).alias("gone")))
    lists = ["docs", "tfs", "lengths"]
    met = rows.join(sided(gone), ["segment", "block"], "left").withColumn("p", F.arrays_zip(*lists))
    kept = met.withColumn("p", F.when(F.col("gone").isNull(), F.col("p")).otherwise(F.filter("p", lambda x: ~F.coalesce(F.array_contains(F.get("gone", part(x["docs"])), x["docs"]), F.lit(False)))))
    again = {
        "n": F.size("p"), "max_tf": F.coalesce(F.array_max("p.tfs"), F.lit(0)), "min_length": F.coalesce(F.array_min("p.lengths"), F.lit(0).cast("bigint")),
        "tokens": F.aggregate("p.tfs", F.lit(0).cast("bigint"), lambda a, x: a + x), **{k: F.col(f"p.{k}") for k in lists}}
    return kept.select(*[again[k].alias(k) if k in again else F.col(k) for k in rows.columns])


def _prefixes(spark: SparkSession, query: str) -> list[str]:
    terms = query_terms(query)
    return list(spark.range(1).select(*[fold(F.lit(t)).alias(f"t{i}") for i, t in enumerate(terms)]).first()) if terms else []


def postings(spark: SparkSession, index: Index, prefixes: list[str], live: bool = True) -> DataFrame:
    """Blocks of postings whose term begins with one of the prefixes, read from those files alone that hold such terms."""
    begins = [F.startswith("term", F.lit(p)) for p in prefixes]
    holds = [(F.col("last_term") >= p) & ((F.col("first_term") <= p) | F.startswith("first_term", F.lit(p))) for p in prefixes]
    never = F.lit(False)
    files = [r["file"] for r in index.table(spark, "terms").filter(reduce(lambda a, b: a | b, holds, never)).select("file").collect()]  # files that the query reads
    found = spark.read.parquet(*files) if files else index.table(spark, "postings").limit(0)
    found = found.filter(reduce(lambda a, b: a | b, begins, never))
    return _alive(spark, index, found).filter("n > 0") if live else found


def vocabulary(spark: SparkSession, index: Index) -> DataFrame:
    """``term, n, docs``: how often each term occurs and in how many documents, from the blocks' sums alone where nothing has died."""
    rows = _alive(spark, index, index.table(spark, "postings"))
    return rows.groupBy("term").agg(F.sum("tokens").alias("n"), F.sum("n").cast("bigint").alias("docs")).filter("docs > 0")


def matches(spark: SparkSession, index: Index, query: str) -> DataFrame:
    """``doc_id, length, n0, n1, ...``: documents in which each term of the query begins some word, with how many."""
    prefixes = _prefixes(spark, query)
    rows = postings(spark, index, prefixes)
    each = rows.select("term", "segment", F.explode(F.arrays_zip("docs", "tfs", "lengths")).alias("p"))
    counts = [F.sum(F.when(F.startswith("term", F.lit(p)), F.col("p.tfs")).otherwise(0)).cast("bigint").alias(f"n{i}") for i, p in enumerate(prefixes)]
    found = each.groupBy(F.col("p.docs").alias("doc_id")).agg(F.first("p.lengths").alias("length"), *counts)
    return found.filter(" and ".join(f"n{i} > 0" for i in range(len(prefixes))) or "false")


def _weight(tf: Column, length: Column, mean: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _idf(docs: int, hits: Column) -> Column:
    return F.log(1 + (docs - hits + 0.5) / (hits + 0.5))


def full_ranking(spark: SparkSession, index: Index, query: str) -> DataFrame:
    """BM25 of every match: ``doc_id, score`` (X3), as :func:`pressgrid.operators.search.rank` has it."""
    hits = snapshot(matches(spark, index, query))
    mean = index.tokens / max(1, index.docs) or 1.0
    total = hits.count()
    terms = [k for k in hits.columns if k not in ("doc_id", "length")]
    score = sum((_idf(index.docs, F.lit(total)) * _weight(F.col(k), F.col("length"), mean) for k in terms), F.lit(0.0))
    return hits.select("doc_id", score.alias("score"))


@dataclass(frozen=True)
class Found:
    """The best hits ``doc_id, score``, how many there are in all, and how many blocks were there, scored and skipped."""

    hits: DataFrame
    total: int
    blocks: int
    scored: int

    @property
    def skipped(self) -> int:
        return self.blocks - self.scored


def top(spark: SparkSession, index: Index, query: str, limit: int = 20) -> Found:
    """The ``limit`` best of :func:`full_ranking`, ties to the smaller id, by block maxima.

    A block's bound for a prefix is the weight of the sum of its terms' highest counts at the block's least length, which no
    document of the block exceeds.  The count of hits needs the blocks' ids alone.  Blocks of the highest bounds are scored
    until they hold enough hits; then only those whose bound reaches the last score so far.
    """
    prefixes = _prefixes(spark, query)
    if not prefixes:
        return Found(spark.createDataFrame([], "doc_id bigint, score double"), 0, 0, 0)
    mean = index.tokens / max(1, index.docs) or 1.0
    rows = postings(spark, index, prefixes)
    begins = [F.startswith("term", F.lit(p)) for p in prefixes]
    ids = [F.flatten(F.collect_list(F.when(b, F.col("docs")))).alias(f"d{i}") for i, b in enumerate(begins)]
    most = [F.sum(F.when(b, F.col("max_tf")).otherwise(0)).alias(f"m{i}") for i, b in enumerate(begins)]
    met = rows.groupBy("segment", "block").agg(F.min("min_length").alias("length"), *most, *ids).filter(" and ".join(f"m{i} > 0" for i in range(len(prefixes))))
    both = reduce(F.array_intersect, [F.col(f"d{i}") for i in range(len(prefixes))]) if len(prefixes) > 1 else F.array_distinct("d0")
    bound = sum((_weight(F.col(f"m{i}"), F.col("length"), mean) for i in range(len(prefixes))), F.lit(0.0))
    blocks = snapshot(met.select("segment", "block", bound.alias("bound"), F.size(both).alias("hits")).filter("hits > 0"))
    told = blocks.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("hits"), F.lit(0)).alias("total")).first()
    idf = _idf(index.docs, F.lit(told["total"]))

    def scored(chosen: DataFrame) -> DataFrame:
        each = rows.join(sided(chosen.select("segment", "block")), ["segment", "block"], "left_semi").select("term", F.explode(F.arrays_zip("docs", "tfs", "lengths")).alias("p"))
        counts = [F.sum(F.when(b, F.col("p.tfs")).otherwise(0)).alias(f"n{i}") for i, b in enumerate(begins)]
        docs = each.groupBy(F.col("p.docs").alias("doc_id")).agg(F.first("p.lengths").alias("length"), *counts).filter(" and ".join(f"n{i} > 0" for i in range(len(prefixes))))
        score = sum((idf * _weight(F.col(f"n{i}"), F.col("length"), mean) for i in range(len(prefixes))), F.lit(0.0))
        return docs.select("doc_id", score.alias("score"), sum((_weight(F.col(f"n{i}"), F.col("length"), mean) for i in range(len(prefixes))), F.lit(0.0)).alias("weight"))

    order = [F.col("weight").desc(), "doc_id"]
    best = blocks.orderBy(F.col("bound").desc(), "segment", "block").limit(limit).collect() if limit else []  # a hit each at least, so no more blocks than hits asked for
    taken, have = [], 0
    for r in best:
        if have < limit:
            taken.append((r["segment"], r["block"]))
            have += r["hits"]
    if not taken:
        return Found(spark.createDataFrame([], "doc_id bigint, score double"), told["total"], told["blocks"], 0)
    first = snapshot(spark.createDataFrame(taken, "segment string, block bigint"))
    head = snapshot(scored(first).orderBy(*order).limit(limit))
    least = head.agg(F.min("weight").alias("w")).first()["w"] if have >= limit else 0.0
    # A bound that equals the last weight may hold a smaller id; a little below it allows for sums taken in another order.
    more = snapshot(blocks.filter(F.col("bound") >= least * (1 - 1e-9)).join(F.broadcast(first), ["segment", "block"], "left_anti"))
    extra = more.count()
    whole = head.unionByName(scored(more)) if extra else head
    return Found(whole.orderBy(*order).limit(limit).select("doc_id", "score"), told["total"], told["blocks"], len(taken) + extra)


def search_index(
    spark: SparkSession, indexes: dict[str, Index | Callable[[], Index]], query: str, scope: str = "all", limit: int = 20, shown: dict[str, DataFrame] | None = None,
    about: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Hits of each scope, best first, with the number of all its hits: ``scope, doc_id, score, total``.

    As :func:`pressgrid.operators.search.search`, over standing indexes, of which only those asked for are opened.  A scope
    that isn't known is an error.  Where ``shown`` has ids for a scope its hits and total are of those alone, so all of its
    matches are ranked.
    """
    if scope != "all" and scope not in indexes:
        raise ValueError(f"unknown scope {scope}: all, {', '.join(indexes)}")
    found = None
    for name, index in indexes.items():
        if scope not in ("all", name):
            continue
        index = index() if callable(index) else index
        if shown and name in shown:
            ranked = snapshot(full_ranking(spark, index, query).join(shown[name].select("doc_id").hint("merge"), "doc_id", "left_semi"))
            total, hits = ranked.count(), ranked.orderBy(F.col("score").desc(), "doc_id").limit(limit)
        else:
            best = top(spark, index, query, limit)
            total, hits = best.total, best.hits
        part = hits.select(F.lit(name).alias("scope"), "doc_id", "score", F.lit(total).cast("bigint").alias("total"))
        if about and name in about:
            part = part.join(about[name].hint("merge"), "doc_id", "left").select("scope", "doc_id", "score", "total", *[k for k in about[name].columns if k != "doc_id"])
        found = part if found is None else found.unionByName(part, allowMissingColumns=True)
    return found


def standing_index(docs: DataFrame, files: DataFrame, name: str) -> Index:
    """The index of ``docs`` under the session's shared folder; built where no index of these very files stands.

    ``files`` is the table that the documents come from: paths, sizes and times of its files name the index.
    """
    spark = docs.sparkSession
    told = files.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s"), F.col("_metadata.file_modification_time").cast("string").alias("t")).distinct()
    key = told.agg(F.md5(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "p", F.col("s").cast("string"), "t"))), "\n")).alias("key")).first()["key"]
    path = f"{shared_folder(spark)}/index-{name}-{key}"
    try:
        return open_index(spark, path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    return create_index(docs, path)
