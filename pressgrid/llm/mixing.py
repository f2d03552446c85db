"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import WORD, materialize, sided

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source and no document counts more often than this.
REPEATS = 3
#: Rows that a bucket of a source holds on average.
BUCKET_ROWS = 2_000
#: A slice of virtual time with no more rows than this is ordered row by row.
SLICE_ROWS = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Water filling over ``sizes(source, source_size)``, one row per source: adds ``target``.

    The sources in code point order, null last, weigh ``weights``, repeating.  They share the sum of all sizes; a
    target stops at ``repeats`` times its source's size and the excess is shared again by weight.  With sources in
    order of size by weight, the first k that stop are those for which the rest's level is not below their own.
    """
    ranked = sizes.withColumn("place", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    capped = ranked.select("source", "source_size", weight.cast("bigint").alias("weight"), "place")
    by_level = W.orderBy(F.expr(f"double(source_size * {repeats}) / weight"), "place")
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(1))
    filled = capped.withColumns({
        "stopped": F.coalesce(F.sum(F.col("source_size") * repeats).over(before), F.lit(0)),
        "weight_left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        "total": F.sum("source_size").over(everything),
    })
    level = filled.withColumn("level", (F.col("total") - F.col("stopped")).cast("double") / F.col("weight_left"))
    # The level that the sources from this one on would share; the first that it doesn't stop fixes it.
    fits = F.expr(f"level * weight <= source_size * {repeats}")
    final = F.first(F.when(fits, F.col("level")), ignorenulls=True).over(by_level.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    goal = F.least((F.col("source_size") * repeats).cast("double"), F.coalesce(final * F.col("weight"), (F.col("source_size") * repeats).cast("double")))
    return level.select("source", "source_size", "weight", goal.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: str = "mix", keep: tuple[str, ...] = ()) -> DataFrame:
    """How much of each of ``docs(doc_id, text, source)`` a mix by target weights takes.

    Documents of a source are shuffled by a hash of seed and doc_id, and queue up ``repeats`` times over.  A copy's
    virtual finish time is the words of its source up to and with it, divided by the source's target.  All
    copies are ordered by finish time over all sources, and the mix is the longest run from the start that
    stays within the sum of all sizes.  Running sums go over buckets of a source and slices of virtual time, so
    one source with most of the rows is spread over many tasks.

    Returns ``doc_id, size, source_size, target, taken`` and the columns ``keep`` of ``docs``; taken is size times the copies in the mix.  Null texts
    have size 0, and documents of size 0 are never taken.  Null is a source of its own, the last.  Rows that repeat
    a doc_id are documents of their own.  If all sizes are 0, all targets are.  An empty table gives no rows.
    """
    null_last = F.col("source").isNull()
    rows = materialize(docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("turn"), *keep,
    ))
    counts = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    targets = materialize(source_targets(counts.select("source", "source_size"), weights, repeats).join(
        counts.select(F.col("source").alias("s"), "n").hint("merge"), F.expr("source <=> s")).drop("source"))

    # A bucket is a range of the turn's first 28 bits, so that buckets follow each other in the source's order.
    buckets = F.ceil(F.col("n") / BUCKET_ROWS)
    bucket = F.floor(F.conv(F.substring("turn", 1, 7), 16, 10).cast("bigint") * buckets / (1 << 28)).cast("bigint")
    dealt = rows.join(sided(targets), F.expr("source <=> s")).withColumn("bucket", bucket).drop("s", "n", "weight")
    starts = dealt.groupBy(F.col("source").alias("s"), F.col("bucket").alias("k")).agg(F.sum("size").alias("words"))
    earlier = W.partitionBy("s").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    starts = materialize(starts.select("s", "k", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start")))
    inside = W.partitionBy("source", "bucket").orderBy("turn", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    queued = materialize(
        dealt.withColumn("inside", F.sum("size").over(inside))
        .join(sided(starts), F.expr("source <=> s and bucket = k"))
        .select("doc_id", "source", "turn", "size", "source_size", "target", (F.col("start") + F.col("inside")).alias("upto"), *keep)
    )

    def finish(epoch: Column) -> Column:
        return (F.col("upto") + epoch * F.col("source_size")).cast("double") / F.col("target")

    def order(epoch: Column) -> Column:
        return F.struct(finish(epoch).alias("finish"), null_last.alias("last"), F.coalesce("source", F.lit("")).alias("source"), "turn", "doc_id")

    copies = queued.filter("size > 0 and target > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("epoch"))
    copies = copies.select("size", order(F.col("epoch")).alias("at"), F.least(F.lit(1 << 38), F.floor(finish(F.col("epoch")) * (1 << 36))).alias("tick"))
    last = _cut(copies, queued.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    if last is None:
        times = F.lit(0)
    else:
        end = F.struct(*[F.lit(last[k]).cast(t).alias(k) for k, t in (("finish", "double"), ("last", "boolean"), ("source", "string"), ("turn", "string"), ("doc_id", docs.schema["doc_id"].dataType))])
        times = sum((F.when(order(F.lit(e)) <= end, 1).otherwise(0) for e in range(repeats)), F.lit(0))
        times = F.when((F.col("size") > 0) & (F.col("target") > 0), times).otherwise(0)
    return queued.select("doc_id", "size", "source_size", "target", (F.col("size") * times).cast("bigint").alias("taken"), *keep)


def _cut(copies: DataFrame, budget: int):
    """The last copy of ``copies(size, at, tick)`` in order of ``at`` for which the running sum is within ``budget``.

    Slices of virtual time narrow the place down, each time to one of at most 16384; only sums per slice meet in
    one task, then the rows of one slice.
    """
    inside, room, best = copies, budget, None
    for shift in (24, 12, 0):
        slices = inside.groupBy(F.shiftright("tick", shift).alias("slice")).agg(F.sum("size").alias("words"), F.max("at").alias("end"), F.count("*").alias("n"))
        ran = slices.withColumn("run", F.sum("words").over(W.orderBy("slice").rowsBetween(W.unboundedPreceding, 0)))
        found = ran.agg(
            F.max_by("end", F.when(F.col("run") <= room, F.col("slice"))).alias("end"),
            F.min_by(F.struct("slice", (F.col("run") - F.col("words")).alias("before"), "n"), F.when(F.col("run") > room, F.col("slice"))).alias("over"),
        ).first()
        best = found["end"] or best
        if found["over"] is None:
            return best
        room -= found["over"]["before"]
        inside = inside.filter(F.shiftright("tick", shift) == found["over"]["slice"])
        if found["over"]["n"] <= SLICE_ROWS:
            break
    run = inside.withColumn("run", F.sum("size").over(W.orderBy("at").rowsBetween(W.unboundedPreceding, 0)))
    return run.filter(F.col("run") <= room).agg(F.max("at")).first()[0] or best
