"""The trie of conversation prefixes, with subtree totals by parallel tree contraction."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import WORD, materialize, sided

#: Rows of a part of the sorted turns, about: a long conversation spreads over several parts.
PART_ROWS = 100_000
#: Span of conversation ids that are joined to one string; the strings of a node are hashed one after another.
ID_SPAN = 4096
#: A prefix is named by sums of 32-bit hashes, which a bigint holds for two thousand million turns.
SUMS = ["s0", "s1", "s2", "s3"]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, part, pos, g1, g2, words``: turns numbered from 1 in each conversation, role and text as two hashes.

    Order is by turn, null first; equal turns by role and text.  Rows are sorted by range and cut into parts, so that a
    conversation of any length spreads over tasks: a turn's number is its number in the part and the turns of the parts
    before.  Null roles and texts become empty; rows without a conv_id belong to no conversation.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("row")]
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    parts = max(1, -(-rows.count() // PART_ROWS))
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    hashed = ordered.select(
        "conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), F.xxhash64("role", "text").alias("g1"),
        F.xxhash64("text", "role", F.lit("again")).alias("g2"), F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("words"))
    placed = materialize(hashed.withColumn("nth", F.row_number().over(W.partitionBy("conv_id", "part").orderBy("at"))))
    before = _before(placed.groupBy("conv_id", "part").agg(F.count("*").alias("n")), ["n"])
    return materialize(placed.join(before, ["conv_id", "part"], "left").select(
        "conv_id", "part", (F.col("nth") + F.coalesce("before_n", F.lit(0))).alias("pos"), "g1", "g2", "words"))


def _before(totals: DataFrame, names: list[str]) -> DataFrame:
    """Sums over the earlier parts of a conversation, for parts that have any: no more rows than there are parts."""
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    summed = totals.select("conv_id", "part", *[F.sum(k).over(earlier).alias(f"before_{k}") for k in names])
    return sided(materialize(summed.filter(f"before_{names[0]} is not null")))


def head_length(conv_id: Column) -> Column:
    """How many turns a rebuilt conversation takes from the first one of its twenty."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 4).cast("int")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations ``conv_id``, and their rebuilt turns ``conv_id, part, d, g1, g2, words``, d from 1.

    The head comes from the original turns of ``conv_id - conv_id % 20``; the rest are the conversation's own after
    as many.  Only conversations whose base is shorter than their head need its length to place the rest.
    """
    convs = materialize(turns.groupBy("conv_id").agg(F.max("pos").alias("size"), F.min("part").alias("part")))
    asked = convs.select("conv_id", "part", head_length(F.col("conv_id")).alias("h"), (F.col("conv_id") - F.col("conv_id") % 20).alias("base")).filter("h > 0")
    first = turns.filter("pos <= 3 and conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.col("pos").alias("d"), "g1", "g2", "words")
    heads = asked.hint("merge").join(first, "base").filter("d <= h").select("conv_id", "part", "d", "g1", "g2", "words")
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    short = asked.join(sizes.hint("merge"), "base", "left").filter("coalesce(base_size, 0) < h").select(F.col("conv_id").alias("its_id"), F.coalesce("base_size", F.lit(0)).alias("b"))
    own = turns.withColumn("h", head_length(F.col("conv_id"))).filter("pos > h").join(sided(materialize(short)), F.expr("conv_id = its_id"), "left")
    own = own.select("conv_id", "part", (F.col("pos") - F.col("h") + F.coalesce("b", "h")).alias("d"), "g1", "g2", "words")
    return convs.select("conv_id"), materialize(heads.unionByName(own))


def _name(d: Column, sums: list[Column]) -> list[Column]:
    return [F.xxhash64(d.cast("bigint"), *sums), F.xxhash64(F.lit("again"), d.cast("bigint"), *sums)]


def prefixes(turns: DataFrame) -> DataFrame:
    """For each rebuilt turn the 128-bit names ``k1, k2`` of the prefix that it ends and ``p1, p2`` of the one before.

    A prefix's name is a hash of its length and of sums over its turns of hashes that a turn's place is part of.
    """
    h1, h2 = F.xxhash64("d", "g1", "g2"), F.xxhash64("d", "g2", "g1", F.lit("again"))
    halves = [F.shiftrightunsigned(h1, 32), h1.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h2, 32), h2.bitwiseAND(F.lit(0xFFFFFFFF))]
    rows = turns.select("conv_id", "part", "d", "words", *[x.alias(f"f{i}") for i, x in enumerate(halves)])
    upto = W.partitionBy("conv_id", "part").orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    summed = materialize(rows.select("*", *[F.sum(f"f{i}").over(upto).alias(s) for i, s in enumerate(SUMS)]))
    before = _before(summed.groupBy("conv_id", "part").agg(*[F.sum(f"f{i}").alias(s) for i, s in enumerate(SUMS)]), SUMS)
    whole = summed.join(before, ["conv_id", "part"], "left").select(
        "conv_id", "d", "words", *[(F.col(s) + F.coalesce(f"before_{s}", F.lit(0))).alias(s) for s in SUMS], *[f"f{i}" for i in range(4)])
    here, there = _name(F.col("d"), [F.col(s) for s in SUMS]), _name(F.col("d") - 1, [F.col(s) - F.col(f"f{i}") for i, s in enumerate(SUMS)])
    return materialize(whole.select("conv_id", "d", "words", *[x.alias(k) for k, x in zip(("k1", "k2", "p1", "p2"), here + there)]))


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """``id`` and the sums of ``values`` over each node's subtree, of a forest ``nodes(id, parent, ...)``; roots' parent is null.

    Parallel tree contraction: in each round chains of nodes with one child are compressed by pointer doubling, which
    joins their bottom to what is above the chain, and then leaves are raked into their parents.  What is left has two
    children or more each, so each round leaves at most half of the nodes, and a chain of n nodes takes log n joins.  An edge
    carries what was compressed on it.  The chains are expanded in the opposite order: a node of a chain has what lies
    between it and the bottom, and the bottom's total.  Children are summed before a shuffle, so a node of
    very many costs a row a task.
    """
    live = materialize(nodes.select("id", "parent", *values, *[F.lit(0).cast("bigint").alias(f"e_{v}") for v in values]))
    chains, done = [], []
    while live.limit(1).count():
        child = F.max(F.struct("id", *[f"e_{v}" for v in values]))
        kids = live.filter("parent is not null").groupBy(F.col("parent").alias("of")).agg(F.count("*").alias("n"), child.alias("child"))
        seen = materialize(live.join(kids.hint("merge"), F.expr("id = of"), "left").withColumn("n", F.coalesce("n", F.lit(0))).drop("of"))
        rest = seen.filter("n <> 1").drop("child")
        chain = seen.filter("n = 1").select(
            "id", F.col("child.id").alias("next"), *[(F.col(v) + F.col(f"child.e_{v}")).alias(v) for v in values], "parent", *[f"e_{v}" for v in values])
        if chain.limit(1).count():
            chain = _compress(chain, values)
            chains.append(chain)
            top = F.max_by(F.struct("parent", *[(F.col(f"e_{v}") + F.col(v)).alias(f"e_{v}") for v in values]), "hops")
            tops = chain.groupBy(F.col("next").alias("bottom")).agg(top.alias("top"))
            now = lambda k: F.when(F.col("bottom").isNull(), F.col(k)).otherwise(F.col(f"top.{k}")).alias(k)
            rest = rest.join(tops.hint("merge"), F.expr("id = bottom"), "left").select("id", now("parent"), *values, *[now(f"e_{v}") for v in values], "n")
        rest = materialize(rest)
        leaves = rest.filter("n = 0")
        done.append(leaves.select("id", *values))
        raked = leaves.filter("parent is not null").groupBy(F.col("parent").alias("of")).agg(*[F.sum(F.col(v) + F.col(f"e_{v}")).alias(f"r_{v}") for v in values])
        live = rest.filter("n > 1").join(raked.hint("merge"), F.expr("id = of"), "left")
        live = materialize(live.select("id", "parent", *[(F.col(v) + F.coalesce(f"r_{v}", F.lit(0))).alias(v) for v in values], *[f"e_{v}" for v in values]))
    if not done:
        return nodes.limit(0).select("id", *values)
    found = done[-1]
    for part in done[:-1]:
        found = found.unionByName(part)
    for chain in reversed(chains):
        totals = found.select(F.col("id").alias("bottom"), *[F.col(v).alias(f"t_{v}") for v in values])
        inner = chain.join(totals.hint("merge"), F.expr("next = bottom")).select("id", *[(F.col(v) + F.col(f"t_{v}")).alias(v) for v in values])
        found = found.unionByName(materialize(inner))
    return found


def _compress(chain: DataFrame, values: list[str]) -> DataFrame:
    """``chain(id, next, values, ...)`` with ``next`` led on to the first node that isn't in it, ``values`` summed on the way, ``hops`` counted."""
    keep = [k for k in chain.columns if k not in ("id", "next", *values)]
    chain = materialize(chain.withColumn("hops", F.lit(1).cast("bigint")).withColumn("open", F.lit(True)))
    while chain.filter("open").limit(1).count():
        other = chain.select(F.col("id").alias("met"), *[F.col(k).alias(f"o_{k}") for k in ("next", "hops", "open", *values)])
        on = chain.join(other.hint("merge"), F.when(F.col("open"), F.col("next")) == F.col("met"), "left")
        chain = materialize(on.select(
            "id", F.coalesce("o_next", "next").alias("next"), *[(F.col(v) + F.coalesce(f"o_{v}", F.lit(0))).alias(v) for v in ("hops", *values)],
            F.coalesce("o_open", F.lit(False)).alias("open"), *keep))
    return chain


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined strings of each key; rows come sorted by key and span, and only one digest is open at a time."""
    def told(key, digest) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([digest.hexdigest()])], names=["k1", "k2", "ends_sha256"])

    open_key, digest = None, None
    for batch in batches:
        for k1, k2, ids in zip(*(batch.column(k).to_pylist() for k in ("k1", "k2", "ids"))):
            if (k1, k2) == open_key:
                digest.update(b"," + ids.encode())
            else:
                if digest:
                    yield told(open_key, digest)
                open_key, digest = (k1, k2), hashlib.sha256(ids.encode())
    if digest:
        yield told(open_key, digest)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all rebuilt conversations of ``conversations(conv_id, turn, role, text)``, a row for each node.

    A conversation is rebuilt as in :func:`rebuilt`.  A node is a distinct sequence of the first d rebuilt turns, told by
    roles and texts; the root has d = 0.  Conversations that begin with it are its members, and those of exactly d turns
    end in it.  Returns ``conv_id`` (the smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``: childless nodes and repeated words of the subtree, and the digest of the ids that end here.

    Null turns come first; turns that tie are ordered by role and text; repeated rows are turns like others.  Null roles and
    texts are empty.  Rows without a conv_id are left out.  An empty table has no node, not even a root.
    """
    convs, turns = rebuilt(numbered_turns(conversations))
    paths = prefixes(turns)
    root = [x.alias(k) for k, x in zip(("k1", "k2"), _name(F.lit(0), [F.lit(0).cast("bigint")] * 4))]
    none = F.lit(None).cast("bigint")

    first = F.min(F.struct("d", "p1", "p2", "words"))
    inner = paths.groupBy("k1", "k2").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), first.alias("x"))
    inner = inner.select("k1", "k2", "n_convs", "conv_id", F.col("x.d").cast("bigint").alias("depth"), "x.p1", "x.p2", "x.words")
    top = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0")
    top = top.select(*root, "n_convs", "conv_id", F.lit(0).cast("bigint").alias("depth"), none.alias("p1"), none.alias("p2"), F.lit(0).cast("bigint").alias("words"))
    nodes = materialize(inner.unionByName(top).withColumn("id", F.monotonically_increasing_id()))

    kids = nodes.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(kids.hint("merge"), ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    leaf = (F.col("n_children") == 0).cast("bigint")
    tree = materialize(nodes.join(parents.hint("merge"), ["p1", "p2"], "left").select(
        "k1", "k2", "id", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", leaf.alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")))
    sums = subtree_sums(tree, ["n_leaves", "saved_tokens"])

    last = paths.groupBy("conv_id").agg(F.max(F.struct("d", "k1", "k2")).alias("x")).select("conv_id", "x.k1", "x.k2")
    turnless = convs.join(last.hint("merge"), "conv_id", "left_anti").select("conv_id", *root)
    spans = last.unionByName(turnless).groupBy("k1", "k2", F.floor(F.col("conv_id") / ID_SPAN).alias("span")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))
    ends = spans.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "span").select("k1", "k2", "ids").mapInArrow(_hash_lists, "k1 bigint, k2 bigint, ends_sha256 string")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    known = tree.drop("n_leaves", "saved_tokens").join(sums.hint("merge"), "id").join(materialize(ends).hint("merge"), ["k1", "k2"], "left")
    return known.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))
