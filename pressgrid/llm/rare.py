"""Links that buckets' leaders leave open, found exactly by the rarest shingles of each set."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize, sided
from .graph import connected_components

#: Shingles are counted in so many slots: a bounded table, whatever the corpus.
SLOTS = 999_983
#: Numbers of 64 bits in a set's parity map.
WORDS = 16


def rarest(sets: DataFrame, percent: int) -> DataFrame:
    """``node, n, place, shingle``: the first shingles of each of ``sets(node, shingles)`` in one order of all shingles, rare ones first.

    Of n shingles the first n - ceil(n * percent / 100) + 1 are taken: two sets that reach the similarity have one of these in
    common.  The order goes by the logarithm of the counts of ``SLOTS`` slots of hashes, then by hash, and a shingle comes out as
    its place in that order: 15 bits of the one and 48 of the other.  Shingles that share a name add a comparison, and hide none.
    """
    slot = F.pmod("shingle", F.lit(SLOTS)).cast("int").alias("slot")
    each = sets.select("node", F.explode("shingles").alias("shingle"))
    counts = each.select(slot).groupBy("slot").agg(F.count("*").alias("held"))
    counts = materialize(counts.select("slot", F.shiftleft(F.least(F.log2("held") * 1000, F.lit(32767)).cast("bigint"), 48).alias("rank")))
    told = each.select("node", "shingle", slot).join(sided(counts), "slot").select("node", F.col("rank").bitwiseOR(F.shiftrightunsigned("shingle", 16)).alias("name"))
    ordered = told.groupBy("node").agg(F.sort_array(F.collect_list("name")).alias("all")).select("node", F.size("all").alias("n"), "all")
    first = ordered.select("node", "n", F.posexplode(F.slice("all", F.lit(1), F.expr(f"n - cast(ceil(n * {percent} / 100.0) as int) + 1"))).alias("place", "shingle"))
    return first.select("node", "n", (F.col("place") + 1).alias("place"), "shingle")


def parity_maps(sets: DataFrame) -> DataFrame:
    """``node, size, x0, x1, ...``: of each slot of 64 * WORDS bits, whether an odd number of the set's shingles falls into it."""
    each = sets.select("node", F.explode("shingles").alias("shingle"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("shingle").bitwiseAND(F.lit(63)).cast("int"))
    word = F.shiftright("shingle", 6).bitwiseAND(F.lit(WORDS - 1))
    return each.groupBy("node").agg(F.count("*").alias("size"), *[F.bit_xor(F.when(word == i, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"x{i}") for i in range(WORDS)])


def _not_apart(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The ``pairs(a, b)`` whose sets may reach the similarity: the bits in which maps differ are never more than the shingles that only one has."""
    left = maps.select(F.col("node").alias("a"), F.col("size").alias("my_size"), *[F.col(f"x{i}").alias(f"my_x{i}") for i in range(WORDS)])
    both = pairs.join(left.hint("merge"), "a").join(maps.withColumnRenamed("node", "b").hint("merge"), "b")
    differ = sum((F.bit_count(F.col(f"x{i}").bitwiseXOR(F.col(f"my_x{i}"))) for i in range(WORDS)), F.lit(0))
    return materialize(both.filter(differ * (100 + percent) <= (F.col("size") + F.col("my_size")) * (100 - percent)).select("a", "b"))


def _may_reach(percent: int) -> Column:
    """Whether two sets can reach the similarity, by their sizes and what follows their first shingle in common."""
    common = F.least("n", "my_n", F.col("n") - F.col("place") + 1, F.col("my_n") - F.col("my_place") + 1)
    return common * (100 + percent) >= (F.col("n") + F.col("my_n")) * percent


def _pair() -> list[Column]:
    return [F.least("my_node", "node").alias("a"), F.greatest("my_node", "node").alias("b")]


def further_links(open_nodes: DataFrame, sets: DataFrame, percent: int, links: DataFrame, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links ``a, b`` between ``open_nodes(node, weight, part)`` of different parts, besides ``links(a, b)``, by which parts are named.

    ``sets(node, shingles)`` holds the open nodes' sets.  Nodes that share one of their rarest shingles are a bucket.  Each is
    compared with its bucket's heaviest node first; then those outside that node's component with the others of other components,
    where sizes, places in the order of shingles and parity maps allow a link.  ``verify`` decides on pairs ``a, b`` by full sets.
    No pair that reaches the similarity is left out but those of one component.
    """
    maps = materialize(parity_maps(sets))
    index = materialize(rarest(sets, percent).join(open_nodes.hint("merge"), "node"))
    mixed = index.groupBy("shingle").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.max(F.struct("weight", "node", "n", "place", "part")).alias("first")).filter("p < q")
    leaders = mixed.select("shingle", *[F.col(f"first.{k}").alias(f"my_{k}") for k in ("node", "n", "place", "part")])
    held = materialize(index.drop("weight").join(leaders.hint("merge"), "shingle"))
    stars = materialize(held.filter("node <> my_node and part <> my_part").filter(_may_reach(percent)).select(*_pair()).distinct())
    found = materialize(verify(_not_apart(stars, maps, percent)))

    comps = connected_components(links.unionByName(found).toDF("src", "dst"))
    now = comps.select(F.col("id").alias("node"), F.col("component").alias("now"))
    home = comps.select(F.col("id").alias("my_node"), F.col("component").alias("home"))
    placed = held.select("shingle", "node", "n", "place", "my_node").join(now.hint("merge"), "node", "left").join(home.hint("merge"), "my_node", "left")
    placed = materialize(placed.select("shingle", "node", "n", "place", F.coalesce("now", "node").alias("part"), F.coalesce("home", "my_node").alias("home")))
    strays = placed.filter("part <> home")
    mine = strays.select("shingle", *[F.col(k).alias(f"my_{k}") for k in ("node", "n", "place", "part", "home")])
    # Two strays meet once; a stray and a node of the leader's component meet where the stray is the first of the two.
    met = mine.hint("merge").join(placed, "shingle").filter("my_part <> part and (part = home or my_node < node)").filter(_may_reach(percent))
    rest = materialize(met.select(*_pair()).distinct().join(stars.hint("merge"), ["a", "b"], "left_anti"))
    return found.unionByName(materialize(verify(_not_apart(rest, maps, percent))))
