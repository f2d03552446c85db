"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize, sided, slices
from .graph import connected_components

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
FINISHER = np.uint64(0xD6E8FEB86659FD93)
#: Width of the blocks of shingles for which all coordinates are made at once.
BLOCK = 1024
#: Coordinates whose lowest bits are kept to rule out pairs that only share a band.
BITS = 256


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of ``text``; with fewer words, of the whole sequence."""
    words = (text or b"").lower().split()  # for bytes, both act on ASCII alone: A-Z, and 9 to 13 with 32
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    take = min(size, len(words))
    n = len(words) - take + 1
    out = np.full(n, take, np.uint64)
    for j in range(take):
        out = (out ^ ids[j:j + n]) * MULTIPLIER
        out ^= out >> np.uint64(31)
    return np.unique(out)


def first_permutation(shingles: np.ndarray) -> np.ndarray:
    """Sigma: spreads the shingles over a circle of 2**32 places."""
    return ((shingles * FINISHER) >> np.uint64(32)).astype(np.uint32)


def second_permutation(places: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Pi: a bijection of the 2**32 places, computed in ``places`` itself."""
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        np.right_shift(places, np.uint32(shift), out=spare)
        np.bitwise_xor(places, spare, out=places)
        np.multiply(places, np.uint32(factor), out=places)
    return places


def circulant_signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """``coordinates`` minima of Pi over the places of Sigma, turned by one more place for each coordinate."""
    places = first_permutation(shingles)
    turns = np.arange(1, coordinates + 1, dtype=np.uint32)[:, None]
    least = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(places), BLOCK):
        turned = places[None, start:start + BLOCK] + turns
        np.minimum(least, second_permutation(turned, np.empty_like(turned)).min(axis=1), out=least)
    return least


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.astype(np.uint64).reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64) * FINISHER
    for j in range(rows):
        key = (key ^ parts[:, j]) * MULTIPLIER
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def lowest_bits(signature: np.ndarray) -> np.ndarray:
    """The lowest bit of every coordinate, 64 to a number: sets of similarity s agree on a share (1 + s) / 2 of them."""
    return np.packbits((signature & np.uint32(1)).astype(np.uint8)).view(np.int64)


def _sketch(size: int, bands: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("set_print", pa.binary()), ("bands", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, prints, keys, bits = [], [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                found = shingle_set(text, size)
                counts.append(len(found))
                if len(found):
                    prints.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    signature = circulant_signature(found, max(bands * rows, BITS))
                    keys.append(band_keys(signature[:bands * rows], bands, rows))
                    bits.append(lowest_bits(signature[:BITS]))
                else:
                    for out in (prints, keys, bits):
                        out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, f.type) for x, f in zip((counts, prints, keys, bits), list(schema)[2:]))], schema=schema)

    return run


def _sets(size: int):
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(x, size).view(np.int64) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], schema=schema)

    return run


#: Numbers of 64 bits in the bitmap of what a document has or lacks against its leader.
MAP_WORDS = 4


def _bitmap(array: str, name: str) -> list[Column]:
    """The hashes of an array, each as one of 64 * MAP_WORDS bits."""
    return [
        F.expr(f"aggregate({array}, 0L, (s, x) -> if(((x >> 6) & {MAP_WORDS - 1}) = {i}, s | shiftleft(1L, cast(x & 63 as int)), s))").alias(f"{name}{i}")
        for i in range(MAP_WORDS)]


def text_key(text: Column) -> Column:
    """A hash that tells texts under one doc_id apart."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _measured(pairs: DataFrame, texts: DataFrame, reps: DataFrame, size: int, maps: bool = False) -> DataFrame:
    """``pairs(a, b)`` of nodes with what their full shingle sets share: ``a, b, shared, total``, total the sum of the set sizes.

    ``maps`` adds bitmaps of what b lacks of a, and of what b has besides.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = materialize(reps.select("id", F.col("doc_id").alias("its_doc"), F.col("text_key").alias("its_key")).join(ids.hint("merge"), "id", "left_semi"))
    found = texts.join(sided(wanted), F.expr("doc_id = its_doc and text_key = its_key")).select("id", "text")
    sets = materialize(found.mapInArrow(_sets(size), "id bigint, shingles array<bigint>"))
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("right"))
    met = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    shared = F.size(F.array_intersect("left", "right"))
    counts = [shared.alias("shared"), (F.size("left") + F.size("right")).alias("total")]
    if not maps:
        return materialize(met.select("a", "b", *counts))
    apart = met.select("a", "b", *counts, F.array_except("left", "right").alias("lost"), F.array_except("right", "left").alias("more"))
    return materialize(apart.select("a", "b", "shared", "total", *_bitmap("lost", "lost"), *_bitmap("more", "more")))


def _links(measured: DataFrame, percent: int) -> DataFrame:
    near = measured.filter(F.col("shared") * 100 >= (F.col("total") - F.col("shared")) * percent)
    return near.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def bits_apart(percent: int, deviations: float = 5.0) -> int:
    """Bits of ``BITS`` by which sets of at least this similarity differ at most, but for a chance of 3e-7."""
    p = (1 - percent / 100) / 2
    return int(BITS * p + deviations * (BITS * p * (1 - p)) ** 0.5)


def _may_link(percent: int) -> Column:
    """Whether two members of a bucket can be linked, by their lowest bits and by what each shares with the leader.

    Both lack what either lacks of the leader's set, and share besides it at most what each has besides; bitmaps bound
    how much of that is not common.  No pair that reaches the similarity is ruled out by the counts.
    """
    def only(name: str, left: str, right: str) -> Column:
        return sum((F.bit_count(F.col(f"{left}{name}{i}").bitwiseAND(F.bitwise_not(F.col(f"{right}{name}{i}")))) for i in range(MAP_WORDS)), F.lit(0))

    size, own, own_more, more = F.col("inside") + F.col("lack"), F.col("my_lack"), F.col("my_n") - F.col("my_inside"), F.col("n") - F.col("inside")
    lacking = F.greatest(own + only("lost", "", "my_"), F.col("lack") + only("lost", "my_", ""))
    common = size - lacking + F.least(own_more - only("more", "my_", ""), more - only("more", "", "my_"))
    differ = sum((F.bit_count(F.col(f"bits{i}").bitwiseXOR(F.col(f"my_bits{i}"))) for i in range(BITS // 64)), F.lit(0))
    return (differ <= bits_apart(percent)) & (common * 100 >= (F.col("n") + F.col("my_n") - common) * percent)


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, bands: int = 32, rows: int = 4) -> DataFrame:
    """Near-duplicate classes of ``docs(doc_id, text)``, with other columns ignored.

    Documents with the same shingle set are one node.  A signature of ``bands * rows`` coordinates comes from two
    permutations, the second turned by one place per coordinate.  In each band's bucket every member is compared with
    the leader, the member whose buckets hold most documents: of many copies with edits, the least edited.
    A link holds if 100 * shared >= percent * union on full sets.  Members outside the leader's component are then
    compared with members of other components, unless a bound rules a link out (see :func:`_may_link`): what
    each has and lacks against the leader, or the lowest bits of 256 coordinates, which differ so much for a linked pair
    with a chance of 3e-7.  So a large group of copies, or of documents with a passage in common, costs about a
    comparison each, not one for each two.  At a similarity of 0.8 the default bands miss a pair with a chance of 5e-8.

    Returns per row ``doc_id, n_shingles, component_id, kept, text_key``: component_id is the smallest doc_id reachable.
    Null or blank text: set size 0, linked with nothing.  A null doc_id has no component and stays.  Several texts
    under one id are linked each by its own set, and text_key tells them apart; rows that repeat an id and a text share their
    result.  An empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key(F.col("text")).alias("text_key"), F.col("text").cast("string").alias("text"))
    marks = materialize(texts.mapInArrow(_sketch(shingle_words, bands, rows), "doc_id bigint, text_key bigint, n_shingles bigint, set_print binary, bands array<bigint>, bits array<bigint>"))
    named = marks.filter("set_print is not null and doc_id is not null")
    # A node is a set; its number is its place in this table, and one of its texts stands for it.
    first = named.groupBy("set_print").agg(F.min(F.struct("doc_id", "text_key")).alias("at"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    reps = materialize(first.select("set_print", "at.doc_id", "at.text_key", "n", "bands", "bits").withColumn("id", F.monotonically_increasing_id()))
    spread = reps.select("id", "n", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("held")).filter("held > 1")
    held = materialize(spread.join(shared.hint("merge"), "bucket"))
    weight = held.groupBy("id").agg(F.sum("held").alias("weight"))
    weighed = held.drop("held").join(weight.hint("merge"), "id")
    first = weighed.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("id")).alias("turned"))).alias("first"))
    members = materialize(weighed.drop("weight").join(first.select("bucket", (-F.col("first.turned")).alias("leader")).hint("merge"), "bucket"))

    stars = materialize(members.filter("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct())
    measured = _measured(stars, texts, reps, shingle_words, maps=True)
    links = materialize(_links(measured, percent))
    comps = connected_components(links)

    words = [f"{k}{i}" for k in ("lost", "more") for i in range(MAP_WORDS)]
    against = measured.groupBy(F.col("a").alias("leader"), F.col("b").alias("id")).agg(F.max("shared").alias("inside"), F.first("total").alias("total"), *[F.first(w).alias(w) for w in words])
    part = comps.select("id", F.col("component").alias("part"))
    home = comps.select(F.col("id").alias("leader"), F.col("component").alias("home"))
    placed = materialize(
        members.join(part.hint("merge"), "id", "left").join(home.hint("merge"), "leader", "left")
        .select("bucket", "leader", "id", "n", F.coalesce("part", "id").alias("part"), F.coalesce("home", "leader").alias("home")))
    mixed = placed.groupBy("bucket").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p < q").select("bucket")
    bits = reps.select("id", *[F.col("bits")[i].alias(f"bits{i}") for i in range(BITS // 64)])
    words += bits.columns[1:]
    placed = materialize(
        placed.filter("id <> leader").join(mixed.hint("merge"), "bucket", "left_semi").join(against.hint("merge"), ["leader", "id"]).join(bits.hint("merge"), "id")
        .select("bucket", "id", "n", "part", "home", "inside", (F.col("total") - F.col("n") - F.col("inside")).alias("lack"), *words))
    # Of each two members of different components, one at least is outside the leader's.
    mine = ["id", "n", "part", "inside", "lack", *words]
    strays = placed.filter("part <> home").select("bucket", *[F.col(k).alias(f"my_{k}") for k in mine])
    rest = (
        strays.hint("merge").join(placed, "bucket")
        .filter("my_part <> part").filter(_may_link(percent))
        .select(F.least("my_id", "id").alias("a"), F.greatest("my_id", "id").alias("b")).distinct()
    )
    rest = materialize(rest)
    if rest.limit(1).count():
        more = materialize(_links(_measured(rest, texts, reps, shingle_words), percent))
        if more.limit(1).count():
            comps = connected_components(links.unionByName(more))

    ids = reps.select("id", F.col("doc_id").alias("least"), "set_print").join(comps.hint("merge"), "id", "left").withColumn("class", F.coalesce("component", "id"))
    lowest = ids.groupBy(F.col("class").alias("its_class")).agg(F.min("least").alias("lowest"))
    named = ids.join(lowest.hint("merge"), F.expr("class = its_class")).select("set_print", "lowest")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("lowest", "doc_id"))
    return marks.join(named.hint("merge"), "set_print", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_key")
