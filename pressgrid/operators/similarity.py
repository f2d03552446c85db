"""Hash and vector similarity within groups."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.names import fold, tokens
from ..functions.rules import FLAG, flag_hypothesis
from ..functions.vectors import cosine_distance
from ..tables import sided, snapshot
from .filters import live
from .ranks import ranked

#: Rows of a block in the all-pairs product.
BLOCK_ROWS = 2048
#: Pivots of the blocks of vectors at most.
PIVOTS = 64
#: Tokens whose hashes a worker holds at a time, about.
BATCH_TOKENS = 1 << 21
#: Hashes of a group that are folded in one task, and those that meet a block's leaders in one task.
FOLD_ITEMS, SHARE_ITEMS = 1 << 17, 1 << 15
#: Bits of a slice that tell buckets apart at most, and pairs that are compared in the time that going through buckets takes by itself.
SLICE_BITS, SLICED_PAIRS = 12, 200_000_000


def md5_64(token: Column) -> Column:
    """The first 64 bits of MD5, as other engines have them too."""
    return F.conv(F.substring(F.md5(token), 1, 16), 16, -10).cast("bigint")


def simhashes(df: DataFrame, keys: list[str], text: str, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``keys, hash64``: the 64-bit SimHash of a text's tokens; texts without a token have no row.

    Bit i is set where more token hashes have it than not: 32 sums, each of bit i and, 32 places higher, bit i + 32.  A text's sums are made in one
    step from all its tokens, and added up where several rows have the same keys.  :func:`md5_64` is taken once for each token that a batch holds.
    """
    by_word = hashed is md5_64
    sent = df.select(*keys, (spaced(F.col(text)) if by_word else F.transform(tokens(F.col(text)), lambda x: hashed(x))).alias("_tokens"))
    sums = T.StructType([*sent.schema.fields[:-1], *[T.StructField(k, T.LongType()) for k in ("_n", *[f"_b{i}" for i in range(32)])]])
    counts = sent.mapInArrow(_bit_sums(_word_hashes if by_word else _sent_hashes), sums).groupBy(*keys).agg(F.sum("_n").alias("n"), *[F.sum(f"_b{i}").alias(f"b{i}") for i in range(32)])
    ones = [F.col(f"b{i}").bitwiseAND(F.lit((1 << 32) - 1)) if i < 32 else F.shiftrightunsigned(f"b{i - 32}", 32) for i in range(64)]
    bits = [F.when(x * 2 > F.col("n"), F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("bigint") for i, x in enumerate(ones)]
    return counts.select(*keys, sum(bits[1:], bits[0]).alias("hash64"))


def spaced(text: Column) -> Column:
    """A text whose tokens are what :func:`_word_hashes` finds: plain ASCII as it is, which needs no tables of letters, else the tokens between spaces."""
    plain = F.is_valid_utf8(text) & (F.octet_length(text) == F.char_length(text))
    return F.when(plain, text).otherwise(F.regexp_replace(fold(text), r"[^\p{L}\p{N}]+", " "))


#: Each byte as a token holds it: ASCII letters in lower case, digits, a space for other ASCII; parts of other letters as they are.
_LOWER = np.array([b if b > 127 or chr(b).isalnum() and not chr(b).isupper() else b + 32 if chr(b).isupper() else 32 for b in range(256)], np.uint8)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the unsigned 64-bit ``hashes`` have each bit, in four lanes of 16 bits at a time."""
    lanes, total = np.arange(16, dtype=np.uint64)[:, None], np.zeros(64, np.int64)
    for a in range(0, len(hashes), 32768):  # what a lane holds, and few numbers at a time
        sums = ((hashes[a:a + 32768] >> lanes) & np.uint64(0x0001000100010001)).sum(1)
        total += np.concatenate([(sums >> np.uint64(16 * k)) & np.uint64(0xFFFF) for k in range(4)]).astype(np.int64)
    return total


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """:func:`md5_64` of all tokens of :func:`spaced` texts, and how many tokens each text has."""
    data = texts.buffers()[2]
    lower = np.take(_LOWER, np.frombuffer(data, np.uint8)) if data else np.empty(0, np.uint8)
    spaced_texts = pa.Array.from_buffers(texts.type, len(texts), [*texts.buffers()[:2], pa.py_buffer(lower)], offset=texts.offset)
    lists = pc.ascii_split_whitespace(spaced_texts)
    words = lists.flatten()
    real = pc.not_equal(words, "")  # a text that begins or ends with a space has an empty word there
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    sizes = np.diff(np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))[np.append(0, ends)])
    coded = words.filter(real).dictionary_encode()
    digests = b"".join([hashlib.md5(w, usedforsecurity=False).digest() for w in coded.dictionary.cast(pa.binary()).to_pylist()])
    return np.frombuffer(digests, ">u8")[::2].astype(np.uint64)[coded.indices.to_numpy()], sizes


def _sent_hashes(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return pc.fill_null(lists.flatten(), 0).to_numpy(zero_copy_only=False).view(np.uint64), sizes


def _bit_sums(hashes_of: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]):
    """``keys, n, b0 to b31`` of batches of keys and tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("_tokens")
            size = pc.binary_length(held) if pa.types.is_string(held.type) else pc.multiply(pc.list_value_length(held), 8)
            filled = np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64)) // (8 * BATCH_TOKENS)
            starts = (np.flatnonzero(np.diff(filled)) + 1).tolist()
            for a, b in zip([0, *starts], [*starts, batch.num_rows]):
                hashes, sizes = hashes_of(held.slice(a, b - a))
                keys = batch.slice(a, b - a).filter(pa.array(sizes > 0)).columns[:-1]
                sizes = sizes[sizes > 0]
                ends = np.cumsum(sizes).tolist()
                ones = np.array([bit_counts(hashes[x:y]) for x, y in zip([0, *ends], ends)], np.int64).reshape(-1, 64)
                sums = ones[:, :32] + (ones[:, 32:] << 32)
                yield pa.RecordBatch.from_arrays([*keys, pa.array(sizes, pa.int64()), *[pa.array(np.ascontiguousarray(x)) for x in sums.T]], names=[*batch.schema.names[:-1], "_n", *[f"_b{i}" for i in range(32)]])

    return run


def _bands(bits: Column, pieces: int) -> Column:
    """``pieces`` slices of the 64 bits, as even as can be."""
    edges = [64 * i // pieces for i in range(pieces + 1)]
    cuts = [F.shiftrightunsigned(bits, a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 64 else -1)) for a, b in zip(edges, edges[1:])]
    return F.array(*cuts)


def hamming_pairs(df: DataFrame, max_bits: int, group: str = "entity_id", key: str = "id", bits: str = "hash64") -> DataFrame:
    """All pairs of a group within ``max_bits``.

    Two hashes that differ in at most k bits agree on one of k + 1 slices at least, so an equality join on group,
    slice number and slice finds every pair; an exact count of the bits follows.
    """
    rows = df.filter(F.col(bits).isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(bits).alias("h"))
    cut = rows.select("g", "k", "h", F.posexplode(_bands(F.col("h"), max_bits + 1)).alias("band", "part"))
    left, right = cut.toDF("g", "a", "ha", "band", "part"), cut.toDF("g", "b", "hb", "band", "part")
    near = F.bit_count(F.col("ha").bitwiseXOR(F.col("hb")))
    met = left.hint("shuffle_hash").join(right, ["g", "band", "part"]).filter("a < b").withColumn("bits", near).filter(F.col("bits") <= max_bits)
    return met.select(F.col("g").alias(group), "a", "b", "bits").distinct()


def mark_duplicates(df: DataFrame, max_bits: int = 5, group: str = "entity_id", order: tuple[str, ...] = ("scraped_at", "id"), key: str = "id", bits: str = "hash64") -> DataFrame:
    """Each item of a group is a duplicate of the earliest earlier item that isn't one and is near enough (V2, V3).

    Fold over each group's sorted list: for groups that fit one row.  :func:`mark_duplicates_large` gives the
    same answer for groups of any size.
    """
    item = F.struct(*[F.col(x) for x in order if x != key], F.col(key).alias("k"), F.col(bits).alias("h"))
    lists = df.filter(F.col(bits).isNotNull()).groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(
        F.array().cast("array<struct<k:bigint,h:bigint>>").alias("leaders"),
        F.array().cast("array<struct<k:bigint,of:bigint>>").alias("done"))

    def step(acc: Column, x: Column) -> Column:
        near = F.filter(acc["leaders"], lambda y: F.bit_count(y["h"].bitwiseXOR(x["h"])) <= max_bits)
        of = F.try_element_at(near, F.lit(1))["k"]
        own = F.struct(x["k"].cast("bigint").alias("k"), x["h"].alias("h"))
        return F.struct(
            F.when(of.isNull(), F.array_append(acc["leaders"], own)).otherwise(acc["leaders"]).alias("leaders"),
            F.array_append(acc["done"], F.struct(x["k"].cast("bigint").alias("k"), of.alias("of"))).alias("done"))

    folded = lists.select(group, F.explode(F.aggregate("items", start, step)["done"]).alias("d"))
    return folded.select(group, F.col("d.k").alias(key), F.col("d.of").isNotNull().alias("is_duplicate"), F.col("d.of").alias("duplicate_of"))


def mark_duplicates_large(df: DataFrame, max_bits: int = 5, group: str = "entity_id", order: str = "scraped_at", key: str = "id", bits: str = "hash64") -> DataFrame:
    """:func:`mark_duplicates` for groups of any size, without making the pairs that are near (V2, V3).

    A null group is a group like others.  Equal hashes of a group are one item, its earliest: a later copy is a duplicate of the same leader, or of the
    first copy where that is one.  A group's items go in order, in blocks of ``FOLD_ITEMS``: what a leader of an earlier block is near to is struck, and the rest of
    the block is folded by itself.  So hashes are compared with leaders alone, and a task holds a block's leaders and a share of another block at most.
    """
    rows = snapshot(df.filter(F.col(bits).isNotNull()).select(F.struct(F.col(group).alias("v")).alias("g"), F.col(key).alias("id"), F.struct(F.col(order).alias("t"), F.col(key).alias("k")).alias("at"), F.col(bits).alias("hash64")))
    firsts = snapshot(rows.groupBy("g", "hash64").agg(F.min("at").alias("at")))
    groups = snapshot(firsts.select("g").distinct().withColumn("gid", F.monotonically_increasing_id()))
    numbered = ranked(firsts.join(sided(groups), "g").select("gid", "at", "hash64"), "gid", ["at"])
    placed = snapshot(numbered.select("gid", "place", F.col("at.k").cast("bigint").alias("id"), "hash64", F.floor((F.col("place") - 1) / FOLD_ITEMS).cast("int").alias("block")))
    told = _fold_blocks(placed, max_bits).join(sided(groups), "gid")
    found = told.select("g", "hash64", F.col("id").alias("first_id"), "of")
    met = rows.join(found.hint("merge"), ["g", "hash64"])
    leader = F.coalesce("of", F.when(F.col("id") != F.col("first_id"), F.col("first_id")))
    return met.select(F.col("g.v").alias(group), F.col("id").alias(key), leader.isNotNull().alias("is_duplicate"), leader.alias("duplicate_of"))


def _fold_blocks(placed: DataFrame, max_bits: int) -> DataFrame:
    """``gid, place, id, hash64, of`` of ``placed(gid, place, id, hash64, block)``: the earliest leader near each item, null for leaders."""
    sizes = snapshot(placed.groupBy("gid").agg(F.max("place").alias("n")))
    total, most = sizes.agg(F.sum("n"), F.max("n")).first()
    blocks = max(1, -(-(most or 0) // FOLD_ITEMS))
    done, leaders = [], None
    for block in range(blocks):
        rest = placed.filter(F.col("block") == block).drop("block")
        if block:
            struck = snapshot(rest.join(_struck(rest, leaders, sizes, block, max_bits), ["gid", "place"]))
            done.append(struck)
            rest = rest.join(struck.select("gid", "place").hint("merge"), ["gid", "place"], "left_anti")
        tasks = max(1, -(-(rest.count() if block else total or 0) // SHARE_ITEMS))
        told = snapshot(rest.repartition(tasks, "gid").sortWithinPartitions("gid", "place").mapInArrow(_folded(max_bits), "gid bigint, place bigint, id bigint, hash64 bigint, of bigint"))
        done.append(told)
        if block + 1 < blocks:
            goes_on = snapshot(sizes.filter(F.col("n") > (block + 1) * FOLD_ITEMS).select("gid"))
            own = snapshot(told.filter("of is null").join(sided(goes_on), "gid", "left_semi").select("gid", "place", "id", "hash64", F.lit(block).alias("led")))
            leaders = own if leaders is None else leaders.unionByName(own)
    return functools.reduce(DataFrame.unionByName, done)


def _struck(rest: DataFrame, leaders: DataFrame, sizes: DataFrame, block: int, max_bits: int) -> DataFrame:
    """``gid, place, of``: items of a block that a leader of an earlier one is near to, and the earliest such leader.

    Each share of the block meets each earlier block's leaders in one task.
    """
    left = sizes.filter(F.col("n") > block * FOLD_ITEMS).select("gid", F.ceil(F.least(F.col("n") - block * FOLD_ITEMS, F.lit(FOLD_ITEMS)) / SHARE_ITEMS).cast("int").alias("shares"))
    shares = snapshot(left)
    tasks = max(1, block * (shares.agg(F.sum("shares")).first()[0] or 0))
    share = F.floor((F.col("place") - 1) % FOLD_ITEMS / SHARE_ITEMS).cast("int")
    items = rest.select("gid", "place", "hash64", share.alias("share"), F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("led"))
    sent = leaders.join(sided(shares), "gid").select("gid", "place", "id", "hash64", "led", F.explode(F.expr("sequence(0, shares - 1)")).alias("share"))
    keys = ["gid", "led", "share"]
    met = items.repartition(tasks, *keys).groupBy(*keys).cogroup(sent.repartition(tasks, *keys).groupBy(*keys)).applyInPandas(_strikes(max_bits), "gid bigint, place bigint, leader bigint, of bigint")
    return met.groupBy("gid", "place").agg(F.min_by("of", "leader").alias("of"))


def first_near(items: np.ndarray, leaders: np.ndarray, max_bits: int) -> np.ndarray:
    """The number of the first of ``leaders`` within ``max_bits`` of each item, -1 where none is; both are unsigned 64-bit hashes.

    Two hashes that differ in at most k bits agree on one of k + 1 slices: where their buckets hold far fewer pairs than there are, only those are compared.
    """
    edges = [64 * i // (max_bits + 1) for i in range(max_bits + 2)]
    cut = lambda hashes, lo, hi: ((hashes >> np.uint64(lo)) & np.uint64((1 << min(hi - lo, SLICE_BITS)) - 1)).astype(np.int32)
    cuts = [(cut(items, lo, hi), cut(leaders, lo, hi)) for lo, hi in zip(edges, edges[1:])]
    met = sum(int(np.bincount(x, minlength=1 << SLICE_BITS) @ np.bincount(y, minlength=1 << SLICE_BITS)) for x, y in cuts)
    if 2 * met + SLICED_PAIRS < len(items) * len(leaders):
        return _near_in_slices(items, leaders, cuts, max_bits)
    of, left = np.full(len(items), -1, np.int64), np.arange(len(items))
    for a in range(0, len(leaders), 4096):
        for b in range(0, len(left), 16):
            at = left[b:b + 16]
            near = np.bitwise_count(items[at, None] ^ leaders[a:a + 4096]) <= max_bits
            hit = near.any(1)
            of[at[hit]] = a + near[hit].argmax(1)
        left = left[of[left] < 0]
    return of


def _near_in_slices(items: np.ndarray, leaders: np.ndarray, cuts: list[tuple[np.ndarray, np.ndarray]], max_bits: int) -> np.ndarray:
    of = np.full(len(items), len(leaders), np.int64)
    for own, others in cuts:
        at, by = np.argsort(own, kind="stable"), np.argsort(others, kind="stable")
        values, starts = np.unique(own[at], return_index=True)
        lows, highs = np.searchsorted(others[by], values), np.searchsorted(others[by], values, side="right")
        mine, theirs = items[at], leaders[by]
        for a, b, low, high in zip(starts.tolist(), [*starts[1:].tolist(), len(at)], lows.tolist(), highs.tolist()):
            step = max(1, 65536 // max(1, high - low))  # pairs at a time, about
            for x in range(a, b if low < high else a, step):
                near = np.bitwise_count(mine[x:min(b, x + step), None] ^ theirs[low:high]) <= max_bits
                hit = near.any(1)
                if hit.any():
                    found = at[x:min(b, x + step)][hit]
                    of[found] = np.minimum(of[found], by[low + near[hit].argmax(1)])
    return np.where(of < len(leaders), of, -1)


def fold_hashes(hashes: np.ndarray, max_bits: int) -> np.ndarray:
    """The number of the first leader near each of the ``hashes``, -1 for the leaders; each is a leader if no earlier one is near."""
    of, places, leaders, n = np.full(len(hashes), -1, np.int64), np.empty(len(hashes), np.int64), np.empty_like(hashes), 0
    for i, h in enumerate(hashes):
        near = np.bitwise_count(leaders[:n] ^ h) <= max_bits
        first = int(near.argmax()) if n else 0
        if n and near[first]:
            of[i] = places[first]
        else:
            leaders[n], places[n], n = h, i, n + 1
    return of


def _folded(max_bits: int):
    """:func:`fold_hashes` of each group of rows that come in order of ``gid`` and ``place``."""
    def told(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        gid, ids, hashes = (rows[k].to_numpy() for k in ("gid", "id", "hash64"))
        of = np.full(len(gid), -1, np.int64)
        edges = [0, *(np.flatnonzero(np.diff(gid)) + 1).tolist(), len(gid)]
        for a, b in zip(edges, edges[1:]):
            near = fold_hashes(hashes[a:b].view(np.uint64), max_bits)
            of[a:b] = np.where(near < 0, -1, near + a)
        column = pa.array(ids[of], pa.int64(), mask=of < 0)
        yield from rows.append_column("of", column).to_batches(max_chunksize=65536)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None  # rows of the group that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            gid = batch.column("gid").to_numpy()
            if held and gid[-1] != last:
                cut = int(np.searchsorted(gid, gid[-1]))
                yield from told(pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks())
                held, batch = [], batch.slice(cut)
            held.append(batch)
            last = gid[-1]
        if held:
            yield from told(pa.Table.from_batches(held).combine_chunks())

    return run


def _strikes(max_bits: int):
    def run(items: pd.DataFrame, leaders: pd.DataFrame) -> pd.DataFrame:
        leaders = leaders.sort_values("place")
        near = first_near(items["hash64"].to_numpy().view(np.uint64), leaders["hash64"].to_numpy().view(np.uint64), max_bits)
        hit, by = items[near >= 0], leaders.iloc[near[near >= 0]]
        return pd.DataFrame({"gid": hit["gid"].to_numpy(), "place": hit["place"].to_numpy(), "leader": by["place"].to_numpy(), "of": by["id"].to_numpy()})

    return run


def diversity(df: DataFrame, group: str = "entity_id", bits: str = "hash64") -> DataFrame:
    """Mean normalised distance of all pairs of a group's items, without making pairs (A19; :func:`dedup_groups` gives it the unique ones).

    Each of the 64 bits adds ones x zeros to the sum of distances.  Below two items the score is 0.
    """
    ones = [F.sum(F.getbit(F.col(bits), F.lit(i)).cast("bigint")).alias(f"b{i}") for i in range(64)]
    sums = df.filter(F.col(bits).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), *ones)
    apart = sum((F.col(f"b{i}") * (F.col("n") - F.col(f"b{i}")) for i in range(64)), F.lit(0))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return sums.select(group, "n", F.when(F.col("n") > 1, F.round(apart / (F.when(F.col("n") > 1, pairs) * 64), 4)).otherwise(0.0).alias("diversity"))


def dedup_groups(df: DataFrame, marks: DataFrame, group: str = "entity_id", key: str = "id", bits: str = "hash64") -> DataFrame:
    """What a deduplication of all groups found: ``items, uniques, duplicates`` and the diversity of the unique items.

    ``marks`` are those of :func:`mark_duplicates`.  Below two items a group has no diversity, below two unique ones it is 0.
    """
    unique = marks.filter("not is_duplicate").select(F.col(key).alias("unique_id"))
    score = diversity(df.join(unique.hint("merge"), F.expr(f"{key} = unique_id"), "left_semi"), group, bits).select(group, "diversity")
    totals = marks.groupBy(group).agg(F.count("*").alias("items"), F.count_if(~F.col("is_duplicate")).alias("uniques"), F.count_if("is_duplicate").alias("duplicates"))
    return totals.join(score.hint("merge"), group, "left").withColumn("diversity", F.when(F.col("items") > 1, F.col("diversity")))


def audit(images: DataFrame, centroids: DataFrame, limit: float = 0.55) -> DataFrame:
    """Confirms or flags each image by its distance to its own entity's centroid, decisions of people aside (V4)."""
    open_rows = images.filter("vector is not null and not coalesce(association_status in ('manual', 'human_flagged'), false)")
    scored = open_rows.join(centroids.select("entity_id", "centroid").hint("merge"), "entity_id").filter("centroid is not null")
    distance = cosine_distance(F.col("vector"), F.col("centroid"))
    return scored.select("id", "entity_id", F.round(distance, 4).alias("match_score"), F.when(distance <= limit, "confirmed").otherwise(FLAG).alias("association_status"))


def safe_auto(canonical_images: Column, duplicate_images: Column, distance: Column, max_distance: float = 0.20, max_growth: float = 1.5) -> Column:
    """Why a pair may not be merged by itself; null where it may (V6)."""
    growth = (canonical_images + duplicate_images) / F.when(canonical_images > 0, canonical_images)
    return F.when(distance > max_distance, "distance").when(growth > max_growth, "growth")


def _block_pairs(limit: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                a, b = np.array(list(r.left_vectors), float), np.array(list(r.right_vectors), float)
                far = 1 - a @ b.T
                left, right = np.asarray(r.left_ids), np.asarray(r.right_ids)
                i, j = np.nonzero(far <= limit)
                if r.left_block == r.right_block:
                    keep = left[i] < right[j]
                    i, j = i[keep], j[keep]
                yield pd.DataFrame({"a": np.minimum(left[i], right[j]), "b": np.maximum(left[i], right[j]), "distance": far[i, j]})

    return run


def _far(pivots: np.ndarray):
    """Distances of the vectors of a batch to all pivots, and the nearest one."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                v = np.array(list(f["v"]), float)
                far = np.sqrt(np.maximum((v * v).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * v @ pivots.T, 0))
                yield f.assign(cell=far.argmin(1).astype("int32"), far=list(far), norm=(v * v).sum(1))

    return run


def _pivots(rows: DataFrame, count: int) -> np.ndarray:
    """Vectors that lie far from each other, of a sample of fixed size that a hash of the id chooses."""
    held = np.array([r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(16 * count).collect()], float)
    chosen = [0]
    near = ((held - held[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(held)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((held - held[chosen[-1]]) ** 2).sum(1))
    return held[chosen]


def pivot_blocks(rows: DataFrame, blocks: int) -> DataFrame:
    """``rows(id, v)`` in blocks of about ``BLOCK_ROWS``: the cell of the nearest pivot, cut by the distance to it.

    Returns ``block, rows, low, high, norm``: the least and greatest distance of the block to each pivot, and its largest squared norm.
    """
    pivots = _pivots(rows, min(PIVOTS, blocks))
    placed = snapshot(rows.mapInPandas(_far(pivots), "id bigint, v array<double>, cell int, far array<double>, norm double").withColumn("own", F.element_at("far", F.col("cell") + 1)))
    sizes = placed.groupBy(F.col("cell").alias("c")).agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("int").alias("pieces"), F.min("own").alias("least"), F.max("own").alias("most"))
    ring = F.least(F.col("pieces") - 1, F.floor((F.col("own") - F.col("least")) / F.when(F.col("most") > F.col("least"), F.col("most") - F.col("least")) * F.col("pieces"))).cast("int")
    ringed = snapshot(placed.join(sided(snapshot(sizes)), F.expr("cell = c")).withColumn("ring", F.coalesce(ring, F.lit(0))).drop("c", "pieces", "least", "most", "own"))
    # Rings of unlike sizes are dealt once more, so that a block's size is bounded whatever the vectors are.
    again = snapshot(ringed.groupBy(F.col("cell").alias("c"), F.col("ring").alias("r")).agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("int").alias("parts")))
    dealt = ringed.join(sided(again), F.expr("cell = c and ring = r")).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    edge = lambda f: F.array(*[f(F.element_at("far", F.lit(i + 1))) for i in range(len(pivots))])
    grouped = dealt.groupBy("cell", "ring", "part").agg(F.collect_list(F.struct("id", "v")).alias("rows"), edge(F.min).alias("low"), edge(F.max).alias("high"), F.max("norm").alias("norm"))
    return snapshot(grouped.withColumn("block", F.monotonically_increasing_id()).drop("cell", "ring", "part"))


def _blocks_that_meet(blocks: DataFrame, limit: float) -> DataFrame:
    """Each two ``blocks`` (or one twice) that may hold two vectors within a cosine distance, as ``left_...`` and ``right_...`` columns.

    By the triangle inequality two vectors lie at least as far apart as their distances to any pivot differ, so their
    inner product is at most half of what their squared norms exceed that gap's square by.  The blocks were written, and each
    task reads its two shares of them: a shuffle would send a block once for each block that it meets, which grows with the square.
    """
    left, right = (blocks.select(*[F.col(k).alias(f"{side}_{k}") for k in blocks.columns]) for side in ("left", "right"))
    gap = lambda low, high: F.zip_with(low, high, lambda x, y: x - y)
    gaps = F.zip_with(gap("left_low", "right_high"), gap("right_low", "left_high"), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    dot = (F.col("left_norm") + F.col("right_norm") - F.pow(F.array_max(gaps), 2)) / 2
    return left.hint("shuffle_replicate_nl").join(right, (F.col("left_block") <= F.col("right_block")) & (1 - dot <= limit + 1e-9))


def meeting_blocks(blocks: DataFrame, limit: float) -> DataFrame:
    """``left_block, right_block``: the pairs of blocks that :func:`vector_pairs` multiplies."""
    return _blocks_that_meet(blocks.drop("rows"), limit).select("left_block", "right_block")


def vector_pairs(vectors: DataFrame, limit: float, key: str = "id", vector: str = "centroid") -> DataFrame:
    """All pairs of unit vectors within a cosine distance (J9): one matrix product for each two blocks that may meet.

    Blocks are cells around pivots, and two blocks whose distances to some pivot differ too much are never multiplied
    (:func:`meeting_blocks`).  Vectors of one block are one product.  What is shuffled and written is the vectors a few times
    and the pairs found; the products grow with the square of the vectors.
    """
    rows = snapshot(vectors.filter(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")))
    count = max(1, -(-rows.count() // BLOCK_ROWS))
    part = lambda side, k: F.transform(f"{side}_rows", lambda r: r[k])
    if count == 1:
        grouped = snapshot(rows.agg(F.collect_list(F.struct("id", "v")).alias("rows")).filter("size(rows) > 0").select(F.lit(0).alias("block"), "rows"))
        met = grouped.select(F.col("block").alias("left_block"), F.col("rows").alias("left_rows"), F.col("block").alias("right_block"), F.col("rows").alias("right_rows"))
    else:
        met = _blocks_that_meet(pivot_blocks(rows, count), limit)
    sides = [F.col("left_block"), F.col("right_block"), *[part(side, k).alias(f"{side}_{name}") for side in ("left", "right") for k, name in (("id", "ids"), ("v", "vectors"))]]
    return met.select(*sides).mapInPandas(_block_pairs(limit), "a bigint, b bigint, distance double")


def candidate_pairs(entities: DataFrame, limit: float = 0.45, least_images: int = 5, auto_distance: float = 0.20) -> DataFrame:
    """Entities whose centroids are near, both with enough images and not of one knowledge-base id (V5).

    ``entities(id, kb_id, kb_status, image_count, centroid)``; tombstones, and rows without a status, take no part.  The one
    with more images is canonical, the lower id on a tie.  Nearest pairs come first.
    """
    rows = live(entities, strict=True).filter(F.col("image_count") >= least_images)
    pairs = vector_pairs(rows, limit)
    side = snapshot(rows.select("id", "kb_id", "image_count"))
    met = pairs.join(sided(side.toDF("a", "kb_a", "images_a")), "a").join(sided(side.toDF("b", "kb_b", "images_b")), "b").filter("kb_a is null or kb_b is null or kb_a <> kb_b")
    swap = F.col("images_b") > F.col("images_a")
    c, d = F.greatest("images_a", "images_b"), F.least("images_a", "images_b")
    reason = safe_auto(c, d, F.col("distance"), auto_distance)
    return met.select(
        F.when(swap, F.col("b")).otherwise(F.col("a")).alias("canonical_id"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("duplicate_id"),
        F.round("distance", 4).alias("distance"), reason.isNull().alias("can_auto"), reason.alias("reason")).orderBy("distance", "canonical_id", "duplicate_id")


def flagged_images(wide: DataFrame, limit: int = 50) -> DataFrame:
    """Images that the audit flagged, with what may be wrong, highest score first (V7)."""
    rows = wide.filter(F.col("association_status") == FLAG).withColumn("hypothesis", flag_hypothesis(F.col("face_count")))
    return rows.orderBy(F.col("match_score").desc_nulls_last(), "id").limit(limit)
