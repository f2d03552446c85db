"""Hard negatives by best-first search in R-trees packed by sort-tile-recursive."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import materialize, sided
from .topk import quantized

#: Rows of a tile, which is one tree, and anchors that a tree is asked for at a time, about.  Both sides of a pair of
#: blocks are then alike in size, so neither is copied much more often than the other.
TILE_ROWS, ANCHOR_BLOCK = 8192, 4096
#: Rows of a leaf, and boxes below a box.
LEAF, FANOUT = 32, 8
#: Integers whose products over a vector floating-point numbers hold exactly.
EXACT = 1 << 22


def labelled(embeddings: DataFrame, relabel_every: int = 7, labels: int = 10) -> DataFrame:
    """``vec_id, label, weights`` of the rows that take part; labels of each ``relabel_every``-th vec_id move on by one."""
    moved = F.when(F.col("vec_id") % relabel_every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    rows = embeddings.filter("label is not null and vec_id is not null").select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", moved.cast("bigint").alias("label"))
    return quantized(rows, keep=("label",))


def tiles(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` with a ``tile``: slabs of about equal size by label, cut by the coordinate that spreads most; and how many.

    The top of the packing: slab and tile borders are approximate quantiles of all rows.  Rows that tie on them, such as
    copies of one vector, share a tile, and tiles that are too large are dealt out by a hash of the row's place.
    """
    count = rows.count()
    slabs = max(1, round((count / TILE_ROWS) ** 0.5))
    each = max(1, -(-count // (TILE_ROWS * slabs)))
    even = lambda n: F.array(*[F.lit(i / n) for i in range(1, n)])
    length = rows.agg(F.max(F.size("weights"))).first()[0] or 0
    at = F.lit(0)
    if length:
        spread = rows.agg(*[F.coalesce(F.stddev_pop(F.try_element_at("weights", F.lit(i + 1)).cast("double")), F.lit(0.0)).alias(f"c{i}") for i in range(length)]).first()
        at = F.coalesce(F.try_element_at("weights", F.lit(1 + int(np.argmax(spread)))), F.lit(0).cast("bigint"))
    keyed = rows.withColumns({"at": at, "row": F.monotonically_increasing_id()})
    borders = rows.agg(F.percentile_approx("label", even(slabs))).first()[0] if slabs > 1 else None  # as many as slabs, the root of the tiles
    slab = F.size(F.filter(F.lit(borders), lambda x: x < F.col("label"))) if borders else F.lit(0)
    keyed = keyed.withColumn("slab", slab)
    if each > 1:
        cuts = materialize(keyed.groupBy(F.col("slab").alias("s")).agg(F.percentile_approx("at", even(each)).alias("cuts")))  # a row for each slab
        keyed = keyed.join(sided(cuts), F.expr("slab = s")).withColumn("tile", F.col("slab") * each + F.size(F.filter("cuts", lambda x: x < F.col("at"))))
    else:
        keyed = keyed.withColumn("tile", F.col("slab"))
    keyed = materialize(keyed.select("vec_id", "label", "weights", "tile", "row"))
    sizes = keyed.groupBy(F.col("tile").alias("t")).agg(F.ceil(F.count("*") / F.lit(2 * TILE_ROWS)).alias("pieces"))
    first = W.orderBy("t").rowsBetween(W.unboundedPreceding, -1)
    numbered = materialize(sizes.select("t", "pieces", F.coalesce(F.sum("pieces").over(first), F.lit(0)).alias("first")))  # a row for each tile
    total = numbered.agg(F.sum("pieces")).first()[0] or 0
    dealt = keyed.join(sided(numbered), F.expr("tile = t"))
    return materialize(dealt.select("vec_id", "label", "weights", (F.col("first") + F.pmod(F.xxhash64("row"), F.col("pieces"))).cast("int").alias("tile"))), int(total)


def _matrix(lists, width: int) -> np.ndarray:
    """Vectors as rows; components that a shorter one lacks are 0.  Numbers too large for exact floating point stay integers."""
    out = np.zeros((len(lists), width), np.int64)
    for i, x in enumerate(lists):
        out[i, :len(x)] = x
    return out


class Tree:
    """An R-tree over rows ``ids, labels, vectors``, packed bottom-up: every level is the one below, in runs of equal length."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = self._tiled(labels, vectors)
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        starts = np.arange(0, len(ids), LEAF)
        take = lambda f, x: f.reduceat(x, starts, axis=0)
        low, high, first, last = (take(f, x) for x in (self.vectors, self.labels) for f in (np.minimum, np.maximum))
        self.levels = [(low, high, first, last)]  # boxes, and the intervals of their labels, from the leaves up
        while len(self.levels[-1][0]) > 1:
            starts = np.arange(0, len(self.levels[-1][0]), FANOUT)
            low, high, first, last = self.levels[-1]
            self.levels.append((take(np.minimum, low), take(np.maximum, high), take(np.minimum, first), take(np.maximum, last)))

    @staticmethod
    def _tiled(labels: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """Sort-tile-recursive order: by label, then slabs along the coordinates that spread most, down to leaves."""
        order = np.argsort(labels, kind="stable")
        edges = np.flatnonzero(np.diff(labels[order])) + 1
        axes = np.argsort(-vectors.std(axis=0), kind="stable")[:8] if len(vectors) else []
        runs = np.split(order, edges)
        for axis in axes:
            cut = []
            for run in runs:
                if len(run) > LEAF:
                    run = run[np.argsort(vectors[run, axis], kind="stable")]
                    half = LEAF * max(1, round(len(run) / (2 * LEAF)))
                    cut += [run[:half], run[half:]]
                else:
                    cut.append(run)
            runs = cut
        return np.concatenate(runs) if runs else order

    def bounds(self, queries: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each level, the least and the highest inner product that a row of each box can have with each query."""
        plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
        return [(plus @ low.T + minus @ high.T, plus @ high.T + minus @ low.T) for low, high, _, _ in self.levels]

    def search(self, query: np.ndarray, bounds, label: int, anchor: int, same: bool, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (least, highest score) the ``k`` best rows of the label, or of any other, that lie in it.

        A queue gives the box with the highest bound first.  A box is left out if its interval meets no window or lies
        strictly below what the window's kth row has; boxes that tie with it stay, since a smaller id may be inside.
        """
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
        least = [low for low, _ in windows]  # what a row needs now

        def wanted(level: int, box: int) -> bool:
            low, high = bounds[level][0][box], bounds[level][1][box]
            first, last = self.levels[level][2][box], self.levels[level][3][box]
            if (same and not first <= label <= last) or (not same and first == last == label):
                return False
            return any(high >= need and low <= top for need, (_, top) in zip(least, windows))

        top = len(self.levels) - 1
        queue = [(-bounds[top][1][0], top, 0)]
        while queue:
            bound, level, box = heapq.heappop(queue)
            if -bound < min(least):
                break
            if not wanted(level, box):
                continue
            if level:
                for child in range(box * FANOUT, min((box + 1) * FANOUT, len(self.levels[level - 1][0]))):
                    if wanted(level - 1, child):
                        heapq.heappush(queue, (-bounds[level - 1][1][child], level - 1, child))
                continue
            part = slice(box * LEAF, (box + 1) * LEAF)
            ids, labels = self.ids[part], self.labels[part]
            some = (labels == label) & (ids != anchor) if same else labels != label
            if not some.any():
                continue
            scores, ids = (self.vectors[part][some] @ query).astype(np.int64), ids[some]
            for w, (low, high) in enumerate(windows):
                good = (scores >= least[w]) & (scores <= high)
                if good.any():
                    s, i = np.concatenate([best[w][0], scores[good]]), np.concatenate([best[w][1], ids[good]])
                    order = np.lexsort((i, -s))[:k]
                    best[w] = s[order], i[order]
                    if len(order) == k:
                        least[w] = max(low, int(s[order[-1]]))
        return best


def _ask(k: int, same: bool):
    """Searches the tree of a tile for a block of anchors; ``windows`` of an anchor are pairs of least and highest score."""
    def run(_, anchors: pd.DataFrame, tile: pd.DataFrame) -> pd.DataFrame:
        found = {"anchor_id": [], "anchor": [], "window": [], "vec_id": [], "score": []}
        if len(anchors) and len(tile):
            width = max(max(map(len, anchors["weights"])), max(map(len, tile["weights"])))
            asked, held = _matrix(anchors["weights"], width), _matrix(tile["weights"], width)
            if max(np.abs(asked).max(initial=0), np.abs(held).max(initial=0)) * max(1, width) ** 0.5 <= EXACT:
                asked, held = asked.astype(float), held.astype(float)
            tree = Tree(tile["vec_id"].to_numpy(), tile["label"].to_numpy(), held)
            for a in range(0, len(asked), 256):
                part = anchors.iloc[a:a + 256]
                bounds = tree.bounds(asked[a:a + 256])
                for n, row in enumerate(part.itertuples(index=False)):
                    own = [(low[n], high[n]) for low, high in bounds]
                    windows = [(int(x), int(y)) for x, y in zip(row.lows, row.highs)]
                    for w, (scores, ids) in enumerate(tree.search(asked[a + n], own, row.label, row.anchor_id, same, windows, k)):
                        found["anchor_id"] += [row.anchor_id] * len(ids)
                        found["anchor"] += [row.anchor] * len(ids)
                        found["window"] += [w] * len(ids)
                        found["vec_id"] += ids.tolist()
                        found["score"] += scores.tolist()
        return pd.DataFrame(found).astype({"window": "int32"} if found["window"] else {x: ("int32" if x == "window" else "int64") for x in found})

    return run


FOUND = "anchor_id bigint, anchor bigint, window int, vec_id bigint, score bigint"


def _best(anchors: DataFrame, rows: DataFrame, count: int, k: int, same: bool) -> DataFrame:
    """The ``k`` best rows of each window of each of ``anchors(anchor, anchor_id, label, weights, lows, highs)`` over all tiles, with their rank."""
    blocks = max(1, -(-anchors.count() // ANCHOR_BLOCK))
    left = anchors.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int")).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(max(count, 1) - 1))))
    right = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = left.groupBy("block", "tile").cogroup(right.groupBy("block", "tile")).applyInPandas(_ask(k, same), FOUND)
    order = W.partitionBy("anchor", "window").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor, positives: int = 5, negatives: int = 5, least_percent: int = 80) -> DataFrame:
    """For each anchor and positive the ``negatives`` best rows of other labels, scored between ``least_percent`` of the positive's score and all of it.

    ``rows(vec_id, label, weights)`` have integer weights, as :func:`labelled` gives them; anchors are rows where ``is_anchor``
    holds, positives an anchor's first rows of its own label.  Scores are integer inner products, higher ones first, ties by
    smaller vec_id.  Every row is in one tile, each tile is one R-tree, and each block of anchors asks every tree; an anchor's
    best of all trees are merged.  Returns ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Rows of an anchor's own vec_id are never its positives; rows that repeat count each, as positives too, while anchors
    that repeat throughout are one.  Where vectors differ in length, missing components are 0.  Scores must fit 62 bits.
    Positives of a negative score have an empty window.  No rows, or no anchors: an empty result.
    """
    spread, count = tiles(materialize(rows))
    asked = spread.filter(is_anchor).select(F.col("vec_id").alias("anchor_id"), "label", "weights").dropDuplicates()
    asked = materialize(asked.withColumn("anchor", F.monotonically_increasing_id()))
    low, high = -(1 << 62), 1 << 62
    every = asked.select("anchor", "anchor_id", "label", "weights", F.array(F.lit(low)).alias("lows"), F.array(F.lit(high)).alias("highs"))
    near = materialize(_best(every, spread, count, positives, same=True).select("anchor", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("window")))

    # The windows of an anchor are those of its positives, in order of their rank.
    listed = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("window", "positive_score"))).alias("found"))
    floor = lambda x: F.ceil(F.col("least") * x["positive_score"] / F.lit(100).cast("decimal(20,0)")).cast("bigint")
    windows = asked.join(listed.hint("merge"), "anchor").withColumn("least", F.lit(least_percent).cast("decimal(10,0)"))
    windows = materialize(windows.select("anchor", "anchor_id", "label", "weights", F.transform("found", floor).alias("lows"), F.transform("found", lambda x: x["positive_score"]).alias("highs")))
    found = _best(windows, spread, count, negatives, same=False)
    return found.join(near.hint("merge"), ["anchor", "anchor_id", "window"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
