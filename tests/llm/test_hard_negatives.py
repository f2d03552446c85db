"""Hard negatives against brute force over odd vectors; boxes skipped, never rows lost."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressgrid.llm import hard_negatives

TYPES = "vec_id bigint, embedding array<float>, label int"


def brute(rows, every=100):
    held = []
    for vec_id, x, label in rows:
        if vec_id is None or label is None or x is None or any(v is None or not np.isfinite(v) for v in x):
            continue
        held.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [int(np.floor(256 * float(np.float32(v)))) for v in x]))
    out = []
    anchors = {(i, lab, tuple(w)) for i, lab, w in held if i % every == 0}
    for i, lab, w in anchors:
        scored = sorted(((-sum(a * b for a, b in zip(w, v)), j, other) for j, other, v in held))
        positives = [(j, -s) for s, j, other in scored if other == lab and j != i][:5]
        for pos, top in positives:
            fits = [(-s, j) for s, j, other in scored if other != lab and 80 * top <= -100 * s <= 100 * top][:5]
            out += [(i, pos, n + 1, j, top, s) for n, (s, j) in enumerate(fits)]
    return sorted(out)


def found(spark, rows, every=100):
    df = spark.createDataFrame(rows, TYPES)
    for k in ("tile", "anchor", "score", "weights", "window", "row"):
        df = df.withColumn(k, F.lit("clash"))
    got = hard_negatives.hard_negatives(hard_negatives.labelled(df), F.col("vec_id") % every == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def vectors(n, width=6, seed=1, labels=3):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0.1, 0.3) for _ in range(width)], rng.randrange(labels)) for i in range(n)]


@pytest.fixture
def small_tiles(monkeypatch):
    for name, value in (("TILE_ROWS", 40), ("ANCHOR_BLOCK", 7)):
        monkeypatch.setattr(hard_negatives, name, value)


def test_odd_rows(spark):
    rows = vectors(60) + [
        (100, [0.5] * 6, 1), (200, [0.5] * 6, 1), (200, [0.5] * 6, 1), (300, None, 1), (400, [0.1, None, 0.2], 1), (500, [float("nan")] * 6, 2), (600, [0.2] * 6, None),
        (700, [0.4] * 6, 9), (None, [0.3] * 6, 1), (800, [], 1), (900, [0.3, 0.1], 0), (1000, [-0.4] * 6, 2), (61, [float("inf")] * 6, 0), (-100, [0.2] * 6, 2)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, [(1, [0.1], 1), (2, [0.1], 2)]) == []
    assert found(spark, [(100, [0.1], 1)]) == []


def test_many_tiles_and_blocks(spark, small_tiles):
    rows = vectors(400, width=8, seed=2, labels=4)
    assert found(spark, rows, every=10) == brute(rows, every=10)


def test_ties_and_hot_vectors(spark, small_tiles):
    """A third of the rows are one vector: many tiles hold copies only, and ties go to smaller ids."""
    rows = vectors(200, width=4, seed=3) + [(1000 + i, [0.5, 0.25, 0.125, 0.5], i % 3) for i in range(110)]
    assert found(spark, rows, every=20) == brute(rows, every=20)


def test_large_components(spark):
    rows = [(i, [float(v) for v in x], i % 2) for i, x in enumerate(np.random.default_rng(5).integers(-(1 << 20), 1 << 20, (60, 3)).tolist())]
    assert found(spark, rows, every=10) == brute(rows, every=10)


def test_boxes_are_skipped():
    """In vectors that lie in clusters the queue opens few leaves, and what it finds is the full ranking's head."""
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 100, (40, 8))
    held = np.floor(np.concatenate([c + rng.normal(0, 5, (200, 8)) for c in centres]))
    ids, labels = np.arange(len(held)), np.zeros(len(held), np.int64)
    tree = hard_negatives.Tree(ids, labels, held)
    opened = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                opened.append(key.start)
            return super().__getitem__(key).view(np.ndarray)

    tree.ids = tree.ids.view(Watched)
    query = held[17]
    bounds = [(low[0], high[0]) for low, high in tree.bounds(query[None])]
    (scores, got), = tree.search(query, bounds, 0, 17, True, [(-(1 << 62), 1 << 62)], 5)
    full = held @ query
    want = [i for i in np.lexsort((ids, -full)) if i != 17][:5]
    assert got.tolist() == want and scores.tolist() == full[want].tolist()
    assert len(set(opened)) * 4 < len(tree.levels[0][0])
