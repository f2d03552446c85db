"""The prefix trie against a plain Python one; tree contraction against recursion."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from pressgrid.llm import prefix_trie


def plain_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append(((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()), (role or "", text or "")))
    turns = {k: [x for _, x in sorted(v)] for k, v in turns.items()}
    whole = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    members = defaultdict(list)
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    out, totals = [], {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        totals[node] = (sum(totals[k][0] for k in kids[node]) or (not kids[node]), own + sum(totals[k][1] for k in kids[node]))
        ends = ",".join(map(str, sorted(c for c in members[node] if whole[c] == node)))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(kids[node]), int(totals[node][0]), totals[node][1], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(df):
    got = prefix_trie.prefix_trie(df)
    assert got.columns == COLUMNS
    return sorted(tuple(r[k] for k in COLUMNS) for r in got.collect())


ROWS = [
    (0, 0, "user", "a b c"), (0, 1, "assistant", "x"), (0, 2, "user", "a b c"), (0, 3, "user", None), (0, None, None, "first of all"),
    (20, 0, "user", "q"), (1, 0, "user", "mine"), (1, 1, "user", "own  words\tthree"), (1, 1, "user", "a tie"), (1, 1, None, "a tie"), (2, 0, "user", "one"),
    (3, 5, "user", ""), (3, 5, "user", ""), (3, 5, "user", ""), (41, 0, "user", "absent base"), (42, 0, "u", "absent base"), (43, 1, "u", "z"), (43, 2, "u", "z"), (43, 3, "u", "z"), (43, 4, "u", "z"),
    (None, 0, "user", "nobody's"), (-3, 0, "user", "below"), (-3, 1, "user", "zero"), (21, 0, "user", "short base"), (21, 1, "u", "short"), (21, 2, "u", "short 2"), (21, 3, "u", "short 3"),
    (22, 0, "u", "w" * 50_000 + " long"), (10**12, 0, "u", "far"), (10**12 + 4097, 0, "u", "far"), (10**12 + 9000, 0, "u", "far"), (10**12 + 9001, 0, "u", "far"),
]
TYPES = "conv_id bigint, turn bigint, role string, text string"


def test_odd_rows(spark, monkeypatch):
    # Conversations over several parts, of a few rows each.
    monkeypatch.setattr(prefix_trie, "PART_ROWS", 4)
    monkeypatch.setattr(prefix_trie, "ID_SPAN", 2)
    df = spark.createDataFrame(ROWS, TYPES)
    for k in ("id", "part", "pos", "parent", "k1", "d", "words", "n_convs"):
        df = df.withColumn(k, F.lit("clash"))
    assert trie(df) == plain_trie(ROWS)
    assert trie(spark.createDataFrame([], TYPES)) == []


def test_shared_heads_and_long_chains(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(c, t, "u", f"{t} common" if t < rng.randrange(5) else f"{rng.randrange(3)}") for c in range(60) for t in range(rng.randrange(9))]
    rows += [(200, t, "u", "hello" if t < 150 else str(t)) for t in range(230)] + [(c, 0, "u", "same") for c in range(300, 360)]
    monkeypatch.setattr(prefix_trie, "PART_ROWS", 50)
    assert trie(spark.createDataFrame(rows, TYPES)) == plain_trie(rows)


def test_contraction(spark):
    """Random trees, a chain, a star, a caterpillar and single nodes, as one forest."""
    rng = random.Random(9)
    shapes = [lambda i: rng.randrange(i), lambda i: i - 1, lambda i: 0, lambda i: i - 1 if i % 2 else max(0, i - 2), lambda i: None if i % 7 == 0 else rng.randrange(i), lambda i: None]
    up = {1000 * k + i: None if i == 0 or shape(i) is None else 1000 * k + shape(i) for k, shape in enumerate(shapes) for i in range(120)}
    up = {i: p if p is None or p < i else None for i, p in up.items()}
    value = {i: rng.randrange(100) for i in up}
    want = dict(value)
    for i in sorted(up, reverse=True):
        if up[i] is not None:
            want[up[i]] += want[i]
    df = spark.createDataFrame([(i, up[i], value[i], 1) for i in up], "id bigint, parent bigint, v bigint, w bigint")
    got = {r["id"]: (r["v"], r["w"]) for r in prefix_trie.subtree_sums(df, ["v", "w"]).collect()}
    assert {k: v for k, (v, _) in got.items()} == want
    assert got[1000][1] == 120 and got[1119][1] == 1
