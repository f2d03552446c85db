"""The corpus pipeline against brute force, stage by stage."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from pyspark.sql import functions as F

from pressgrid.llm.common import materialize
from tests.conftest import SMALL
from tests.llm.test_operators import ODD, brute_near, check_packing, odd_docs


def exact_kept(rows):
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), i))
    return {min(g)[1] for g in groups.values()}


def mixed(rows):
    """Copies of each document, with floats as the operator has them."""
    import hashlib

    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    total, sources = sum(size.values()), sorted({s for *_, s in rows})
    own = {s: sum(size[i] for i, _, x in rows if x == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, open_ = {}, set(sources)
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * own[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 3.0 * own[s] for s in full}
        open_ -= full
    queue = []
    for s in sources:
        turn = sorted((hashlib.md5(f"mix/{i}".encode()).hexdigest(), i) for i, _, x in rows if x == s)
        run = 0
        for t, i in turn:
            run += size[i]
            queue += [((run + e * own[s]) / target[s], s, t, i) for e in range(3) if size[i] and target[s]]
    used, copies = 0, Counter()
    for *_, i in sorted(queue):
        if used + size[i] > total:
            break
        used += size[i]
        copies[i] += 1
    return copies


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.select("doc_id", "text", "source").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, docs, SMALL))
        if name == "packing":
            seen = {}
            packed = after.collect()
            # Copies of a document have the same pieces; each is packed once.
            counts = Counter(i for i, *_ in rows)
            assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == counts
            for r in packed:
                seen.setdefault((r["sequence_id"], r["offset"]), r)
            assert len(seen) == len(packed)
            break
        assert after.columns == docs.columns
        got = [(r["doc_id"], r["text"], r["source"]) for r in after.select("doc_id", "text", "source").collect()]
        if name == "language":
            want = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
        elif name == "exact_dedup":
            keep = exact_kept(rows)
            want = [r for r in rows if r[0] in keep]
        elif name == "near_dedup":
            comp = brute_near(rows, 5)
            want = [r for r in rows if comp[r[0]][1] == r[0]]
        else:
            copies = mixed(rows)
            want = [r for r in rows for _ in range(copies[r[0]])]
        assert sorted(got) == sorted(want), name
        docs, rows = after, got


def test_run_equals_the_stages(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0


def test_stages_on_odd_tables(spark):
    """Rows of every stage against brute force: null ids, ids with several texts, repeats, ties, clashing and dotted names."""
    reused = [(2, "another text under the id two, with words of its own", "a"), (20, "the very same words in a row of ten or so here", "b"), (20, "the very same words in a row of ten or so here", "b"), (None, None, "a")]
    docs = odd_docs(spark, ODD + reused).withColumn("meta.url", F.lit("clash")).withColumn("r1", F.lit("clash"))
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), SMALL)
        assert empty.count() == 0, name
        after = materialize(stage(spark, docs, SMALL))
        if name == "packing":
            assert Counter(r["doc_id"] for r in after.collect() if r["piece"] == 0) == Counter(i for i, *_ in rows)
            break
        assert after.columns == docs.columns, name
        got = [(r["doc_id"], r["text"], r["source"]) for r in after.collect()]
        if name == "language":
            want = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
        elif name == "exact_dedup":
            best = {}
            for r in sorted(rows, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)):
                best.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), r)
            want = list(best.values())
        elif name == "near_dedup":
            comp = brute_near([(k, r[1], r[2]) for k, r in enumerate(rows)], 5)
            least = defaultdict(list)
            for k, r in enumerate(rows):
                least[comp[k][1]] += [r[0]] if r[0] is not None else []
            want = [r for k, r in enumerate(rows) if r[0] is None or r[0] == min(least[comp[k][1]])]
        else:
            want = got
            size = {r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in rows}
            assert set(got) <= set(rows) and max(Counter(got).values()) <= 3
            assert None in {r[0] for r in got}
            assert sum(map(size.get, got)) <= sum(map(size.get, rows))
        assert sorted(map(str, got)) == sorted(map(str, want)), name
        docs, rows = after, got
    check_packing(list(ODD), corpus_pipeline.pack(spark, odd_docs(spark), SMALL).collect())


def test_mixing_of_equal_rows_loses_none(spark):
    """Of rows that are equal throughout, as many copies come out as the operator takes of them."""
    from pressgrid.llm import mixing

    docs = spark.createDataFrame([(None, "a b c", "x"), (None, "a b c", "x"), (7, "d e", "y"), (7, "d e", "y"), (7, "other words", "y"), (8, "f g h i", "z")], "doc_id bigint, text string, source string")
    taken = [(r["doc_id"], r["size"], r["taken"]) for r in mixing.mix(docs).collect()]
    assert corpus_pipeline.mix(spark, docs, SMALL).count() == sum(t // n for _, n, t in taken)
