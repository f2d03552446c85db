"""The standing index: versions, tombstones, pruned files, skipped blocks, and the same rows as a full ranking."""

import random

import pytest
from pyspark.sql import functions as F

from pressgrid.operators import index as I, search as X

WORDS = [f"{a}{b}" for a in ("the", "her", "sol", "mar", "ver", "ano") for b in ("", "a", "in", "os", "ette", "que")]


def made(spark, ids, seed=0, key="doc_id"):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.choice([3, 8, 20, 90])))) for i in ids]
    return spark.createDataFrame(rows, f"{key} bigint, text string")


def plain(spark, docs, query):
    """The ranking over postings made for the occasion."""
    postings, lengths = X.build_index(X.documents(docs, ["text"], "doc_id"))
    return sorted(((round(r["score"], 6), -r["doc_id"]) for r in X.rank(X.match(postings, query), lengths).collect()), reverse=True)


def ranked(df):
    return [(round(r["score"], 6), -r["doc_id"]) for r in df.collect()]


@pytest.fixture(scope="module")
def small_blocks():
    before = I.BLOCK_DOCS, I.FILE_TOKENS
    I.BLOCK_DOCS, I.FILE_TOKENS = 16, 2000
    yield
    I.BLOCK_DOCS, I.FILE_TOKENS = before


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory, small_blocks):
    docs = made(spark, range(500))
    path = str(tmp_path_factory.mktemp("index"))
    return docs, I.create_index(X.documents(docs, ["text"], "doc_id"), path)


@pytest.mark.parametrize("query", ["the", "thea ano ver"])
def test_top_is_the_head_of_the_full_ranking(spark, base, query):
    docs, index = base
    want = plain(spark, docs, query)
    assert sorted(ranked(I.full_ranking(spark, index, query)), reverse=True) == want
    found = I.top(spark, index, query, 5)
    assert ranked(found.hits) == want[:5] and found.total == len(want)
    assert found.scored + found.skipped == found.blocks and (found.skipped > 0 or " " in query)
    assert ranked(I.top(spark, index, query, 10_000).hits) == want


def test_odd_queries(spark, base):
    _, index = base
    assert I.top(spark, index, " *! ", 5).hits.count() == 0 and I.matches(spark, index, "zzz").count() == 0
    assert I.top(spark, index, "zzz the", 5).total == 0 and I.top(spark, index, "the", 0).hits.count() == 0
    with pytest.raises(ValueError):
        I.search_index(spark, {"docs": index}, "the", "people")
    shown = spark.createDataFrame([(i,) for i in range(0, 500, 7)], "doc_id bigint")
    got = I.search_index(spark, {"docs": index}, "her sol", "docs", 3, {"docs": shown}).collect()
    want = [x for x in plain(spark, base[0], "her sol") if -x[1] % 7 == 0]
    assert [(round(r["score"], 6), -r["doc_id"]) for r in got] == want[:3] and all(r["total"] == len(want) for r in got)


def test_files_and_columns_are_pruned(spark, base):
    _, index = base
    everything = index.table(spark, "postings")
    some = I.postings(spark, index, ["vero"])
    assert 0 < len(some.inputFiles()) < len(everything.inputFiles())
    plan = some.select("docs")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,vero)" in plan and "lengths" not in plan.split("ReadSchema")[-1]


def test_refresh_adds_a_segment_and_merge_gives_one(spark, base, tmp_path):
    docs, first = base
    index = I.branch(spark, first, str(tmp_path / "own"))
    now = docs.filter("doc_id % 5 <> 1").withColumn("text", F.when(F.col("doc_id") % 10 == 0, "Thérèse moved the index").otherwise(F.col("text")))
    now = now.unionByName(made(spark, range(600, 640), seed=3))
    changed = spark.createDataFrame([(i,) for i in [*range(0, 500, 10), *range(1, 500, 5), *range(600, 640), 9999]], "doc_id bigint")
    after = I.refresh(index, changed, X.documents(now, ["text"], "doc_id"))
    assert len(after.segments) == 2 and after.segments[0] == first.segments[0]
    assert (after.docs, I.open_index(spark, after.path)) == (now.count(), after)
    assert I.open_index(spark, first.path) == first  # the other index is as it was
    for each in (after, I.merge_segments(after, spark)):
        assert each.docs == now.count() and each.tokens == X.build_index(X.documents(now, ["text"], "doc_id"))[0].count()
        for query in ("moved", "her sol"):
            want = plain(spark, now, query)
            found = I.top(spark, each, query, 4)
            assert ranked(found.hits) == want[:4] and found.total == len(want)
            assert sorted(ranked(I.full_ranking(spark, each, query)), reverse=True) == want
    assert len(each.segments) == 1 and not each.tombstones
    words = {r["term"]: (r["n"], r["docs"]) for r in I.vocabulary(spark, after).collect()}
    assert words == {r["term"]: (r["n"], r["docs"]) for r in I.vocabulary(spark, each).collect()} and words["moved"] == (50, 50)


def test_stream(spark, tmp_path, small_blocks):
    """Batches become segments, an alias that moves changes both owners, and a batch played again changes nothing."""
    source, path = tmp_path / "in", str(tmp_path / "index")
    texts = lambda rows: spark.createDataFrame(rows, "doc_id bigint, texts array<string>")
    index = I.create_index(texts([(1, ["Ada", "Countess alias"]), (2, ["Bob", ""]), (3, ["Cyd", None])]), path)
    texts([(1, ["Ada", ""]), (2, ["Bob", "Countess alias"]), (3, None)]).coalesce(1).write.parquet(str(source))
    stream = lambda: spark.readStream.schema("doc_id bigint, texts array<string>").parquet(str(source))
    I.index_stream(stream(), path, str(tmp_path / "a")).awaitTermination()
    hits = lambda x, q: sorted(r[0] for r in I.matches(spark, x, q).select("doc_id").collect())
    after = I.open_index(spark, path)
    assert hits(index, "countess") == [1] and hits(after, "countess") == [2] and hits(after, "cyd") == [] and after.docs == 2
    I.index_stream(stream(), path, str(tmp_path / "b")).awaitTermination()  # the checkpoint is lost: batch 0 comes again
    assert I.open_index(spark, path) == after
    texts([(9, ["Countess", "of nine"])]).coalesce(1).write.mode("append").parquet(str(source))
    I.index_stream(stream(), path, str(tmp_path / "b"), merge_at=3).awaitTermination()
    last = I.open_index(spark, path)
    assert len(last.segments) == 1 and hits(last, "countess") == [2, 9] and last.docs == 3


def test_empty(spark, tmp_path):
    index = I.create_index(spark.createDataFrame([], "doc_id bigint, texts array<string>"), str(tmp_path / "none"))
    assert index.docs == 0 and I.top(spark, index, "a", 3).total == 0 and I.vocabulary(spark, index).count() == 0


def test_best_window(spark):
    """The second window has both terms; of several columns the one that says most is shown."""
    text = "one theatre and many words between it and what comes later in the text before here is a theatre for heroes at last"
    df = spark.createDataFrame([(text,), (None,), ("nothing of that kind",)], "t string")
    got = [r[0] for r in df.select(X.snippet(F.col("t"), "thea hero", 6)).collect()]
    assert got == ["…is a <mark>theatre</mark> for <mark>heroes</mark> at…", None, "nothing of that kind"]
    cells = F.array(F.lit("the theatre"), F.col("t"), F.lit(None).cast("string"))
    assert df.limit(1).select(X.best_snippet(cells, "thea hero", 6)).first()[0] == got[0]
    assert df.limit(1).select(X.best_snippet(F.array(F.lit("x")), "thea", 6)).first()[0] is None


def test_blocks_and_files_are_bounded(spark, tmp_path, monkeypatch):
    """Long documents make more blocks, and rows of few postings lie in other files than rows of many."""
    monkeypatch.setattr(I, "BLOCK_TOKENS", 20_000)
    rng = random.Random(5)
    rows = [(i, [" ".join([f"rare{i}", *(rng.choice(WORDS) for _ in range(500))])]) for i in range(200)]
    index = I.create_index(spark.createDataFrame(rows, "doc_id bigint, texts array<string>"), str(tmp_path / "long"))
    sizes = [r["n"] for r in index.table(spark, "docs").groupBy("block").agg(F.sum("length").alias("n")).collect()]
    assert sum(sizes) == index.tokens == 200 * 501 and len(sizes) > 3 and max(sizes) < 40_000
    files = index.table(spark, "postings").groupBy(F.col("_metadata.file_name")).agg(F.min("n").alias("low"), F.max("n").alias("high")).collect()
    assert len(files) > 1 and all(r["high"] < I.DENSE_POSTINGS or r["low"] >= I.DENSE_POSTINGS for r in files)
    assert I.top(spark, index, "rare7 the", 3).total == plain_total(index, spark, "rare7")


def plain_total(index, spark, prefix):
    return I.matches(spark, index, prefix).count()


def test_tombstones_are_looked_up_by_parts(spark, base, tmp_path):
    """Postings of the dead leave rows of any length, and a row's other postings stay."""
    docs, first = base
    index = I.branch(spark, first, str(tmp_path / "own"))
    gone = docs.filter("doc_id % 3 = 0").select("doc_id")
    after = I.refresh(index, gone, X.documents(docs.filter("doc_id < 0"), ["text"], "doc_id"))
    want = X.build_index(X.documents(docs.filter("doc_id % 3 <> 0"), ["text"], "doc_id"))[0].groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))
    assert sorted(I.vocabulary(spark, after).collect()) == sorted(want.collect())
    assert "array_contains(gone," not in I._alive(spark, after, after.table(spark, "postings"))._jdf.queryExecution().analyzed().toString()
