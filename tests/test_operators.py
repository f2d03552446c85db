"""Operators on hand-made corpora: resolution, lifecycle, search, similarity, sources, streams."""

import datetime
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressgrid.operators import aggregates as A, components as C, joins as J, lifecycle as L, resolve, search as X, similarity as S
from pressgrid.schema import Corpus
from pressgrid.sources import feeds, versions as VS
from pressgrid.streaming import jobs as K
from pressgrid.tables import snapshot


@pytest.fixture
def corpus(spark):
    e = spark.createDataFrame([(1, "Lovelace, Ada", "lovelace-ada", 0, "Q1", "done", 1.0, True), (2, "Lovelace", "lovelace", 0, "Q1", "done", 1.0, False), (3, "Orchid", "orchid", 0, None, "not_person", None, False)],
                              "id bigint, name string, slug string, image_count bigint, kb_id string, kb_status string, kb_score double, is_favorite boolean")
    e = e.withColumn("first_seen", F.lit(None).cast("timestamp_ntz")).withColumn("article_count", F.lit(0).cast("bigint")).withColumn("unique_image_count", F.lit(0).cast("bigint")).withColumn("centroid", F.array(F.lit(1.0)))
    articles = spark.createDataFrame([(10, "u10", "T", datetime.date(2026, 1, 1), datetime.datetime(2026, 1, 2)), (11, "u11", "T", None, datetime.datetime(2026, 1, 1))], "id bigint, url string, title string, published_at date, scraped_at timestamp_ntz")
    links = spark.createDataFrame([(10, 1), (10, 2), (11, 2)], "article_id bigint, entity_id bigint")
    aliases = spark.createDataFrame([(1, 2, "A. L.", "x"), (2, 1, "A. L.", "x")], "id bigint, entity_id bigint, alias string, source string")
    images = spark.createDataFrame([(100, 10, 1, "s1", "Ada here", False, "auto", 0.1), (101, 11, 2, "s2", "Ada and Bob", True, "flagged", 0.2), (102, 11, 2, "s3", None, None, "manual", 0.3)],
                                   "id bigint, article_id bigint, entity_id bigint, source_url string, caption string, is_duplicate boolean, association_status string, match_score double")
    faces = spark.createDataFrame([(100, "front"), (101, "left")], "image_id bigint, pose string")
    return Corpus.empty(spark, entities=e, aliases=aliases, articles=articles, links=links, images=images, faces=faces)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_counts(corpus):
    got = {r["id"]: r for r in A.recompute_counts(corpus).collect()}
    assert (got[1]["image_count"], got[1]["unique_image_count"], got[1]["article_count"]) == (1, 1, 1)
    assert (got[2]["image_count"], got[2]["unique_image_count"], got[2]["article_count"]) == (2, 0, 2)
    assert (got[3]["image_count"], got[3]["article_count"]) == (0, 0) and got[2]["first_seen"] == datetime.datetime(2026, 1, 1)
    again = A.recompute_counts(corpus.with_(entities=A.recompute_counts(corpus)))
    assert rows(again, "id", "image_count") == rows(A.recompute_counts(corpus), "id", "image_count")


def test_counts_take_as_many_tasks_as_links_ask_for(corpus, monkeypatch):
    monkeypatch.setattr(A, "LINKS_OF_TASK", 1)
    links = corpus.links.unionByName(corpus.links)
    found = A.recompute_counts(corpus.with_(links=links))
    assert re.search(r"hashpartitioning\(article_id#\d+L?, 3\)", found._jdf.queryExecution().executedPlan().toString())
    assert rows(found, "id", "article_count") == [(1, 1), (2, 2), (3, 0)]


def test_search_reads_a_table_once(spark, corpus):
    """The images are made once, not for postings, lengths and texts each."""
    made = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            made.add(len(f))
            yield f

    images = corpus.images.mapInPandas(count, corpus.images.schema)
    hits = X.global_search(corpus.with_(images=images), "Ada", "images", 5).collect()
    assert sorted(h["doc_id"] for h in hits) == [100, 101] and {h["total"] for h in hits} == {2} and made.value == 3


def test_attribution_makes_images_once_and_copies_no_texts(spark, corpus):
    """The images are made once, and their texts aren't shuffled once more for each entity of their article."""
    made = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            made.add(len(f))
            yield f

    asked = corpus.images.select(F.col("id").alias("image_id"), "article_id", F.lit("").alias("alt"), F.when(F.col("id") == 101, "Lovelace").otherwise("nobody").alias("caption"))
    own = corpus.links.withColumn("entity_pos", F.col("entity_id"))
    found = L.attribute_images(asked.mapInPandas(count, asked.schema), own, corpus.entities, corpus.aliases.limit(0))
    assert rows(found, "image_id", "entity_id", "outcome") == [(100, None, "ignored"), (101, 2, "named"), (102, 2, "only_person")]
    assert made.value == 3 and "BroadcastHashJoin [entity_id" in found._jdf.queryExecution().executedPlan().toString()


def test_merge_and_split(spark, corpus):
    edges = spark.createDataFrame([(2, 1), (3, 3), (9, 1)], "duplicate_id bigint, canonical_id bigint")
    after = resolve.apply_merges(corpus, edges)
    assert rows(after.entities, "id", "image_count") == [(1, 3), (3, 0)]
    assert rows(after.links, "article_id", "entity_id") == [(10, 1), (11, 1)]
    assert rows(after.aliases, "entity_id", "alias") == [(1, "A. L."), (1, "Lovelace")]
    assert after.entities.filter("id = 1 and centroid is null").count() == 1
    split = resolve.split_entity(after, 1, [(3, ["Ada here"], [])], [["Ada"], ["Bob"]], {"A. L.": 3})
    assert rows(split.images, "id", "entity_id", "association_status")[0] == (100, 3, "auto")
    assert split.images.filter("association_status = 'flagged'").count() == 1
    assert rows(split.aliases, "entity_id", "alias") == [(1, "Lovelace"), (3, "A. L.")]


def test_merge_chains(spark):
    edges = spark.createDataFrame([(i, i - 1) for i in range(1, 40)] + [(50, 50)], "duplicate_id bigint, canonical_id bigint")
    assert {r["canonical_id"] for r in resolve.resolve_chains(edges).collect()} == {0}


def test_merge_refusals(spark, corpus):
    asks = spark.createDataFrame([(1, 2), (1, 1), (1, 3), (1, 99)], "canonical_id bigint, duplicate_id bigint")
    assert {(r["duplicate_id"], r["refusal"]) for r in resolve.merge_refusals(asks, corpus.entities).collect()} == {(2, None), (1, "same"), (3, "tombstone"), (99, "unknown")}


def test_centroid_merges_equal_the_sequential_order(spark):
    rng = random.Random(3)
    pairs = sorted((round(rng.random() / 5, 4), *rng.sample(range(30), 2)) for _ in range(60))
    df = spark.createDataFrame([(c, d, x, True) for x, c, d in pairs], "canonical_id bigint, duplicate_id bigint, distance double, can_auto boolean")
    gone, want = set(), []
    for x, c, d in pairs:
        if c not in gone and d not in gone:
            gone.add(d)
            want.append((c, d, x))
    assert rows(resolve.plan_centroid_merges(df), "canonical_id", "duplicate_id", "distance") == sorted(want)


def test_upsert(spark, corpus):
    mentions = spark.createDataFrame([("Ada Lovelace", "a"), ("A. L.", "a"), ("Orchid", "a"), ("Grace Hopper", "b"), ("grace  hopper", "c")], "raw_name string, source string")
    entities, aliases, found = L.upsert_entities(mentions, corpus.entities, corpus.aliases, "2026-01-01")
    assert sorted(r["slug"] for r in entities.collect()) == ["hopper-grace", "lovelace", "lovelace-ada", "orchid"]
    got = {r["raw_name"]: r["entity_id"] for r in found.collect()}
    assert got["Ada Lovelace"] == 1 and got["A. L."] == 1 and got["Grace Hopper"] == got["grace  hopper"] == 4 and "Orchid" not in got
    assert aliases.filter("entity_id = 1 and alias = 'Ada Lovelace'").count() == 1
    again = L.upsert_entities(mentions, snapshot(entities), snapshot(aliases), "2026-01-01")
    assert again[0].count() == entities.count() and again[1].count() == aliases.count()


def test_lifecycle(spark, corpus):
    ids = spark.createDataFrame([(2,)], "id bigint")
    gone = L.purge_not_person(corpus, ids)
    tomb = gone.entities.filter("id = 2").first()
    assert tomb["kb_status"] == "not_person" and tomb["image_count"] == 0 and tomb["name"] == "Lovelace"
    assert gone.images.count() == 1 and gone.links.count() == 1 and gone.faces.count() == 1
    after, report = L.erase_entities(corpus, spark.createDataFrame([("lovelace",)], "slug string"))
    assert {r["what"]: r["n"] for r in report.collect()} == {"entities": 1, "aliases": 1, "links": 2, "images": 2, "faces": 1, "orphans": 1}
    assert after.articles.count() == 2 and J.orphan_articles(after).count() == 1
    set_ = spark.createDataFrame([(3, True), (1, False)], "id bigint, favorite boolean")
    assert rows(L.set_favorites(corpus.entities, set_), "id", "is_favorite") == [(1, False), (2, False), (3, False)]


def test_enrich(spark):
    e = spark.createDataFrame([(1, "Lovelace, Ada", None, "pending", None), (2, "Nobody, At", None, "pending", None), (3, "Park", "Q9", "pending", None), (4, "Hopper, Grace", "Q4", "done", None)], "id bigint, name string, kb_id string, kb_status string, kb_score double")
    e = e.withColumn("summary", F.lit(None).cast("string"))
    hits = spark.createDataFrame([("Ada Lovelace", "en", 0, "Q8", "Other"), ("Ada Lovelace", "fr", 0, "Q1", "Ada lovelace")], "query string, lang string, rank int, kb_id string, label string")
    st = spark.createDataFrame([("Q1", json.dumps({"P31": ["Q5"], "P569": [{"time": "+1815-12-10T00:00:00Z"}], "P106": ["Q20", "Q21"], "P19": ["Q30"]})), ("Q9", json.dumps({"P31": ["Q22698"]}))], "kb_id string, j string")
    st = st.select("kb_id", F.from_json("j", "map<string, array<variant>>").alias("statements"))
    labels = spark.createDataFrame([("Q20", "en", "mathematician"), ("Q21", "fr", "autrice"), ("Q21", "en", "writer"), ("Q30", "fr", "Londres"), ("Q4", "en", "Someone")], "kb_id string, lang string, label string")
    pages = spark.createDataFrame([("Ada lovelace", "fr", "standard", "Texte"), ("Grace Hopper", "fr", "disambiguation", "No"), ("Grace Hopper", "en", "standard", "Text")], "title string, lang string, type string, extract string")
    got = {r["id"]: r for r in L.enrich(e, hits, st, labels, pages, "2026-01-01").collect()}
    assert (got[1]["kb_id"], got[1]["kb_score"], got[1]["kb_status"], got[1]["summary"], str(got[1]["birth_date"])) == ("Q1", 1.0, "done", "Texte", "1815-12-10")
    assert got[1]["occupations"] == ["mathematician", "autrice"] and got[1]["birth_place"] == "Londres"
    assert got[2]["kb_status"] == "not_found" and got[3]["kb_status"] == "not_person" and got[3]["summary"] is None
    assert got[4]["kb_score"] == 0.7 and got[4]["summary"] == "Text"


def test_duplicates_fold_equals_rounds(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(6)]
    data = []
    for i in range(300):
        h = rng.choice(base)
        for _ in range(rng.randrange(7)):
            h ^= 1 << rng.randrange(64)
        data.append((i, rng.randrange(2), rng.randrange(50), h - (1 << 64) if h >> 63 else h))
    df = spark.createDataFrame(data, "id bigint, entity_id bigint, scraped_at bigint, hash64 bigint")
    cols = ("id", "is_duplicate", "duplicate_of")
    assert [str(r) for r in rows(S.mark_duplicates(df, 5), *cols)] == [str(r) for r in rows(S.mark_duplicates_large(df, 5), *cols)]
    got = {r["entity_id"]: r["diversity"] for r in S.diversity(df).collect()}
    for g in (0, 1):
        hs = [h % (1 << 64) for _, e, _, h in data if e == g]
        pairs = [bin(a ^ b).count("1") / 64 for k, a in enumerate(hs) for b in hs[k + 1:]]
        assert got[g] == pytest.approx(np.mean(pairs), abs=1e-4)


def test_audit_respects_people(spark):
    v = spark.createDataFrame([(1, 7, [1.0, 0.0], "auto"), (2, 7, [0.0, 1.0], "manual"), (3, 7, [0.0, -1.0], "human_flagged"), (4, 7, [1.0, 0.0], "flagged"), (5, 8, [1.0, 0.0], None)], "id bigint, entity_id bigint, vector array<float>, association_status string")
    c = A.centroids(v)
    assert {r["entity_id"]: r["centroid_n"] for r in c.collect()} == {7: 2, 8: 1}
    assert {r["id"]: r["association_status"] for r in S.audit(v, c).collect()} == {1: "confirmed", 4: "confirmed", 5: "confirmed"}


def test_search(spark):
    docs = spark.createDataFrame([(1, "Élodie Durand", "peintre|auteur"), (2, "Durand, Paul", None), (3, "Autre", "élève")], "id bigint, name string, jobs string")
    postings, lengths = X.build_index(X.documents(docs, ["name", "jobs"]))
    hit = lambda q: sorted(r[0] for r in X.match(postings, q).select("doc_id").distinct().collect())
    assert hit("elo dur") == [1] and hit("DURAND") == [1, 2] and hit("Élè") == [3] and hit("auteur") == [1] and hit("  *! ") == [] and hit("durand zzz") == []
    found = X.search({"people": (postings, lengths)}, "dur", limit=1).collect()
    assert len(found) == 1 and found[0]["total"] == 2
    assert spark.createDataFrame([("un deux Été quatre " * 5,)], "t string").select(X.snippet(F.col("t"), "ete", 3)).first()[0] == "…deux <mark>Été</mark> quatre…"
    after, _ = X.refresh_index(postings, lengths, spark.createDataFrame([(1,)], "doc_id bigint"), X.documents(docs.filter("id <> 1"), ["name", "jobs"]))
    assert not X.match(after, "peintre").count() and X.match(after, "durand").count() == 1


def test_feeds(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"entities": [{"type": "PERSON", "value": " Ada ", "mentions": None, "image": {"url": "u", "width": 3}}, {"type": "ORG", "value": "X"}, {"type": "PERSON", "value": " "}, {"type": "PERSON", "value": "Bob", "mentions": 4, "image": "no"}], "total": 4}))
    got = feeds.read_entity_feed(spark, str(tmp_path / "e.json")).collect()
    assert [(r["name"], r["mentions"], r["image"] and r["image"]["url"]) for r in got] == [("Ada", 0, "u"), ("Bob", 4, None)]
    items = [{"URL": "u1", "title": "T", "images": [{"url": "i"}], "entities": {"PERSON": ["Ada", " "]}}, {"URL": "", "entities": {"PERSON": ["x"]}}, {"URL": "u2", "entities": {}}]
    for name, whole in (("a", items), ("b", {"articles": items})):
        (tmp_path / f"{name}.json").write_text(json.dumps(whole))
        ok, bad = feeds.read_article_feed(spark, str(tmp_path / f"{name}.json"))
        assert [(r["url"], r["persons"]) for r in ok.collect()] == [("u1", ["Ada"])]
        assert sorted(r["reason"] for r in bad.collect()) == ["no_person", "no_url"]


def test_feeds_of_lines_are_split(spark, tmp_path):
    """One file of many lines is several tasks, with the same rows and rejects as a file that is one document."""
    items = [{"URL": f"u{i}" if i % 7 else "", "title": "t" * 200, "entities": {"PERSON": ["Ada"] if i % 5 else []}} for i in range(600)]
    (tmp_path / "whole.json").write_text(json.dumps(items))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(x) if i % 3 else json.dumps([x]) if i % 2 else json.dumps({"articles": [x]}) for i, x in enumerate(items)) + "\n\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        split = feeds.read_article_feed(spark, str(tmp_path / "lines.json"), lines=True)
        parts = split[0].select(F.spark_partition_id()).distinct().count()
        got = [sorted(str(r) for r in df.collect()) for df in split]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert parts > 3 and got == [sorted(str(r) for r in df.collect()) for df in feeds.read_article_feed(spark, str(tmp_path / "whole.json"))]
    assert len(got[1]) == len([x for x in items if not x["URL"] or not x["entities"]["PERSON"]])


def test_media(spark):
    html = """<img src="/a.jpg" alt="A"><figure><img data-src="b.png"><figcaption> The <b>caption</b> </figcaption></figure><img src="data:x"><img><img src="/a.jpg">"""
    got = feeds.extract_media(spark.createDataFrame([(1, "https://h/p/", html), (2, None, None)], "page_id bigint, url string, html string")).orderBy("position").collect()
    assert [(r["src"], r["alt"], r["caption"]) for r in got] == [("https://h/a.jpg", "A", None), ("https://h/p/b.png", None, "Thecaption")]


def test_blobs_and_tables(spark, tmp_path, corpus):
    (tmp_path / "x.bin").write_bytes(b"\xff\xd8\xff\xe0" + b"0" * 20)
    (tmp_path / "y.bin").write_bytes(b"GIF89a" + b"0" * 5000)
    (tmp_path / "z.bin").write_bytes(b"text")
    assert [r["kind"] for r in feeds.read_blobs(spark, str(tmp_path), 1000).collect()] == ["jpeg"]
    feeds.write_corpus(corpus, str(tmp_path / "snap"))
    back = feeds.read_corpus(spark, str(tmp_path / "snap"))
    assert back.articles.count() == 2 and rows(back.links, "article_id", "entity_id") == rows(corpus.links, "article_id", "entity_id")


def test_metrics_text(spark):
    df = spark.createDataFrame([("m", {"b": "2", "a": "1"}, 3.0), ("r", {}, 0.25)], "metric string, labels map<string,string>, value double")
    assert sorted(r[0] for r in feeds.metrics_text(df).collect()) == ['m{a="1",b="2"} 3', "r 0.250000"]


@pytest.fixture
def event_log(spark, tmp_path):
    base = datetime.datetime(2026, 1, 10, 12)
    data = [(base - datetime.timedelta(hours=h), kind, loop, str(h)) for h, kind, loop in ((25, "success", "a"), (24, "success", "b"), (23, "error", "a"), (1, "success", "b"), (1, "merged", None), (200, "error", "c"))]
    df = spark.createDataFrame(data, "ts timestamp_ntz, kind string, loop string, summary string")
    path = str(tmp_path / "events")
    df.write.parquet(path)
    return df, path


def test_health(event_log):
    got = {r["loop"]: r for r in K.job_health(event_log[0], "2026-01-10 12:00:00").collect()}
    assert (got["a"]["successes"], got["a"]["errors"], got["a"]["last_summary"]) == (0, 1, "25") and got["a"]["last_success"] is not None
    assert got["b"]["successes"] == 2 and got["c"]["errors"] == 0
    assert K.retain(event_log[0], "2026-01-10 12:00:00").count() == 5


def test_streams(spark, event_log, tmp_path):
    stream = feeds.read_events(spark, event_log[1], streaming=True)
    K.run_available(K.job_health_stream(stream), str(tmp_path / "h"), str(tmp_path / "hc"))
    assert spark.read.parquet(str(tmp_path / "h")).filter("loop = 'a' and kind = 'success'").agg(F.sum("n")).first()[0] == 23  # the last of 24 windows ends after the watermark
    seen = []
    done = K.run_cycle(feeds.read_events(spark, event_log[1], streaming=True), lambda batch, n: seen.append(batch.count()), str(tmp_path / "cc"), lambda: seen.append("after"))
    assert done == 1 and seen == [6, "after"]
    again = K.run_cycle(feeds.read_events(spark, event_log[1], streaming=True), lambda batch, n: seen.append(batch.count()), str(tmp_path / "cc"), lambda: seen.append("after"))
    assert again == 0 and len(seen) == 2


def test_liveness(spark, event_log, tmp_path):
    got = []
    live = K.liveness(feeds.read_events(spark, event_log[1], streaming=True))
    live.writeStream.foreachBatch(lambda df, n: got.extend(df.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "lc")).trigger(availableNow=True).start().awaitTermination()
    last = {r["loop"]: r for r in got}
    assert last["b"]["last_summary"] == "1" and last["a"]["last_error"] is not None and set(last) == {"a", "b", "c"}


def test_a_silent_loop_turns_stale(spark, tmp_path):
    """No event comes any more, and yet the stream says so when the time is up."""
    import time

    now = datetime.datetime.now(datetime.UTC).replace(tzinfo=None) + datetime.timedelta(seconds=10)  # time for the first batch to start
    old = now - datetime.timedelta(hours=2)
    schema = "ts timestamp_ntz, kind string, loop string, summary string"
    spark.createDataFrame([(now, "success", "a", "1"), (now, "other", "a", None), (old, "error", "b", "2")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = []
    live = K.liveness_by_clock(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "20 seconds")
    running = live.writeStream.foreachBatch(lambda df, n: got.extend(df.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        end = time.monotonic() + 120
        while time.monotonic() < end and running.isActive and [r["stale"] for r in got if r["loop"] == "a"][-1:] != [True]:
            time.sleep(0.5)
    finally:
        running.stop()
    assert [r["stale"] for r in got if r["loop"] == "b"] == [True]
    mine = [r for r in got if r["loop"] == "a"]
    assert [r["stale"] for r in mine] == [False, True] and mine[-1]["last_summary"] == "1" and mine[-1]["last_error"] is None


FEED = "url string, title string, published_at date, scraped_at timestamp_ntz, domain string, persons array<string>"


def test_a_batch_that_dies_and_comes_again(spark, corpus, tmp_path, monkeypatch):
    """A batch lost between two tables leaves the corpus as it was; played again it is whole, and a third time changes nothing."""
    path = str(tmp_path / "corpus")
    VS.commit(Corpus.empty(spark), corpus, path, 0)
    day = datetime.datetime(2026, 1, 3)
    batch = spark.createDataFrame([("u10", "again", None, day, "d", ["Grace Hopper"]), ("u99", "new", None, day, "d", ["Grace Hopper", "Ada Lovelace"])], FEED)
    state = lambda: {k: sorted(map(str, df.collect())) for k, df in VS.read_version(spark, path).items()}
    start, mark = state(), VS._mark
    monkeypatch.setattr(VS, "_mark", lambda *a: (_ for _ in ()).throw(OSError("the driver is gone")))
    with pytest.raises(OSError):
        K.ingest_batch(batch, 1, path, "2026-01-04")
    assert state() == start
    monkeypatch.setattr(VS, "_mark", mark)
    assert {r["outcome"]: r["n"] for r in K.ingest_batch(batch, 1, path, "2026-01-04").collect()} == {"already": 1, "new": 1}
    after = state()
    whole, _ = K.ingest(batch, corpus, "2026-01-04")
    assert len(after["articles"]) == 3 and len(after["entities"]) == 4 and len(after["links"]) == whole.links.count() and after["images"] == start["images"]
    assert K.ingest_batch(batch, 1, path, "2026-01-04") is None and state() == after
    VS.compact(spark, path)
    assert state() == after and VS.last_commit(spark, path)[0] == 1 and all(len(v) == 1 for v in VS.last_commit(spark, path)[1].values())


def test_new_articles(spark, corpus, tmp_path):
    rows_ = corpus.articles.unionByName(corpus.articles)
    rows_.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows_.schema).parquet(str(tmp_path / "in"))
    K.run_available(K.new_articles(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_long_chain_is_decided_whole(spark):
    """Each item is near its neighbours alone: every second one is a duplicate, however many rounds that takes."""
    data, h = [], 0
    for i in range(24):
        data.append((i, 1, i, h if h < 1 << 63 else h - (1 << 64)))
        h ^= 0b111 << (i * 2 % 62)
    df = spark.createDataFrame(data, "id bigint, entity_id bigint, scraped_at bigint, hash64 bigint")
    cols = ("id", "is_duplicate", "duplicate_of")
    want = rows(S.mark_duplicates(df, 3), *cols)
    assert [str(r) for r in rows(S.mark_duplicates_large(df, 3), *cols)] == [str(r) for r in want] and 5 < sum(r[1] for r in want) < 24


def chain(n):
    """Hashes that are near their neighbours in order alone, as a Gray code of three bits a step."""
    data, h = [], 0
    for i in range(n):
        data.append((i, 1, i, h if h < 1 << 63 else h - (1 << 64)))
        h ^= 0b111 << 3 * ((i + 1 & -(i + 1)).bit_length() - 1)
    return data


HASHED = "id bigint, entity_id bigint, scraped_at bigint, hash64 bigint"


def plain_marks(data, max_bits):
    leaders, out = {}, []
    for i, g, t, h in sorted(data, key=lambda r: (str(r[1]), r[2], r[0])):
        near = [k for k, x in leaders.get(g, []) if bin((h ^ x) & (1 << 64) - 1).count("1") <= max_bits]
        if not near:
            leaders.setdefault(g, []).append((i, h))
        out.append((i, bool(near), near[0] if near else None))
    return sorted(out)


def test_a_chain_of_two_thousand(spark):
    import time

    data = chain(2000)
    df, began = spark.createDataFrame(data, HASHED), time.monotonic()
    got = sorted(tuple(r) for r in S.mark_duplicates_large(df, 3).select("id", "is_duplicate", "duplicate_of").collect())
    assert got == plain_marks(data, 3) and sum(r[1] for r in got) == 1000
    assert time.monotonic() - began < 60


def test_components_larger_than_a_row(spark, monkeypatch):
    """Blocks of four rows give what whole folds give; copies and null groups too."""
    monkeypatch.setattr(C, "FOLD_ROWS", 4)
    rng, base = random.Random(8), [random.Random(2).getrandbits(63) for _ in range(3)]
    data = [(i, rng.choice([1, 2, None]), rng.randrange(9), rng.choice(base) ^ 1 << rng.randrange(12) ^ 1 << rng.randrange(12)) for i in range(150)] + [(1000 + i, 7, t, h) for i, _, t, h in chain(20)]
    for bits in (3, 1):
        got = S.mark_duplicates_large(spark.createDataFrame(data, HASHED), bits).select("id", "is_duplicate", "duplicate_of").collect()
        assert sorted(tuple(r) for r in got) == plain_marks(data, bits)


def test_duplicates_are_found_without_pairs(spark, monkeypatch):
    """Every hash within three bits of one: a billion pairs, and one leader."""
    import itertools

    def no_pairs(*_, **__):
        raise AssertionError("pairs of near hashes grow with the square of a cluster")

    monkeypatch.setattr(S, "hamming_pairs", no_pairs)
    near = [sum(1 << i for i in c) for k in range(4) for c in itertools.combinations(range(64), k)]
    df = spark.createDataFrame([(i, 1, 0, h - (1 << 64) if h >> 63 else h) for i, h in enumerate(near)], HASHED)
    got = S.mark_duplicates_large(df, 6).groupBy("is_duplicate", "duplicate_of").count().collect()
    assert sorted((r[0], r[1], r[2]) for r in got) == [(False, None, 1), (True, 0, len(near) - 1)]


def test_blocks_of_hashes_give_what_a_fold_gives(spark, monkeypatch):
    """Groups of several blocks and shares, of one and of none; copies, null groups and null hashes."""
    monkeypatch.setattr(S, "FOLD_ITEMS", 48)
    monkeypatch.setattr(S, "SHARE_ITEMS", 16)
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(5)]
    data = []
    for i in range(260):
        h = rng.choice(base)
        for _ in range(rng.randrange(8)):
            h ^= 1 << rng.randrange(64)
        data.append((i, rng.choice([1, 1, 1, 2, None, i]), rng.randrange(90), h - (1 << 64) if h >> 63 else h))
    data += [(1000 + i, 7, t, h) for i, _, t, h in chain(70)]
    for bits in (5, 22):
        got = S.mark_duplicates_large(spark.createDataFrame([*data, (5000, 1, 0, None)], HASHED), bits).select("id", "is_duplicate", "duplicate_of").collect()
        assert sorted(tuple(r) for r in got) == plain_marks(data, bits)
    assert S.mark_duplicates_large(spark.createDataFrame([], HASHED), 5).count() == 0


def test_first_near_over_many_leaders():
    import numpy as np

    rng = np.random.default_rng(3)
    leaders = rng.integers(0, 1 << 64, 9000, np.uint64)
    at = rng.integers(0, 9000, 50)
    items = leaders[at] ^ np.uint64(1 << 63 | 1)
    leaders[8999] = items[7]
    assert S.first_near(items, leaders, 2).tolist() == at.tolist() and set(S.first_near(items, leaders, 1).tolist()) == {-1, 8999}
    assert S.first_near(items, leaders[:0], 2).tolist() == [-1] * 50


def test_first_near_in_slices(monkeypatch):
    """Buckets of slices give what all comparisons give, also where many leaders are near or slices are wider than their buckets' numbers."""
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 64, 40, np.uint64)
    flip = lambda n: base[rng.integers(0, 40, n)] ^ (np.uint64(1) << rng.integers(0, 64, n, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, n, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, n, np.uint64))
    items, leaders = flip(400), flip(700)
    whole = S.first_near
    for bits in (5, 4, 1, 0):
        near = np.bitwise_count(items[:, None] ^ leaders) <= bits
        want = np.where(near.any(1), near.argmax(1), -1).tolist()
        assert bits < 4 or len({*want}) > 20
        assert whole(items, leaders, bits).tolist() == want
        with monkeypatch.context() as m:
            m.setattr(S, "SLICED_PAIRS", 0)
            taken, sliced = [], S._near_in_slices
            m.setattr(S, "_near_in_slices", lambda *a: taken.append(1) or sliced(*a))
            assert whole(items, leaders, bits).tolist() == want and taken


def test_scratch_is_cleared(spark):
    """What an application wrote between steps goes at once, and nothing else; later steps write anew."""
    from pathlib import Path

    from pressgrid.tables import clear_scratch, scratch_folder, shared_folder

    first = snapshot(spark.range(5))
    other = Path(shared_folder(spark).removeprefix("file://")) / "index-of-another"
    other.mkdir(parents=True)
    assert first.count() == 5 and Path(scratch_folder(spark).removeprefix("file://")).exists()
    clear_scratch(spark)
    assert not Path(scratch_folder(spark).removeprefix("file://")).exists() and other.exists() and snapshot(spark.range(3)).count() == 3


def test_articles_of_many_entities(spark, monkeypatch):
    """An article with more entities than a block gives all its pairs, over several tasks; small articles beside it."""
    monkeypatch.setattr(J, "ARTICLE_BLOCK", 20)
    rng = random.Random(6)
    links = [(1, e) for e in range(150)] + [(2, e) for e in range(0, 150, 3)] + [(a, rng.randrange(150)) for a in range(3, 40) for _ in range(4)] + [(1, 5), (None, 7)]
    want = {}
    for a in {a for a, _ in links if a is not None}:
        own = sorted({e for x, e in links if x == a})
        for i, x in enumerate(own):
            for y in own[i + 1:]:
                want[x, y] = want.get((x, y), 0) + 1
    df = spark.createDataFrame(links, "article_id bigint, entity_id bigint")
    assert {(r[0], r[1]): r[2] for r in J.cooccurrence(df).collect()} == want
    assert {(r[0], r[1]): r[2] for r in J.cooccurrence(df, 3).collect()} == {k: n for k, n in want.items() if n >= 3}


def test_composite_over_parts(spark, monkeypatch):
    """One entity with nearly all images: its places come from several parts."""
    from pressgrid.operators import ranks

    monkeypatch.setattr(ranks, "PART_ROWS", 30)
    rng = random.Random(4)
    data = [(i, None if i % 17 == 0 else 1 if i % 9 else 2, None if i % 5 == 0 else rng.randrange(40), [rng.random(), float(i)]) for i in range(200)]
    df = spark.createDataFrame(data, "id bigint, entity_id bigint, scraped_at bigint, vector array<float>")
    got = {r["entity_id"]: r["vector"] for r in A.composite_vector(df, "linear").collect()}
    for e in (1, 2, None):
        own = sorted((r for r in data if r[1] == e), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        w = [1 - 0.9 * k / (len(own) - 1) for k in range(len(own))]
        assert got[e] == pytest.approx([sum(x * r[3][p] for x, r in zip(w, own)) / sum(w) for p in (0, 1)], rel=1e-5)
    parts = ranks.ranked(df.drop("vector"), "entity_id", ["scraped_at", "id"])
    assert sorted(r["place"] for r in parts.filter("entity_id = 1").collect()) == list(range(1, 1 + sum(r[1] == 1 for r in data)))


def test_blocks_that_cannot_meet(spark, monkeypatch):
    """Pairs are those of the whole product, though most pairs of blocks are never multiplied where vectors lie in clusters."""
    monkeypatch.setattr(S, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (12, 16))
    v = np.concatenate([c + rng.normal(0, 0.05, (50, 16)) for c in centres] + [np.repeat(centres[:1], 90, 0)])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, centroid array<double>")
    far = 1 - v @ v.T
    want = {(i, j) for i, j in zip(*np.nonzero(far <= 0.1)) if i < j}
    assert {(r["a"], r["b"]) for r in S.vector_pairs(df, 0.1).collect()} == want
    blocks = S.pivot_blocks(df.select("id", F.col("centroid").alias("v")), 18)
    n, met = blocks.count(), S.meeting_blocks(blocks, 0.1).count()
    assert blocks.agg(F.max(F.size("rows"))).first()[0] <= 80 and met < 0.5 * n * (n + 1) / 2


def test_blocks_are_not_shuffled_to_meet(spark, monkeypatch):
    """Blocks are read where they meet: a shuffle would send each once for each block that it meets."""
    monkeypatch.setattr(S, "BLOCK_ROWS", 40)
    v = np.random.default_rng(5).normal(0, 1, (200, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    found = S.vector_pairs(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, centroid array<double>"), 0.3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    assert {(r["a"], r["b"]) for r in found.collect()} == {(i, j) for i, j in zip(*np.nonzero(1 - v @ v.T <= 0.3)) if i < j}


def test_merges_of_components_larger_than_a_row(spark, monkeypatch):
    monkeypatch.setattr(C, "FOLD_ROWS", 5)
    test_centroid_merges_equal_the_sequential_order(spark)


def test_merges_in_rounds(spark, monkeypatch):
    """Pairs of which none waits long are settled by rounds alone, whatever the component's size; a chain's open rest is folded."""
    rng = random.Random(4)
    for n, chain in ((80, False), (60, True)):
        some = {tuple(rng.sample(range(n), 2)) for _ in range(4 * n)}
        pairs = [(i / 1000, i, i + 1) for i in range(n)] if chain else sorted((round(rng.random() / 5, 2), *p) for p in some)
        folded = []
        monkeypatch.setattr(resolve, "in_order", lambda *a: folded.append(1) or C.in_order(*a))
        gone, want = set(), []
        for x, c, d in pairs:
            if c not in gone and d not in gone:
                gone.add(d)
                want.append((c, d, x))
        df = spark.createDataFrame([(c, d, x, True) for x, c, d in pairs], "canonical_id bigint, duplicate_id bigint, distance double, can_auto boolean")
        assert rows(resolve.plan_centroid_merges(df), "canonical_id", "duplicate_id", "distance") == sorted(want)
        assert bool(folded) == chain


def test_dedup_of_groups(spark):
    data = [(1, 1, 0), (2, 1, 1), (3, 1, (1 << 20) - 1), (4, 2, 5), (5, 3, 7), (6, 3, 7)]
    df = spark.createDataFrame([(i, g, i, h) for i, g, h in data], "id bigint, entity_id bigint, scraped_at bigint, hash64 bigint")
    got = {r["entity_id"]: (r["items"], r["uniques"], r["duplicates"], r["diversity"]) for r in S.dedup_groups(df, S.mark_duplicates(df)).collect()}
    assert got == {1: (3, 2, 1, round(20 / 64, 4)), 2: (1, 1, 0, None), 3: (2, 1, 1, 0.0)}


def test_candidates_leave_tombstones_out(spark):
    v = [[1.0, 0.0], [1.0, 0.0], [0.99, 0.141], [1.0, 0.0]]
    df = spark.createDataFrame([(i, None, s, 10, x) for i, (s, x) in enumerate(zip(["done", "done", "done", "not_person"], v))], "id bigint, kb_id string, kb_status string, image_count bigint, centroid array<double>")
    got = [(r["canonical_id"], r["duplicate_id"]) for r in S.candidate_pairs(df).collect()]
    assert got[0] == (0, 1) and len(got) == 3 and all(3 not in p for p in got)


def test_centroids_are_reset(spark, corpus):
    decisions = spark.createDataFrame([(100, 2), (101, 2)], "id bigint, entity_id bigint")
    after = L.reassign(corpus, decisions)
    assert rows(after.entities, "id", "image_count") == [(1, 0), (2, 3), (3, 0)]
    assert {r["id"] for r in after.entities.filter("centroid is null").collect()} >= {1, 2}
    split = resolve.split_entity(corpus, 2, [(1, ["Bob"], [])], [])
    assert {r["id"] for r in split.entities.filter("centroid is null").collect()} >= {1, 2}


def test_manual_merges(spark, corpus):
    after, said = resolve.merge_manual(corpus, spark.createDataFrame([(1, 2), (1, 3), (1, 1), (1, 9)], "canonical_id bigint, duplicate_id bigint"))
    assert [str(x) for x in rows(said, "duplicate_id", "refusal")] == ["(1, 'same')", "(2, None)", "(3, 'tombstone')", "(9, 'unknown')"]
    assert rows(after.entities, "id", "image_count") == [(1, 3), (3, 0)]


def test_global_search(spark, corpus):
    got = X.global_search(corpus, "lovelace", "entities").collect()
    assert [(r["doc_id"], r["entity_id"], r["total"]) for r in got] and all("<mark>Lovelace" in r["snippet"] for r in got)
    assert X.global_search(corpus, "orchid", "entities").count() == 0  # a tombstone
    images = X.global_search(corpus, "ada bob", "images").collect()
    assert [(r["doc_id"], r["entity_id"], r["name"]) for r in images] == [(101, 2, "Lovelace")]
    assert {r["scope"] for r in X.global_search(corpus, "ada").collect()} == {"entities", "images"}


def test_liveness_at(spark, event_log):
    events = feeds.read_events(spark, event_log[1])
    newest = events.filter("loop is not null and kind in ('success', 'error')").agg(F.max("ts")).first()[0]
    soon, late = str(newest + datetime.timedelta(minutes=1)), str(newest + datetime.timedelta(hours=100))
    assert not all(r["stale"] for r in K.liveness_at(events, soon).collect())
    assert all(r["stale"] for r in K.liveness_at(events, late).collect())
    assert K.liveness_at(events, str(newest - datetime.timedelta(days=4000))).count() == 0


def test_ingest_from_a_stream(spark, corpus, tmp_path):
    """Batches of a stream go through M1 to M3; what is known only gets links."""
    feed = spark.createDataFrame([
        ("u10", "again", datetime.date(2026, 1, 1), datetime.datetime(2026, 1, 2), "d", ["Grace Hopper"]), ("u99", "new", None, datetime.datetime(2026, 1, 3), "d", ["Grace Hopper", "Orchid", ""])],
        "url string, title string, published_at date, scraped_at timestamp_ntz, domain string, persons array<string>")
    feed.coalesce(1).write.parquet(str(tmp_path / "feed"))
    state = {"corpus": corpus}

    def work(batch, number):
        state["corpus"], state["summary"] = K.ingest(batch, state["corpus"], "2026-01-04")

    stream = K.new_articles(spark.readStream.schema(feed.schema).parquet(str(tmp_path / "feed"))).withColumn("scraped_at", F.col("scraped_at").cast("timestamp_ntz"))
    assert K.run_cycle(stream, work, str(tmp_path / "checkpoint")) == 1
    after = state["corpus"]
    assert sorted(r["slug"] for r in after.entities.collect()) == ["hopper-grace", "lovelace", "lovelace-ada", "orchid"]
    grace, u99 = after.entities.filter("slug = 'hopper-grace'").first()["id"], after.articles.filter("url = 'u99'").first()["id"]
    assert rows(after.links.filter(F.col("entity_id") == grace), "article_id", "entity_id") == sorted([(10, grace), (u99, grace)])
    assert after.links.filter("entity_id = 3").count() == 0
    assert {r["outcome"]: r["n"] for r in state["summary"].collect()} == {"already": 1, "new": 1}


def test_recheck_and_label_ids(spark, corpus):
    facts = {"P31": ["Q43229"], "P27": ["Q30", "Q145"], "P19": ["Q84"], "P106": ["Q30"], "P108": []}
    kb = spark.createDataFrame([("Q1", json.dumps(facts))], "kb_id string, text string").selectExpr("kb_id", "from_json(text, 'map<string,array<variant>>') as statements")
    after = L.recheck(corpus, kb)
    assert {r["id"]: r["kb_status"] for r in after.entities.collect()} == {1: "not_person", 2: "not_person", 3: "not_person"}
    assert after.images.count() == 0
    assert kb.select(L.label_ids(F.col("statements"))).first()[0] == ["Q84", "Q30", "Q145"]


def test_resolved_mentions(spark, corpus):
    mentions = spark.createDataFrame([("Ada Lovelace", "x"), ("Orchid", "x"), ("Nobody Known", "x")], "raw_name string, source string")
    assert rows(K.resolved_stream(mentions, corpus.entities, corpus.aliases), "raw_name", "outcome") == [("Ada Lovelace", "slug"), ("Nobody Known", "new")]


def test_images_without_a_canonical_spread(spark):
    """Images that duplicate nothing are the most, and no task gets them all."""
    df = spark.range(2000).select("id", F.when(F.col("id") % 10 == 3, F.col("id") - 3).alias("duplicate_of"), F.concat(F.lit("u"), F.col("id")).alias("source_url"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = J.with_canonical(df).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r["id"], r["canonical_url"]) for r in got) == [(i, f"u{i - 3}" if i % 10 == 3 else None) for i in range(2000)]
    tasks = [r["task"] for r in got]
    assert max(tasks.count(t) for t in set(tasks)) < 1200


def test_more_links_are_more_tasks(spark, monkeypatch):
    """The pairs of an article's entities are made by as many tasks as there are links for."""
    monkeypatch.setattr(J, "LINKS_OF_TASK", 100)
    links = spark.createDataFrame([(i % 200, i // 200 + i % 3) for i in range(1000)], "article_id bigint, entity_id bigint")
    own = {}
    for r in links.distinct().collect():
        own.setdefault(r["article_id"], set()).add(r["entity_id"])
    want = {}
    for es in own.values():
        for p in ((a, b) for a in es for b in es if a < b):
            want[p] = want.get(p, 0) + 1
    found = J.cooccurrence(links)
    assert {(r["entity_a"], r["entity_b"]): r["shared"] for r in found.collect()} == want
    assert "RepartitionByExpression [article_id" in found._jdf.queryExecution().optimizedPlan().toString()
