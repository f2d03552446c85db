"""Column functions on hand-made cases."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressgrid.functions import dates as D, geometry as G, names as N, rules as R, vectors as V


def column(spark, values, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_names(spark):
    names = ["Ada Lovelace", "Anne Marie de Vries", "Cher", "Zoë Élan", "", None]
    assert column(spark, names, "string", N.canonical_name) == ["Lovelace, Ada", "Vries, Anne Marie de", "Cher", "Élan, Zoë", "", ""]
    assert column(spark, names, "string", N.slug) == ["lovelace-ada", "vries-anne-marie-de", "cher", "elan-zoe", "unknown", "unknown"]
    assert column(spark, ["Élan", "žižek", "3M", ""], "string", N.bucket_letter) == ["E", "Z", "#", "#"]
    assert column(spark, ["Éa", "ea", "éa", "Ža", "Za"], "string", lambda x: N.in_letter(x, "E")) == [True, True, False, False, False]
    assert column(spark, ["Ža", "Za"], "string", lambda x: N.in_letter(x, "#")) == [True, False]
    assert column(spark, ["Lovelace, Ada", "Cher"], "string", N.sort_key) == ["Ada Lovelace", "Cher"]
    assert column(spark, ["Ἀθῆναι Été", None], "string", N.fold_any) == ["αθηναι ete", None]
    assert column(spark, ["L'Été à 12h!"], "string", N.tokens) == [["l", "ete", "a", "12h"]]


def test_variants(spark):
    df = spark.createDataFrame([("Lovelace, Ada", ["A. L.", ""]), ("Cher", None)], "name string, aliases array<string>")
    assert [r[0] for r in df.select(N.name_variants(F.col("name"), F.col("aliases"))).collect()] == [["Lovelace, Ada", "Ada Lovelace", "A. L."], ["Cher"]]
    assert [r[0] for r in df.select(N.natural_name(F.col("name"), F.col("aliases"))).collect()] == ["A. L.", "Cher"]


def test_dates(spark):
    day = datetime.date
    assert column(spark, ["Tue, 12 May 2026 08:30:00 +0200", "12 May 2026 08:30:00 GMT", "2026-05-12T08:30:00", "2026-05-12", "yesterday", "", None], "string", D.parse_pub_date) == [day(2026, 5, 12)] * 4 + [None] * 3
    assert column(spark, ["+1955-02-24T00:00:00Z", "-0044-03-15T00:00:00Z", "+1955-00-00T00:00:00Z", "+1955-02-30T00:00:00Z", "junk", None], "string", D.parse_kb_time) == [day(1955, 2, 24), day(44, 3, 15), None, None, None, None]
    assert column(spark, [day(2024, 12, 30), None], "date", lambda x: F.when(x.isNotNull(), D.period_key(x, "week"))) == ["2025-W01", None]
    df = spark.createDataFrame([(day(1950, 6, 1), day(2000, 5, 31)), (day(1950, 6, 1), day(2000, 6, 1)), (day(2000, 1, 1), day(1999, 1, 1)), (None, day(2000, 1, 1))], "b date, d date")
    assert [r[0] for r in df.select(D.age_at_death(F.col("b"), F.col("d"))).collect()] == [49, 50, None, None]
    with pytest.raises(ValueError):
        D.period_key(F.lit(None), "year")


def test_geometry(spark):
    assert column(spark, [0.0, -14.9, 15.0, 30.0, -15.0, None], "double", G.classify_pose) == ["front", "front", "right", "right", "left", None]
    df = spark.createDataFrame([(50.0, 40.0, 60.0), (60.0, 40.0, 60.0), (50.0, 50.0, 50.0)], "n double, l double, r double")
    assert [r[0] for r in df.select(G.estimate_yaw(F.col("n"), F.col("l"), F.col("r"))).collect()] == [0.0, 30.0, 0.0]
    m = spark.range(1).select(G.align_matrix(*map(F.lit, (100.0, 100.0, 140.0, 130.0))).alias("m")).first()["m"]
    for (x, y), want in (((100, 100), (110, 105)), ((140, 130), (190, 105))):
        assert (m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5]) == pytest.approx(want)
    blob = np.array([0.5, 0.25, 1, 0], "<f4").tobytes()
    assert column(spark, [blob, blob[:12], b"abc", None], "binary", G.decode_mesh) == [[(0.5, 0.25), (1.0, 0.0)], None, None, None]


def test_vectors(spark):
    rng = random.Random(2)
    rows = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(20)]
    got = column(spark, rows, "array<double>", V.median_bits)
    for values, bits in zip(rows, got):
        median = sorted(values[1:])[31]
        assert bits % (1 << 64) == sum(1 << i for i, v in enumerate(values) if v > median)
    assert column(spark, [[3.0, 4.0], [0.0, 0.0]], "array<double>", V.l2_normalize) == [[0.6, 0.8], [0.0, 0.0]]
    df = spark.createDataFrame([(5, 5), (0, -1), (0, 1)], "a bigint, b bigint")
    assert [r[0] for r in df.select(V.hamming64(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0, 1 / 64]
    image = np.random.default_rng(5).random((32, 32)) * 255
    same = column(spark, [image.ravel().tolist(), (image * 0.5 + 20).ravel().tolist(), [1.0]], "array<double>", V.phash)
    assert same[0] is not None and bin((same[0] ^ same[1]) % (1 << 64)).count("1") <= 2 and same[2] is None


def test_simhash_of_near_texts(spark):
    from pressgrid.operators.similarity import simhashes

    words = [f"w{i}" for i in range(200)]
    texts = [words, [*words[:-3], "x", "y", "z"], [f"v{i}" for i in range(200)], []]
    got = {r["id"]: r["hash64"] for r in simhashes(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id bigint, text string"), ["id"], "text").collect()}
    near, far = (bin((got[0] ^ got[k]) % (1 << 64)).count("1") for k in (1, 2))
    assert near < 12 < far and 3 not in got


def test_rules(spark):
    assert column(spark, ["https://a.b/c", "nonsense", None], "string", R.url_host) == ["a.b", "", ""]
    assert column(spark, ["https://a/x.JPEG?y", "https://a/x.gif", "https://a/x.bmp", None], "string", R.guess_ext) == [".jpg", ".gif", ".jpg", ".jpg"]
    assert column(spark, ["https://a/x.gif"], "string", lambda x: R.guess_ext(x, gif=False)) == [".jpg"]
    assert column(spark, ["a| b||", None], "string", R.pipe_list) == [["a", "b"], []]
    assert column(spark, ["Portrait of X", "portrait", "Portrait and crowd", None], "string", lambda x: R.caption_rule(x, ["Portrait"], ["crowd"])) == [True, False, False, False]
    assert column(spark, [0, 1, 30, 60], "int", lambda x: R.heat_level(x, F.lit(60))) == [0.0, 0.18, 0.5, 1.0]
    assert column(spark, [3, 0], "int", lambda x: R.safe_ratio(F.lit(1), x, 2, None)) == [0.33, None]
    images = [[{"url": "https://a/1", "alt": "A", "title": ""}, {"url": "data:x", "alt": None, "title": "t"}, {"url": "http://a/2", "alt": None, "title": "T"}]]
    assert [[tuple(x) for x in y] for y in column(spark, images, "array<struct<url string, alt string, title string>>", R.feed_candidates)] == [[("https://a/1", "A", "A"), ("http://a/2", None, "T")]]
    assert not math.isnan(column(spark, [2], "int", R.diversity_note)[0] is None)


def test_statements(spark):
    df = spark.createDataFrame([("""{"P31": ["Q5", "x", {"id": "Q7"}], "P569": [{"time": "+1955-02-24T00:00:00Z"}, {"time": "+1955-00-00T00:00:00Z"}, "+1956-01-02"]}""",)], "j string")
    s = df.select(F.from_json("j", "map<string, array<variant>>").alias("s"))
    got = s.select(R.statement_ids(F.col("s"), "P31").alias("ids"), R.statement_ids(F.col("s"), "P9").alias("none"), R.statement_dates(F.col("s"), "P569").alias("days")).first()
    assert got["ids"] == ["Q5"] and got["none"] == [] and got["days"] == [datetime.date(1955, 2, 24), datetime.date(1956, 1, 2)]


def test_simhash_takes_32_sums(spark):
    """Two bits a sum, each as if counted alone, also where every token or none has it."""
    from pressgrid.operators.similarity import simhashes

    for hashes in ([-1, -1, -1], [0, 0], [-(1 << 63), 1 << 31, -1], [1 << 32, 1, 1 << 32 | 1], [(1 << 31) - 1] * 5):
        df = spark.createDataFrame([(1, " ".join(f"t{i}" for i in range(len(hashes))))], "id bigint, text string")
        own = F.create_map(*[F.lit(x) for i, h in enumerate(hashes) for x in (f"t{i}", h)])
        found = simhashes(df, ["id"], "text", lambda token: own[token].cast("bigint"))
        want = sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))
        assert found.first()["hash64"] == (want - (1 << 64) if want >> 63 else want)
        plan = found._jdf.queryExecution().analyzed()
        while plan.nodeName() != "Aggregate":
            plan = plan.children().head()
        assert plan.aggregateExpressions().size() <= 34  # the id, the count and 32 sums


def test_simhash_makes_no_row_per_token(spark, monkeypatch):
    """A text's sums come from its list of tokens; rows of the same keys, texts without tokens and long ones count as ever."""
    import hashlib

    from pressgrid.operators import similarity

    monkeypatch.setattr(similarity, "BATCH_TOKENS", 300)
    words = ["Été", "ada", "ADA", "x1", "日本", *[f"w{i}" for i in range(60)]]
    data = [(i, None if i % 4 == 3 else "s", " - ".join(words[k * (i + 3) % len(words)] for k in range(i))) for i in range(40)]
    data += [(5, "s", "more of five"), (90, "s", None), (91, "s", " .,- "), (92, "s", "many words " * 40000 + "two two"), (5, "s", None)]
    bags = {}
    for i, s, text in data:
        bags.setdefault((i, s), []).extend((text or "").lower().replace("é", "e").replace(" - ", " ").replace(" .,- ", "").split())

    def plain(bag):
        hashes = [int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big") for w in bag]
        bits = sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))
        return bits - (1 << 64) if bits >> 63 else bits

    want = {k: plain(bag) for k, bag in bags.items() if bag}
    df = spark.createDataFrame(data, "id bigint, source string, text string").repartition(3)
    for hashed in (similarity.md5_64, lambda token: similarity.md5_64(token)):
        found = similarity.simhashes(df, ["id", "source"], "text", hashed)
        assert {(r["id"], r["source"]): r["hash64"] for r in found.collect()} == want and len(want) == 40
        assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_simhash_takes_plain_texts_apart_as_tokens_are(spark):
    """All characters of the first planes, broken UTF-8, and texts of nothing but separators: numpy's tokens are those of ``tokens``."""
    from pressgrid.operators import similarity

    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"x{chr(c)}Y{chr(c)} {chr(c)}q" for c in points[i:i + 64]) for i in range(0, len(points), 64)]
    texts += [chr(c) for c in range(128)] + ["", "  ", "A", " a B.c\n", "\x00A\x00", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    df = df.unionByName(spark.sql("select -id as id, cast(unhex(h) as string) as text from values (1L, '41FF62'), (2L, '618062'), (3L, 'C3'), (4L, '41C3A9FF'), (5L, 'FF') as t(id, h)"))
    own, plain = (similarity.simhashes(df, ["id"], "text", h) for h in (similarity.md5_64, lambda token: similarity.md5_64(token)))
    assert (found := {tuple(r) for r in own.collect()}) == {tuple(r) for r in plain.collect()} and len(found) > 3000
    assert df.filter("text = 'A'").select(similarity.spaced(df["text"])).first()[0] == "A"  # sent as it is
