"""Training-data operators: odd tables, brute force, round trips, held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pressgrid.llm import exact_dedup, fuzzy_lines, langid, minhash, mixing, packing, queries, rare, shingles, topk, toxicity, url_filter, warc
from pressgrid.llm.graph import connected_components
from tests.conftest import SMALL
from tests.helpers import assert_same

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
ODD = [
    (1, "alpha beta gamma delta epsilon zeta", "a"), (2, "alpha beta gamma delta epsilon zeta", "a"), (2, "alpha beta gamma delta epsilon zeta", "a"),
    (3, None, "b"), (4, "", None), (5, " \t\n", "b"), (6, LONG, "c"), (7, LONG + " end", "c"), (8, "ALPHA  beta\tgamma delta epsilon zeta", None),
    (9, "Öl für Éva — 12 < 13", "a"), (10, "one", "b"), (None, "no id here", "a"),
]


def odd_docs(spark, rows=ODD):
    """Documents with nulls, repeats, ties and columns whose names clash with the operators' own."""
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("lang", F.when(F.col("doc_id") < 9, "en"))
    for k in ("id", "size", "bucket", "rep", "kept", "length", "component", "text_sha256", "n", "target", "mix_copies"):
        df = df.withColumn(k, F.lit("clash"))
    return df


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, duck, name):
    assert_same(queries.QUERIES[name](spark, SMALL), duck, queries.SQL[name])


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {x: find(x) for x in parent}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


# ---- near duplicates

def brute_near(rows, size=2, percent=80):
    sets = {}
    for i, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[k:k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
    comp = {i: i for i in sets}
    changed = True
    near = [(a, b) for a in sets for b in sets if a is not None and b is not None and a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in near:
            low = min(comp[a], comp[b])
            changed |= comp[a] != low or comp[b] != low
            comp[a] = comp[b] = low
    return {i: (len(sets[i]), comp[i]) for i in sets}


def test_near_odd(spark):
    got = minhash.near_duplicates(odd_docs(spark), 2).collect()
    want = brute_near(ODD)
    assert len(got) == len(ODD)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)


def test_near_group_of_edited_copies(spark):
    """Many copies with edits of a base, and many documents with a passage in common, against brute force."""
    rng = random.Random(4)
    base = [f"t{rng.randrange(5000)}" for _ in range(90)]
    passage = [f"p{i}" for i in range(25)]
    rows = []
    for i in range(220):
        words = list(base)
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(words), "s"))
    rows += [(300 + i, " ".join(passage + [f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 40))]), "s") for i in range(120)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), 2).collect()}
    assert got == brute_near(rows)


def test_near_empty(spark):
    assert minhash.near_duplicates(odd_docs(spark, [])).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 1200).astype(np.uint64)
    x, y = a[:1000], a[200:]
    s, t = minhash.circulant_signature(x, 1024), minhash.circulant_signature(y, 1024)
    assert abs((s == t).mean() - 800 / 1200) < 0.06
    apart = sum(int(v).bit_count() for v in (minhash.lowest_bits(s[:256]) ^ minhash.lowest_bits(t[:256])).view(np.uint64))
    assert abs(apart - 256 * (1 - 800 / 1200) / 2) < 26


# ---- WARC

def test_warc_round_trip(spark):
    page = "<p>" + "é" * 800 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n</p>"
    rows = [(1, "http://a.example/x", page), (2, "http://a.example/y", page), (3, None, page), (4, "no url", "short"), (5, "http://b.example", "short"), (6, "http://c.example", None), (7, "http://d.example", ""),
            (8, "http://e.example", "x" * 300_000), (None, "http://f.example", page)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("payload", F.lit("clash")).withColumn("key", F.lit("clash"))
    got = {r["page_id"]: r for r in warc.archive_round_trip(df).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("revisit", 3) if html == page and i != 3 and i is not None else ("response", None))


def test_warc_payloads_and_parts(spark, tmp_path):
    rows = [(1, "http://a.example/x?q=ü z", "Grüße\r\n\r\n"), (2, "http://a.example/", "b" * 2000), (3, "http://a.example/", "b" * 2000)]
    path = f"file://{tmp_path}/archive"
    warc.write_archive(spark.createDataFrame(rows, "page_id bigint, url string, html string"), path)
    got = {r["metadata"]["fields"]: r for r in warc.assemble(warc.read_archive(spark, path)).collect()}
    assert bytes(got["page: 1\r\n"]["response"]["payload"]) == "Grüße\r\n\r\n".encode()
    assert got["page: 2\r\n"]["response"]["payload"] is None and got["page: 2\r\n"]["response"]["kind"] == "revisit"
    assert all(r["request"]["record_id"] for r in got.values())


def test_warc_repeated_ids_and_long_pages(spark):
    """Rows of one page_id with different payloads, and a page of 50 MB in a file of its own."""
    a, b, long = "a" * 1500, "b" * 1500, "<p>long page</p>" * (50 * 65_536)
    rows = [(5, "http://x.example/", a), (5, "http://x.example/", b), (9, "http://y.example/", a), (11, "http://z.example/", long), (12, "http://z.example/", "c" * 70_000)]
    got = warc.archive_round_trip(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    want = [(i, len(h), hashlib.sha1(h.encode()).hexdigest(), "revisit" if (i, h) == (5, a) else "response", 9 if (i, h) == (5, a) else None) for i, _, h in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_warc_empty(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


# ---- exact duplicates

def test_exact_odd(spark):
    groups = defaultdict(list)
    for i, text, _ in ODD:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), i is None, i or 0, i))
    want = sorted((str(i), str(min(groups[k])[3]), len(groups[k]), hashlib.sha256(k.encode()).hexdigest()) for k in groups for *_, i in groups[k])
    got = exact_dedup.deduplicate(odd_docs(spark)).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)
    assert exact_dedup.deduplicate(odd_docs(spark, [])).count() == 0


# ---- packing

def check_packing(rows, got):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
    want = []
    for i, text, *_ in rows:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(str(i), k, a, len(ids[a:a + 2048]), zlib.crc32(ids[a:a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    ends = defaultdict(int)
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values(), default=0) <= 2048
    return len(ends), -(-sum(ends.values()) // 2048)


def test_packing_odd(spark):
    used, least = check_packing(ODD, packing.pack(odd_docs(spark)).collect())
    assert used <= least + 1
    assert packing.pack(odd_docs(spark, [])).count() == 0


def test_packing_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    used, least = check_packing([(r["doc_id"], r["text"]) for r in docs.collect()], packing.pack(docs).collect())
    assert used <= least + 2


def test_plan_is_near_the_least(spark):
    rng = np.random.default_rng(2)
    lengths = np.minimum(2048, np.exp(rng.normal(6, 1, 20_000)).astype(int) + 1)
    places = packing.plan({int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True))})
    ends, covered = defaultdict(list), defaultdict(int)
    for length, first, count, at, offset in places:
        assert first == covered[length]
        covered[length] += count
        for k in range(count):
            ends[at + k].append((offset, length))
    for parts in ends.values():
        total = 0
        for offset, length in sorted(parts):
            assert offset == total
            total += length
        assert total <= 2048
    assert sum(covered.values()) == len(lengths) and len(ends) <= 1.004 * lengths.sum() / 2048 + 2


def test_word_encoder_equals_whole_texts():
    enc = packing.WordEncoder(packing.default_tokenizer(), known=40)
    rng = random.Random(3)
    letters = "abAB éÉİŸßΣσς'\"s.,!? \t\n\r\x0b\x1c\x1f\u00a0\u3000\u0301中文12٣😀ſŉ－—'ll isn't ИÅﬁ가\x85"
    for k in range(600):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(40))) + (" <|endoftext|>x" if k % 5 == 0 else "")
        assert enc.encode(pa.array([text]))[0] == np.array(enc.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_word_encoder_with_another_tokenizer():
    """Tokenizers that don't work word by word encode whole texts."""
    import public_tokenizers

    enc = packing.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["Two words,  and\n\nmore Words", None, "", "x"]
    assert not enc.by_words
    assert enc.encode(pa.array(texts)) == [np.array(enc.tokenizer.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_fit_is_the_least_squares_solution():
    """Counts against non-negative least squares by projected gradients, on a small histogram."""
    rng = np.random.default_rng(7)
    histogram = np.zeros(65, np.int64)
    histogram[rng.integers(5, 60, 14)] = rng.integers(50, 900, 14)
    sets = packing.patterns(np.flatnonzero(histogram), 64)
    a = np.zeros((65, len(sets)))
    for k, row in enumerate(sets):
        for x in row[row > 0]:
            a[x, k] += 1
    x, step = np.zeros(len(sets)), 1 / np.linalg.norm(a, 2) ** 2
    for _ in range(60_000):
        x = np.maximum(0, x - step * (a.T @ (a @ x - histogram)))
    got = packing.fit_counts(sets, histogram, 60_000)
    assert (got >= 0).all() and len(sets) > 3
    assert np.linalg.norm(a @ got - histogram) <= np.linalg.norm(a @ x - histogram) + 2


# ---- lines

def brute_lines(rows, width=8, percent=80):
    lines, sets = [], {}
    for i, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            line = line.strip(" \t\n\x0b\x0c\r")
            if line:
                lines.append((i, k, line))
                sets[line] = {line[a:a + width] for a in range(max(1, len(line) - width + 1))}
    names = list(sets)
    group = {x: x for x in names}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, x in enumerate(names):
        for y in names[a + 1:]:
            if 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                group[find(x)] = find(y)
    first = {}
    for i, k, line in sorted(lines):
        first.setdefault(find(line), (i, k))
    return {(i, k): first[find(line)] for i, k, line in lines}


def test_lines_brute_force(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    bases = [" ".join(word() for _ in range(rng.randrange(6, 130))) for _ in range(30)]
    rows = []
    for i in range(60):
        own = []
        for b in rng.sample(bases, 4):
            if rng.random() < 0.5:
                at = rng.randrange(len(b))
                b = b[:at] + "X" + b[at + 1:]
            own.append(b)
        rows.append((i, "\n".join([*own, "", "  tiny ", "ü" * rng.randrange(1, 4), word()])))
    rows += [(100, None), (101, ""), (102, "\n \n")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("line", F.lit("clash")).withColumn("k1", F.lit("clash"))
    got = fuzzy_lines.fuzzy_lines(df).collect()
    want = brute_lines(rows)
    found = {(r["doc_id"], r["line_no"]): (r["class_doc"], r["class_line"]) for r in got}
    assert found.keys() == want.keys()
    assert sum(found[k] == want[k] for k in want) >= 0.995 * len(want)
    assert all(r["kept"] == ((r["doc_id"], r["line_no"]) == (r["class_doc"], r["class_line"])) for r in got)
    kept = {r["doc_id"]: r["text"] for r in fuzzy_lines.without_repeats(df, fuzzy_lines.fuzzy_lines(df)).collect()}
    assert len(kept) == len(rows) and kept[100] is None and kept[102] == "\n \n"


def test_lines_of_any_length_meet(spark):
    """One set of shingles, repeated to 42 and to 120 words."""
    rows = [(1, "ab cd ef gh ij kl " * 7), (2, "ab cd ef gh ij kl " * 20), (3, "mn op qr st uv wx " * 400), (4, "mn op qr st uv wx " * 2)]
    got = {r["doc_id"]: r["class_doc"] for r in fuzzy_lines.fuzzy_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3}


def test_lines_recall_on_a_table(spark):
    """Links of all different lines, found exactly through an inverted index over shingles, against the operator's classes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = {}
    for r in docs.collect():
        for k, line in enumerate((r["text"] or "").split("\n")):
            if line := line.strip(" \t\n\x0b\x0c\r"):
                lines.setdefault(line, (r["doc_id"], k))
    names = list(lines)
    sets = [{x[a:a + 8] for a in range(max(1, len(x) - 7))} for x in names]
    held = defaultdict(int)
    for own in sets:
        for x in own:
            held[x] += 1
    index, pairs = defaultdict(list), set()
    for i, own in enumerate(sets):
        rare = sorted(own, key=lambda x: (held[x], x))[:len(own) - -(-8 * len(own) // 10) + 1]  # linked lines share one of these
        for x in rare:
            pairs.update((j, i) for j in index[x] if 8 * len(own) <= 10 * len(sets[j]) and 8 * len(sets[j]) <= 10 * len(own))
            index[x].append(i)
    links = [(a, b) for a, b in pairs if 100 * (n := len(sets[a] & sets[b])) >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    group = {(r["doc_id"], r["line_no"]): (r["class_doc"], r["class_line"]) for r in fuzzy_lines.fuzzy_lines(docs).collect()}
    met = [group[lines[names[a]]] == group[lines[names[b]]] for a, b in links]
    assert len(met) > 100 and np.mean(met) >= 0.99


def test_lines_template_with_unlinked_variants(spark):
    """Lines that share half of their text with a template and are linked with none, beside variants that are."""
    rng = random.Random(12)
    stem = " ".join(f"stem{i}" for i in range(20))
    rows = [(i, stem + " " + " ".join(f"v{rng.randrange(10**6)}" for _ in range(rng.choice([1, 2, 14, 18])))) for i in range(120)]
    got = {(r["doc_id"], r["line_no"]): (r["class_doc"], r["class_line"]) for r in fuzzy_lines.fuzzy_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = brute_lines(rows)
    assert np.mean([got[k] == want[k] for k in want]) >= 0.99


def test_lines_of_a_large_unlinked_group(spark):
    """2,000 lines with a stem in common, of a similarity of about 0.6, and some of them with a near copy: no all-pairs comparison."""
    rng = random.Random(13)
    stem = " ".join(f"stem{i}" for i in range(30))
    word = lambda: f"v{rng.randrange(10**8):08d}"
    lines = [" ".join([stem, *(word() for _ in range(7))]) for _ in range(2000)]
    lines += [x + " x" for x in lines[:200]]
    rows = list(enumerate(lines))
    got = {r["doc_id"]: r["class_doc"] for r in fuzzy_lines.fuzzy_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sum(got[2000 + i] == i for i in range(200)) >= 199
    assert all(got[i] == i for i in range(2000))


def families(rng, count, copies):
    """Texts that share some 0.5 to 0.95 of their shingles with others, several repeating themselves."""
    rows = []
    for _ in range(count):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([3, 20, 60]))] * rng.choice([1, 1, 3])
        rows += [" ".join(w if rng.random() > rng.choice([0.01, 0.03, 0.06]) else f"n{rng.randrange(10**6)}" for w in words) for _ in range(copies)]
    return rows


def test_lines_that_share_a_bucket_are_all_decided(spark, monkeypatch):
    """Lines outside their leader's component are compared inside their buckets, not by shingles that the whole table may share."""
    def refused(*_):
        raise AssertionError("no bucket is large")

    monkeypatch.setattr(fuzzy_lines, "further_links", refused)
    rows = list(enumerate(families(random.Random(15), 8, 20)))
    got = {(r["doc_id"], r["line_no"]): (r["class_doc"], r["class_line"]) for r in fuzzy_lines.fuzzy_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = brute_lines(rows)
    assert np.mean([got[k] == want[k] for k in want]) >= 0.99


def test_maps_rule_no_link_out(spark):
    lines = families(random.Random(16), 10, 10)
    sets = [{x[a:a + 8] for a in range(max(1, len(x) - 7))} for x in lines]
    links = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    texts = spark.createDataFrame(list(enumerate(lines)), "node bigint, line string")
    pairs = spark.createDataFrame([(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))], "a bigint, b bigint")
    kept = fuzzy_lines._alike(pairs, fuzzy_lines._maps(texts, 8), 80)
    found = {(r["a"], r["b"]) for r in kept.collect()}
    assert links <= found and len(found) < pairs.count() / 2
    assert {(r["a"], r["b"]) for r in fuzzy_lines._links(kept, texts, 8, 80).collect()} == links


def test_rare_shingles_leave_no_link_out(spark):
    rng = random.Random(14)
    bases = [rng.sample(range(400), 60) for _ in range(6)]
    sets = [sorted({x if rng.random() > 0.08 else rng.randrange(10**6) for x in rng.choice(bases)}) for _ in range(150)] + [[5], [5, 6], [6]]
    frame = spark.createDataFrame(list(enumerate(sets)), "node bigint, shingles array<bigint>")
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * (n := len(set(sets[i]) & set(sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - n)}
    near = frame.sparkSession.createDataFrame(sorted(want), "a bigint, b bigint")
    alone = frame.select("node", F.lit(1).cast("bigint").alias("weight"), F.col("node").alias("part"))
    none = near.limit(0)
    asked = []

    def verify(pairs):
        asked.extend((r["a"], r["b"]) for r in pairs.collect())
        return pairs.join(near, ["a", "b"])

    found = {(r["a"], r["b"]) for r in rare.further_links(alone, frame, 80, none, verify).collect()}
    group = brute_groups(range(len(sets)), found)
    assert found <= want and len(want) > 100 and group == brute_groups(range(len(sets)), want)
    assert len(asked) == len(set(asked))
    assert rare.further_links(alone.limit(0), frame.limit(0), 80, none, verify).count() == 0


def brute_groups(ids, links):
    least = {i: i for i in ids}
    for _ in least:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return least


def test_lines_run_without_python(spark):
    """No signature, verification or decision leaves the JVM: nothing of the plans asks for a Python worker."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    occurrences, nodes, links = fuzzy_lines.line_links(docs, 8, 80, 10, 11)
    plans = [fuzzy_lines._signatures(docs, 8, 11), fuzzy_lines._links(links, nodes.withColumn("line", F.lit("x")), 8, 80), fuzzy_lines.fuzzy_lines(docs)]
    for df in plans:
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in text and "Arrow" not in text and "Pandas" not in text


def test_lines_taken_out_of_odd_tables(spark):
    rows = [(1, "a line to keep\nsecond line"), (1, "other text of the id\nsecond line"), (None, "a line to keep\nno id"), (2, None), (3, "a line to keep")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("meta.url", F.lit("clash")).withColumn("gone", F.lit("clash")).withColumn("kept", F.lit("clash"))
    out = fuzzy_lines.without_repeats(docs, fuzzy_lines.fuzzy_lines(docs))
    assert out.columns == docs.columns
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in out.collect()) == sorted([("1", "a line to keep\nsecond line"), ("1", "other text of the id\nsecond line"), ("None", "no id"), ("2", "None"), ("3", "")])


def test_lines_empty(spark):
    assert fuzzy_lines.fuzzy_lines(odd_docs(spark, [])).count() == 0


def test_shingle_sets_of_pieces(monkeypatch):
    """Texts of any length, in pieces and whole: as many shingles as by slicing, and shared ones alike."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("abü😀 ") for _ in range(rng.choice([1, 2, 7, 8, 9, 30, 31, 32, 33, 200]))) for _ in range(80)]
    slices = []
    for t in texts:
        u = t.encode("utf-16-le")
        slices.append({u[i:i + 16] for i in range(0, max(1, len(u) - 15), 2)})
    whole = list(shingles.sets(texts, 8))
    monkeypatch.setattr(shingles, "CHUNK", 24)
    pieces = list(shingles.sets(texts, 8))
    assert [len(x) for x in whole] == [len(x) for x in slices] and all((a == b).all() for a, b in zip(whole, pieces, strict=True))
    for i in range(0, 80, 7):
        for j in range(80):
            assert len(np.intersect1d(whole[i], whole[j])) == len(slices[i] & slices[j])
    assert list(shingles.sets([], 8)) == []


# ---- language

def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.language_of(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").select("lang_pred", "lang", "score").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.97 and all(0 <= r["score"] <= 1 for r in got)


def test_language_scores_by_hand(spark):
    """Predictions and cosines from the profiles, trigram by trigram in plain Python."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    profiles = langid.learn_profiles(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, profiles).collect()}
    for r in docs.limit(40).collect():
        codes, counts = langid.trigrams(r["text"])
        if not len(codes):
            assert got[r["doc_id"]] == ("und", 0.0)
            continue
        total = np.zeros(langid.DIMENSIONS)
        for code, n in zip(codes.tolist(), counts.tolist()):
            total += np.asarray(langid.bundle(np.array([code], codes.dtype), np.array([n], counts.dtype), langid.DIMENSIONS), float)
        near = {k: float(np.dot(v, total) / np.linalg.norm(total)) for k, v in profiles.items()}
        assert got[r["doc_id"]][0] == max(near, key=near.get) and got[r["doc_id"]][1] == pytest.approx(max(near.values()), abs=1e-3)


def test_language_odd(spark):
    got = {r["doc_id"]: r for r in langid.language_of(odd_docs(spark)).collect()}
    assert {i for i, r in got.items() if r["lang_pred"] == "und"} == {3, 4, 5}
    assert len(langid.language_of(odd_docs(spark)).collect()) == len(ODD)
    assert langid.language_of(odd_docs(spark, [])).count() == 0
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got if i is not None)
    assert {r["lang_pred"] for r in langid.language_of(odd_docs(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# ---- top-k

def test_topk_odd(spark):
    rows = [(0, [0.5, 0.25]), (50, [0.5, 0.25]), (1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [-0.5, 0.1]), (7, [1.0]), (8, []), (9, [0.5, 0.25]), (10, [9.0, 9.0, 9.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("q", F.lit("clash")).withColumn("c", F.lit("clash"))
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    q = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for i in (0, 50):
        best = sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i)[:5]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# ---- mixing

def test_mixing_odd(spark):
    got = mixing.mix(odd_docs(spark)).collect()
    assert len(got) == len(ODD)
    assert all(r["taken"] % r["size"] == 0 and r["taken"] <= 3 * r["size"] if r["size"] else r["taken"] == 0 for r in got)
    assert sum(r["taken"] for r in got) <= sum(r["size"] for r in got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(odd_docs(spark)).collect()), key=str)
    assert mixing.mix(odd_docs(spark, [])).count() == 0
    assert [r["target"] for r in mixing.mix(odd_docs(spark, [(1, None, "a"), (2, " ", None)])).collect()] == [0.0, 0.0]


def test_targets(spark):
    def water(sizes, weights):
        total, target, open_ = sum(sizes), {}, set(range(len(sizes)))
        while open_:
            level = (total - sum(target.values())) / sum(weights[i] for i in open_)
            full = {i for i in open_ if level * weights[i] > 3 * sizes[i]}
            if not full:
                return [target.get(i, level * weights[i]) for i in range(len(sizes))]
            target |= {i: 3.0 * sizes[i] for i in full}
            open_ -= full
        return [target[i] for i in range(len(sizes))]

    rng = random.Random(8)
    for n in (1, 2, 3, 7, 20):
        sizes = [rng.choice([0, 1, 5, 100, 10_000]) + rng.randrange(3) for _ in range(n)]
        df = spark.createDataFrame([(f"s{i:03d}", s) for i, s in enumerate(sizes)], "source string, source_size bigint")
        got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
        assert [got[f"s{i:03d}"] for i in range(n)] == pytest.approx(water(sizes, [(5, 2, 1)[i % 3] for i in range(n)]))


# ---- URLs

def test_urls_rules(spark):
    rows = [(1, "HTTP://A.Example.ORG/es/x"), (2, "https://example.org/en/1?x"), (3, "https://x.org"), (4, "https://x.org/#/es/"), (5, "http://a.com/de/q"), (6, "http://a.com/fr/"), (7, None), (8, "nothing"), (9, "https://notexample.org/es/"), (10, "x://H/p://y/z"), (10, "x://H/p://y/z"), (None, "https://n.net/")]
    df = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("host", F.lit("clash")).withColumn("bad", F.lit("clash"))
    none = spark.createDataFrame([], "page_id bigint, bad boolean")
    got = sorted((str(r["page_id"]), r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df, none).fillna("-", ["rule"]).collect())
    assert got == sorted([
        ("1", "a.example.org", "/es/x", "example.org/es/", "block"), ("2", "example.org", "/en/1", "example.org/en/1", "block"), ("3", "x.org", "", "-", "allow"), ("4", "x.org", "/", "org/", "allow"),
        ("5", "a.com", "/de/q", "com/de/", "block"), ("6", "a.com", "/fr/", "com/fr/", "allow"), ("7", "", "", "-", "allow"), ("8", "", "", "-", "allow"), ("9", "notexample.org", "/es/", "org/", "allow"),
        ("10", "h", "/p://y/z", "-", "allow"), ("10", "h", "/p://y/z", "-", "allow"), ("None", "n.net", "/", "-", "allow")])
    assert url_filter.filter_urls(df.limit(0), none).count() == 0


def brute_force_verdicts(items, marks, support=0.002, min_rows=5):
    """Blocks what holds any combination of up to three items that is frequent, confident and lifted among the labels."""
    from itertools import combinations

    total, bads = len(marks), sum(marks.values())
    count, bad_count = defaultdict(int), defaultdict(int)
    for i, bad in marks.items():
        for n in (1, 2, 3):
            for c in combinations(sorted(items[i]), n):
                count[c] += 1
                bad_count[c] += bad
    least = max(support, min_rows / total) * total - 1e-9
    rules = [c for c in count if bad_count[c] >= least and bad_count[c] >= 0.5 * count[c] and bad_count[c] / count[c] >= 1.5 * bads / total]
    assert rules
    by_item = defaultdict(list)
    for c in rules:
        by_item[c[0]].append(set(c))
    return {i: "block" if any(held.issuperset(c) for x in held for c in by_item.get(x, ())) else "allow" for i, held in items.items()}


def assert_verdicts(spark, rows, labels, **least):
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    host, path = url_filter.url_host(F.col("url")), url_filter.url_path(F.col("url"))
    items = {r[0]: set(r[1]) for r in pages.select("page_id", url_filter.url_tokens(host, path, F.col("url"))).collect()}
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages, spark.createDataFrame(labels, "page_id bigint, bad boolean"), **least).collect()}
    assert got == brute_force_verdicts(items, dict(labels), least.get("min_support", 0.002))
    return got


def random_pages(n=400, seed=9):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        host, lang, key = rng.choice(["a", "spam", "c"]), rng.choice(["en", "de"]), rng.choice(["x", "y"])
        rows.append((i, f"https://{host}.example.net/{lang}/{rng.choice(['buy', 'read'])}?{key}=1"))
        bad = (host == "spam" and key == "x") or rng.random() < 0.05
        if i % 2 == 0:
            labels.append((i, bad))
    return rows, labels


def test_urls_mined_rules_against_brute_force(spark):
    assert_verdicts(spark, *random_pages(), min_support=0.03)


def test_urls_level_by_level(spark, monkeypatch):
    """Where rows are too wide for FP-growth the same rules come from counting by levels."""
    monkeypatch.setattr(url_filter, "WIDE", 1)
    assert_verdicts(spark, *random_pages(240, 3), min_support=0.03)


def test_urls_items_that_coincide_among_labels_alone(spark):
    """Items that only the labelled rows have together each stand for themselves on other pages, alone and in pairs."""
    rows = [(i, f"https://spam.example.net/p/{i}") for i in range(20)] + [(20 + i, f"https://c.example.net/p/{i}") for i in range(20)]
    labels = [(i, i < 20) for i in range(40)]
    rows += [(50, "https://spam.other.net/a/7"), (51, "https://c.other.net/a/7"), (52, "https://x.spam.example.net/")]
    # q and r coincide, and are bad with k alone; a third of both is good.
    rows += [(100 + i, f"https://h{i}.net/q/r" + ("?k=1" if i < 20 else "")) for i in range(50)] + [(200 + i, f"https://g{i}.net/z?k=1") for i in range(30)]
    labels += [(100 + i, i < 20) for i in range(50)] + [(200 + i, False) for i in range(30)]
    rows += [(300, "https://n1.net/q?k=2"), (301, "https://n2.net/r?k=2"), (302, "https://n3.net/q/r"), (303, "https://n4.net/s?k=2")]
    got = assert_verdicts(spark, rows, labels)
    assert got[50] == got[300] == got[301] == "block" and got[51] == got[302] == got[303] == "allow"


def test_urls_of_fifteen_items(spark):
    rng = random.Random(2)
    rows = [(i, "https://w.net/" + "/".join(sorted({f"s{rng.randrange(30)}" for _ in range(15)}))) for i in range(300)]
    labels = [(i, "s1/" in u and "s2" in u) for i, u in rows if i % 3]
    assert_verdicts(spark, rows, labels)


def test_urls_with_very_many_segments(spark):
    """Bad pages with a long path in common, and some with other paths of their own: mined in seconds, blocked all."""
    import time

    path = "/".join(f"s{i}" for i in range(40))
    rows = [(i, f"https://long.example.net/{path}/{i}") for i in range(10)] + [(10 + i, f"https://fine.example.net/p{i % 7}/q{i % 5}") for i in range(60)]
    rows += [(100 + i, "https://mixed.example.net/" + "/".join(f"t{k}" for k in range(40) if k != i)) for i in range(20)]
    labels = spark.createDataFrame([(i, i < 10 or i >= 100) for i, _ in rows], "page_id bigint, bad boolean")
    began = time.perf_counter()
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id bigint, url string"), labels).collect()}
    assert time.perf_counter() - began < 60
    assert got == {i: "block" if i < 10 or i >= 100 else "allow" for i, _ in rows}


# ---- toxicity

def plain_features(text):
    """Hashed features of a text, written apart from the module: different words, and their first 4, 5 and 6 letters."""
    import xxhash

    words, word = set(), ""
    for c in (text or "").lower() + " ":
        if c.isalnum() and not c.isdecimal():
            word += c
        else:
            words.add(word)
            word = ""
    parts = [{"w" + w} | {"p" + w[:n] for n in (4, 5, 6) if len(w) >= n} for w in words - {""}]
    return [xxhash.xxh32(x.encode()).intdigest() % (1 << 22) for own in parts for x in own]


def test_toxicity_scores_by_hand(spark):
    """Every row's expected severity from the model's weights and thresholds, in plain Python."""
    import math

    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    model = toxicity.fit_toxicity(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    assert model.weights
    got = {r["doc_id"]: r["expected_severity"] for r in docs.select("doc_id", "text").mapInArrow(toxicity._score(model), "doc_id bigint, severity int, expected_severity double").collect()}
    for r in docs.collect():
        score = sum(model.weights.get(f, 0.0) for f in plain_features(r["text"]))
        assert got[r["doc_id"]] == pytest.approx(sum(1 / (1 + math.exp(min(40, max(-40, t - score)))) for t in model.thresholds), abs=2e-6)


def test_toxicity_gradient():
    """The first step of the fit is that of the numeric gradient of the cumulative-link likelihood, for weights and thresholds."""
    rng = np.random.default_rng(1)
    rows = [rng.choice(12, rng.integers(0, 6)) for _ in range(50)]
    grades = rng.integers(0, 4, 50)
    start = np.linspace(1.0, 3.0, 3)

    def loss(w, theta):
        total = 0.0
        for r, g in zip(rows, grades):
            above = [1.0, *(1 / (1 + np.exp(t - w[r].sum())) for t in theta), 0.0]
            total -= np.log(above[g] - above[g + 1])
        return total / len(rows)

    def numeric(f, x):
        steps = np.eye(len(x)) * 1e-6
        return np.array([(f(x + d) - f(x - d)) / 2e-6 for d in steps])

    weights, theta = toxicity.OrdinalModel._ascend(rows, grades, rounds=1, rate=0.1, decay=0.0, seed=5)
    for moved, gradient in ((-weights[:12], numeric(lambda w: loss(w, start), np.zeros(12))), (start - theta, numeric(lambda t: loss(np.zeros(12), t), start))):
        assert moved == pytest.approx(0.1 * gradient / np.sqrt(1e-6 + gradient ** 2), abs=1e-4)


def test_toxicity_held_out(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    test = labels.filter("doc_id % 4 = 0")
    got = toxicity.toxicity(docs.join(test.select("doc_id"), "doc_id", "left_semi"), labels.limit(0)).collect()
    assert not any(r["toxic"] for r in got)
    model_rows = toxicity.fit_toxicity(docs, labels.filter("doc_id % 4 <> 0"))
    held = docs.join(test.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(toxicity._score(model_rows), "doc_id bigint, severity int, expected_severity double")
    rows = held.join(test, "doc_id").collect()
    hit = [r["expected_severity"] >= 0.5 for r in rows if r["toxic"]]
    miss = [r["expected_severity"] >= 0.5 for r in rows if not r["toxic"]]
    assert np.mean(hit) > 0.85 and np.mean(miss) < 0.01


def test_toxicity_odd(spark):
    labels = spark.createDataFrame([(1, 0), (2, 1), (9, 0), (None, 1), (10, None)], "doc_id bigint, toxic int")
    got = toxicity.toxicity(odd_docs(spark), labels).collect()
    assert len(got) == len(ODD) and all(0 <= r["expected_severity"] <= 3 for r in got)
    assert toxicity.toxicity(odd_docs(spark, []), labels).count() == 0


def test_thresholds_are_ordered_and_weights_shared():
    rng = np.random.default_rng(1)
    rows = [np.array([1] * g + [7], np.int32) for g in rng.integers(0, 4, 400)]
    model = toxicity.OrdinalModel.fit(rows, np.array([int((r == 1).sum()) for r in rows]))
    assert list(model.thresholds) == sorted(model.thresholds)
    score = np.array([model.weights[1] * g + model.weights.get(7, 0) for g in range(4)])
    expected = model.exceed(score).sum(axis=1)
    assert list(expected) == sorted(expected) and expected[3] > 2.3 and expected[0] < 0.7
