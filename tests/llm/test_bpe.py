"""Byte-pair encoding: equal to the tokenizers library, round trips, odd rows."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from pressgrid.llm import bpe, queries
from tests.conftest import SMALL
from tests.llm.test_operators import odd_docs

public_tokenizers = pytest.importorskip("public_tokenizers")
FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
LETTERS = "abcdefinorstuv'  ABÉéß中文1²٣.,!<|>_-\n\t́\u0085  Σİ😀\x00"


def tokenizer(name):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(public_tokenizers.path(name))
    found.no_truncation()
    found.no_padding()
    return found


@pytest.fixture(scope="module", params=FILES)
def both(request):
    path = public_tokenizers.path(request.param)
    return bpe.BacktrackingEncoder(path), bpe.Decoder(path), tokenizer(request.param)


def assert_equal(both, texts):
    encoder, decoder, library = both
    raw = encoder.encode(pa.array(texts, pa.string()))
    ids = [np.frombuffer(x, "<u4").astype(np.int64) for x in raw]
    want = [library.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert [x.tolist() for x in ids] == want
    decoded = decoder.decode(np.concatenate(ids), np.array([len(x) for x in ids]))
    assert [bytes(x).decode() for x in decoded] == [library.decode(x, skip_special_tokens=False) for x in want]


def test_texts_that_tell(both):
    rng = random.Random(7)
    made = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(80))) for _ in range(1500)]
    runs = ["a" * 5000, "ab" * 3000, "!" * 999, "banana" * 50, "ﬁﬃ Ⅷ ǅ", "ΑΣ ΟΔΟΣ İstanbul", "don't we'll I'M it's 's'S"]
    added = ["<|endoftext|>", "x<|endoftext|><|startoftext|> Y <|endoftext|>z", "<|endoftext", "<|<|endoftext|>|>"]
    assert_equal(both, [*made, *runs, *added, "", None])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=8))
def test_any_text(texts):
    for name in FILES:
        path = public_tokenizers.path(name)
        assert_equal((bpe._tools(path)[0], bpe._tools(path)[1], tokenizer(name)), [x.encode("utf-8", "ignore").decode() for x in texts])


def test_pairs_are_judged_like_the_library(both):
    """Two tokens are compatible just where the library's ids of their joined symbols are those two."""
    encoder, _, library = both
    model = library.model
    rng = np.random.default_rng(3)
    made = np.flatnonzero(encoder.merges.rank >= 0)
    left, right = rng.choice(made, 4000), rng.choice(made, 4000)
    words = [(model.id_to_token(int(a)), model.id_to_token(int(b))) for a, b in zip(left, right)]
    # Where word ends are marked, a word's last token has the mark and no other one.
    some = [k for k, (a, b) in enumerate(words) if not encoder.merges.marked or (b.endswith("</w>") and not a.endswith("</w>"))]
    fits = encoder.merges.compatible(left, right)
    again = encoder.merges.compatible(left, right)
    assert (fits == again).all()
    for k in some:
        a, b = words[k]
        assert fits[k] == ([t.id for t in model.tokenize(a + b.removesuffix("</w>"))] == [left[k], right[k]]), (a, b)


def test_small_model_by_hand():
    """Merges ab, bc, abc (of a and bc): 'abc' is ab + c, since ab merges first; the token abc never comes out."""
    letters = bpe.byte_letters()
    vocab = {x: i for i, x in enumerate(letters)} | {"ab": 256, "bc": 257, "abc": 258}
    merges = bpe.Merges({"vocab": vocab, "merges": [["a", "b"], ["b", "c"], ["a", "bc"]]})
    ids, counts = merges.encode(np.frombuffer(b"abcbcaab", np.uint8), np.array([3, 3, 2]))
    assert ids.tolist() == [256, vocab["c"], 257, vocab["a"], 256] and counts.tolist() == [2, 2, 1]
    with pytest.raises(ValueError):
        bpe.Merges({"vocab": vocab, "merges": [["a", "bc"], ["b", "c"], ["a", "b"]]})
    with pytest.raises(ValueError):
        bpe.Merges({"vocab": vocab, "merges": [], "dropout": 0.1})


def test_query_against_the_library(spark):
    library = tokenizer(FILES[0])
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op11_bpe(spark, SMALL).collect()}
    assert got.keys() == texts.keys()
    for k, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(spark):
    docs = odd_docs(spark)
    library = tokenizer(FILES[0])
    encoded = bpe.encode_texts(docs)
    rows = [(r["doc_id"], r["ids"]) for r in encoded.collect()]
    texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    assert sorted(rows, key=str) == sorted([(k, library.encode(x, add_special_tokens=False).ids) for k, x in texts], key=str)
    back = [(r["doc_id"], r["text"]) for r in bpe.decode_ids(encoded).collect()]
    assert sorted(back, key=str) == sorted([(k, library.decode(ids, skip_special_tokens=False)) for k, ids in rows], key=str)
    digests = bpe.round_trip(docs)
    assert digests.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted((r["doc_id"], r["n_tokens"]) for r in digests.filter("doc_id is not null").collect()) == sorted((k, len(ids)) for k, ids in rows if k is not None)
    assert bpe.round_trip(docs.limit(0)).count() == 0


def test_texts_come_back(spark):
    """Byte-level ids give the text itself again."""
    path = public_tokenizers.path(FILES[1])
    docs = spark.createDataFrame([(1, "Öl, 12 %\n\tmehr…😀"), (2, ""), (3, "a b  c ")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["text"] for r in bpe.decode_ids(bpe.encode_texts(docs, path), path).collect()} == {r["doc_id"]: r["text"] for r in docs.collect()}
