"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .packing import WordEncoder, _gather, default_tokenizer

#: Slots of the table of pairs that were judged, a power of two; a pair whose slot another one holds is judged again.
PAIR_SLOTS = 1 << 20
#: Documents that are worked on at a time within a task.
SLICE = 512
NEVER = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The letter that a byte-level vocabulary writes for each byte: printable ones as they are, others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Merges:
    """The merges of a byte-level BPE model, ready for the backtracking encoder.

    A piece of text is a row of symbols: its bytes, the last one marked where the model marks word ends.
    """

    def __init__(self, model: dict):
        for name in ("dropout", "unk_token", "continuing_subword_prefix"):
            if model.get(name):
                raise ValueError(f"models with {name} aren't supported")
        if model.get("ignore_merges") or model.get("byte_fallback"):
            raise ValueError("models that ignore merges or fall back to bytes aren't supported")
        vocab, suffix, letters = model["vocab"], model.get("end_of_word_suffix") or "", byte_letters()
        size = 1 + max(vocab.values())
        self.last = np.array([vocab[x + suffix] for x in letters])
        byte_of = {x: b for b, x in enumerate(letters)}

        # What a token is made of, and when.
        self.rank, self.left, self.right = np.full(size, -1), np.full(size, -1), np.full(size, -1)
        parts = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in parts]).reshape(-1, 3)
        a, b, made = pairs.T
        self.rank[made], self.left[made], self.right[made] = np.arange(len(made)), a, b
        if len(np.unique(made)) < len(made) or (self.rank[made] <= np.maximum(self.rank[a], self.rank[b])).any():
            raise ValueError("a merge must make a new token, of tokens that earlier merges made")
        self.size = size
        order = np.argsort(a * size + b)
        self.pair_keys, self.pair_ranks = (a * size + b)[order], np.arange(len(made))[order]
        self.right_spine, self.left_spine = self._spine(self.right), self._spine(self.left)
        self.slots, self.fits = np.full(PAIR_SLOTS, -1), np.zeros(PAIR_SLOTS, bool)

        # Tokens that the merges themselves never end with take no part in matching.
        whole = np.ones(size, bool)
        for a, b, t in pairs[~self._judge(pairs[:, 0], pairs[:, 1], skip_whole=True)]:
            whole[t] = False
        spelled = {}
        for token, t in vocab.items():
            body = token[:len(token) - len(suffix)] if suffix and token.endswith(suffix) and token != suffix else token
            if body and whole[t] and all(x in byte_of for x in body):
                symbols = [byte_of[x] for x in body]
                symbols[-1] += 256 * (body != token)
                spelled[tuple(symbols)] = t
        self.length = np.zeros(size, np.int64)
        self.shorter = np.full(size, -1)
        for symbols, t in spelled.items():
            self.length[t] = len(symbols)
            self.shorter[t] = next((spelled[symbols[:k]] for k in range(len(symbols) - 1, 0, -1) if symbols[:k] in spelled), -1)
        self._automaton(spelled, 256 if suffix else 0)

    def _spine(self, child: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token: itself, its first (or last) part, the part's part, and so on; the rank that ends each; how many."""
        tokens, ends = [np.arange(self.size)], [np.full(self.size, NEVER)]
        while (tokens[-1] >= 0).any():
            here = tokens[-1]
            tokens.append(np.where(here >= 0, child[here], -1))
            ends.append(self.rank[here])
        return np.stack(tokens[:-1], 1), np.stack(ends[:-1], 1), (np.stack(tokens[:-1], 1) >= 0).sum(1)

    def _judge(self, left: np.ndarray, right: np.ndarray, skip_whole: bool = False) -> np.ndarray:
        """Whether the merges leave each pair of tokens apart.

        They don't if some end of the left token and some beginning of the right one merge while both still stand: before
        the rank that ends the one, and no later than that which ends the other, since merges of a rank go from left to right.
        """
        if not len(left):
            return np.zeros(0, bool)
        (ends, end_ranks, n), (begins, begin_ranks, m) = self.right_spine, self.left_spine
        count = n[left] * m[right]
        pair = np.repeat(np.arange(len(left)), count)
        nth = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
        i, j = np.divmod(nth, m[right][pair])
        key = ends[left[pair], i] * self.size + begins[right[pair], j]
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        rank = self.pair_ranks[at]
        merge = (self.pair_keys[at] == key) & (rank < end_ranks[left[pair], i]) & (rank <= begin_ranks[right[pair], j])
        if skip_whole:
            merge &= nth > 0
        return np.bincount(pair[merge], minlength=len(left)) == 0

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """:meth:`_judge`, remembered in a table of bounded size."""
        key = left * self.size + right
        slot = ((key * 0x9E3779B1) >> 7) & (PAIR_SLOTS - 1)
        new = self.slots[slot] != key
        fits = self.fits[slot]
        if new.any():
            keys, back = np.unique(key[new], return_inverse=True)
            judged = self._judge(keys // self.size, keys % self.size)
            fits[new] = judged[back]
            at = ((keys * 0x9E3779B1) >> 7) & (PAIR_SLOTS - 1)
            at, first = np.unique(at, return_index=True)
            self.slots[at], self.fits[at] = keys[first], judged[first]
        return fits

    def _automaton(self, spelled: dict[tuple, int], marked: int) -> None:
        """An Aho-Corasick automaton over the tokens read backwards, so that a state tells the longest token that begins here."""
        inner = sorted({x for symbols in spelled if len(symbols) > 1 for x in symbols if x < 256})
        self.column = np.full(256, len(inner))  # symbols of no longer token lead back to the root
        self.column[inner] = np.arange(len(inner))
        child: dict[tuple[int, int], int] = {}
        parents, symbols_in, depths, token = [-1], [-1], [0], [-1]
        for symbols, t in spelled.items():
            if len(symbols) == 1 and symbols[0] < 256 and self.column[symbols[0]] == len(inner):
                continue
            state = 0
            for x in reversed(symbols):
                nxt = child.get((state, x))
                if nxt is None:
                    nxt = child[state, x] = len(parents)
                    parents.append(state)
                    symbols_in.append(x)
                    depths.append(depths[state] + 1)
                    token.append(-1)
                state = nxt
            token[state] = t
        parents, symbols_in, depths = np.array(parents), np.array(symbols_in), np.array(depths)
        self.longest = np.array(token)
        self.next = np.zeros((len(parents), len(inner) + 1), np.int32)
        fail = np.zeros(len(parents), np.int64)
        begin = np.arange(256) + marked
        self.begin = np.array([child.get((0, int(x)), 0) for x in begin])
        self.single = np.full(512, -1)
        for symbols, t in spelled.items():
            if len(symbols) == 1:
                self.single[symbols[0]] = t
        for depth in range(1, int(depths.max()) + 1):
            nodes = np.flatnonzero(depths == depth)
            plain = nodes[symbols_in[nodes] < 256]
            if depth > 1:
                fail[plain] = self.next[fail[parents[plain]], self.column[symbols_in[plain]]]
            self.next[parents[plain], self.column[symbols_in[plain]]] = plain
            none = nodes[self.longest[nodes] < 0]
            self.longest[none] = self.longest[fail[none]]
            self.next[nodes] = self.next[fail[nodes]]
        self.marked = marked

    def encode(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pieces at once: the bytes of all of them one after another, and how many each has; none is empty.

        Each piece takes the longest token that begins where it stands and fits the token before; else the longest
        shorter one; else it gives its last token up, never to come back to this place.  Every piece moves in each step,
        so that a step is a few array operations.  Returns all ids, and how many each piece has.
        """
        order = np.argsort(-lengths, kind="stable")
        size, starts = lengths[order], (np.cumsum(lengths) - lengths)[order]
        best = np.empty(len(data), np.int64)
        state = np.zeros(len(size), np.int64)
        for back in range(int(size[0]) if len(size) else 0):
            n = np.searchsorted(-size, -back, side="left")  # pieces of more symbols than were read
            at = starts[:n] + size[:n] - 1 - back
            byte = data[at].astype(np.int64)
            state[:n] = self.next[state[:n], self.column[byte]] if back else self.begin[byte]
            found = self.longest[state[:n]]
            best[at] = np.where(found < 0, self.single[byte + (0 if back else self.marked)], found)
        ends = starts + size
        dead = np.zeros(len(data) + 1, bool)  # a place within a piece that leads nowhere; its end is never one
        stack, depth, at = np.empty(len(data), np.int64), np.zeros(len(size), np.int64), starts.copy()
        todo = np.arange(len(size))
        wanted = best[at]
        while len(todo):
            token, here, deep = wanted[todo], at[todo], depth[todo]
            to = here + self.length[token]
            fits = ~dead[to] | (to == ends[todo])
            inner = np.flatnonzero(fits & (deep > 0))
            fits[inner] = self.compatible(stack[starts[todo[inner]] + deep[inner] - 1], token[inner])
            on = todo[fits]
            stack[starts[on] + deep[fits]] = token[fits]
            at[on], depth[on] = to[fits], deep[fits] + 1
            more = on[at[on] < ends[on]]
            wanted[more] = best[at[more]]
            off, tried = todo[~fits], self.shorter[token[~fits]]
            wanted[off] = tried
            back = off[tried < 0]
            dead[at[back]] = True
            wanted[back] = stack[starts[back] + depth[back] - 1]
            at[back] -= self.length[wanted[back]]
            depth[back] -= 1
            todo = todo[at[todo] < ends[todo]]
        count = np.empty(len(size), np.int64)
        count[order] = depth
        first = np.empty(len(size), np.int64)
        first[order] = starts
        ids = stack[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        return ids, count


class BacktrackingEncoder(WordEncoder):
    """Ids of whole texts; the tokenizer's own normaliser and splitter tell the pieces, the merges are :class:`Merges`'."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.merges = Merges(told["model"])
        self.added = {x["content"]: x["id"] for x in told["added_tokens"]}
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in told["added_tokens"]):
            raise ValueError("added tokens that take in more than their own letters aren't supported")
        self.byte_of = {x: b for b, x in enumerate(byte_letters())}
        super().__init__(path)

    def _encoded(self, pieces: pa.Array) -> list[bytes]:
        """Ids of pieces of text that aren't empty."""
        offsets = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset:pieces.offset + len(pieces) + 1]
        data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]] if len(pieces) else np.zeros(0, np.uint8)
        ids, counts = self.merges.encode(data, np.diff(offsets).astype(np.int64) if len(pieces) else np.zeros(0, np.int64))
        raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def _letters(self, words: list[str]) -> dict[str, bytes]:
        return dict(zip(words, self._encoded(pa.array(words, pa.string()))))

    def _split(self, text: str) -> Iterator[int | bytes]:
        """The ids of added tokens, and the bytes of the pieces between."""
        rest = [text]
        for token in sorted(self.added, key=len, reverse=True):
            rest = [y for x in rest for y in ([x] if isinstance(x, int) else self._around(x, token))]
        for x in rest:
            if isinstance(x, int):
                yield x
            elif x:
                normal = self.tokenizer.normalizer.normalize_str(x) if self.tokenizer.normalizer else x
                for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal):
                    yield bytes(map(self.byte_of.__getitem__, piece))

    def _around(self, text: str, token: str) -> list[int | str]:
        parts = text.split(token)
        return [parts[0], *[y for x in parts[1:] for y in (self.added[token], x)]]

    def _whole(self, texts: list[str]) -> list[bytes]:
        split = [list(self._split(x)) for x in texts]
        known = list(dict.fromkeys(y for x in split for y in x if isinstance(y, bytes)))
        joined, sizes = b"".join(known), np.fromiter(map(len, known), np.int64, len(known))
        ids, counts = self.merges.encode(np.frombuffer(joined, np.uint8), sizes)
        raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        found = dict(zip(known, (raw[a:b] for a, b in zip([0, *ends], ends))))
        return [b"".join(found[y] if isinstance(y, bytes) else np.array([y], "<u4").tobytes() for y in x) for x in split]

    def _plain(self, texts: list[str]) -> dict[str, bytes]:
        return dict(zip(texts, self._whole(texts)))


class Pieces:
    """A string for each id, end to end in one array with a table of lengths."""

    def __init__(self, strings: list[bytes]):
        self.flat, self.each = np.frombuffer(b"".join(strings), np.uint8), np.fromiter(map(len, strings), np.int64, len(strings))

    def join(self, ids: np.ndarray, counts: np.ndarray) -> list[memoryview]:
        """The strings of the ids, text by text; each text has the next ``counts`` ids."""
        flat, ends = _gather(self.flat, self.each, ids)
        bounds = ends[np.concatenate([[0], np.cumsum(counts)])].tolist()
        view = memoryview(np.ascontiguousarray(flat))
        return [view[a:b] for a, b in zip(bounds, bounds[1:])]


class Decoder:
    """Texts of ids by an offset table over the vocabulary.

    Without a decoder of its own a tokenizer's tokens stand as they are, parted by blanks; with the byte-level one they are bytes.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        kind = (told["decoder"] or {"type": None})["type"]
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"decoder {kind} isn't supported")
        self.gap = 0 if kind else 1
        vocab = told["model"]["vocab"] | {x["content"]: x["id"] for x in told["added_tokens"]}
        byte_of = {x: b for b, x in enumerate(byte_letters())}
        strings = [b""] * (1 + max(vocab.values()))
        for token, i in vocab.items():
            strings[i] = bytes(map(byte_of.__getitem__, token)) if kind and all(x in byte_of for x in token) else token.encode() + b" " * self.gap
        self.pieces = Pieces(strings)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 of each text; bytes that are none become U+FFFD."""
        found = self.pieces.join(ids, counts)
        if self.gap:
            return [x[:-1] if len(x) else x for x in found]  # the blank after the last token
        return [bytes(x).decode("utf-8", "replace").encode() for x in found]


@lru_cache(1)
def _tools(path: str) -> tuple[BacktrackingEncoder, Decoder, Pieces]:
    """One set for each Python worker: later tasks find its tables filled."""
    decoder = Decoder(path)
    return BacktrackingEncoder(path), decoder, Pieces([b"%d " % i for i in range(len(decoder.pieces.each))])


def encode_texts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``doc_id, ids array<int>`` of ``docs(doc_id, text)``; null is an empty text, repeated rows are encoded each."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, SLICE):
                batch = whole.slice(a, SLICE)
                raw = _tools(path)[0].encode(batch.column(1))
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])])
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<u4").astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return _texts(docs).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_ids(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``doc_id, text`` of ``encoded(doc_id, ids)``; null and empty lists are empty texts."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, SLICE):
                batch = whole.slice(a, SLICE)
                lists = [np.asarray(x, np.int64) if x is not None else np.zeros(0, np.int64) for x in batch.column(1).to_pylist()]
                texts = _tools(path)[1].decode(np.concatenate(lists), np.fromiter(map(len, lists), np.int64, len(lists)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([str(x, "utf-8") for x in texts], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("ids").cast("array<bigint>").alias("ids")).mapInArrow(run, "doc_id bigint, text string")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Encodes ``docs(doc_id, text)`` and decodes the ids again: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    The digests are of the decimal ids joined by a blank, and of the decoded text in UTF-8.  Null texts are empty ones,
    repeated rows and null ids get a row each, an empty table none.  Each row is worked on by itself, whole.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder, decimals = _tools(path)
        for whole in batches:
            for a in range(0, whole.num_rows, SLICE):
                batch = whole.slice(a, SLICE)
                raw = encoder.encode(batch.column(1))
                counts = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
                ids = np.frombuffer(b"".join(raw), "<u4").astype(np.int64)
                digests = [
                    [hashlib.sha256(x).hexdigest() for x in found]
                    for found in ((x[:-1] if len(x) else x for x in decimals.join(ids, counts)), decoder.decode(ids, counts))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), *map(pa.array, digests)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
