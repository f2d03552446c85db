"""Best-fit packing of token sequences by patterns fitted with non-negative least squares."""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import materialize, sided

SEQUENCE = 2048
END_ID = 0
#: Entries that a task's table of known words holds at most; words beyond are encoded each time.
KNOWN_WORDS = 100_000
#: Steps of the least-squares fit at most; what the fit leaves is packed best-fit, so nothing is lost where they end it.
FIT_STEPS = 1500

PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, nth bigint"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of whole texts, word by word: the tokenizer never merges across white space, so equal words give equal ids.

    A word of Latin letters with punctuation at its end is two parts for the tokenizer, which are encoded apart: many
    words share few endings, and letters can be encoded many words at a time, since each word's last id says so.
    A tokenizer for which that doesn't hold (see :meth:`_holds`) encodes whole texts.
    """

    LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u017f]+"
    MARKS = r"[!-/:-@\[-`{-~]*"

    def __init__(self, path: str, known: int = KNOWN_WORDS):
        # Executors run a worker for each core already, and every further thread keeps memory of its own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), known
        self.letters: dict[str, bytes] = {}
        self.ends: dict[str, bytes] = {"": b""}
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.last[i] = token.endswith("</w>")
        self.by_words = True
        self.by_words = self._holds()

    def _plain(self, texts: list[str]) -> dict[str, bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return {x: np.array(f.ids, "<u4").tobytes() for x, f in zip(texts, found)}

    def _letters(self, words: list[str], together: int = 64) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        groups = [words[a:a + together] for a in range(0, len(words), together)]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            cuts = (np.flatnonzero(self.last[ids]) + 1) * 4
            if len(cuts) != len(group):
                out |= self._plain(group)
                continue
            raw, start = ids.tobytes(), 0
            for word, end in zip(group, cuts.tolist()):
                out[word] = raw[start:end]
                start = end
        return out

    def _table(self, name: str, words: list[str], encode) -> list[bytes]:
        """Ids of different words from a table, which keeps what came first: frequent words do."""
        table = getattr(self, name)
        out = list(map(table.get, words))
        missing = [k for k, ids in enumerate(out) if ids is None]
        new = encode([words[k] for k in missing])
        for k in missing:
            out[k] = new[words[k]]
        if len(table) < self.limit:
            table |= new
        return out

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(f.ids, "<u4").tobytes() for f in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _holds(self) -> bool:
        """Whether this tokenizer's ids are those of its words, on texts made to tell: case, marks, digits, runs of white space."""
        told = ["Word words, WORD\t\tword's  end.", " \n Öl-Tank 12,5% isn't\r\nit?", "don 't ' s 'S x's", "(a) [b]{c} #d @e --f __g", "été ÉTÉ naïve\x0bß中文 ١٢ 😀!!", "<|endoftext|> <s> [UNK]", ""]
        return self.encode(pa.array(told)) == self._whole(told)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """For each text its ids as little-endian 32-bit numbers; null is an empty text.

        Words are split and told apart in Arrow, and so are their letters and marks at their ends; each different part is
        looked up or encoded once, and the texts' ids are gathered from those of the parts.
        """
        texts = pc.fill_null(texts, "")
        if not self.by_words:
            return self._whole(texts.to_pylist())
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.values.dictionary_encode()
        cut = pc.extract_regex(coded.dictionary, f"^(?P<word>{self.LETTERS})(?P<end>{self.MARKS})$")
        other = pc.is_null(cut)
        word = pc.struct_field(cut, "word").dictionary_encode()
        end = pc.struct_field(cut, "end").dictionary_encode()
        lower = pc.utf8_lower(word.dictionary).dictionary_encode()
        rest = _strings(pc.filter(coded.dictionary, other))
        plain = self._plain(rest)
        tables = [self._table("letters", _strings(lower.dictionary), self._letters), self._table("ends", _strings(end.dictionary), self._plain), [plain[w] for w in rest], [b""]]
        firsts = np.cumsum([0, *map(len, tables)])

        # A word is two parts: letters and end, or the whole of it and nothing.
        odd = other.to_numpy(zero_copy_only=False)
        parts = np.full((len(odd), 2), firsts[3])
        parts[~odd, 0] = lower.indices.to_numpy()[word.indices.drop_null().to_numpy()]
        parts[~odd, 1] = firsts[1] + end.indices.drop_null().to_numpy()
        parts[odd, 0] = firsts[2] + np.arange(len(rest))
        raw = [x for t in tables for x in t]
        each = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        ids, ends = _gather(np.frombuffer(b"".join(raw), "<u4"), each, parts.ravel())
        each = np.diff(ends[::2])
        ids, ends = _gather(ids, each, coded.indices.to_numpy())
        bounds = ends[lists.offsets.to_numpy()].tolist()
        return [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]


def _strings(array: pa.Array) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()  # far faster than to_pylist()


def _gather(flat: np.ndarray, each: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``flat``, whose lengths are ``each``, in the order of ``codes``; and where they begin, with the end last."""
    counts = each[codes]
    ends = np.concatenate([[0], np.cumsum(counts)])
    starts = np.cumsum(each) - each
    return flat[np.repeat(starts[codes] - ends[:-1], counts) + np.arange(ends[-1])], ends


@lru_cache(1)
def encoder(path: str) -> WordEncoder:
    """One for each Python worker: later tasks find its tables filled."""
    return WordEncoder(path)


def _pieces(path: str, sequence: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), defaultdict(int)
        end = np.array([END_ID], "<u4").tobytes()
        names = [x.split(" ")[0] for x in PIECE.split(", ")]
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch, rows = whole.slice(a, 512), []
                for doc_id, ids in zip(batch.column(0).to_pylist(), encoder(path).encode(batch.column(1))):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * sequence)):
                        part = ids[at:at + 4 * sequence]
                        length = len(part) // 4
                        rows.append((doc_id, piece, at // 4, length, zlib.crc32(part), task, seen[length]))
                        seen[length] += 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def patterns(lengths: np.ndarray, sequence: int) -> np.ndarray:
    """All sets of one, two or three of ``lengths`` that fill a sequence to the end: rows of three, 0 for none."""
    have = np.zeros(sequence + 1, bool)
    have[lengths] = True
    found = [(sequence, 0, 0)] if have[sequence] else []
    found += [(int(a), int(sequence - a), 0) for a in lengths if 2 * a >= sequence and a < sequence and have[sequence - a]]
    for a in lengths:
        second = lengths[(lengths <= a) & (lengths < sequence - a)]
        third = sequence - a - second
        good = (third <= second) & (third > 0)
        good[good] = have[third[good]]
        found += [(int(a), int(b), int(c)) for b, c in zip(second[good], third[good])]
    return np.array(found, np.int64).reshape(-1, 3)


def fit_counts(sets: np.ndarray, histogram: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns that bring A x near the histogram in least squares.

    Coordinate descent: each step moves the pattern that lowers the error most to its best count, so few
    patterns get counts over 0.
    """
    counts = np.zeros(len(sets))
    rest = histogram.astype(float).copy()
    rest[0] = 0
    # Squared length of a pattern's column: repeats of a length within it add up.
    a, b, c = sets.T
    norm = np.where(b == 0, 1.0, np.where(c == 0, np.where(a == b, 4.0, 2.0), np.where((a == b) & (b == c), 9.0, np.where((a == b) | (b == c), 5.0, 3.0))))
    for _ in range(steps):
        step = np.maximum((rest[a] + rest[b] + rest[c]) / norm, -counts)
        k = int(np.argmax(step * step * norm))
        if abs(step[k]) < 0.5:
            break
        counts[k] += step[k]
        for length in sets[k]:
            if length:
                rest[length] -= step[k]
    return counts


def plan(histogram: dict[int, int], sequence: int = SEQUENCE, steps: int = FIT_STEPS) -> list[tuple[int, int, int, int, int]]:
    """Places for ``histogram`` (pieces by length): ``length, first, count, sequence_id, offset``.

    The nth piece of a length, first <= n < first + count, goes to sequence_id + n - first at offset.  Patterns
    get their rounded counts as far as pieces last; what is left is packed best-fit, longest first, many equal
    sequences at a time.  The work depends on the number of different lengths, not on the number of pieces.
    """
    left = np.zeros(sequence + 1, np.int64)
    for length, n in histogram.items():
        left[length] += n
    used, places, next_id = np.zeros(sequence + 1, np.int64), [], 0
    bins: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free space -> (sequence_id, how many in a row)

    def put(length: int, count: int, at: int, offset: int) -> None:
        places.append((length, int(used[length]), count, at, offset))
        used[length] += count
        left[length] -= count

    sets = patterns(np.flatnonzero(left), sequence)
    if len(sets):
        counts = fit_counts(sets, left, steps)
        for k in np.argsort(-counts, kind="stable"):
            if counts[k] < 0.5:
                break
            parts = [int(x) for x in sets[k] if x]
            count = min([int(np.floor(counts[k] + 0.5)), *(int(left[x]) // parts.count(x) for x in parts)])
            if count > 0:
                offset = 0
                for x in parts:
                    put(x, count, next_id, offset)
                    offset += x
                next_id += count
    spaces: list[int] = []
    for length in range(sequence, 0, -1):
        while left[length]:
            k = bisect_left(spaces, length)
            if k == len(spaces):
                each = sequence // length
                full, over = divmod(int(left[length]), each)
                for many, times in ((full, each), (1 if over else 0, over)):
                    if many:
                        for j in range(times):
                            put(length, many, next_id, j * length)
                        space = sequence - times * length
                        if space:
                            if space not in bins or not bins[space]:
                                insort(spaces, space)
                            bins[space].append((next_id, many))
                        next_id += many
                continue
            space = spaces[k]
            at, many = bins[space].pop()
            if not bins[space]:
                spaces.pop(k)
            now = min(many, int(left[length]))
            put(length, now, at, sequence - space)
            if now < many:
                if not bins[space]:
                    insort(spaces, space)
                bins[space].append((at + now, many - now))
            if rest := space - length:
                if not bins[rest]:
                    insort(spaces, rest)
                bins[rest].append((at, now))
    return places


def pack(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """Packs the token ids of ``docs(doc_id, text)``, each followed by id 0, into sequences of at most ``sequence``.

    A piece's number among the pieces of its length in its task is known as it is made; the number of pieces by
    length and task gives its number among all.  The histogram by length, at most ``sequence`` numbers, is what the
    driver fits patterns to, and the plan gives each range of numbers its sequences.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.  Null and empty texts are the end
    id alone.  Only documents longer than a sequence are cut.  Rows that repeat a document are packed each.
    An empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = materialize(texts.mapInArrow(_pieces(tokenizer or default_tokenizer(), sequence), PIECE))
    tallies = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    bases = materialize(tallies.select("length", "task", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")))
    histogram = {r[0]: r[1] for r in bases.groupBy("length").agg(F.sum("n")).collect()}  # at most `sequence` rows
    slots = np.array(sorted(plan(histogram, sequence)), np.int64).reshape(-1, 5)
    numbered = pieces.join(sided(bases.drop("n")), ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("number"))
    return numbered.mapInArrow(_placed(slots), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def _placed(slots: np.ndarray):
    """Looks places up in the plan, whose size depends on the sequence length alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (slots[:, 0] << 44) + slots[:, 1]
        for batch in batches:
            number = batch.column("number").to_numpy()
            slot = slots[np.searchsorted(keys, (batch.column("length").to_numpy() << 44) + number, side="right") - 1]
            found = {"sequence_id": slot[:, 3] + number - slot[:, 1], "offset": slot[:, 4]}
            yield pa.RecordBatch.from_arrays(batch.columns[:5] + [pa.array(x) for x in found.values()], names=[*batch.schema.names[:5], *found])

    return run
