"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import fraction_filter, slices

#: Length of the vectors.
DIMENSIONS = 1024
#: Documents of each language that profiles are learned from at most, chosen by a hash of doc_id.
DOCS_PER_LANGUAGE = 4000
#: Symbols: 0 is the edge of a word, 1 to 26 are a to z, letters beyond share the others by a hash of their code point.
SYMBOLS = 128
UNKNOWN = "und"


@lru_cache(1)
def symbol_table() -> np.ndarray:
    """The symbol of each code point; 0 for what isn't a letter."""
    points = np.arange(0x110000)
    letter = np.fromiter((chr(i).isalpha() for i in points), bool, len(points))
    table = np.where(letter, 27 + (points * 2654435761 >> 7) % (SYMBOLS - 27), 0)
    table[ord("a"):ord("z") + 1] = np.arange(1, 27)
    return table.astype(np.int32)


@lru_cache(4)
def letter_vectors(dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random vectors of -1 and 1 for each symbol, turned by two places, by one, and as they are."""
    base = np.random.default_rng(7).choice(np.array([-1, 1], np.int8), (SYMBOLS, dimensions))
    return np.roll(base, 2, axis=1), np.roll(base, 1, axis=1), base


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Different letter trigrams, word edges included, and how often each occurs."""
    raw = (text or "").lower().encode("utf-32-le", "surrogatepass")
    symbols = np.concatenate(([0], symbol_table()[np.frombuffer(raw, "<u4")], [0]))
    edge = symbols == 0
    symbols = symbols[~(edge & np.concatenate(([False], edge[:-1])))]
    if len(symbols) < 3:
        return np.empty(0, np.int64), np.empty(0)
    codes = (symbols[:-2].astype(np.int64) * SYMBOLS + symbols[1:-1]) * SYMBOLS + symbols[2:]
    codes = codes[symbols[1:-1] > 0]  # none that has a word's edge in its middle
    return np.unique(codes, return_counts=True)


def bundle(codes: np.ndarray, counts: np.ndarray, dimensions: int) -> np.ndarray:
    """Sum of the trigrams' vectors, each bound by multiplying the turned vectors of its letters."""
    two, one, none = letter_vectors(dimensions)
    total = np.zeros(dimensions, np.float32)
    for a in range(0, len(codes), 4096):
        part = codes[a:a + 4096]
        bound = two[part // SYMBOLS ** 2] * one[part // SYMBOLS % SYMBOLS] * none[part % SYMBOLS]
        total += counts[a:a + 4096].astype(np.float32) @ bound.astype(np.float32)
    return total


def _unit(vector: np.ndarray) -> np.ndarray:
    size = float(np.linalg.norm(vector))
    return vector / size if size else vector


def _sums(dimensions: int):
    """Of a task's documents, the sum of unit vectors by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                vector = _unit(bundle(*trigrams(text), dimensions))
                sums[lang] = sums.get(lang, 0) + vector.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], names=["lang", "vector"])

    return run


def learn_profiles(labelled: DataFrame, dimensions: int = DIMENSIONS, per_language: int = DOCS_PER_LANGUAGE) -> dict[str, list[float]]:
    """A prototype vector per language of ``labelled(doc_id, text, lang)``.

    Of each language at most about ``per_language`` documents are read, by a hash of doc_id; tasks send one sum per
    language.  Rows with a null lang or text are left out.  The result has one vector per language.
    """
    usable = labelled.filter("lang is not null and text is not null")
    counts = {r[0]: r[1] for r in usable.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return {}
    key, keep = F.col("doc_id"), F.lit(False)
    for lang, n in counts.items():
        keep = keep | ((F.col("lang") == lang) & fraction_filter(key, per_language / n))
    sums = usable.filter(keep).select("lang", F.col("text").cast("string")).mapInArrow(_sums(dimensions), "lang string, vector array<double>")
    parts = sums.select("lang", F.posexplode("vector").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    found: dict[str, np.ndarray] = {}
    for lang, k, x in parts.collect():  # languages x dimensions numbers
        found.setdefault(lang, np.zeros(dimensions))[k] = x
    return {lang: np.round(_unit(v), 9).tolist() for lang, v in sorted(found.items())}


def _predict(profiles: dict[str, list[float]], dimensions: int):
    names = list(profiles)
    matrix = np.array([profiles[x] for x in names], np.float32).reshape(len(names), dimensions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            langs, scores = [], []
            for text in batch.column(1).to_pylist():
                codes, counts = trigrams(text)
                if not len(codes) or not names:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                near = matrix @ _unit(bundle(codes, counts, dimensions))
                best = int(np.argmax(near))
                langs.append(names[best])
                scores.append(min(1.0, max(0.0, float(near[best]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, profiles: dict[str, list[float]], dimensions: int = DIMENSIONS) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``docs(doc_id, text)``: the profile with the highest cosine.

    Whole texts count, whatever their length.  Text that is null or has no letter is ``und`` with score 0, as is
    everything if no profile was learned.  Ties go to the first language by name.  Rows that repeat are
    predicted each.  An empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_predict(profiles, dimensions), "doc_id bigint, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_of(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """Learns from the rows of ``docs(doc_id, text, lang)`` that aren't held out, and predicts every row.

    ``doc_id, held_out, lang_pred, score``; a null doc_id is not held out.
    """
    profiles = learn_profiles(docs.filter(~held_out(F.col("doc_id"))), dimensions)
    return identify(docs, profiles, dimensions).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def _told(profiles: dict[str, list[float]], dimensions: int, text_at: int):
    predict = _predict(profiles, dimensions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text = batch.column(text_at)
            for found in predict(iter([pa.RecordBatch.from_arrays([text, text], names=["doc_id", "text"])])):
                yield batch.filter(pa.array([x != UNKNOWN for x in found.column(1).to_pylist()], pa.bool_()))

    return run


def with_language(docs: DataFrame, profiles: dict[str, list[float]], dimensions: int = DIMENSIONS) -> DataFrame:
    """The rows of ``docs``, columns as they are, whose language can be told; others are rejected in place, without a shuffle."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names with a dot can't be told from fields
    return plain.mapInArrow(_told(profiles, dimensions, docs.columns.index("text")), plain.schema).toDF(*docs.columns)
