"""Shingles of many texts at once, as hashes in numpy arrays: helpers of tasks that get their texts by Arrow."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Characters that are worked on at a time; a longer text comes in pieces.
CHUNK = 1 << 18
#: An odd multiplier for the hash of a shingle's units, and the constants of a 64-bit finaliser.
BASE, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def chunks(texts: Iterable[str], width: int) -> Iterator[list[tuple[int, str]]]:
    """Lists of (number of the text, piece) of about ``CHUNK`` characters; pieces of a text overlap, so no shingle is lost."""
    held, room = [], CHUNK
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - width + 1), CHUNK):
            piece = text[at:at + CHUNK + width - 1]
            held.append((i, piece))
            room -= len(piece) + width
            if room <= 0:
                yield held
                held, room = [], CHUNK
    if held:
        yield held


def hashes(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of ``width`` UTF-16 units, text after text, and where each text's begin.

    The texts are not empty and hold no line feed: feeds part them, and fill up a text shorter than a shingle.
    """
    gap = "\n" * width
    units = np.frombuffer((gap.join(texts) + gap).encode("utf-16-le"), np.uint16)
    feed = units == 10
    ends = np.flatnonzero(feed[1:] & ~feed[:-1]) + 1
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1] + width])
    found = np.zeros(len(units) - width + 1, np.uint64)
    for j in range(width):
        found *= BASE
        found += units[j:j + len(found)]
    counts = np.maximum(ends - starts - width, 0) + 1
    begins = np.cumsum(counts) - counts
    found = found[np.arange(int(counts.sum())) + np.repeat(starts - begins, counts)]
    found ^= found >> np.uint64(30)
    found *= MIX1
    found ^= found >> np.uint64(27)
    found *= MIX2
    found ^= found >> np.uint64(31)
    return found, begins


def sets(texts: Iterable[str], width: int) -> Iterator[np.ndarray]:
    """The different shingles of each text, in order."""
    row, held = 0, []
    for part in chunks(texts, width):
        found, begins = hashes([piece for _, piece in part], width)
        bounds = [*begins.tolist(), len(found)]
        for k, (i, _) in enumerate(part):
            if i != row:
                yield held[0] if len(held) == 1 else np.unique(np.concatenate(held))
                row, held = i, []
            held.append(np.unique(found[bounds[k]:bounds[k + 1]]))
    if held:
        yield held[0] if len(held) == 1 else np.unique(np.concatenate(held))
