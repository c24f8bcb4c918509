"""Vectorised reading of many texts at once: word bounds and 64-bit word hashes in numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np

BATCH_BYTES = 2 << 20
#: Words of so many eight-byte groups are hashed together.
GROUPS_AT_ONCE = 1 << 18
_MULTIPLIERS = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_GROUP = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([0, *((1 << 8 * k) - 1 for k in range(1, 9))], np.uint64)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * _MULTIPLIERS[0]
    h = (h ^ (h >> np.uint64(27))) * _MULTIPLIERS[1]
    return h ^ (h >> np.uint64(31))


class Words(NamedTuple):
    """Words of consecutive texts: byte bounds in ``buffer``, hashes, words per text and their offsets."""

    buffer: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray
    offsets: np.ndarray


def word_bytes(separators: Sequence[int]) -> np.ndarray:
    """A table of the bytes that make words: all but ``separators``."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


def word_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: its eight-byte groups, each mixed with its place, added up and mixed with the length.

    Groups go through a mixing that is not linear, so no family of words is known to collide.
    """
    eight = np.ndarray((len(buffer) + 1,), "<u8", np.concatenate((buffer, np.zeros(8, np.uint8))).data, strides=(1,))
    sizes = ends - starts
    hashes = np.empty(len(starts), np.uint64)
    groups = np.cumsum((sizes + 7) >> 3)
    low = 0
    while low < len(starts):
        before = int(groups[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(groups, before + GROUPS_AT_ONCE, side="right")))
        firsts = np.concatenate(([0], groups[low : high - 1] - before))
        total = int(groups[high - 1]) - before
        word = np.repeat(np.arange(low, high), np.diff(np.append(firsts, total)))
        place = np.arange(total) - firsts[word - low]
        left = np.minimum(sizes[word] - 8 * place, 8)
        values = eight[starts[word] + 8 * place].astype(np.uint64) & _MASKS[left]
        mixed = mix(values ^ mix(place.astype(np.uint64) * _GROUP + _GROUP))
        hashes[low:high] = mix(np.add.reduceat(mixed, firsts) + sizes[low:high].astype(np.uint64) * _GROUP)
        low = high
    return hashes


def scan_words(texts: list[bytes], is_word: np.ndarray) -> Words:
    """Lower-case A-Z and find maximal runs of word bytes; a space must be no word byte."""
    buffer = np.frombuffer(b" ".join([*texts, b""]).translate(LOWER), np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    inside = np.concatenate(([False], is_word[buffer], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    hashes = word_hashes(buffer, starts, ends)
    offsets = np.searchsorted(starts, bounds)
    return Words(buffer, starts, ends, hashes, np.diff(offsets), offsets)


def sequence_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """One hash per run of ``length`` consecutive word hashes, at the run's first word."""
    n = max(0, len(hashes) - length + 1)
    total = np.full(n, np.uint64(length))
    for k in range(length):
        total = total * _MULTIPLIERS[0] + mix(hashes[k : k + n] + np.uint64(k + 1))
    return mix(total)


def batches_by_size(texts: Sequence[bytes], limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes; a longer text is a range of its own."""
    start = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, k
            start, size = k, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def encoded(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
