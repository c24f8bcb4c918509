"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent 1- to 3-grams of a language's labelled texts, most frequent first. A
text's own list is compared with each profile by out-of-place distance: the places by which each of its
n-grams is off, or the profile's length for one that it lacks.

Counts are taken over all labelled texts, in each task first, so a language that holds most rows costs
one entry per task and n-gram. Only profiles go through the driver: languages times profile length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import workers

LENGTH = 400
BATCH_CHARS = 1 << 20
BATCH_TEXTS = 2048
ENTRIES_HELD = 1 << 21
UNKNOWN = "und"
RESULT = "doc_id long, lang_pred string, score double"
_SPACE = 32
_GAP = re.compile(r"[\W\d_]")
_letters: list[np.ndarray] = []


class Grams(NamedTuple):
    """Distinct n-grams of each text, text after text: code points in 21 bits each, and counts."""

    text: np.ndarray
    code: np.ndarray
    count: np.ndarray


class Profiles(NamedTuple):
    """Languages in order of name; ``ranks[l, g]`` is the place of n-gram ``codes[g]``, or the length."""

    languages: list[str]
    codes: np.ndarray
    ranks: np.ndarray
    length: int


def is_letter() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def text_ranges(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= BATCH_CHARS or k - start + 1 >= BATCH_TEXTS:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def pieces(text: str) -> Iterator[tuple[str, int, int]]:
    """A lower-cased long text in pieces of about BATCH_CHARS, with the letters of context before and after each.

    Pieces end before a character that is no letter or, in a longer run of letters, inside it; then one letter on either
    side of the cut stands in both pieces and is counted in its own.
    """
    start = 0
    while len(text) - start > 2 * BATCH_CHARS:
        gap = _GAP.search(text, start + BATCH_CHARS, start + 2 * BATCH_CHARS)
        stop = gap.start() if gap else start + 2 * BATCH_CHARS
        before, after = int(start > 0 and text[start - 1].isalpha() and text[start].isalpha()), int(text[stop - 1].isalpha() and text[stop].isalpha())
        yield text[start - before : stop + after], before, after
        start = stop
    before = int(start > 0 and text[start - 1 : start].isalpha() and text[start : start + 1].isalpha())
    yield text[start - before :], before, 0


def count_grams(texts: list[str | None]) -> Grams:
    """N-grams of words with a blank on either side; other characters part words. At most BATCH_TEXTS texts."""
    if max(map(len, filter(None, texts)), default=0) <= 2 * BATCH_CHARS:
        return _count_grams(texts)
    found = [(k, _count_grams([piece], *context)) for k, text in enumerate(texts) for piece, *context in pieces((text or "").lower())]
    text = np.concatenate([np.full(len(g.code), k) for k, g in found])
    code, count = (np.concatenate([g[i] for _, g in found]) for i in (1, 2))
    order = np.lexsort((code, text))
    text, code, count = text[order], code[order], count[order]
    firsts = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (code[1:] != code[:-1]))))
    return Grams(text[firsts], code[firsts], np.add.reduceat(count, firsts))


def _count_grams(texts: list[str | None], before: int = 0, after: int = 0) -> Grams:
    """As ``count_grams``; of a text's first and last letters, so many are context only."""
    lowered = [(t or "").lower() for t in texts]
    points = np.frombuffer(" ".join(["", *lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = is_letter()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    ends = np.cumsum([len(t) + 1 for t in lowered])
    at = np.flatnonzero(keep)
    text_of = np.searchsorted(ends, at - 1, side="right").astype(np.uint64)
    letter = letter[at]
    alphabet, symbol = np.unique(np.where(letter, points[at], _SPACE), return_inverse=True)
    bits = np.uint64(max(1, int(len(alphabet) - 1).bit_length()))
    symbol = symbol.astype(np.uint64)
    word = np.flatnonzero(letter)
    word = word[before : len(word) - after]
    one, two, three = np.uint64(1) << np.uint64(3) * bits, np.uint64(2) << np.uint64(3) * bits, np.uint64(3) << np.uint64(3) * bits
    pairs = np.concatenate((word, word[~letter[word - 1]] - 1))
    own = np.concatenate((text_of[word], text_of[word[~letter[word - 1]]]))
    top = np.uint64(3) * bits + np.uint64(2)
    codes = np.concatenate(
        (
            text_of[word] << top | one | symbol[word],
            own << top | two | symbol[pairs] << bits | symbol[pairs + 1],
            text_of[word] << top | three | symbol[word - 1] << bits + bits | symbol[word] << bits | symbol[word + 1],
        )
    )
    codes.sort()
    firsts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
    distinct = codes[firsts]
    order = (distinct >> np.uint64(3) * bits) & np.uint64(3)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    parts = [alphabet[((distinct >> np.uint64(k) * bits) & mask).astype(np.int64)].astype(np.uint64) for k in range(3)]
    code = parts[0] | np.where(order > 1, parts[1] << np.uint64(21), 0).astype(np.uint64) | np.where(order > 2, parts[2] << np.uint64(42), 0).astype(np.uint64)
    return Grams((distinct >> top).astype(np.int64), code, np.diff(np.append(firsts, len(codes))))


def fit_profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", length: int = LENGTH) -> Profiles:
    """Profiles from all rows of ``docs`` that have a language and a text. Equal counts go by n-gram."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.begin("language")
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged() -> pa.RecordBatch:
            names, codes, counts = [], [], []
            for name, parts in held.items():
                code, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                names += [name] * len(code)
                codes.append(code.view(np.int64))
                counts.append(np.bincount(where, np.concatenate([p[1] for p in parts]), len(code)).astype(np.int64))
            held.clear()
            return pa.record_batch([pa.array(names, pa.string()), pa.array(np.concatenate(codes)), pa.array(np.concatenate(counts))], names=["lang", "code", "n"])

        size = 0
        for batch in batches:
            names, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for i, j in text_ranges(texts):
                by: dict[str, list[str]] = {}
                for name, text in zip(names[i:j], texts[i:j], strict=True):
                    by.setdefault(name, []).append(text)
                grams = count_grams([" ".join(own) for own in by.values()])
                cuts = np.searchsorted(grams.text, np.arange(len(by) + 1))
                for k, name in enumerate(by):
                    held.setdefault(name, []).append((grams.code[cuts[k] : cuts[k + 1]], grams.count[cuts[k] : cuts[k + 1]]))
                size += len(grams.code)
                if size > ENTRIES_HELD:
                    yield merged()
                    size = 0
        if held:
            yield merged()

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    counts = rows.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    top = counts.withColumn("rank", place).filter(F.col("rank") <= length).select("lang", "code", "rank")
    found = top.toPandas()
    languages = sorted(found["lang"].unique())
    codes = np.sort(found["code"].unique().astype(np.uint64))
    ranks = np.full((len(languages), len(codes) + 1), length, np.int64)
    at = np.searchsorted(codes, found["code"].to_numpy().astype(np.uint64))
    ranks[np.searchsorted(languages, found["lang"].tolist()) if languages else [], at] = found["rank"].to_numpy() - 1
    return Profiles(languages, codes, ranks, length)


def closest(texts: list[str | None], profiles: Profiles) -> tuple[list[str], np.ndarray]:
    """Each text's closest language and how close it is: 1 minus distance over largest distance."""
    grams = count_grams(texts)
    order = np.argsort((grams.text.astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - grams.count.astype(np.uint64)), kind="stable")
    text, code = grams.text[order], grams.code[order]
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    rank = np.arange(len(text)) - bounds[text]
    listed = rank < profiles.length
    text, code, rank = text[listed], code[listed], rank[listed]
    n = np.bincount(text, minlength=len(texts))
    near = np.full(len(texts), -1.0)
    best = np.full(len(texts), -1)
    if len(profiles.languages):
        at = np.searchsorted(profiles.codes, code)
        at[(at == len(profiles.codes)) | (profiles.codes[np.minimum(at, len(profiles.codes) - 1)] != code)] = len(profiles.codes)
        for k in range(len(profiles.languages)):
            place = profiles.ranks[k][at]
            off = np.where(place < profiles.length, np.abs(place - rank), profiles.length)
            close = 1.0 - np.bincount(text, off, len(texts)) / np.maximum(n * profiles.length, 1)
            better = (close > near) & (n > 0)
            near[better], best[better] = close[better], k
    return [profiles.languages[k] if k >= 0 else UNKNOWN for k in best], np.maximum(near, 0.0)


def predict(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score``, one row per document.

    The score is 1 minus the distance to the closest profile over the largest possible distance; equal
    distances go to the first language by name. ``und`` with score 0: null text, text without letters, no
    profiles. Rows with null or repeated ids are predicted like others; other columns are not read.
    """
    known = docs.sparkSession.sparkContext.broadcast(profiles)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.begin("language")
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in text_ranges(texts):
                languages, scores = closest(texts[i:j], known.value)
                yield pa.record_batch([batch.column("doc_id").slice(i, j - i), pa.array(languages, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(find, RESULT)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are not learned from; false for a null id, which is not learned from either."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def learnable(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.filter(F.col(id_col).isNotNull() & ~held_out(id_col))


def with_language(docs: DataFrame, profiles: Profiles, text_col: str = "text", least_score: float = 0.0) -> DataFrame:
    """The documents whose language is known with at least ``least_score``, all columns kept."""
    known = docs.sparkSession.sparkContext.broadcast(profiles)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.begin("language")
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            stays: list[bool] = []
            for i, j in text_ranges(texts):
                languages, scores = closest(texts[i:j], known.value)
                stays += [lang != UNKNOWN and s >= least_score for lang, s in zip(languages, scores, strict=True)]
            yield batch.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
