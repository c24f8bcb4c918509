"""Benchmark decontamination with suffix arrays over shards of the training documents.

A shard is a run of documents that a task reads together. Its suffix array has the word suffixes that
start with a word gram of the benchmark; no other suffix can match. Each test window, the first words
of a test suffix, is binary-searched in every shard: the suffixes that start with it are neighbours.
Windows that follow each other in a document and in an item make longer verbatim matches; these are listed
on request only, since a sentence that many items share meets each of them at every place.

Only the benchmark is sent to the tasks. It is the stated query set; it goes in blocks whose text has
at most ``BLOCK_BYTES``. A task holds all blocks and searches its documents for one after the other.
Documents are not shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import workers
from .scanning import Words, batches_by_size, encoded, scan_words, sequence_hashes, word_bytes

WINDOW = 10
GRAM = 3
BLOCK_BYTES = 8 << 20
#: ASCII bytes that part words, all but digits and letters.
SEPARATORS = (*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80))
_IS_WORD = word_bytes(SEPARATORS)
RESULT = "doc_id long, n_words long, n_hit long, items array<string>"
MATCHES = ", matches array<struct<item_id:string,item_word:long,doc_word:long,n_words:long>>"


class Windows(NamedTuple):
    """Distinct test windows of a block: word hashes, lengths, first grams, where in which items each is, and its items."""

    words: np.ndarray
    lengths: np.ndarray
    grams: np.ndarray
    gram: int
    bits: np.ndarray
    place_bounds: np.ndarray
    place_item: np.ndarray
    place_word: np.ndarray
    item_bounds: np.ndarray
    item_of: np.ndarray
    items: list[str | None]


class Hits(NamedTuple):
    """Of one document: words, words hit, items, and maximal matches (item, item word, document word, words)."""

    n_words: int
    n_hit: int
    items: list[str]
    matches: list[tuple[str | None, int, int, int]]


def windows_of(items: list[tuple[str | None, bytes]], window: int = WINDOW, gram: int = GRAM) -> list[Windows]:
    """Windows of ``window`` words of each item; an item with fewer words, but not none, is one window.

    Windows of fewer words than a gram are sets of their own, as their shorter grams would meet most texts.
    """
    words = scan_words([text for _, text in items], _IS_WORD)
    sizes = np.minimum(words.counts, window)
    steps = [(n, n + 1) for n in range(1, min(gram, window))] + [(min(gram, window), window + 1)]
    return [_windows(items, words, np.where((low <= sizes) & (sizes < high), sizes, 0), window, low) for low, high in steps if ((low <= sizes) & (sizes < high)).any()]


def _windows(items: list[tuple[str | None, bytes]], words: Words, sizes: np.ndarray, window: int, gram: int) -> Windows:
    """The windows of the items with a size, which is 0 for the others."""
    counts = np.where(sizes > 0, words.counts - sizes + 1, 0)
    item = np.repeat(np.arange(len(items)), counts)
    word = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    length = sizes[item]
    places = words.offsets[:-1][item] + word
    columns = np.arange(window)
    rows = np.concatenate((words.hashes, np.zeros(window, np.uint64)))[places[:, None] + columns]
    rows[columns >= length[:, None]] = 0
    distinct, which = np.unique(rows, axis=0, return_inverse=True)
    which = which.reshape(-1)
    order = np.argsort(which, kind="stable")
    lengths = np.zeros(len(distinct), np.int64)
    lengths[which] = length
    grams = sequence_hashes(distinct[:, :gram].reshape(-1), gram)[::gram]
    bits = np.zeros(1 << 20, bool)
    bits[grams >> np.uint64(44)] = True
    bounds = np.searchsorted(which[order], np.arange(len(distinct) + 1))
    own = np.unique(which << 32 | item)
    item_bounds = np.searchsorted(own >> 32, np.arange(len(distinct) + 1))
    return Windows(distinct, lengths, grams, gram, bits, bounds, item[order], word[order], item_bounds, own & 0xFFFFFFFF, [i for i, _ in items])


def bounds_in(array: np.ndarray, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each window, the range of the suffix array whose suffixes start with it, by binary search."""
    inside = np.arange(windows.shape[1]) < lengths[:, None]
    found = []
    for after_equal in (False, True):
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), len(array), np.int64)
        while (open_ := low < high).any():
            middle = (low + high) // 2
            rows = array[np.minimum(middle, len(array) - 1)]
            differ = (rows != windows) & inside
            first = differ.argmax(axis=1)
            at = np.arange(len(windows))
            right = np.where(differ[at, first], rows[at, first] < windows[at, first], after_equal)
            low = np.where(open_ & right, middle + 1, low)
            high = np.where(open_ & ~right, middle, high)
        found.append(low)
    return found[0], found[1]


def search_shard(texts: list[bytes], blocks: list[Windows], with_matches: bool = False) -> list[Hits]:
    """Find the windows of all blocks in the documents of one shard."""
    words = scan_words(texts, _IS_WORD)
    total = len(words.hashes)
    last = np.repeat(words.offsets[1:], words.counts)
    doc_of = np.repeat(np.arange(len(texts)), words.counts)
    steps = np.zeros(total + 1, np.int64)
    items: dict[int, set[str]] = {}
    matches: dict[int, list] = {}
    for block in blocks:
        grams = sequence_hashes(words.hashes, block.gram)
        starts = np.flatnonzero(block.bits[grams >> np.uint64(44)])
        starts = starts[np.isin(grams[starts], block.grams) & (starts + block.gram <= last[starts])]
        if not len(starts):
            continue
        wanted = np.flatnonzero(np.isin(block.grams, grams[starts]))
        columns = np.arange(block.words.shape[1])
        places = starts[:, None] + columns
        suffixes = words.hashes[np.minimum(places, total - 1)]
        suffixes[places >= last[starts][:, None]] = 0
        order = np.lexsort(suffixes.T[::-1])
        starts, suffixes = starts[order], suffixes[order]
        low, high = bounds_in(suffixes, block.words[wanted], block.lengths[wanted])
        wanted, low, n = wanted[high > low], low[high > low], (high - low)[high > low]
        if not len(wanted):
            continue
        window = np.repeat(wanted, n)
        at = starts[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        np.add.at(steps, at, 1)
        np.add.at(steps, at + block.lengths[window], -1)
        for doc, own in items_met(block, window, doc_of[at]):
            items.setdefault(doc, set()).update(own)
        for doc, found in maximal_matches(block, window, at, words.offsets, doc_of) if with_matches else ():
            matches.setdefault(doc, []).extend(found)
    hit = np.concatenate(([0], np.cumsum(np.cumsum(steps[:total]) > 0)))
    n_hit = np.diff(hit[words.offsets])
    return [Hits(int(n), int(h), sorted(items.get(d, ())), sorted(matches.get(d, []), key=str)) for d, (n, h) in enumerate(zip(words.counts, n_hit, strict=True))]


def items_met(block: Windows, window: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, list[str]]]:
    """The items of each document, from its distinct windows; a document's items are marked, not listed by place."""
    met = np.unique(doc << 32 | window)
    bounds = np.flatnonzero(np.diff(met >> 32, prepend=-1, append=1 << 40))
    for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        marked = np.zeros(len(block.items), bool)
        for w in (met[i:j] & 0xFFFFFFFF).tolist():
            marked[block.item_of[block.item_bounds[w] : block.item_bounds[w + 1]]] = True
        yield int(met[i] >> 32), [block.items[k] for k in np.flatnonzero(marked).tolist() if block.items[k] is not None]


def maximal_matches(block: Windows, window: np.ndarray, at: np.ndarray, offsets: np.ndarray, doc_of: np.ndarray) -> Iterator:
    """Per document, its longest verbatim matches: windows that follow each other in text and item."""
    n = np.diff(block.place_bounds)[window]
    place = np.repeat(block.place_bounds[:-1][window] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    at, length = np.repeat(at, n), np.repeat(block.lengths[window], n)
    item, word = block.place_item[place], block.place_word[place]
    doc = doc_of[at]
    order = np.lexsort((at, at - word, item, doc))
    at, length, item, word, doc = (x[order] for x in (at, length, item, word, doc))
    follows = (doc[1:] == doc[:-1]) & (item[1:] == item[:-1]) & (at[1:] == at[:-1] + 1) & (word[1:] == word[:-1] + 1)
    firsts = np.flatnonzero(np.concatenate(([True], ~follows)))
    lasts = np.append(firsts[1:], len(at)) - 1
    sizes = at[lasts] + length[lasts] - at[firsts]
    by_doc: dict[int, list] = {}
    for k, size in zip(firsts.tolist(), sizes.tolist(), strict=True):
        d = int(doc[k])
        by_doc.setdefault(d, []).append((block.items[item[k]], int(word[k]), int(at[k] - offsets[d]), size))
    yield from by_doc.items()


def _search(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text: str, window: int, rows: Callable, schema, with_matches: bool = False) -> DataFrame:
    """``rows(batch, hits)`` makes the output batch of each input batch."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    context, blocks = docs.sparkSession.sparkContext, []
    for k in range(n):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).filter("text is not null").collect()
        blocks += [context.broadcast(found) for found in windows_of([(r.item, r.text.encode()) for r in part], window)]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.begin("decontamination")
        known = [b.value for b in blocks]
        for batch in batches:
            texts = encoded(batch.column(text_col))
            hits = [h for i, j in batches_by_size(texts) for h in search_shard(texts[i:j], known, with_matches)]
            yield rows(batch, hits)

    return docs.mapInArrow(search, schema)


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, with_matches: bool = False,
) -> DataFrame:
    """One row per document: its words, those inside a benchmark window and the items met.

    ``with_matches`` adds the longest verbatim matches, one for every place of an item at every place of the
    document, so their number is a product where both repeat a sentence.

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. A window has ``window``
    words of an item, or all words of a shorter one. Null text has no words, an item without words no
    windows. Items with a null id hit, but are not listed. Repeated rows and null ids give a row each; an
    empty benchmark hits nothing; an empty table gives no rows. Other columns are not read.
    """

    def rows(batch: pa.RecordBatch, hits: list[Hits]) -> pa.RecordBatch:
        columns = {
            "doc_id": batch.column("doc_id"), "n_words": pa.array([h.n_words for h in hits], pa.int64()), "n_hit": pa.array([h.n_hit for h in hits], pa.int64()),
            "items": pa.array([h.items for h in hits], pa.list_(pa.string())),
        }
        if with_matches:
            match = pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("n_words", pa.int64())])
            columns["matches"] = pa.array([[dict(zip(match.names, m, strict=True)) for m in h.matches] for h in hits], pa.list_(match))
        return pa.record_batch(list(columns.values()), names=list(columns))

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _search(docs, benchmark, "text", item_col, item_text, window, rows, RESULT + MATCHES * with_matches, with_matches)


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW
) -> DataFrame:
    """The documents that have no word inside a benchmark window, all columns kept."""

    def rows(batch: pa.RecordBatch, hits: list[Hits]) -> pa.RecordBatch:
        return batch.filter(pa.array([not h.n_hit for h in hits], pa.bool_()))

    return _search(docs, benchmark, text_col, item_col, item_text, window, rows, docs.schema)
