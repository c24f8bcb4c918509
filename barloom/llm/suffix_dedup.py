"""Exact removal of long repeated byte strings, by bucket-pointer refinement of suffixes.

Two equal strings of ``length`` bytes contain the same anchor at the same place: the q-gram whose hash
is the least of the string. So anchors are the only suffixes that need initial buckets, one per q-gram:

1. Every chunk of documents sends the buckets of its anchors; buckets with one document are done.
2. The other buckets get the bytes that their anchors stand for (the strings whose least q-gram the
   anchor is), equal bytes of a chunk once with their smallest document.
3. A bucket whose bytes are all equal is done. In the others all suffixes are refined: initial buckets
   are q-grams, sorted on the bucket pointer ``q`` bytes on, then, as a pointer now stands for ``2q``
   bytes, on the pointer ``2q`` bytes on, and so on until pointers stand for ``length`` bytes; suffixes
   alone in their bucket drop out. Each bucket knows its smallest document.
4. Chunks get these documents back and remove what a smaller document has.

Everything is shuffled by bucket or by chunk. Where a passage or copy is long enough to fill the bytes of an
anchor, a third of all documents cost one entry per chunk and bucket. At its edges, and in shared lines
shorter than that, each document has bytes of its own around the same q-gram. A q-gram with more than
``SLICE`` different bytes around it is therefore not refined in its bucket: each of its strings of
``length`` bytes is sent by a hash of the string, equal strings of a chunk once, to all buckets alike.
Hashes only choose anchors and buckets; equality is that of bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import (
    blob_to_table,
    chunked,
    from_blob,
    range_bits,
    shared_keys,
    shared_of,
    short,
    to_blob,
)
from .scanning import encoded, mix

LENGTH = 50
GRAM = 20
BLOCK = 1 << 18
SLICE = 1 << 14
ROWS = 1 << 16
#: Numbers of contexts that 7 bits stand for, each at most 15 % (or one) above the one before.
STEPS = np.maximum(np.arange(128), 1.15 ** np.arange(128)).astype(np.int64)
HOT = 255
NO_ID = np.iinfo(np.int64).max
_ROW = "kind int, chunk long, bucket int, payload binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


class Texts(NamedTuple):
    """The documents of a chunk in one buffer, document k in ``bounds[k]:bounds[k + 1]``."""

    buffer: np.ndarray
    bounds: np.ndarray
    ids: np.ndarray


class Anchors(NamedTuple):
    """Anchor keys and documents; each owns the strings that start in ``first`` to ``last``."""

    keys: np.ndarray
    at: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    last: np.ndarray


def read_texts(table: pa.Table, id_col: str, text_col: str) -> Texts:
    texts = encoded(table.column(text_col))
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64))).astype(np.int64)
    ids = np.array([NO_ID if i is None else i for i in table.column(id_col).to_pylist()], np.int64)
    return Texts(np.frombuffer(b"".join(texts), np.uint8), bounds, ids)


def grams(buffer: np.ndarray) -> np.ndarray:
    """At each byte, it and the seven after it as one integer, zeros after the end."""
    padded = np.concatenate((buffer, np.zeros(16, np.uint8)))
    out = np.empty(len(buffer) + 8, np.uint64)
    for k in range(8):
        part = padded[k : k + (len(padded) - k) // 8 * 8].view(np.uint64)
        into = out[k::8]
        into[:] = part[: len(into)]
    return out[: len(buffer)]


def find_anchors(texts: Texts, length: int = LENGTH, gram: int = GRAM) -> Anchors:
    """The least q-gram of each string of ``length`` bytes, the leftmost of equals, block by block."""
    starts = np.zeros(len(texts.buffer) + 1, np.int32)
    np.add.at(starts, texts.bounds[:-1], 1)
    np.add.at(starts, np.maximum(texts.bounds[1:] - length + 1, texts.bounds[:-1]), -1)
    valid = np.cumsum(starts[:-1], dtype=starts.dtype) > 0
    parts = [_anchors_of_block(texts.buffer[k : k + BLOCK + length - 1], valid[k : k + BLOCK], k, length, gram) for k in range(0, len(valid), BLOCK)]
    if not parts:
        empty = np.zeros(0, np.int64)
        return Anchors(np.zeros(0, np.uint64), empty, empty, empty, empty)
    keys, at, first, last = (np.concatenate(x) for x in zip(*parts, strict=True))
    return Anchors(keys, at, np.searchsorted(texts.bounds, first, side="right") - 1, first, last)


def _anchors_of_block(buffer: np.ndarray, valid: np.ndarray, base: int, length: int, gram: int) -> tuple:
    """Keys, places, first and last string of the anchors of the strings that start at ``valid`` places."""
    n, width = len(buffer), length - gram + 1
    valid = np.flatnonzero(valid)
    if not len(valid):
        return np.zeros(0, np.uint64), valid, valid, valid
    v = grams(buffer)
    h = v * np.uint64(0x9E3779B97F4A7C15)
    for k in range(8, gram, 8):
        at = min(k, gram - 8)
        h[: n - at] = (h[: n - at] ^ (h[: n - at] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + v[at:]
    h = mix(h)
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    owner = (least[valid] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cut = np.concatenate(([True], (owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1] + 1), [True]))
    runs = np.flatnonzero(cut)
    at = owner[runs[:-1]]
    return mix(h[at] + np.uint64(gram)), at + base, valid[runs[:-1]] + base, valid[runs[1:] - 1] + base


def document_counts(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and in how many documents each is."""
    order = np.lexsort((docs, keys))
    k, d = keys[order], docs[order]
    new_key = np.concatenate(([True], k[1:] != k[:-1])) if len(k) else np.zeros(0, bool)
    new_pair = new_key | np.concatenate(([True], d[1:] != d[:-1]))[: len(k)]
    firsts = np.flatnonzero(new_key)
    return k[firsts], np.add.reduceat(new_pair.astype(np.int64), firsts) if len(firsts) else firsts


def string_hashes(texts: Texts, anchors: Anchors, length: int) -> np.ndarray:
    """A hash of the bytes that each anchor stands for and of its place in them."""
    v, sizes = grams(texts.buffer), anchors.last - anchors.first + length
    h = mix((sizes << 16 | (anchors.at - anchors.first)).astype(np.uint64))
    for k in range(0, int(sizes.max(initial=0)), 8):
        h = mix(h + v[np.minimum(anchors.first + k, anchors.last + length - 8)]) * np.uint64(0x9E3779B97F4A7C15)
    return h


def context_codes(texts: Texts, anchors: Anchors, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys; 128 where several documents have them, plus the step of their number of contexts."""
    keys, docs = document_counts(anchors.keys, anchors.doc)
    contexts = document_counts(anchors.keys, string_hashes(texts, anchors, length))[1]
    return keys, (docs > 1) * 128 + np.minimum(np.searchsorted(STEPS, contexts), 127)


def split_anchors(texts: Texts, anchors: Anchors, hot: np.ndarray, length: int) -> Anchors:
    """The anchors; of the hot ones each string, with a key of its own bytes."""
    n = (anchors.last - anchors.first + 1)[hot]
    start = np.repeat(anchors.first[hot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    split = Anchors(start, start, np.repeat(anchors.doc[hot], n), start, start)
    split = split._replace(keys=string_hashes(texts, split, length))
    return Anchors(*(np.concatenate((x[~hot], y)) for x, y in zip(anchors, split, strict=True)))


def rows_of_bytes(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """A row per string, zeros after its end."""
    columns = np.arange(width)
    out = np.empty((len(starts), width), np.uint8)
    for k in range(0, len(starts), ROWS):
        part = out[k : k + ROWS]
        part[:] = buffer[np.minimum(starts[k : k + ROWS, None] + columns, max(len(buffer) - 1, 0))]
        part[columns >= sizes[k : k + ROWS, None]] = 0
    return out


def equal_rows(strings: np.ndarray, *marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings equal rows (bytes and marks) together, and where a new one begins."""
    h = np.zeros(len(strings), np.uint64)
    words = np.ascontiguousarray(strings).view(np.uint64)
    for column in (*marks, *words.T):
        h = mix(h + column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(h, kind="stable")
    new = np.ones(len(order), bool)
    same = (words[order[1:]] == words[order[:-1]]).all(axis=1)
    for mark in marks:
        same &= mark[order[1:]] == mark[order[:-1]]
    new[1:] = ~same
    return order, new


def refine(strings: np.ndarray, sizes: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Bucket pointers of all ``length``-byte strings inside the given rows of bytes.

    The result has a pointer for each byte place; equal strings, and only they, have equal pointers.
    Places where no such string starts have -1.
    """
    flat = strings.reshape(-1)
    width = strings.shape[1]
    room = (sizes[:, None] - np.arange(width)).reshape(-1)
    depth = 8
    active = np.flatnonzero(room >= length)
    needed = np.flatnonzero(room >= depth)
    pointer = np.full(len(flat), -1, np.int64)
    pointer[needed] = np.unique(grams(flat)[needed], return_inverse=True)[1]
    while depth < length:
        step = min(depth, length - depth)
        places = np.flatnonzero(room >= depth + step)
        bucket = pointer[places]
        alone = np.bincount(bucket)[bucket] == 1
        refined = np.full(len(flat), -1, np.int64)
        rest = places[~alone]
        pairs = (pointer[rest].astype(np.uint64) << np.uint64(32)) | pointer[rest + step].astype(np.uint64)
        values, new = np.unique(pairs, return_inverse=True)
        refined[rest] = new
        refined[places[alone]] = len(values) + np.arange(alone.sum())
        pointer, depth = refined, depth + step
    out = np.full(len(flat), -1, np.int64)
    out[active] = pointer[active]
    return out.reshape(strings.shape)


def smallest_documents(
    keys: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, smallest: np.ndarray, strings: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each entry's strings, runs with the same smallest document: entry, length, document."""
    order, new = equal_rows(strings, keys, offsets, sizes)
    firsts = np.flatnonzero(new)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    least = np.minimum.reduceat(smallest[order], firsts)
    head = order[firsts]
    _, bucket, members = np.unique(keys[head], return_inverse=True, return_counts=True)
    mixed = np.flatnonzero(members[bucket] > 1)
    windows = sizes - length + 1
    run_entry, run_length, run_doc = [], [], []
    plain = members[bucket[group]] == 1
    run_entry.append(np.flatnonzero(plain))
    run_length.append(windows[plain])
    run_doc.append(least[group[plain]])
    if len(mixed):
        pointers = refine(strings[head[mixed]], sizes[head[mixed]], length)
        rows, columns = np.nonzero(pointers >= 0)
        p = pointers[rows, columns]
        best = np.full(p.max() + 1, NO_ID, np.int64)
        np.minimum.at(best, p, least[mixed][rows])
        m = best[p]
        begins = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (m[1:] != m[:-1]))))
        lengths = np.diff(np.append(begins, len(m)))
        by_group = np.full(len(firsts), -1, np.int64)
        by_group[mixed] = np.arange(len(mixed))
        entries = np.flatnonzero(~plain)
        row = by_group[group[entries]]
        bounds = np.searchsorted(rows[begins], np.arange(len(mixed) + 1))
        counts = np.diff(bounds)[row]
        runs = np.repeat(bounds[row] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        run_entry.append(np.repeat(entries, counts))
        run_length.append(lengths[runs])
        run_doc.append(m[begins][runs])
    entry, size, doc = (np.concatenate(x) for x in (run_entry, run_length, run_doc))
    order = np.argsort(entry, kind="stable")
    return entry[order], size[order], doc[order]


def key_slices(keys: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Ranges of about ``size`` sorted keys that never part equal keys."""
    cuts = [0]
    while cuts[-1] < len(keys):
        stop = min(cuts[-1] + size, len(keys))
        cuts.append(int(np.searchsorted(keys, keys[stop - 1], side="right")))
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def covered(texts: Texts, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of the buffer that lie in any of the ranges."""
    steps = np.bincount(starts, minlength=len(texts.buffer) + 1) - np.bincount(ends, minlength=len(texts.buffer) + 1)
    return np.cumsum(steps[: len(texts.buffer)]) > 0


def repeated_bytes(
    docs: DataFrame, finish: Callable, schema: str | T.StructType, id_col: str, text_col: str, length: int = LENGTH
) -> DataFrame:
    """Find the bytes of each text that a smaller document repeats; ``finish(table, texts, mask)`` makes the rows."""
    gram, width = GRAM, -(-(2 * length - GRAM) // 8) * 8
    chunks = chunked(docs, text_col, owner="suffix dedup")
    bits = range_bits(chunks, (length - gram + 2) / 2)

    most = SLICE

    def keys_of(table: pa.Table):
        texts = read_texts(table, id_col, text_col)
        return context_codes(texts, find_anchors(texts, length, gram), length)

    def total(codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        docs = np.add.reduceat((codes >> np.uint64(7)) + np.uint64(1), firsts)
        contexts = np.add.reduceat(STEPS[codes & np.uint64(127)], firsts)
        return np.where((docs > 1) & (contexts > most), HOT, np.minimum(docs, 2))

    def entries_of(group: pa.Table) -> pa.Table:
        """Kind 0: the entries of a bucket. Kind 1: a chunk's own anchors."""
        chunk = group.column("chunk")[0].as_py()
        kinds, buckets, blobs = (group.column(k).to_pylist() for k in ("kind", "bucket", "payload"))
        texts = read_texts(blob_to_table(blobs[kinds.index(0)]), id_col, text_col)
        a = find_anchors(texts, length, gram)
        answers = [k for k, kind in enumerate(kinds) if kind]
        shared, totals = shared_of([buckets[k] for k in answers], [blobs[k] for k in answers])
        keys = short(a.keys, bits)
        place = np.searchsorted(shared, keys)
        held = np.flatnonzero(shared[np.minimum(place, max(len(shared) - 1, 0))] == keys) if len(shared) else place[:0]
        a = split_anchors(texts, Anchors(*(x[held] for x in a)), totals[place[held]] == HOT, length)
        keys = short(a.keys, bits)
        sizes = a.last - a.first + length
        strings = rows_of_bytes(texts.buffer, a.first, sizes, width)
        order, new = equal_rows(strings, keys, a.at - a.first, sizes)
        firsts = np.flatnonzero(new)
        heads = order[firsts]
        smallest = np.minimum.reduceat(texts.ids[a.doc[order]], firsts) if len(firsts) else texts.ids[:0]
        by_key = np.argsort(keys[heads], kind="stable")
        heads, smallest = heads[by_key], smallest[by_key]
        rank = np.empty(len(firsts), np.int64)
        rank[by_key] = np.arange(len(firsts))
        entry = np.empty(len(order), np.int64)
        entry[order] = rank[np.cumsum(new) - 1]
        bounds = np.searchsorted(keys[heads], np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32))
        rows = [(1, chunk, -1, to_blob(entry.astype(np.uint32), a.first, bounds))]
        for bucket, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if i < j:
                part = heads[i:j]
                filled = np.arange(width) < sizes[part][:, None]
                rows.append(
                    (0, chunk, bucket, to_blob((keys[part] & np.uint64(0xFFFFFFFF)).astype(np.uint32), (a.at - a.first)[part].astype(np.uint16), sizes[part].astype(np.uint16), smallest[i:j], strings[part][filled]))
                )
        return _table(rows)

    def answer(group: pa.Table) -> pa.Table:
        chunk, bucket, blobs = (group.column(k) for k in ("chunk", "bucket", "payload"))
        parts = [from_blob(b.as_py(), np.uint32, np.uint16, np.uint16, np.int64, np.uint8) for b in blobs]
        keys, offsets, sizes, smallest, flat = (np.concatenate(x) for x in zip(*parts, strict=True))
        sizes = sizes.astype(np.int64)
        begins = np.cumsum(sizes) - sizes
        by_key = np.argsort(keys, kind="stable")
        found = []
        for i, j in key_slices(keys[by_key], SLICE):
            part = by_key[i:j]
            strings = rows_of_bytes(flat, begins[part], sizes[part], width)
            entry, run, doc = smallest_documents(keys[part], offsets[part], sizes[part], smallest[part], strings, length)
            found.append((part[entry], run, doc))
        entry, run, doc = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(entry, kind="stable")
        entry, run, doc = entry[order], run[order], doc[order]
        bounds = np.concatenate(([0], np.cumsum([len(p[0]) for p in parts])))
        cuts = np.searchsorted(entry, bounds)
        return _table(
            [
                (2, chunk[k].as_py(), bucket[k].as_py(), to_blob((entry[i:j] - bounds[k]).astype(np.uint32), run[i:j].astype(np.uint16), doc[i:j]))
                for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))
            ]
        )

    def result(group: pa.Table) -> pa.Table:
        kinds, buckets, blobs = (group.column(k).to_pylist() for k in ("kind", "bucket", "payload"))
        table = blob_to_table(blobs[kinds.index(0)])
        texts = read_texts(table, id_col, text_col)
        starts = ends = np.zeros(0, np.int64)
        if 1 in kinds:
            entry, first, bounds = from_blob(blobs[kinds.index(1)], np.uint32, np.int64, np.int64)
            runs = [(bounds[buckets[k]], *from_blob(blobs[k], np.uint32, np.uint16, np.int64)) for k, kind in enumerate(kinds) if kind == 2]
            runs.sort(key=lambda r: r[0])
            if runs:
                of = np.concatenate([r[1] + r[0] for r in runs])
                size = np.concatenate([r[2] for r in runs]).astype(np.int64)
                doc = np.concatenate([r[3] for r in runs])
                begin = np.cumsum(size) - size
                cuts = np.searchsorted(of, np.arange(bounds[-1] + 1))
                begin -= np.repeat(begin[cuts[:-1]], np.diff(cuts))
                counts = np.diff(cuts)[entry]
                at = np.repeat(cuts[entry] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
                start = np.repeat(first, counts) + begin[at]
                own = texts.ids[np.searchsorted(texts.bounds, start, side="right") - 1]
                taken = doc[at] < own
                starts = start[taken]
                ends = starts + size[at][taken] - 1 + length
        return finish(table, texts, covered(texts, starts, ends))

    payloads = chunks.select(F.lit(0).alias("kind"), "chunk", F.lit(-1).alias("bucket"), "payload")
    shared = shared_keys(chunks, keys_of, bits, total).select(F.lit(1).alias("kind"), "chunk", "bucket", "payload")
    # Not stored: made twice from one exchange, which costs less than writing them once.
    entries = payloads.unionByName(shared).groupBy("chunk").applyInArrow(entries_of, _ROW)
    answers = entries.filter("kind = 0").groupBy("bucket").applyInArrow(answer, _ROW)
    together = payloads.unionByName(entries.filter("kind = 1")).unionByName(answers)
    return together.groupBy("chunk").applyInArrow(result, schema)


def _table(rows: list[tuple]) -> pa.Table:
    kinds, chunks, buckets, blobs = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table([pa.array(kinds, pa.int32()), pa.array(chunks, pa.int64()), pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary())], names=["kind", "chunk", "bucket", "payload"])


def _kept(texts: Texts, mask: np.ndarray) -> list[bytes]:
    raw, kept = texts.buffer.tobytes(), texts.buffer[~mask].tobytes()
    gone = np.concatenate(([0], np.cumsum(mask)))[texts.bounds]
    at = texts.bounds - gone
    return [kept[i:j] if g else raw[k:m] for i, j, k, m, g in zip(at[:-1], at[1:], texts.bounds[:-1], texts.bounds[1:], np.diff(gone), strict=True)]


def repeat_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per document: its bytes, those that a smaller document repeats, their runs, and a digest of the rest.

    A byte is removed when it lies in a string of ``length`` bytes that also starts in a document with a
    smaller id; strings are judged on the input. Null text is empty. A null id counts as larger than any
    id, equal ids (repeated rows) never remove from each other, and null ids neither. Only the id and the
    text of ``docs`` are read, so other columns may have any name. An empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def finish(table: pa.Table, texts: Texts, mask: np.ndarray) -> pa.Table:
        rises = mask.copy()
        rises[1:] &= ~mask[:-1]
        inner = texts.bounds[:-1][texts.bounds[:-1] < len(mask)]
        rises[inner] = mask[inner]
        total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[texts.bounds])
        digests = [hashlib.sha256(t).hexdigest() for t in _kept(texts, mask)]
        return pa.table(
            [table.column("doc_id"), pa.array(np.diff(texts.bounds)), pa.array(total(mask)), pa.array(total(rises)), pa.array(digests, pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    return repeated_bytes(docs, finish, RESULT, "doc_id", "text", length)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """The documents with those bytes taken out of the text, all columns kept.

    A character that loses a part of its bytes goes. A document that had text and has none left is
    dropped; null and empty texts stay as they are. Order by ids as in ``repeat_report``.
    """
    place = docs.columns.index(text_col)

    def finish(table: pa.Table, texts: Texts, mask: np.ndarray) -> pa.Table:
        left = [t.decode("utf-8", "ignore") for t in _kept(texts, mask)]
        null = table.column(place).is_null().to_pylist()
        text = pa.array([None if x else t for t, x in zip(left, null, strict=True)], table.schema.field(place).type)
        stays = [bool(t) or not n for t, n in zip(left, np.diff(texts.bounds), strict=True)]
        return table.set_column(place, table.schema.field(place), text).filter(pa.array(stays, pa.bool_()))

    return repeated_bytes(docs, finish, docs.schema, id_col, text_col, length)
