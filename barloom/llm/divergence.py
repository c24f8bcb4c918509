"""Divergence of sources: how the terms of each source of a language differ from the others' and the language's.

Terms are counted by sorting pointers. The texts of a slice lie one after the other in an Arrow buffer; a
pointer to the first byte of each term is all that moves. Multikey quicksort orders the pointers by
eight bytes at a time: slices larger than ``SLICE_POINTERS`` are parted into less, equal and greater, smaller
ones are finished level by level. Equal pointers then stand in runs, and a run gives a term's
occurrences and documents in each source at once.

What leaves a task is one row per slice, language and term, with the sources that hold it, so that a term
which most rows hold is added up before the exchange. Document frequencies decide which terms a language
keeps. Pairs of sources are compared in blocks of ``SOURCES_AT_ONCE`` by as many, over one hash range of
terms at a time, so neither a language of many sources nor one of many terms is gathered in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.staging import stored

from .scanning import LOWER, batches_by_size

SLICE_BYTES = 16 << 20
SLICE_POINTERS = 1 << 19
LEAST_DOCUMENTS = 30
TOP_TERMS = 50
UNIT = 1_000_000_000
SMOOTHING = 5
SOURCES_AT_ONCE = 128
TERMS_AT_ONCE = 1 << 15
#: Ranges of terms are so many that comparing has about so many tasks, as long as a range has LEAST_TERMS.
COMPARE_TASKS, LEAST_TERMS = 256, 512
COUNTED = "lang string, term string, docs long, sources array<string>, counts array<long>"
PAIRED = "lang string, source string, item string, part_value long"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_MASKS = np.array([0, *(((1 << 8 * k) - 1) << 8 * (8 - k) for k in range(1, 9))], np.uint64)


def term_pointers(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and length of every term of the buffer."""
    inside = np.concatenate(([False], _LETTER[buffer], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2] - edges[::2]


def eight_bytes(buffer: np.ndarray) -> np.ndarray:
    """A view with the eight bytes from each place on, first byte highest; nothing is copied but the buffer."""
    padded = np.concatenate((buffer, np.zeros(8, np.uint8)))
    return np.ndarray((len(buffer) + 1,), ">u8", padded.data, strides=(1,))


def characters(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes of each term from ``depth`` on as one number, zeros after its end."""
    at = np.minimum(starts + depth, len(words) - 1)
    return words[at].astype(np.uint64) & _MASKS[np.clip(sizes - depth, 0, 8)]


def sort_pointers(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort: the order of the terms by their bytes, and the place of each run of equal terms.

    Terms hold no zero byte, so eight zeros after a term's end are less than all that goes on.
    """
    words = eight_bytes(buffer)
    order, first = np.arange(len(starts)), np.zeros(len(starts), bool)
    stack = [(0, len(starts), 0)]
    while stack:
        low, high, depth = stack.pop()
        if high - low <= SLICE_POINTERS:
            finish(words, starts, sizes, order[low:high], first[low:high], depth)
            continue
        own = order[low:high]
        keys = characters(words, starts[own], sizes[own], depth)
        sample = np.sort(keys[:: max(1, len(keys) // 100)])
        pivot = sample[len(sample) // 2]
        less, equal = keys < pivot, keys == pivot
        order[low:high] = np.concatenate((own[less], own[equal], own[~less & ~equal]))
        a = low + int(less.sum())
        b = a + int(equal.sum())
        if pivot & np.uint64(255):
            stack.append((a, b, depth + 8))
        else:
            first[a] = True
        stack += [part for part in ((low, a, depth), (b, high, depth)) if part[0] < part[1]]
    return order, np.flatnonzero(first)


def finish(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, order: np.ndarray, first: np.ndarray, depth: int) -> None:
    """Sort the pointers of one slice, equal ones of all prefixes a level deeper at once."""
    if not len(order):
        return
    keys = characters(words, starts[order], sizes[order], depth)
    move = np.argsort(keys, kind="stable")
    order[:] = order[move]
    keys = keys[move]
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    first |= new
    group = np.cumsum(new)
    going = np.flatnonzero(keys & np.uint64(255) != 0)
    group = group[going]
    while len(going):
        depth += 8
        own = order[going]
        keys = characters(words, starts[own], sizes[own], depth)
        move = np.lexsort((keys, group))
        order[going] = own[move]
        keys = keys[move]
        new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (group[1:] != group[:-1])))
        first[going] |= new
        on = np.flatnonzero(keys & np.uint64(255) != 0)
        going, group = going[on], np.cumsum(new)[on]


def count_slice(texts: list[bytes], group: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Terms of a slice, and for every term and group that holds it an entry, occurrences and documents.

    Entries are ``term number << 32 | group`` in ascending order.
    """
    buffer = np.frombuffer(b" ".join([*texts, b""]).translate(LOWER), np.uint8)
    starts, sizes = term_pointers(buffer)
    none = np.zeros(0, np.int64)
    if not len(starts):
        return [], none, none, none
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    order, runs = sort_pointers(buffer, starts, sizes)
    term = np.repeat(np.arange(len(runs)), np.diff(np.append(runs, len(order))))
    held = term << 32 | np.searchsorted(ends, starts[order], side="right")
    held.sort()
    changed = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1])))
    times = np.diff(np.append(changed, len(held)))
    entry = held[changed] >> 32 << 32 | group[held[changed] & 0xFFFFFFFF]
    move = np.argsort(entry, kind="stable")
    entry, times = entry[move], times[move]
    firsts = np.flatnonzero(np.concatenate(([True], entry[1:] != entry[:-1])))
    raw, at = buffer.tobytes(), order[runs]
    terms = [raw[i : i + n] for i, n in zip(starts[at].tolist(), sizes[at].tolist(), strict=True)]
    return terms, entry[firsts], np.add.reduceat(times, firsts), np.diff(np.append(firsts, len(entry)))


def slices(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows of the batch that make about ``size`` bytes, with the bytes of their texts; a longer text stands alone."""
    column = batch.column("text")
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].tolist()
    view = memoryview(data) if data is not None else memoryview(b"")
    texts = [bytes(view[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
    for i, j in batches_by_size(texts, size):
        yield batch.slice(i, j - i), texts[i:j]


def _named(docs: DataFrame, lang_col: str, source_col: str) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))]


def counted_terms(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``lang, term, docs, sources, counts``: a term's documents in a slice, and its occurrences by source.

    A language and term has one row per slice that holds it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for part, texts in slices(batch, SLICE_BYTES):
                pairs = list(zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), strict=True))
                groups = sorted(set(pairs))
                number = {pair: k for k, pair in enumerate(groups)}
                langs = sorted({lang for lang, _ in groups})
                lang_of = np.searchsorted(langs, [lang for lang, _ in groups])
                terms, entry, n, docs_held = count_slice(texts, np.fromiter(map(number.__getitem__, pairs), np.int64, len(pairs)))
                if not terms:
                    continue
                group = entry & 0xFFFFFFFF
                row = entry >> 32 << 32 | lang_of[group]
                firsts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                offsets = pa.array(np.append(firsts, len(row)), pa.int32())
                sources = pa.array([source for _, source in groups], pa.string()).take(pa.array(group))
                yield pa.record_batch(
                    [
                        pa.array(langs, pa.string()).take(pa.array(row[firsts] & 0xFFFFFFFF)),
                        pa.array(terms, pa.binary()).cast(pa.string()).take(pa.array(row[firsts] >> 32)),
                        pa.array(np.add.reduceat(docs_held, firsts), pa.int64()),
                        pa.ListArray.from_arrays(offsets, sources),
                        pa.ListArray.from_arrays(offsets, pa.array(n, pa.int64())),
                    ],
                    names=["lang", "term", "docs", "sources", "counts"],
                )

    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    return docs.select(*_named(docs, lang_col, source_col), text).mapInArrow(count, COUNTED)


def share(count: str, total: str, kept: str) -> Column:
    """``1 + floor(UNIT * (count + SMOOTHING) / (total + SMOOTHING * kept))`` in exact numbers; null without kept terms."""
    over = f"(cast({count} as decimal(19,0)) + {SMOOTHING}) * cast({UNIT} as decimal(10,0))"
    under = f"(cast({total} as decimal(19,0)) + {SMOOTHING} * cast({kept} as decimal(19,0)))"
    return F.expr(f"if({kept} > 0, 1 + {over} div {under}, null)")


def kept_terms(partial: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """``lang, term, source, n``: occurrences by source of the terms that enough of a language's documents hold."""
    kept = partial.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least_documents).select("lang", "term")
    rows = partial.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("held")).select("lang", "term", "held.sources", "held.counts")
    return rows.join(kept, ["lang", "term"]).groupBy("lang", "term", F.col("sources").alias("source")).agg(F.sum("counts").alias("n"))


def pair_distances(groups: DataFrame, cells: DataFrame, ranges: int) -> DataFrame:
    """``lang, source, item, value`` for all ordered pairs of a language's sources.

    ``groups`` has ``lang, source, number, zero, kept``: the share of a term that the source lacks and the number
    of terms; ``cells`` has ``lang, term, number, p``. A range of terms gives, for its terms, by how much
    they move a pair from the distance that it would have without them.
    """
    block = F.floor(F.col("number") / SOURCES_AT_ONCE)
    last = groups.groupBy("lang").agg(F.max(block).alias("last"))

    def to_block_pairs(rows: DataFrame) -> DataFrame:
        """Each row once for every pair of blocks that has its block."""
        others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))
        meets = rows.withColumn("own", block).join(last, "lang").withColumn("other", others)
        return meets.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))

    every = to_block_pairs(groups).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))))
    spread = to_block_pairs(cells).withColumn("part", F.pmod(F.xxhash64("term"), F.lit(ranges)).cast("int"))
    keys = ["lang", "low", "high", "part"]
    every = every.select(*keys, "source", "number", "zero", "kept")
    spread = spread.select(*(F.col(c).alias(c) for c in (*keys, "term", "number", "p")))  # columns of their own, as both sides come from groups

    def compare(key: tuple, sources: pa.Table, held: pa.Table) -> pa.Table:
        lang, low, high, part = (k.as_py() for k in key)
        number, zero, kept = (sources.column(c).to_numpy() for c in ("number", "zero", "kept"))
        order = np.argsort(number)
        names = sources.column("source").take(pa.array(order))
        number, zero = number[order], np.nan_to_num(zero[order]).astype(np.int64)
        terms = int(np.nan_to_num(kept[0]))
        left = np.flatnonzero(number // SOURCES_AT_ONCE == low)
        right = np.flatnonzero(number // SOURCES_AT_ONCE == high)
        gap = np.abs(zero[left][:, None] - zero[right][None, :])
        total = gap * (terms if part == 0 else 0)
        _, term = np.unique(held.column("term").combine_chunks().dictionary_encode().indices.to_numpy(), return_inverse=True)
        column, p = np.searchsorted(number, held.column("number").to_numpy()), held.column("p").to_numpy()
        move = np.argsort(term, kind="stable")
        term, column, p = term[move], column[move], p[move]
        count = int(term[-1]) + 1 if len(term) else 0
        for start in range(0, count, TERMS_AT_ONCE):
            i, j = np.searchsorted(term, (start, start + TERMS_AT_ONCE))
            n = min(TERMS_AT_ONCE, count - start)
            shares = np.tile(zero[:, None], (1, n))
            shares[column[i:j], term[i:j] - start] = p[i:j]
            for k, own in enumerate(left):
                total[k] += np.abs(shares[right] - shares[own]).sum(axis=1)
            total -= gap * n
        a, b = np.meshgrid(left, right, indexing="ij")
        once = a < b
        a, b, value = a[once], b[once], total[once]
        both = [np.concatenate(x) for x in ((a, b), (b, a), (value, value))]
        return pa.table(
            [pa.array([lang] * len(both[0]), pa.string()), names.take(pa.array(both[0])), names.take(pa.array(both[1])), pa.array(both[2], pa.int64())],
            names=["lang", "source", "item", "part_value"],
        )

    found = every.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInArrow(compare, PAIRED)
    return found.groupBy("lang", "source", "item").agg(F.sum("part_value").alias("value"))


def divergence(
    docs: DataFrame,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
    least_documents: int = LEAST_DOCUMENTS,
    top_terms: int = TOP_TERMS,
) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far sources are from each other, and by which terms.

    Terms are runs of ASCII letters and all other characters beyond ASCII, only A-Z lower-cased. A language
    keeps the terms that at least ``least_documents`` of its documents hold; a row is a document, so repeated rows
    count as often as they stand. A group's share of a term is smoothed and floored, see ``share``.

    Part ``pair``: distance to each other source of the language, summed over all kept terms, largest first.
    Part ``term``: the terms whose share is above the language's, by how much, the first ``top_terms``. Ties go
    by item in byte order. Null language, source and text count as empty; groups without terms have the shares
    of a count of 0; without kept terms all distances are 0. An empty table gives no rows; other columns are
    not read.
    """
    partial = stored(counted_terms(docs, lang_col, source_col, text_col))
    kept = stored(kept_terms(partial, least_documents))
    by_lang = kept.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    sizes = by_lang.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = stored(
        docs.select(*_named(docs, lang_col, source_col)).distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
        .select("lang", "source", place.cast("long").alias("number"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "kept", "lang_total")))
        .withColumn("zero", F.coalesce(share("0", "total", "kept"), F.lit(0)))
    )
    cells = kept.join(groups, ["lang", "source"]).select("lang", "term", "source", "number", "lang_total", "kept", share("n", "total", "kept").alias("p"))
    blocks = groups.groupBy("lang").agg(F.max("kept").alias("kept"), F.expr(f"max(number) div {SOURCES_AT_ONCE} + 1").alias("n"))
    most, block_pairs = blocks.agg(F.max("kept"), F.sum(F.expr("n * (n + 1) div 2"))).first()
    most, wanted = most or 0, COMPARE_TASKS // (block_pairs or 1)
    ranges = 1 + max(most // TERMS_AT_ONCE, min(most // LEAST_TERMS, wanted))
    pairs = pair_distances(groups.select("lang", "source", "number", "zero", "kept"), cells.select("lang", "term", "number", "p"), ranges)
    above = cells.join(by_lang, ["lang", "term"]).withColumn("value", F.col("p") - share("n", "lang_total", "kept")).filter("value > 0")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = [
        rows.select("lang", "source", F.lit(part).alias("part"), "item", "value").withColumn("rank", rank)
        for part, rows in (("pair", pairs), ("term", above.withColumnRenamed("term", "item")))
    ]
    return ranked[0].unionByName(ranked[1].filter(F.col("rank") <= top_terms))
