"""Packing of documents into fixed sequences, shortest pack first over the histogram of lengths.

Documents are tokenized and cut into pieces of at most a sequence. Only the histogram of piece lengths
goes to the driver, at most one row per length. There the longest lengths are placed first, all pieces
of a length at a time, into the packs that are shortest so far; a packing pattern carries the number of
packs that have it and splits when only some of them get a piece. The result is, for each length, which
ranks go to which packs at which offset: a table of a few thousand rows at any input size. Pieces are
joined back by their rank among those of their length. Ranks come from counts per task and length, so
that no length, however frequent, is sorted or gathered in one task.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import workers

CAPACITY = 2048
END_ID = 1
#: What a worker remembers of words until another operator begins there; longer words are not remembered.
CACHE_BYTES = 128 << 20
LONGEST_REMEMBERED = 64
ENTRY_BYTES = 200
BLOCK_CHARS = 1 << 20
ROWS_AT_ONCE = 512
ENCODE_TOGETHER = 5000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_SIMPLE = re.compile("[a-zA-ZÀ-ÖØ-öø-ÿ]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")
_BLANK = re.compile(r"[ \t\n\r\f\v]+")
_tokenizers: dict[str, WordTokenizer] = {}


class WordTokenizer:
    """Token ids of texts, for tokenizers that drop white space and never join words across it.

    Ids of words are kept, up to about ``CACHE_BYTES`` or those of a block, since words repeat. Words of Latin letters
    are encoded together: such a word's last token, and no other, ends a word in the vocabulary.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, k in vocabulary.items():
            self.ends[k] = token.endswith("</w>")
        self.known: dict[str, bytes] = {}

    @staticmethod
    def words(text: str) -> list[str]:
        return _BLANK.split(text) if _SEPARATORS.search(text) else text.split()

    def forget(self) -> None:
        self.known = {}

    def learn(self, words: set[str]) -> None:
        known = self.known
        simple, others, derived = set(), [], []
        for word in words:
            core, mark = (word[:-1], word[-1]) if word[-1:] in (".", ",") else (word, "")
            if _SIMPLE.fullmatch(core):
                core = core.lower()
                simple.add(core)
                if core != word:
                    derived.append((word, core, mark))
            else:
                others.append(word)
        new = [w for w in simple if w not in known]
        parts = [new[k : k + ENCODE_TOGETHER] for k in range(0, len(new), ENCODE_TOGETHER)]
        for part, found in zip(parts, self.tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part):
                raw, bounds = ids.tobytes(), [0, *(4 * cuts).tolist()]
                known.update(zip(part, (raw[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)), strict=True))
            else:
                others += part
        others += [m for m in (".", ",") if m not in known]
        for word, found in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False), strict=True):
            known[word] = np.array(found.ids, np.uint32).tobytes()
        for word, core, mark in derived:
            known[word] = known[core] + known[mark] if mark else known[core]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers. Words of all texts are learned together."""
        self.known[""] = b""
        split = [self.words(t) for t in texts]
        held = [list(map(self.known.get, words)) for words in split]
        gaps = [[k for k, ids in enumerate(own) if ids is None] for own in held]
        new = {words[k] for words, missing in zip(split, gaps, strict=True) for k in missing}
        if (len(self.known) + len(new)) * ENTRY_BYTES > CACHE_BYTES:
            self.forget()
        self.learn({w for w in new if len(w) <= LONGEST_REMEMBERED})
        known = self.known
        for words, own, missing in zip(split, held, gaps, strict=True):
            for k in missing:
                word = words[k]
                own[k] = known[word] if word in known else self._alone(word)
        return [b"".join(own) for own in held]

    def _alone(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, np.uint32).tobytes()


@workers.drops
def forget_words() -> None:
    for tokens in _tokenizers.values():
        tokens.forget()


def tokenizer_at(path: str) -> WordTokenizer:
    """One tokenizer per worker and file."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def parts_of(text: str) -> Iterator[str]:
    """A long text in parts of about BLOCK_CHARS that end at white space."""
    start = 0
    while len(text) - start > BLOCK_CHARS and (blank := _BLANK.search(text, start + BLOCK_CHARS)):
        yield text[start : blank.end()]
        start = blank.end()
    yield text[start:]


def encoded_texts(tokens: WordTokenizer, texts: list[str]) -> Iterator[bytes]:
    """The ids of each text, encoded in blocks of about BLOCK_CHARS."""
    held, size = [], 0
    for text in texts:
        if len(text) > BLOCK_CHARS:
            yield from tokens.encode_all(held)
            held, size = [], 0
            yield b"".join(ids for part in parts_of(text) for ids in tokens.encode_all([part]))
            continue
        held.append(text)
        size += len(text)
        if size > BLOCK_CHARS:
            yield from tokens.encode_all(held)
            held, size = [], 0
    yield from tokens.encode_all(held)


class Placement(NamedTuple):
    """Pieces of ``length`` with ranks from ``rank`` on, ``count`` of them, go to the sequences from ``sequence`` on."""

    length: int
    rank: int
    count: int
    sequence: int
    offset: int


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Placement]:
    """Place all pieces of each length, longest first, into the shortest packs, opening packs where none has room."""
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    widest = 0
    opened, placements = 0, []
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            while widest and not room[widest]:
                widest -= 1
            if widest >= length:
                space = widest
                first, packs = room[space].pop()
            else:
                space, first, packs = capacity, opened, left
                opened += left
            n = min(packs, left)
            if packs > n:
                room[space].append((first + n, packs - n))
            placements.append(Placement(length, rank, n, first, capacity - space))
            if space > length:
                room[space - length].append((first, n))
                widest = max(widest, space - length)
            rank, left = rank + n, left - n
    return placements


def cut_pieces(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, capacity: int, with_ids: bool) -> DataFrame:
    """Checkpointed pieces of all documents; ``part, place`` number the pieces of a length within a task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.begin("packing")
        tokens = tokenizer_at(tokenizer)
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        end = np.array([END_ID], np.uint32).tobytes()
        for batch in (whole.slice(k, ROWS_AT_ONCE) for whole in batches for k in range(0, whole.num_rows, ROWS_AT_ONCE)):
            columns: list[list] = [[] for _ in range(7)]
            raw: list[bytes] = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc, found in zip(batch.column("doc_id").to_pylist(), encoded_texts(tokens, texts), strict=True):
                ids = found + end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    length = len(piece) // 4
                    for column, value in zip(columns, (doc, start, length, zlib.crc32(piece), total, part, seen[length]), strict=True):
                        column.append(value)
                    seen[length] += 1
                    if with_ids:
                        raw.append(piece)
            arrays = [pa.array(c, pa.int64()) for c in columns]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "place"]
            yield pa.record_batch([*arrays, pa.array(raw, pa.binary())] if with_ids else arrays, names=[*names, "ids"] if with_ids else names)

    schema = f"{PIECE}, part long, place long" + ", ids binary" * with_ids
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(cut, schema).checkpoint()


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """One row per piece: where it comes from, its checksum, and its sequence and offset.

    A document is its token ids and then id 1; null text is empty. Documents longer than ``capacity`` are
    cut every ``capacity`` ids. Sequences are gapless from offset 0. ``with_ids`` adds the piece's ids as
    little-endian unsigned 32-bit integers. Rows with null or repeated ids are packed like others; other
    columns are not read; an empty table gives no rows. ``tokenizer`` is a file that every executor can
    read; its tokenizer must drop white space.
    """
    pieces = cut_pieces(docs, tokenizer, id_col, text_col, capacity, with_ids)
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placed = sorted(pack_histogram(histogram, capacity))
    length, rank, _, sequence, offset = (np.array(x, np.int64) for x in zip(*placed, strict=True)) if placed else [np.zeros(0, np.int64)] * 5
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    ranked = pieces.join(counts.select("length", "part", before.alias("before")), ["length", "part"])
    names = [f.split()[0] for f in PIECE.split(", ")] + ["ids"] * with_ids
    ranked = ranked.select(*names, (F.col("before") + F.col("place")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = length << 40 | rank
        for batch in batches:
            own, at = (batch.column(c).to_numpy() for c in ("length", "rank"))
            k = np.searchsorted(keys, own << 40 | at, side="right") - 1
            yield pa.record_batch(
                [*(batch.column(n) for n in names), pa.array(sequence[k] + at - rank[k]), pa.array(offset[k])],
                names=[*names, "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, f"{PIECE}{', ids binary' * with_ids}, sequence_id long, offset long")
