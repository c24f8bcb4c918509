"""Byte-level byte-pair encoding with a segment tree of pair ranks, and decoding.

A text is split by the tokenizer's pattern and each match is merged on its own. Over the byte positions of
a match lies a segment tree: the leaf of a live position holds the rank of the pair that starts there, with
the position below it, and a node holds its least leaf. So the root is the leftmost pair of least rank. A
merge changes three leaves, those of the position, of its live neighbour before and of the neighbour
that it swallows, and the nodes above them.

Matches of a block of texts are encoded once each. Short ones are merged side by side, a merge of each in a
step, in trees of one size; long ones alone. Nothing is kept from block to block.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_CHARS = 1 << 21
MATCHES_AT_ONCE = 1 << 17
TREES_AT_ONCE = 1 << 15
#: Matches are merged side by side where at least so many are of one size, and alone elsewhere.
LEAST_TREES = 16
ENCODED = "doc_id long, ids array<int>"
DECODED = "doc_id long, ids array<int>, decoded binary"
_NONE = 1 << 62
_merges: dict[str, Merges] = {}


class Numbers(dict):
    """Numbers from 0 on in the order of first use."""

    def __missing__(self, key) -> int:
        self[key] = number = len(self)
        return number


class Merges:
    """The ranks of a file: a token's rank is its id, and a pair's rank is that of its joined bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {
            ranks[token[:k]] << 32 | ranks[token[k:]]: rank
            for token, rank in ranks.items()
            for k in range(1, len(token))
            if token[:k] in ranks and token[k:] in ranks
        }
        keys = np.array(sorted(pairs), np.int64)
        self.pairs = pairs
        self.pair_keys = np.append(keys, np.int64(_NONE))
        self.pair_ranks = np.array([*map(pairs.__getitem__, keys.tolist()), -1], np.int64)
        widths = np.zeros(max(ranks.values()) + 2, np.int64)
        for rank, token in self.tokens.items():
            widths[rank + 1] = len(token)
        self.starts = np.cumsum(widths)
        self.bytes = np.frombuffer(b"".join(self.tokens[k] for k in sorted(self.tokens)), np.uint8)

    @classmethod
    def of_file(cls, path: str) -> Merges:
        """Ranks as lines of a base64 token and its rank."""
        with open(path, "rb") as file:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)})

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, -1 where the two do not merge."""
        keys = left << np.int64(32) | right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def encode_matches(self, matches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all matches one after the other, and where those of each begin."""
        sizes = np.zeros(len(matches), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def put(members: list[int], ids: np.ndarray, counts: np.ndarray) -> None:
            own = np.array(members, np.int64)
            sizes[own] = counts
            found.append((np.repeat(own, counts), ids))

        known, whole, by_size = [], [], {}
        for k, match in enumerate(matches):
            rank = self.ranks.get(match)
            if rank is None:
                by_size.setdefault((len(match) - 1).bit_length(), []).append(k)
            else:
                known.append(k)
                whole.append(rank)
        put(known, np.array(whole, np.int32), np.ones(len(known), np.int64))
        for bits, members in sorted(by_size.items()):
            together = max(1, TREES_AT_ONCE >> max(0, bits - 4))
            for i in range(0, len(members), together):
                part = members[i : i + together]
                if len(part) >= LEAST_TREES:
                    put(part, *self.merge_together([matches[k] for k in part], bits))
                else:
                    for k in part:
                        ids = self.merge_alone(matches[k])
                        put([k], ids, np.array([len(ids)]))
        order = np.argsort(np.concatenate([match for match, _ in found]), kind="stable")
        return np.concatenate([ids for _, ids in found])[order], np.concatenate(([0], np.cumsum(sizes)))

    def merge_together(self, matches: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of matches of at most ``1 << bits`` bytes, a tree of so many leaves for each, and their numbers."""
        n, leaves = len(matches), 1 << bits
        sizes = np.fromiter(map(len, matches), np.int64, n)
        tokens = np.zeros((n, leaves + 1), np.int64)
        place = np.arange(leaves)
        inside = place < sizes[:, None]
        tokens[:, :-1][inside] = self.single[np.frombuffer(b"".join(matches), np.uint8)]
        tree = np.full((2 * leaves, n), _NONE, np.int64)
        paired = place[1:] < sizes[:, None]
        row, column = np.nonzero(paired)
        rank = self.pair_rank(tokens[row, column], tokens[row, column + 1])
        merges = rank >= 0
        tree[leaves + column[merges], row[merges]] = rank[merges] << np.int64(bits) | column[merges]
        for level in range(bits - 1, -1, -1):
            low = 1 << level
            tree[low : 2 * low] = np.minimum(tree[2 * low : 4 * low : 2], tree[2 * low + 1 : 4 * low : 2])
        after = np.minimum(place + 1, sizes[:, None])
        before = np.broadcast_to(place - 1, (n, leaves)).copy()
        alive = inside.copy()
        rows = np.flatnonzero(tree[1] < _NONE)

        def update(leaf: np.ndarray, own: np.ndarray, values: np.ndarray) -> None:
            node = leaves + leaf
            tree[node, own] = values
            for _ in range(bits):
                node = node >> 1
                tree[node, own] = np.minimum(tree[2 * node, own], tree[2 * node + 1, own])

        def leaf_values(at: np.ndarray, own: np.ndarray, right: np.ndarray) -> np.ndarray:
            """The leaves at ``at``, whose live neighbours are at ``right``."""
            ranks = self.pair_rank(tokens[own, at], tokens[own, right])
            return np.where((right < sizes[own]) & (ranks >= 0), ranks << np.int64(bits) | at, _NONE)

        while len(rows):
            least = tree[1, rows]
            at = least & (leaves - 1)
            gone = after[rows, at]
            right = after[rows, gone]
            tokens[rows, at] = least >> np.int64(bits)
            after[rows, at] = right
            alive[rows, gone] = False
            follows = right < sizes[rows]
            before[rows[follows], right[follows]] = at[follows]
            update(gone, rows, np.full(len(rows), _NONE))
            update(at, rows, leaf_values(at, rows, right))
            left = before[rows, at]
            has = left >= 0
            own, left = rows[has], left[has]
            update(left, own, leaf_values(left, own, at[has]))
            rows = rows[tree[1, rows] < _NONE]
        return tokens[:, :-1][alive].astype(np.int32), alive.sum(axis=1)

    def merge_alone(self, match: bytes) -> np.ndarray:
        """Ids of one match; some 40 bytes of memory a byte."""
        n, pairs = len(match), self.pairs
        bits = max(1, (n - 1).bit_length())
        leaves = 1 << bits
        tokens = self.single[np.frombuffer(match, np.uint8)]
        rank = self.pair_rank(tokens[:-1], tokens[1:])
        whole = np.full(2 * leaves, _NONE, np.int64)
        whole[leaves : leaves + n - 1] = np.where(rank >= 0, rank << np.int64(bits) | np.arange(n - 1), _NONE)
        for level in range(bits - 1, -1, -1):
            low = 1 << level
            whole[low : 2 * low] = np.minimum(whole[2 * low : 4 * low : 2], whole[2 * low + 1 : 4 * low : 2])
        tree, token = array("q", whole.tobytes()), array("i", tokens.astype(np.int32).tobytes())
        del whole, rank
        after = array("i", np.arange(1, n + 1, dtype=np.int32).tobytes())
        before = array("i", np.arange(-1, n - 1, dtype=np.int32).tobytes())

        def update(leaf: int, value: int) -> None:
            node = leaves + leaf
            tree[node] = value
            while node > 1:
                other = tree[node ^ 1]
                node >>= 1
                value = other if other < value else value
                if tree[node] == value:
                    return
                tree[node] = value

        def leaf_value(at: int, right: int) -> int:
            found = pairs.get(token[at] << 32 | token[right]) if right < n else None
            return _NONE if found is None else found << bits | at

        mask = leaves - 1
        while (least := tree[1]) < _NONE:
            at = least & mask
            gone = after[at]
            right = after[gone]
            token[at], after[at], token[gone] = least >> bits, right, -1
            if right < n:
                before[right] = at
            update(gone, _NONE)
            update(at, leaf_value(at, right))
            if (left := before[at]) >= 0:
                update(left, leaf_value(left, at))
        ids = np.frombuffer(token, np.int32)
        return ids[ids >= 0].copy()

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids' tokens; an id that the file lacks is an error."""
        if len(ids) and not (0 <= int(ids.min()) and int(ids.max()) + 1 < len(self.starts)):
            raise ValueError("an id is not in the vocabulary")
        first = self.starts[ids]
        widths = self.starts[ids + 1] - first
        ends = np.cumsum(widths)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + widths, widths)
        return self.bytes[at].tobytes()


def merges_at(path: str) -> Merges:
    """One table per worker and file."""
    if path not in _merges:
        _merges[path] = Merges.of_file(path)
    return _merges[path]


class Splitter:
    """The matches of a pattern, with letters and digits as the tokenizer's own library knows them.

    That library's Unicode tables are older than those of the installed ``regex``. Characters which only the
    latter counts as letters or digits are read as if they were unassigned.
    """

    def __init__(self, pattern: str, younger: str = ""):
        import regex

        self.pattern = regex.compile(pattern)
        self.younger = regex.compile(f"[{younger}]") if younger else None

    def matches(self, text: str) -> Iterator[list[bytes]]:
        """The matches in order, a bounded number at a time."""
        if self.younger and not text.isascii() and self.younger.search(text):
            plain = self.younger.sub("", text)
            found = (text[m.start() : m.end()] for m in self.pattern.finditer(plain))
        elif len(text) <= BLOCK_CHARS:
            found = iter(self.pattern.findall(text))
        else:
            found = (m.group() for m in self.pattern.finditer(text))
        while part := [m.encode() for m in islice(found, MATCHES_AT_ONCE)]:
            yield part


def younger_characters() -> str:
    """What ``regex`` counts as letters or digits and the tokenizer library does not, as ranges of a set."""
    import regex
    import tiktoken

    everything = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([b]): b for b in range(256)}
    ranges = []
    for kind in (r"\p{L}", r"\p{N}"):
        library = tiktoken.Encoding(kind, pat_str=f"{kind}+", mergeable_ranks=single, special_tokens={})
        known = set(bytes(library.encode_ordinary(everything)).decode())
        points = sorted(ord(c) for c in regex.findall(kind, everything) if c not in known)
        start = 0
        for k in range(1, len(points) + 1):
            if k == len(points) or points[k] != points[k - 1] + 1:
                ranges.append(f"\\U{points[start]:08x}-\\U{points[k - 1]:08x}")
                start = k
    return "".join(ranges)


def text_blocks(texts: list[str], chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about so many characters; a longer text is a block of its own."""
    start = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text) > chars:
            yield start, k
            start, size = k, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def encode_texts(texts: list[str], splitter: Splitter, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and where those of each begin."""
    numbers, of_text, own = Numbers(), [], []
    for text in texts:
        before = len(own)
        for part in splitter.matches(text):
            own.append(np.fromiter(map(numbers.__getitem__, part), np.int32, len(part)))
        of_text.append(sum(map(len, own[before:])))
    ids, starts = merges.encode_matches(list(numbers))
    match = np.concatenate([np.zeros(0, np.int32), *own])
    first = starts[match]
    widths = starts[match + 1] - first
    ends = np.cumsum(widths)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + widths, widths)
    bounds = np.concatenate(([0], np.cumsum(of_text))).astype(np.int64)
    return ids[at], np.concatenate(([0], ends))[bounds]


def encoded(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``, one row per document.

    ``ranks`` is a file that every executor can read, ``pattern`` what splits texts before merging. Null text is
    empty and has no ids. Rows with null or repeated ids are encoded like others; other columns are not
    read; an empty table gives no rows. A text of any length is encoded whole.
    """
    younger = younger_characters()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, merges = Splitter(pattern, younger), merges_at(ranks)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for i, j in text_blocks(texts, BLOCK_CHARS):
                ids, bounds = encode_texts(texts[i:j], splitter, merges)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.record_batch([batch.column("doc_id").slice(i, j - i), lists], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, ENCODED)


def decoded(tokens: DataFrame, ranks: str) -> DataFrame:
    """``doc_id, ids, decoded``: the bytes that the ids of each row stand for; null ids are empty."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = merges_at(ranks)
        for batch in batches:
            ids = batch.column("ids")
            found = [merges.decode(np.asarray(own.values, np.int64)) if own.is_valid else b"" for own in ids]
            yield pa.record_batch([batch.column("doc_id"), ids, pa.array(found, pa.binary())], names=["doc_id", "ids", "decoded"])

    return tokens.select("doc_id", "ids").mapInArrow(decode, DECODED)
