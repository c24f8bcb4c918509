"""Token counts under a unigram vocabulary, without making tokens.

An Aho-Corasick automaton lists the vocabulary pieces that end at each character; dynamic programming
carries, for each place, the best score and the number of pieces that reach it. Ties go as in the
tokenizer: of the candidates that end at a place, the one that starts first wins, and a later one only
with a higher score. A character that no piece is costs the lowest score less ten and, with byte fallback,
counts its UTF-8 bytes.

Pieces never join a character with a blank after it, so a text's words are counted on their own, each
distinct word once while it is remembered. Of a word only as many places are kept as the longest
piece has characters, so a text without blanks needs no more memory than another.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import workers

BLANK = "▁"
UNKNOWN_PENALTY = 10.0
#: Scores up to this mark pieces that merges make but do not rank; they count as just below the lowest
#: real score. Left as they are, single precision in the tokenizer would lose all smaller differences.
PLACEHOLDER = -1e8
#: What a worker remembers of words until another operator begins there; longer words are not remembered.
CACHE_BYTES, ENTRY_BYTES = 128 << 20, 200
LONGEST_REMEMBERED = 64
LONG_WORD = 1000
RESULT = "doc_id long, n_tokens long, score double"
_NORMAL, _USER_DEFINED, _BYTE = 1, 4, 6
_vocabularies: dict[str, Vocabulary] = {}


class Vocabulary:
    """Pieces and scores of a sentencepiece model file, read as a unigram vocabulary."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        normalizer = model.normalizer_spec
        if normalizer.precompiled_charsmap or normalizer.remove_extra_whitespaces or not normalizer.escape_whitespaces:
            raise ValueError("the model changes texts before it cuts them")
        scores = {p.piece: p.score for p in model.pieces if p.type == _NORMAL}
        highest, lowest = max(scores.values()), min(s for s in scores.values() if s > PLACEHOLDER) - 1.0
        scores = {piece: max(score, lowest) for piece, score in scores.items()}
        scores |= {p.piece: len(p.piece) * highest - 0.1 for p in model.pieces if p.type == _USER_DEFINED}
        self.prefix = BLANK if normalizer.add_dummy_prefix else ""
        self.byte_fallback = model.trainer_spec.byte_fallback and any(p.type == _BYTE for p in model.pieces)
        self.load(scores, lowest - UNKNOWN_PENALTY)

    @classmethod
    def of(cls, scores: dict[str, float], unknown: float, prefix: str = BLANK, byte_fallback: bool = True) -> Vocabulary:
        """A vocabulary from pieces and scores."""
        self = cls.__new__(cls)
        self.prefix, self.byte_fallback = prefix, byte_fallback
        self.load(scores, unknown)
        return self

    def load(self, scores: dict[str, float], unknown: float) -> None:
        import ahocorasick

        if any(a != BLANK and b == BLANK for piece in scores for a, b in zip(piece, piece[1:], strict=False)):
            raise ValueError("a piece joins a character with a blank after it")
        self.automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = unknown
        self.longest = max(map(len, scores), default=1)
        self.single = {piece for piece in scores if len(piece) == 1}
        self.newline_alone = not any("\n" in piece for piece in scores)
        self.known: dict[str, tuple[int, float]] = {}

    def count_word(self, word: str) -> tuple[int, float]:
        """Pieces and score of the best way through ``word``; of a long one only the last places are kept."""
        size = len(word) + 1 if len(word) <= LONG_WORD else self.longest + 1
        score, count = [0.0] * size, [0] * size
        matches = self.automaton.iter(word)
        end, piece = next(matches, (-1, None))
        for at, character in enumerate(word):
            ending = []
            while end == at:
                ending.append(piece)
                end, piece = next(matches, (-1, None))
            if len(ending) > 1:
                ending.sort(reverse=True)
            best, pieces = None, 0
            for length, value in ending:
                before = (at + 1 - length) % size
                candidate = score[before] + value
                if best is None or candidate > best:
                    best, pieces = candidate, count[before] + 1
            if character not in self.single:
                before = at % size
                candidate = score[before] + self.unknown
                if best is None or candidate > best:
                    best, pieces = candidate, count[before] + (len(character.encode("utf-8", "replace")) if self.byte_fallback else 1)
            here = (at + 1) % size
            score[here], count[here] = best, pieces
        return count[len(word) % size], score[len(word) % size]

    def words(self, text: str) -> list[str]:
        """The parts of the escaped text that no piece crosses: runs of blanks with what follows them."""
        escaped = self.prefix + text.replace(" ", BLANK)
        if BLANK * 2 not in escaped:
            first, *rest = escaped.split(BLANK)
            return ([first] if first else []) + [BLANK + w for w in rest]
        return re.findall(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+", escaped)

    def count(self, text: str) -> tuple[int, float]:
        """Pieces and score of a text; an empty text has none."""
        if not text:
            return 0, 0.0
        total, sum_ = 0, 0.0
        breaks = text.count("\n") if self.newline_alone else 0
        words = self.words(text)
        if breaks:
            words = [part for word in words for part in word.split("\n")]
        known = self.known
        for word in words:
            found = known.get(word)
            if found is None:
                found = self.count_word(word)
                if len(word) <= LONGEST_REMEMBERED:
                    if len(known) * ENTRY_BYTES > CACHE_BYTES:
                        known.clear()
                    known[word] = found
            total += found[0]
            sum_ += found[1]
        return total + breaks, sum_ + breaks * self.unknown


@workers.drops
def forget_words() -> None:
    for vocabulary in _vocabularies.values():
        vocabulary.known = {}


def vocabulary_at(path: str) -> Vocabulary:
    """One vocabulary per worker and file."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, score``, one row per document.

    Null and empty texts have no tokens and score 0. Rows with null or repeated ids are counted like others;
    other columns are not read; an empty table gives no rows. ``model`` is a file that every executor can read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.begin("token counts")
        vocabulary = vocabulary_at(model)
        for batch in batches:
            found = [vocabulary.count(t or "") for t in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())],
                names=["doc_id", "n_tokens", "score"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, RESULT)
