"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. A line's features are those of its own characters and words and of the lines
before and after it; transitions tie neighbours. Training takes a document's label for all its lines, on
a bounded sample of labelled documents. A document's score is the mean of its lines' marginal
probabilities of being good, from forward-backward, weighted by line length.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scanning import batches_by_size, encoded, scan_words, word_bytes

#: The sample that the field is fitted on: documents with the least hash of their id, and most lines of each.
SAMPLE_DOCUMENTS = 4000
SAMPLE_LINES = 300
STEPS = 300
RATE = 0.1
PENALTY = 1e-4
#: Texts of more lines or bytes are read in blocks; the chain runs on from block to block.
LONG_LINES, LONG_BYTES = 5000, 1 << 20
BLOCK_BYTES, BLOCK_LINES = 1 << 16, 1 << 16
THRESHOLD = 0.3
RESULT = "doc_id long, score double, predicted int"
_IS_WORD = word_bytes((0x20, *range(0x09, 0x0E)))
#: Kinds of bytes whose shares are features: letters, upper case (letters too), digits, marks, blanks, stress marks, others.
_UPPER, _KINDS = 2, 7
_KIND = np.full(256, 7, np.uint8)
for _kind, _bytes in ((1, [*range(97, 123), *range(128, 256)]), (_UPPER, range(65, 91)), (3, range(48, 58)), (4, b".,;:'"), (5, b" \t\r"), (6, b"!?|")):
    _KIND[list(_bytes)] = _kind


class Lines(NamedTuple):
    """Features of consecutive lines, line lengths, and lines per document."""

    features: np.ndarray
    weights: np.ndarray
    counts: np.ndarray


class Field(NamedTuple):
    """Weights of the label good, and the scores of label pairs."""

    weights: np.ndarray
    pairs: np.ndarray


def own_features(buffer: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each line shows by itself, and its length. Lines end at ``ends``, where ``buffer`` has line breaks."""
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = (ends - starts).astype(np.float64)
    kinds = _KIND[buffer]
    sums = np.stack([np.add.reduceat(kinds == k, starts, dtype=np.int64) for k in range(1, _KINDS + 1)], axis=1)
    sums[:, 0] += np.add.reduceat(kinds == _UPPER, starts, dtype=np.int64)
    share = sums / np.maximum(size, 1)[:, None]
    words = scan_words([buffer.tobytes()], _IS_WORD)
    line = np.searchsorted(ends, words.starts)
    n_words = np.bincount(line, minlength=len(ends)).astype(np.float64)
    again = (words.hashes[1:] == words.hashes[:-1]) & (line[1:] == line[:-1])
    repeated = np.bincount(line[1:][again], minlength=len(ends)) / np.maximum(n_words, 1)
    last = np.where(size > 0, buffer[np.maximum(ends - 1, 0)], 0)
    own = np.column_stack(
        [
            share, repeated, size == 0, np.log1p(size) / 8, size / np.maximum(n_words, 1) / 16,
            np.isin(last, list(b".!?")), share[:, 1] > 0.5, share[:, 5] + share[:, 6] > 0.03, repeated > 0.3,
        ]
    )
    return own, np.maximum(size, 1)


def with_neighbours(own: np.ndarray, first: np.ndarray, final: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Features of lines: their own, those of the lines around them, and whether they begin or end a document."""
    past, ahead = np.concatenate((before[None], own[:-1])), np.concatenate((own[1:], after[None]))
    past[first], ahead[final] = 0, 0
    return np.column_stack([np.ones(len(own)), own, past, ahead, first, final])


def line_features(texts: list[bytes]) -> Lines:
    """Features of all lines; an empty text is one empty line."""
    buffer = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    ends = np.flatnonzero(buffer == 10)
    own, weights = own_features(buffer, ends)
    doc_ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.concatenate(([0], np.searchsorted(ends, doc_ends - 1, side="right"))))
    first = np.zeros(len(own), bool)
    first[np.cumsum(counts) - counts] = True
    none = np.zeros(own.shape[1])
    return Lines(with_neighbours(own, first, np.roll(first, -1), none, none), weights, counts)


def line_blocks(text: bytes) -> Iterator[bytes]:
    """A long text in blocks of whole lines, without the line break at a block's end."""
    start = 0
    while (cut := text.find(b"\n", min(len(text), start + BLOCK_BYTES))) >= 0:
        yield text[start:cut]
        start = cut + 1
    yield text[start:]


def line_scores(text: bytes, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score of the label good, and length, of every line of a long text; features are made block by block."""
    n = text.count(b"\n") + 1
    scores, lengths = np.empty(n), np.empty(n)
    done, before, own = 0, None, None

    def score(after: np.ndarray | None) -> None:
        first, final = np.zeros(len(own), bool), np.zeros(len(own), bool)
        first[0], final[-1] = before is None, after is None
        nothing = np.zeros(own.shape[1])
        features = with_neighbours(own, first, final, nothing if before is None else before, nothing if after is None else after)
        scores[done : done + len(own)] = features @ weights

    for block in line_blocks(text):
        buffer = np.frombuffer(block + b"\n", np.uint8)
        following, size = own_features(buffer, np.flatnonzero(buffer == 10))
        if own is not None:
            score(following[0])
            done, before = done + len(own), own[-1]
        own = following
        lengths[done : done + len(own)] = size
    score(None)
    return scores, lengths


def scan(steps: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Messages after each of the steps, 2 x 2 matrices of log weights, from the message ``start``.

    Steps are dealt to as many runs as a run is long; runs are multiplied up side by side and then joined.
    """
    n = len(steps)
    size = int(np.sqrt(n)) + 1
    runs = -(-n // size)
    dealt = np.concatenate((steps, np.zeros((runs * size - n, 2, 2)))).reshape(runs, size, 2, 2)
    done = np.empty((size, runs, 2, 2))
    done[0] = dealt[:, 0]
    for t in range(1, size):
        done[t] = np.logaddexp(done[t - 1][:, :, :1] + dealt[:, t, :1], done[t - 1][:, :, 1:] + dealt[:, t, 1:])
    heads = np.empty((runs, 2))
    heads[0] = start
    for k in range(1, runs):
        heads[k] = np.logaddexp(heads[k - 1, 0] + done[-1, k - 1, 0], heads[k - 1, 1] + done[-1, k - 1, 1])
    after = np.logaddexp(heads[:, :1] + done[:, :, 0], heads[:, 1:] + done[:, :, 1])
    return after.transpose(1, 0, 2).reshape(-1, 2)[:n]


def chain_score(scores: np.ndarray, weights: np.ndarray, pairs: np.ndarray) -> float:
    """Weighted mean of P(good) over one long chain: forward messages are kept at block ends and made again in the blocks."""
    n, blocks = len(scores), range(0, len(scores), BLOCK_LINES)

    def unary(a: int, b: int) -> np.ndarray:
        return np.column_stack([np.zeros(b - a), scores[a:b]])

    def forward(a: int, start: np.ndarray | None) -> np.ndarray:
        own = unary(a, min(n, a + BLOCK_LINES))
        steps = pairs[None] + own[:, None, :]
        if start is None:
            steps[0] = [own[0], [-np.inf, -np.inf]]
        return scan(steps, np.zeros(2) if start is None else start)

    starts: list[np.ndarray | None] = [None]
    for a in blocks:
        starts.append(forward(a, starts[-1])[-1])
    behind, total = np.zeros(2), 0.0
    for k, a in reversed(list(enumerate(blocks))):
        ahead = unary(a + 1, min(n, a + BLOCK_LINES + 1))
        steps = np.swapaxes(pairs[None] + ahead[:, None, :], 1, 2)[::-1]
        missing = min(n, a + BLOCK_LINES) - a - len(steps)
        back = scan(steps, behind)[::-1] if len(steps) else np.zeros((0, 2))
        back = np.concatenate((back, np.zeros((missing, 2))))
        both = forward(a, starts[k]) + back
        good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
        total += float(good @ weights[a : a + BLOCK_LINES])
        behind = back[0]
    return total / float(weights.sum())


def marginals(scores: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line, and the expected number of each label pair, by forward-backward.

    All chains go step by step together, longest first, so that those with a further line are a prefix.
    """
    order = np.argsort(-counts, kind="stable")
    starts = (np.cumsum(counts) - counts)[order]
    sizes = counts[order]
    unary = np.column_stack([np.zeros(len(scores)), scores])
    forward, backward = np.empty_like(unary), np.zeros_like(unary)
    longest = int(sizes.max(initial=0))
    active = np.searchsorted(-sizes, -np.arange(longest + 1), side="left")
    for t in range(longest):
        at = starts[: active[t]] + t
        if t == 0:
            forward[at] = unary[at]
        else:
            past = forward[at - 1]
            forward[at] = np.logaddexp(past[:, :1] + pairs[0], past[:, 1:] + pairs[1]) + unary[at]
    expected = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        ahead = backward[at + 1] + unary[at + 1]
        backward[at] = np.logaddexp(ahead[:, :1] + pairs[:, 0], ahead[:, 1:] + pairs[:, 1])
        joint = forward[at][:, :, None] + pairs[None] + ahead[:, None, :]
        total = np.logaddexp.reduce(forward[at] + backward[at], axis=1)
        expected += np.exp(joint - total[:, None, None]).sum(axis=0)
    both = forward + backward
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500))), expected


def fit_field(lines: Lines, labels: np.ndarray) -> Field:
    """Maximum likelihood with a small penalty, by adaptive gradient steps."""
    x, y = lines.features, np.repeat(labels, lines.counts)
    observed = np.zeros((2, 2))
    for label in (0, 1):
        observed[label, label] = (lines.counts[labels == label] - 1).sum()
    weights, pairs = np.zeros(x.shape[1]), np.zeros((2, 2))
    n = len(labels)
    moments = [np.zeros(x.shape[1] + 4) for _ in range(2)]
    for step in range(1, STEPS + 1):
        good, expected = marginals(x @ weights, lines.counts, pairs)
        gradient = np.concatenate([x.T @ (y - good), (observed - expected).reshape(-1)]) / n
        gradient -= PENALTY * np.concatenate([weights, pairs.reshape(-1)])
        moments[0] = 0.9 * moments[0] + 0.1 * gradient
        moments[1] = 0.99 * moments[1] + 0.01 * gradient**2
        move = RATE * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        weights, pairs = weights + move[:-4], pairs + move[-4:].reshape(2, 2)
    return Field(weights, pairs)


def score_texts(texts: list[bytes], field: Field) -> np.ndarray:
    """Length-weighted mean of P(good) over each text's lines."""
    found = np.zeros(len(texts))
    long = np.array([len(t) > LONG_BYTES or t.count(b"\n") > LONG_LINES for t in texts], bool)
    for k in np.flatnonzero(long):
        found[k] = chain_score(*line_scores(texts[k], field.weights), field.pairs)
    if not long.all():
        lines = line_features([t for t, apart in zip(texts, long, strict=True) if not apart])
        good, _ = marginals(lines.features @ field.weights, lines.counts, field.pairs)
        firsts = np.cumsum(lines.counts) - lines.counts
        found[~long] = np.add.reduceat(good * lines.weights, firsts) / np.add.reduceat(lines.weights, firsts)
    return found


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are not learned from; false for a null id, which is not learned from either."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Field:
    """Fit on the labelled rows that are not held out: ``SAMPLE_DOCUMENTS`` of them with the least hash of the id.

    The chosen labels are sent to the documents, so that only texts of the sample move. Of a document of more than
    ``SAMPLE_LINES`` lines, a run of so many lines is in the sample, from a place that the hash of its id gives. Null
    labels and texts are left out; without labels of both kinds every line is as likely good as bad. Labels of both
    kinds of which the sample has one only are an error.
    """
    chosen = labels.filter(F.col(id_col).isNotNull() & ~held_out(id_col) & F.col(label_col).isin(0, 1))
    chosen = chosen.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    learnable = chosen
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(SAMPLE_DOCUMENTS)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null")
    sample = texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    spare = F.greatest(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1 - SAMPLE_LINES, F.lit(0))
    first = F.pmod(F.xxhash64("doc_id", F.lit("run")), spare + 1).cast("int") + 1
    run = F.array_join(F.slice(F.split("text", "\n", -1), first, SAMPLE_LINES), "\n")
    sample = sample.withColumn("text", F.when(spare > 0, run).otherwise(F.col("text")))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [line_features([t]) for t in encoded(batch.column("text"))]
            yield pa.record_batch(
                [batch.column("label"), pa.array([b.features.astype(np.float32).tobytes() for b in blobs], pa.binary()), pa.array([b.weights.tobytes() for b in blobs], pa.binary())],
                names=["label", "features", "weights"],
            )

    rows = sample.mapInArrow(features, "label int, features binary, weights binary").collect()
    width = line_features([b""]).features.shape[1]
    if len({r.label for r in rows}) < 2:
        if learnable.select("label").distinct().count() > 1:
            raise ValueError(f"the labels are of both kinds, those of the sample of {len(rows)} documents are not")
        return Field(np.zeros(width), np.zeros((2, 2)))
    x = np.frombuffer(b"".join(r.features for r in rows), np.float32).reshape(-1, width).astype(np.float64)
    weights = [np.frombuffer(r.weights, np.float64) for r in rows]
    return fit_field(Lines(x, np.concatenate(weights), np.array([len(w) for w in weights])), np.array([r.label for r in rows]))


def score(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted``, one row per document; null text is empty and scored as one empty line.

    ``predicted`` is 1 from a score of ``THRESHOLD``. Rows with null or repeated ids are scored like others;
    other columns are not read; an empty table gives no rows.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = encoded(batch.column("text"))
            scores = [score_texts(texts[i:j], field) for i, j in batches_by_size(texts)]
            scores = np.clip(np.concatenate(scores) if scores else np.zeros(0), 0, 1)
            yield pa.record_batch([batch.column("doc_id"), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(judge, RESULT)
