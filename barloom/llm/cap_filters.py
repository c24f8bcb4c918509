"""Embedding near-duplicates by spherical-cap filters from structured random product codes.

A filter is a direction; a vector passes it when their cosine exceeds a threshold. Directions are a
random product code: after a random rotation the dimensions fall into three blocks, each block has its
own random codewords, and a direction takes one codeword of each. All directions that a vector passes
are listed by decoding block after block, leaving out beginnings that no rest can lift over the
threshold. The threshold lets a random vector pass ``PASSED`` filters on average, at any dimension. ``TABLES`` codes are
independent of each other, so that vectors in a gap of one meet in another.

Vectors meet in buckets of the filters that agree in all blocks but the last, and are compared exactly;
a pair counts only in its first common bucket. A bucket counts links and sends a spanning forest, not
its pairs. Equal vectors are one class before that; large buckets
are compared by pairs of blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components

SIMILARITY = 0.95
PASSED = 16
TABLES = 3
#: A vector in a gap of the code passes what scores at least this share of its best direction.
NEAR_BEST = 0.9
LEAST_CODEWORDS = 32
VECTORS_PER_FILTER = 64
BLOCK = 2048
ROWS_PER_TASK = 20_000
SEED = 20260
_SAMPLE = 512
_MEETING = "dims int, bucket long, rep long, n long, vector binary, buckets binary"
_FOUND = "kind int, a long, b long"


class Code(NamedTuple):
    """A rotation, the blocks' bounds and codewords, and the threshold of the score."""

    rotation: np.ndarray
    bounds: list[int]
    words: list[np.ndarray]
    threshold: float


@lru_cache(maxsize=64)
def product_code(dims: int, codewords: int, table: int, passed: float = PASSED) -> Code:
    """The code of a dimension and table, the same in every task. The threshold is fitted on random vectors."""
    random = np.random.default_rng([SEED, dims, codewords, table])
    rotation = np.linalg.qr(random.standard_normal((dims, dims)))[0]
    blocks = min(3, dims)
    bounds = [dims * k // blocks for k in range(blocks + 1)]
    words = []
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        w = random.standard_normal((codewords, high - low))
        words.append(w / np.linalg.norm(w, axis=1, keepdims=True) / np.sqrt(blocks))
    sample = unit(random.standard_normal((_SAMPLE, dims)))
    code = Code(rotation, bounds, words, -np.inf)
    low, high = 0.0, 1.0
    for _ in range(30):
        middle = (low + high) / 2
        n = sum(len(decode(sample[k : k + 64], code._replace(threshold=middle), most=2 * _SAMPLE * passed)[0]) for k in range(0, _SAMPLE, 64))
        low, high = (middle, high) if n > passed * _SAMPLE else (low, middle)
    return code._replace(threshold=high)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1 in double precision; rows must be finite and not zero."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def decode(x: np.ndarray, code: Code, most: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Row and filter of all filters that the unit rows pass, in order; ``most`` ends a count that is only compared."""
    turned = x @ code.rotation
    scores = [turned[:, i:j] @ w.T for i, j, w in zip(code.bounds[:-1], code.bounds[1:], code.words, strict=True)]
    best = [s.max(axis=1) for s in scores]
    row, filters, total = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
    least = np.minimum(code.threshold, NEAR_BEST * sum(best))
    for k, score in enumerate(scores):
        rest = sum((b[row] for b in best[k + 1 :]), np.zeros(len(row)))
        sums = total[:, None] + score[row]
        kept, word = np.nonzero(sums + rest[:, None] > least[row][:, None])
        total, filters, row = sums[kept, word], filters[kept] * score.shape[1] + word, row[kept]
        if len(row) > most * code.words[0].shape[0]:
            return row, filters
    return row, filters


def meet_before(lists: list[np.ndarray], bucket: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which pairs of lists share a value below ``bucket``."""
    earlier = [x[x < bucket] for x in lists]
    which = np.unique(np.concatenate(earlier), return_inverse=True)[1]
    member = np.repeat(np.arange(len(lists)), [len(x) for x in earlier])
    bits = np.zeros((len(lists), int(which.max(initial=0)) // 8 + 1), np.uint8)
    np.bitwise_or.at(bits, (member, which // 8), (1 << (which % 8)).astype(np.uint8))
    out = np.empty(len(p), bool)
    step = max(1, (1 << 24) // bits.shape[1])
    for k in range(0, len(p), step):
        out[k : k + step] = (bits[p[k : k + step]] & bits[q[k : k + step]]).any(axis=1)
    return out


def usable(vector: str | Column) -> Column:
    """Vectors that can link: not null, not empty, not zero, all components finite."""
    size = lambda x: F.abs(x.cast("double"))
    finite = F.forall(vector, lambda x: F.coalesce(size(x) < float("inf"), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: size(x) > 0), F.lit(False))


def link_classes(classes: DataFrame, codewords: int, similarity: float = SIMILARITY) -> DataFrame:
    """``kind, a, b``: kind 0 has the vectors ``b`` that class ``a`` links with, kind 1 links that join classes."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            dims = np.diff(vectors.offsets.to_numpy())
            for d in np.unique(dims).tolist():
                own = np.flatnonzero(dims == d)
                values = np.array(vectors.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, d)
                x = unit(values)
                found = [decode(x, product_code(d, codewords, t)) for t in range(TABLES)]
                row = np.concatenate([f[0] for f in found])
                bucket = np.concatenate([f[1] // codewords + t * codewords**2 for t, f in enumerate(found)])
                order = np.lexsort((bucket, row))
                row, bucket = row[order], bucket[order]
                first = np.concatenate(([True], (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])))[: len(row)]
                rows, bucket = row[first], bucket[first]
                cuts = np.searchsorted(rows, np.arange(len(own) + 1))
                blobs = [bucket[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                packed = [v.tobytes() for v in x]
                yield pa.record_batch(
                    [
                        pa.array(np.full(len(rows), d, np.int32)), pa.array(bucket),
                        batch.column("rep").take(pa.array(own[rows])), batch.column("n").take(pa.array(own[rows])),
                        pa.array([packed[k] for k in rows], pa.binary()), pa.array([blobs[k] for k in rows], pa.binary()),
                    ],
                    names=["dims", "bucket", "rep", "n", "vector", "buckets"],
                )

    met = classes.mapInArrow(meet, _MEETING)
    sizes = met.groupBy("dims", "bucket").agg(F.count("*").alias("size")).filter("size > 1").checkpoint()
    total = sizes.agg(F.sum("size")).first()[0] or 0
    parts = sizes.select("dims", "bucket", F.ceil(F.col("size") / BLOCK).alias("parts"))
    own = met.join(parts, ["dims", "bucket"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    task = F.pmod(F.xxhash64("dims", "bucket", "i", "j"), F.lit(max(1, total // ROWS_PER_TASK)))

    def compare(group: pa.Table) -> pa.Table:
        dims, bucket, i, j, own, rep, n = (group.column(c).to_numpy() for c in ("dims", "bucket", "i", "j", "own", "rep", "n"))
        vectors, buckets = group.column("vector").to_pylist(), group.column("buckets").to_pylist()
        order = np.lexsort((rep, j, i, bucket, dims))
        keys = np.stack([dims[order], bucket[order], i[order], j[order]])
        cuts = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0), [True])))
        degrees: dict[int, int] = {}
        edges: set[tuple[int, int]] = set()
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            members = order[low:high]
            x = np.frombuffer(b"".join([vectors[k] for k in members]), np.float64).reshape(len(members), -1)
            left = np.flatnonzero(own[members] == i[members[0]])
            right = np.flatnonzero(own[members] == j[members[0]])
            p, q = np.nonzero(x[left] @ x[right].T >= similarity)
            p, q = left[p], right[q]
            p, q = (p[p < q], q[p < q]) if i[members[0]] == j[members[0]] else (p, q)
            if not len(p):
                continue
            new = ~meet_before([np.frombuffer(buckets[k], np.int64) for k in members], bucket[members[0]], p, q)
            p, q = p[new], q[new]
            ids, weights = rep[members], n[members]
            for a, b in ((p, q), (q, p)):
                for k, w in zip(*_sums(a, weights[b]), strict=True):
                    degrees[int(ids[k])] = degrees.get(int(ids[k]), 0) + int(w)
            label = np.arange(len(members))
            while True:
                low_label = label.copy()
                np.minimum.at(low_label, p, label[q])
                np.minimum.at(low_label, q, low_label[p])
                low_label = low_label[low_label]
                if (low_label == label).all():
                    break
                label = low_label
            joined = np.flatnonzero(label != np.arange(len(members)))
            edges.update(zip(ids[joined].tolist(), ids[label[joined]].tolist(), strict=True))
        rows = [(0, a, w) for a, w in degrees.items()] + [(1, a, b) for a, b in edges]
        kind, a, b = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table([pa.array(kind, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["kind", "a", "b"])

    return dealt.drop("other", "parts", "size").withColumn("task", task).groupBy("task").applyInArrow(compare, _FOUND)


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, which = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(which, values, len(distinct)).astype(np.int64)


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", similarity: float = SIMILARITY, codewords: int | None = None
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per vector.

    Vectors with a cosine of at least ``similarity`` link; of these pairs a few that share no bucket may be
    missed, and none below is linked. ``n_links`` counts the other rows, copies included; the component is
    the smallest id that links reach; the vector that names it is kept. Vectors that are null, empty, zero
    or hold null or non-finite components link with nothing, nor do vectors of different lengths. Rows with
    one id are one vector of several values. A null id links with nothing, has no component and is not
    kept. Other columns are not read. An empty table gives no rows.

    ``codewords`` is by default the least number, at least ``LEAST_CODEWORDS``, that makes as many filters
    as there are ``VECTORS_PER_FILTER``-sized shares of the distinct vectors.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    able = F.col("vec_id").isNotNull() & usable("vector")
    classes = rows.filter(able).groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).checkpoint()
    if codewords is None:
        codewords = max(LEAST_CODEWORDS, int(np.ceil((classes.count() / VECTORS_PER_FILTER) ** (1 / 3))))
    found = link_classes(classes, codewords, similarity).checkpoint()
    degrees = found.filter("kind = 0").groupBy("a").agg(F.sum("b").alias("links")).withColumnRenamed("a", "rep")
    places = components(found.filter("kind = 1").select("a", "b")).withColumnRenamed("node", "rep")
    named = classes.join(degrees, "rep", "left").join(places, "rep", "left")
    named = named.select("vector", "rep", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component")
    linked = rows.filter(able).join(named, "vector").select("vec_id", "n_links", F.coalesce("component", "rep").alias("component_id"))
    alone = rows.filter(~able).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
