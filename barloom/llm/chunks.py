"""Documents in compressed chunks, and the exchange that tells every chunk which of its keys others have.

Row-wise shuffles of billions of small keys cost more than the keys themselves. Here each chunk of
documents ships one sorted block of keys per key range, each key once with its number of documents, so
a key that a third of all documents hold costs one entry per chunk. A range's task adds up the counts
and answers every chunk with those of its keys that at least two documents hold.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import workers

CHUNK_BYTES = 2 << 20
KEYS_PER_RANGE = 1 << 20
CHUNK_SCHEMA = "chunk long, size long, payload binary"
SHARED_SCHEMA = "chunk long, bucket int, payload binary"


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints of frames that nothing refers to any more.

    Spark's cleaner waits for the driver's garbage collection, which on a large heap comes late. The first
    collection frees plans, later ones what only they held.
    """
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def to_blob(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed message."""
    sizes = np.array([len(arrays), *(a.nbytes for a in arrays)], np.uint64)
    return zstandard.compress(b"".join([sizes.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)]), 3)


def from_blob(blob: bytes, *types) -> list[np.ndarray]:
    """The arrays of ``to_blob``, read as ``types``."""
    raw = zstandard.decompress(blob)
    ends = np.cumsum(np.frombuffer(raw, np.uint64, 1 + len(types))[1:]).astype(int) + 8 * (1 + len(types))
    starts = [8 * (1 + len(types)), *ends[:-1]]
    return [np.frombuffer(raw[i:j], t) for i, j, t in zip(starts, ends, types, strict=True)]


def sorted_to_blob(keys: np.ndarray, *arrays: np.ndarray) -> bytes:
    """As ``to_blob``; sorted 32-bit keys first, kept as differences, equal bytes of them together."""
    steps = np.diff(keys, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4)
    return to_blob(steps.T, *arrays)


def sorted_from_blob(blob: bytes, *types) -> list[np.ndarray]:
    planes, *arrays = from_blob(blob, np.uint8, *types)
    steps = np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).reshape(-1)
    return [np.cumsum(steps, dtype=np.uint32), *arrays]


def table_to_blob(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def blob_to_table(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def chunked(docs: DataFrame, text: str, chunk_bytes: int = CHUNK_BYTES, owner: str = "chunks") -> DataFrame:
    """A checkpointed table with one row per chunk: rows of ``docs`` that were read together, all columns.

    A chunk ends after ``chunk_bytes`` of text. Only the checkpoint fixes what a chunk holds, so a
    task that runs again later cannot deal rows differently. ``owner`` is whose tasks these are.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.begin(owner)
        first, number, held, size = TaskContext.get().partitionId() << 24, 0, [], 0

        def chunk() -> pa.RecordBatch:
            blob = table_to_blob(pa.Table.from_batches(held).combine_chunks())
            return pa.record_batch([[first + number], [size], pa.array([blob], pa.binary())], names=["chunk", "size", "payload"])

        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0)
            ends = np.cumsum(lengths.to_numpy(zero_copy_only=False), dtype=np.int64)
            start = 0
            while start < batch.num_rows:
                taken = int(ends[start - 1]) if start else 0
                stop = int(np.searchsorted(ends, taken + chunk_bytes - size)) + 1
                stop = min(max(stop, start + 1), batch.num_rows)
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop - 1]) - taken
                start = stop
                if size >= chunk_bytes:
                    yield chunk()
                    number, held, size = number + 1, [], 0
        if held:
            yield chunk()

    return docs.mapInArrow(pack, CHUNK_SCHEMA).checkpoint()


def range_bits(chunks: DataFrame, bytes_per_key: float) -> int:
    """The number of key bits that make a range, so that a range has about ``KEYS_PER_RANGE`` keys."""
    size = chunks.agg(F.sum("size")).first()[0] or 0
    return max(4, int(np.ceil(np.log2(max(1.0, size / bytes_per_key / KEYS_PER_RANGE)))))


def short(keys: np.ndarray, bits: int) -> np.ndarray:
    """The part of a key that the exchange compares: its range and 32 bits more."""
    return keys >> np.uint64(32 - bits)


def add_counts(counts: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(counts, firsts)


def capped(totals: np.ndarray) -> np.ndarray:
    """Totals as bytes that end at 255."""
    return np.minimum(totals, 255).astype(np.uint8)


def magnitudes(totals: np.ndarray) -> np.ndarray:
    """Totals as bytes in the same order: exact below 64, then six steps for each doubling, up to 2 ** 37."""
    beyond = 64 + 6 * (np.log2(np.maximum(totals, 64).astype(np.float64)) - 6)
    return np.where(totals < 64, totals, np.minimum(beyond, 255)).astype(np.uint8)


def shared_keys(
    chunks: DataFrame,
    keys_of: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]],
    bits: int,
    total: Callable[[np.ndarray, np.ndarray], np.ndarray] = add_counts,
    told: Callable[[np.ndarray], np.ndarray] = capped,
) -> DataFrame:
    """For every chunk and key range, the chunk's keys that at least two documents hold.

    ``keys_of`` gives the sorted distinct 64-bit keys of a chunk and how many of its documents hold
    each. Keys are compared by ``short``; who needs more must compare what stands behind them. A chunk's counts
    end at 255. ``total`` makes one number of each key's counts, which stand together from ``firsts`` on;
    keys of less than 2 are not told, the others as the bytes that ``told`` makes of their numbers.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("payload"), strict=True):
                keys, counts = keys_of(blob_to_table(blob.as_py()))
                part = short(keys, bits)
                bounds = np.searchsorted(part, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32))
                rows = [
                    (b, sorted_to_blob(part[i:j].astype(np.uint32), np.minimum(counts[i:j], 255).astype(np.uint8)))
                    for b, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))
                    if i < j
                ]
                if rows:
                    yield pa.record_batch(
                        [pa.array([chunk] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
                        names=["chunk", "bucket", "payload"],
                    )

    def answer(table: pa.Table) -> pa.Table:
        chunk, bucket, blobs = (table.column(k) for k in ("chunk", "bucket", "payload"))
        parts = []
        for source, blob in enumerate(blobs):
            keys, counts = sorted_from_blob(blob.as_py(), np.uint8)
            parts.append(keys.astype(np.uint64) << np.uint64(32) | np.uint64(source << 8) | counts)
        entries = np.sort(np.concatenate(parts))
        keys = (entries >> np.uint64(32)).astype(np.uint32)
        firsts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        totals = total(entries & np.uint64(255), firsts)
        totals = np.repeat(totals, np.diff(np.append(firsts, len(keys))))
        held = totals >= 2
        keys, totals = keys[held], told(totals[held])
        source = ((entries[held] >> np.uint64(8)) & np.uint64(0xFFFFFF)).astype(np.uint32)
        order = np.argsort(source, kind="stable")
        bounds = np.searchsorted(source[order], np.arange(len(parts) + 1))
        rows = [
            (chunk[k].as_py(), bucket[k].as_py(), sorted_to_blob(keys[order[i:j]], totals[order[i:j]]))
            for k, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))
            if i < j
        ]
        return pa.table(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())],
            names=["chunk", "bucket", "payload"],
        )

    return chunks.mapInArrow(send, SHARED_SCHEMA).groupBy("bucket").applyInArrow(answer, SHARED_SCHEMA)


def shared_of(buckets: list[int], blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The answers of one chunk as sorted short keys and their counts."""
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
    for bucket, blob in sorted(zip(buckets, blobs, strict=True)):
        k, c = sorted_from_blob(blob, np.uint8)
        keys.append(k.astype(np.uint64) | np.uint64(bucket << 32))
        counts.append(c)
    return np.concatenate(keys), np.concatenate(counts)
