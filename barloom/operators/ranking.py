"""Places and average ranks inside groups, one way for groups of every size.

Rows are spread by a range exchange on (group, order) and sorted inside the partitions, so a partition
holds a stretch of the order whatever group it belongs to, and a group of any size is cut. The one pass
that writes them also notes each row's place in its partition. A row's place in its group is that place
plus the rows of the group in earlier partitions, from a table with one row per partition and group that
meets it.

Null values have no average rank and do not count; as an order they come first. Rows with a null key
form a group of their own, as in a window.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.staging import stored

# ship these small functions inside the task, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equality join in which null keys meet each other; the keys appear once."""
    other = {k: f"__right_{k}" for k in keys}
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(o)) for k, o in other.items()])
    return left.join(right.withColumnsRenamed(other), same, how).drop(*other.values())


def _sorted(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)


def _with_offsets(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``_offset``, the rows of the group in earlier partitions, and ``_group_rows``."""
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumns(
        {
            "_offset": F.coalesce(F.sum("_part_rows").over(earlier), F.lit(0)),
            "_group_rows": F.sum("_part_rows").over(Window.partitionBy(*keys)),
        }
    )


def with_lower(df: DataFrame, keys: Sequence[str], order: Sequence[str], helpers: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``_lower``, the rows of its group before it by ``order``, and ``_group_rows``.

    ``helpers`` are columns of the order that nobody needs once rows are sorted; they are not written.

    Rows are written in order with a running number of their partition, as partitions must not change between two reads.
    The exchange reads ``df`` twice, once for a sample, so it should be stored.
    """
    number = F.monotonically_increasing_id()
    cut = stored(_sorted(df, keys, order).drop(*helpers).withColumn("_number", number)).withColumn("_part", F.shiftright("_number", 33))
    part = [*keys, "_part"]
    sizes = cut.groupBy(*part).agg(F.count(F.lit(1)).alias("_part_rows"), F.min("_number").alias("_first"))
    placed = join_on(cut, _with_offsets(sizes, keys), part)
    lower = F.col("_offset") + F.col("_number") - F.col("_first")
    return placed.withColumn("_lower", lower).drop("_number", "_part", "_part_rows", "_first", "_offset")


def positions_in_group(df: DataFrame, keys: Sequence[str], value: str, tie: str) -> DataFrame:
    """Add ``_position``, the 1-based place by (value, md5 of tie, tie), and ``_group_rows``."""
    hashed = df.withColumn("_tie", F.unhex(F.md5(F.col(tie).cast("string"))))
    placed = with_lower(hashed, keys, [value, "_tie", tie] if tie != value else [value], ["_tie"])
    return placed.withColumn("_position", F.col("_lower") + 1).drop("_lower")


def _changes(table: pa.Table, columns: Sequence[str]) -> np.ndarray:
    """Where a row differs from the one before it in any of the columns; the first row does."""
    found = np.zeros(table.num_rows, bool)
    found[:1] = True
    for c in columns:
        column = table.column(c).combine_chunks()
        if pa.types.is_floating(column.type):
            null, x = column.is_null().to_numpy(zero_copy_only=False), column.fill_null(0.0).to_numpy(zero_copy_only=False)
            same = ((x[1:] == x[:-1]) | (np.isnan(x[1:]) & np.isnan(x[:-1]))) & (null[1:] == null[:-1])
            found[1:] |= ~same
        else:
            codes = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            found[1:] |= codes[1:] != codes[:-1]
    return found


def _runs(keys: Sequence[str], value: str):
    """A pass over sorted rows that adds, inside the partition: ``_lower``, the group's known values below the row's,
    ``_alike``, how many rows share it, and ``_part``. Held at a time: a batch, and the run of equal values at its end."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, below = TaskContext.get().partitionId(), None, 0

        def placed(table: pa.Table, last: bool) -> tuple[pa.Table, pa.Table | None, int]:
            """The rows of the runs that are complete, the rows of the last one, and the values below it."""
            group = _changes(table, keys)
            starts = np.flatnonzero(group | _changes(table, [value]))
            known = table.column(value).is_valid().to_numpy()
            sizes = np.diff(np.append(starts, table.num_rows))
            counted = np.where(known[starts], sizes, 0)
            sofar = np.concatenate(([0], np.cumsum(counted)))[:-1]
            firsts = np.flatnonzero(group[starts])
            base = np.repeat(sofar[firsts], np.diff(np.append(firsts, len(starts))))
            lower = sofar - base
            lower[: firsts[1] if len(firsts) > 1 else len(lower)] += below
            end = table.num_rows if last else int(starts[-1])
            columns = {"_lower": np.repeat(lower, sizes), "_alike": np.repeat(sizes, sizes), "_part": np.full(table.num_rows, part)}
            done = table.slice(0, end)
            for name, values in columns.items():
                done = done.append_column(name, pa.array(values[:end], pa.int64()))
            return done, None if last else table.slice(end), int(lower[-1])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if held is not None:
                ends = pa.concat_tables([held.slice(held.num_rows - 1), rows])
                if not _changes(ends, [*keys, value])[1:].any():
                    held = pa.concat_tables([held, rows])
                    continue
                rows = pa.concat_tables([held, rows])
            done, held, below = placed(rows, False)
            yield from done.combine_chunks().to_batches()
        if held is not None:
            yield from placed(held, True)[0].combine_chunks().to_batches()

    return number


def with_average_rank(df: DataFrame, keys: Sequence[str], value: str, name: str = "_rank") -> DataFrame:
    """Add the 1-based rank of ``value`` with ties averaged, and ``{name}_of``, how many are ranked.

    Equal values are spread by a hash of the other columns, so one that many rows share is cut as well.
    A value on both sides of a cut is counted apart; each cut has one such value at most, so their
    number is below that of the partitions and they are broadcast.
    """
    others = [c for c in df.columns if c not in (*keys, value)]
    spread = df.withColumn("_spread", F.xxhash64(*others))
    added = [T.StructField(c, T.LongType()) for c in ("_lower", "_alike", "_part")]
    rows = _sorted(spread, keys, [value, "_spread"]).drop("_spread")
    cut, part, x = stored(rows.mapInArrow(_runs(keys, value), T.StructType(rows.schema.fields + added))), [*keys, "_part"], F.col(value)
    parts = cut.groupBy(*part).agg(
        F.count(x).alias("_part_rows"), F.min(x).alias("_low"), F.max(x).alias("_high"),
        F.min_by("_alike", x).alias("_low_rows"), F.max_by("_alike", x).alias("_high_rows"),
    )
    parts = _with_offsets(parts, keys).withColumnRenamed("_group_rows", "_ranked")
    end = lambda v, n, lower: F.struct(F.col(v).alias(value), F.col(n).alias("_piece"), lower.alias("_below"))
    low = end("_low", "_low_rows", F.col("_offset"))
    high = end("_high", "_high_rows", F.col("_offset") + F.col("_part_rows") - F.col("_high_rows"))
    ends = parts.select(*keys, F.inline(F.when(F.col("_low") == F.col("_high"), F.array(low)).otherwise(F.array(low, high))))
    # its first partition holds lower values only besides it
    torn = ends.where(x.isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("_pieces"), F.min("_below").alias("_below"), F.sum("_piece").alias("_whole")
    )
    torn = torn.where("_pieces > 1").drop("_pieces")
    placed = join_on(cut, parts.select(*part, "_offset", "_ranked"), part)
    placed = join_on(placed, F.broadcast(torn), [*keys, value], "left")
    rank = F.coalesce(F.col("_below") + (F.col("_whole") + 1) / 2.0, F.col("_offset") + F.col("_lower") + (F.col("_alike") + 1) / 2.0)
    return placed.withColumns({name: F.when(x.isNotNull(), rank), f"{name}_of": F.col("_ranked")}).drop(
        "_part", "_offset", "_lower", "_alike", "_ranked", "_below", "_whole"
    )
