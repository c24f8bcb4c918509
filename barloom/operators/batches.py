"""Batch plans: every batch holds samples of one label date.

The shuffled order of samples and dates is a hash of (seed, epoch, key), so it is reproducible and
any task can compute it; without shuffling, samples keep the order of their id. ``ranking`` numbers
the samples of a date by either order, spread over tasks however many they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.staging import stored
from barloom.operators.ranking import join_on, with_lower


def _shuffled(seed: int, epoch: int, key: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), F.col(key).cast("string")))


def numbered_in_date(samples: DataFrame, order: Column | None = None, sample_id: str = "sample_id") -> DataFrame:
    """Add ``n_in_date``, 0-based by (order, sample id) or by the sample id alone, and ``date_size``.

    ``samples`` are read twice, so they should be stored.
    """
    if order is None:
        placed = with_lower(samples, ["label_date"], [sample_id])
    else:
        placed = with_lower(samples.withColumn("_order", order), ["label_date"], ["_order", sample_id], ["_order"])
    return placed.withColumnsRenamed({"_lower": "n_in_date", "_group_rows": "date_size"})


def _batch_count(size: Column, batch_size: int, drop_last: bool) -> Column:
    whole = F.floor if drop_last else F.ceil
    return whole(size / F.lit(batch_size)).cast("long")


def date_batches(
    samples: DataFrame,
    batch_size: int,
    shuffle: bool = True,
    drop_last: bool = False,
    seed: int = 42,
    epoch: int = 0,
) -> DataFrame:
    """(sample_id, label_date, batch_in_date, slot); short batches are dropped on request."""
    if batch_size <= 0:
        raise ValueError(f"batches of {batch_size} samples")
    return _date_plan(stored(samples.select("sample_id", "label_date")), batch_size, shuffle, drop_last, seed, epoch)


def _date_plan(samples: DataFrame, batch_size: int, shuffle: bool, drop_last: bool, seed: int, epoch: int) -> DataFrame:
    """The date batches of stored samples."""
    rows = numbered_in_date(samples, _shuffled(seed, epoch, "sample_id") if shuffle else None)
    plan = rows.select(
        "sample_id",
        "label_date",
        F.floor(F.col("n_in_date") / batch_size).cast("long").alias("batch_in_date"),
        F.pmod("n_in_date", F.lit(batch_size)).cast("int").alias("slot"),
        "date_size",
    )
    plan = plan.where(F.col("batch_in_date") < _batch_count(F.col("date_size"), batch_size, drop_last))
    return plan.drop("date_size")


def batch_count(samples: DataFrame, batch_size: int, drop_last: bool = False) -> DataFrame:
    sizes = samples.groupBy("label_date").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum(_batch_count(F.col("n"), batch_size, drop_last))
    return sizes.agg(F.coalesce(total, F.lit(0)).alias("batches"))


def rank_batches(
    samples: DataFrame,
    batch_size: int,
    world_size: int,
    shuffle: bool = True,
    drop_last: bool = False,
    seed: int = 42,
    epoch: int = 0,
) -> DataFrame:
    """(rank, step, sample_id, label_date, slot): the date batches dealt round-robin to the ranks.

    All ranks get the same number of steps: the surplus is cut with ``drop_last``, otherwise the
    first batches are repeated.
    """
    if world_size <= 0:
        raise ValueError(f"batches for {world_size} ranks")
    if batch_size <= 0:
        raise ValueError(f"batches of {batch_size} samples")
    samples = stored(samples.select("sample_id", "label_date"))
    plan = _date_plan(samples, batch_size, shuffle, drop_last, seed, epoch)
    sizes = samples.groupBy("label_date").agg(F.count(F.lit(1)).alias("n"))
    turn = _shuffled(seed, epoch, "label_date") if shuffle else F.col("label_date").cast("string")
    # one row per label date from here to the join: bounded by the calendar
    order = Window.orderBy("_turn", "label_date")
    dates = sizes.select(
        "label_date", turn.alias("_turn"), _batch_count(F.col("n"), batch_size, drop_last).alias("_batches")
    )
    dates = dates.select(
        "label_date",
        (F.sum("_batches").over(order) - F.col("_batches")).alias("_first"),
        F.sum("_batches").over(Window.partitionBy()).alias("_total"),
    )
    dealt = join_on(plan, dates, ["label_date"]).withColumn(
        "_number", F.col("_first") + F.col("batch_in_date")
    )
    full_rounds = F.floor(F.col("_total") / world_size) * world_size
    if drop_last:
        dealt = dealt.where(F.col("_number") < full_rounds)
    else:
        padding = F.pmod(-F.col("_total"), F.lit(world_size))
        copies = F.when(
            F.col("_number") < padding, F.array(F.col("_number"), F.col("_number") + F.col("_total"))
        ).otherwise(F.array(F.col("_number")))
        dealt = dealt.withColumn("_number", F.explode(copies))
    return dealt.select(
        F.pmod("_number", F.lit(world_size)).cast("int").alias("rank"),
        F.floor(F.col("_number") / world_size).cast("long").alias("step"),
        "sample_id",
        "label_date",
        "slot",
    )
