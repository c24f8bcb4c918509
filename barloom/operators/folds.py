"""Walk-forward splits: folds over a trading calendar that may overlap, purged at their label dates.

A fold is two ranges of trading days, train before test. A sample belongs to a range when its window
ends inside and its label date does not lie behind the range's last day, so nothing that a fold learns
from, or is measured on, reaches into a later range. An embargo keeps days between train and test free.

Samples meet ranges by an equality join on the day: each range is spread over its days, which are
bounded by the calendar, however many samples there are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.samples import one_exchange


@dataclass(frozen=True)
class WalkForward:
    """Lengths in trading days. ``train_days`` of 0 lets every fold learn from the first day on."""

    test_days: int
    step_days: int
    train_days: int = 0
    first_test_day: int | None = None
    embargo_days: int = 0

    def __post_init__(self) -> None:
        if self.test_days < 1 or self.step_days < 1 or self.train_days < 0 or self.embargo_days < 0:
            raise ValueError("test and step need a day at least, train and embargo no negative number of days")
        if self.first_test_day is None:
            if not self.train_days:
                raise ValueError("without train_days the first test day must be named")
            object.__setattr__(self, "first_test_day", self.train_days + self.embargo_days)


def fold_ranges(calendar: DataFrame, plan: WalkForward) -> DataFrame:
    """``fold, role, first_pos, last_pos, first_date, last_date``, two rows per fold.

    ``calendar`` is ``(cal_date, pos)`` of one exchange. The last test range may be shorter than the others.
    """
    days = one_exchange(calendar).select("cal_date", "pos")
    last = days.agg(F.max("pos").alias("last"))
    numbers = F.explode(F.expr(f"sequence(0L, (last - {plan.first_test_day}) div {plan.step_days})"))
    folds = last.where(F.col("last") >= plan.first_test_day).select("last", numbers.alias("fold"))
    test = F.lit(plan.first_test_day) + F.col("fold") * plan.step_days
    train_last = test - 1 - plan.embargo_days
    train_first = F.greatest(train_last - plan.train_days + 1, F.lit(0)) if plan.train_days else F.lit(0)
    ranges = folds.select(
        "fold",
        F.inline(
            F.array(
                F.struct(F.lit("train").alias("role"), train_first.cast("long").alias("first_pos"), train_last.cast("long").alias("last_pos")),
                F.struct(F.lit("test").alias("role"), test.cast("long").alias("first_pos"), F.least(test + plan.test_days - 1, "last").cast("long").alias("last_pos")),
            )
        ),
    ).where("first_pos <= last_pos")
    # one row per trading day on the right
    for end in ("first", "last"):
        ranges = ranges.join(days.select(F.col("pos").alias(f"{end}_pos"), F.col("cal_date").alias(f"{end}_date")), f"{end}_pos")
    return ranges.select("fold", "role", "first_pos", "last_pos", "first_date", "last_date")


def in_folds(
    samples: DataFrame, ranges: DataFrame, calendar: DataFrame, whole_windows: bool = False,
    start: str = "sequence_start_date", end: str = "sequence_end_date", label: str = "label_date",
) -> DataFrame:
    """Every sample once for each range that it belongs to, with ``fold`` and ``role``.

    ``whole_windows`` also wants the window's first day in the range. Samples with a date that is no trading
    day, or without one, belong to no range.
    """
    days = calendar.select("cal_date", "pos")
    placed = samples
    for column, name in ((end, "_end_pos"), (label, "_label_pos"), *([(start, "_start_pos")] if whole_windows else ())):
        placed = placed.join(days.select(F.col("cal_date").alias(column), F.col("pos").alias(name)), column)
    spread = ranges.select("fold", "role", "first_pos", "last_pos", F.explode(F.sequence("first_pos", "last_pos")).alias("_end_pos"))
    inside = placed.join(spread, "_end_pos").where("_label_pos <= last_pos")
    if whole_windows:
        inside = inside.where("_start_pos >= first_pos")
    return inside.select(*samples.columns, "fold", "role")


def split_summary(samples: DataFrame, *by: str, end: str = "sequence_end_date", label: str = "label_date") -> DataFrame:
    """Samples, range of end dates and last label date of each split or fold."""
    return samples.groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"), F.min(end).alias("first_date"), F.max(end).alias("last_date"), F.max(label).alias("last_label_date")
    )
