"""Snapshots and daily bars -> bars of every past or present member with a membership flag."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.config import DATE, SYMBOL
from barloom.operators.membership import (
    flag_membership,
    rebalance_intervals,
    resolve_index,
    snapshot_intervals,
)
from barloom.operators.scaling import year_bounds
from barloom.sources.vendors import daily_bars


def _member_bars(
    bars: DataFrame, intervals: DataFrame, first_year: int, last_year: int, column: str
) -> DataFrame:
    """Full history in the year range of every symbol that was ever a member."""
    inside = bars.where(F.col(DATE).between(*year_bounds(first_year, last_year)))
    ever = intervals.select(F.col("symbol").alias(SYMBOL)).distinct()
    return flag_membership(inside.join(ever, SYMBOL, "left_semi"), intervals, column)


def index_panel(
    snapshots: DataFrame,
    bar_parts: Sequence[DataFrame],
    index_name: str,
    first_year: int,
    last_year: int,
) -> DataFrame:
    name, code = resolve_index(snapshots.sparkSession, index_name)
    mine = snapshots.where(F.col("index_code") == code)
    intervals = snapshot_intervals(mine, first_year, last_year)
    return _member_bars(daily_bars(bar_parts), intervals, first_year, last_year, f"in_{name}")


def rebalanced_panel(
    constituents: DataFrame,
    bars: DataFrame,
    first_year: int,
    last_year: int,
    column: str = "in_csi300",
) -> DataFrame:
    """The variant on semi-annual rebalance dates: constituents ``(trade_date, con_code)`` as of each
    rebalance date hold until the next."""
    spans = rebalance_intervals(bars.sparkSession, first_year, last_year)
    # two rows per year
    held = constituents.join(
        F.broadcast(spans), F.col("trade_date") == F.col("start_date")
    ).select(F.col("con_code").alias("symbol"), "start_date", "end_date")
    return _member_bars(bars, held, first_year, last_year, column)
