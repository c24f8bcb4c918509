"""Market states of an index series, and scores of predictions by year and state.

A state holds for an island: a run of dates with the same label. Dates of scores look up the island that
began last, by a running value over both tables put together, not by comparing every date with every island.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.config import DATE
from barloom.operators.scoring import DAY

INDEX = "index_code"


def index_returns(panel: DataFrame, ret: str = "ret_1", code: str = "ALL") -> DataFrame:
    """``index_code, date, ret``: the equally weighted return of all symbols."""
    return panel.groupBy(DATE).agg(F.avg(ret).alias("ret")).select(F.lit(code).alias(INDEX), DATE, "ret")


def market_states(index: DataFrame, days: int = 20, band: float = 0.0) -> DataFrame:
    """``index_code, island, state, first_date, last_date, days``: runs of ``up``, ``down`` and ``flat``.

    A date's label is the sign of the mean return of the last ``days`` dates, ``flat`` within ``band`` of zero; dates
    before the first full window have none. Rows per index are bounded by the calendar.
    """
    order = Window.partitionBy(INDEX).orderBy(DATE)
    recent = order.rowsBetween(1 - days, 0)
    mean = F.when(F.count("ret").over(recent) >= days, F.avg("ret").over(recent))
    label = F.when(mean > band, "up").when(mean < -band, "down").when(mean.isNotNull(), "flat")
    labelled = index.withColumn("state", label).where("state is not null")
    begins = F.coalesce((F.col("state") != F.lag("state").over(order)).cast("long"), F.lit(1))
    runs = labelled.withColumn("_begins", begins)
    runs = runs.withColumn("island", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(INDEX, "island").agg(
        F.first("state").alias("state"), F.min(DATE).alias("first_date"), F.max(DATE).alias("last_date"), F.count(F.lit(1)).alias("days")
    )


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, value: Sequence[str]) -> DataFrame:
    """``left`` with the ``value`` columns of the last row of ``right`` at or before its time, null where there is none.

    Both sides go through one exchange on the keys; right rows stand before left rows of the same time. Repeated
    times on the right go to the largest values.
    """
    held = F.struct(*value)
    both = left.select(*[F.col(k) for k in keys], F.col(left_time).alias("_time"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(held.alias("v")).schema["v"].dataType).alias("_held")).unionByName(
        right.select(*[F.col(k) for k in keys], F.col(right_time).alias("_time"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("r")).schema["r"].dataType).alias("_row"), held.alias("_held"))
    )
    order = Window.partitionBy(*keys).orderBy("_time", "_side", "_held").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_last", F.last("_held", ignorenulls=True).over(order)).where("_side = 1")
    return found.select("_row.*", *[F.col("_last")[c].alias(c) for c in value])


def scores_by_state(days: DataFrame, states: DataFrame, code: str = "ALL") -> DataFrame:
    """``year, state, days, ic, ic_std, rank_ic, rank_ic_std, rank_ic_positive`` of daily scores.

    One row per year, per state, per both and for all, with null where a column is summed over; ``none`` is the state
    of dates before the first. ``days`` has ``label_date, ic, rank_ic``. One aggregate with grouping sets.
    """
    dated = as_of(days.withColumn(INDEX, F.lit(code)), states, [INDEX], DAY, "first_date", ["state"])
    rows = dated.select(F.year(DAY).alias("year"), F.coalesce("state", F.lit("none")).alias("state"), "ic", "rank_ic")
    sets = [[F.col("year"), F.col("state")], [F.col("year")], [F.col("state")], []]
    return rows.groupingSets(sets, "year", "state").agg(
        F.count(F.lit(1)).alias("days"), F.avg("ic").alias("ic"), F.stddev_pop("ic").alias("ic_std"),
        F.avg("rank_ic").alias("rank_ic"), F.stddev_pop("rank_ic").alias("rank_ic_std"),
        F.avg((F.col("rank_ic") > 0).cast("double")).alias("rank_ic_positive"),
    )
